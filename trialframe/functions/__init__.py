from .normal import add_normal_quantile, chi2_sf, normal_sf, normal_two_sided
from .scalar import inhibition, log10_or_null, ratio, safe_sqrt, star_code
from .tails import f_sf, t_quantile, t_two_sided, with_p_value

__all__ = [
    "add_normal_quantile",
    "chi2_sf",
    "f_sf",
    "inhibition",
    "log10_or_null",
    "normal_sf",
    "normal_two_sided",
    "ratio",
    "safe_sqrt",
    "star_code",
    "t_quantile",
    "t_two_sided",
    "with_p_value",
]
