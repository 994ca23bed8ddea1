"""Normal and chi-square tails and the normal quantile as SQL expressions.

Spark has no error function. These expressions stay on the JVM and inside
whole-stage code generation, so they may also be used on row-sized data. They
take column names, not expressions: the argument occurs many times in the
formula and should be computed once, in a column of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rational approximations of the normal distribution function
# (W. J. Cody, Math. Comp. 23, 1969), lowest power first.
CENTRE_TOP = [
    18154.981253343561249, 1067.6894854603709582, 161.02823106855587881,
    2.2352520354606839287, 0.065682337918207449113,
]
CENTRE_BOTTOM = [
    45507.789335026729956, 10260.932208618978205, 976.09855173777669322, 47.20258190468824187, 1.0,
]
TAIL_TOP = [
    9842.7148383839780218, 11602.651437647350124, 6848.1904505362823326, 2494.5375852903726711,
    597.27027639480026226, 93.506656132177855979, 8.8831497943883759412, 0.39894151208813466764,
    1.0765576773720192317e-8,
]
TAIL_BOTTOM = [
    19685.429676859990727, 38912.003286093271411, 34900.952721145977266, 18615.571640885098091,
    6485.558298266760755, 1519.377599407554805, 235.38790178262499861, 22.266688044328115691, 1.0,
]
# Quantile of the normal distribution (algorithm AS 241, M. J. Wichura,
# Applied Statistics 37, 1988), lowest power first.
MID_TOP = [
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
]
MID_BOTTOM = [
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
]
NEAR_TOP = [
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
    1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
]
NEAR_BOTTOM = [
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
]
FAR_TOP = [
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
    2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
]
FAR_BOTTOM = [
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
]

_CENTRE_LIMIT = 0.67448975
_TAIL_LIMIT = math.sqrt(32.0)
_HALF_LOG_PI = math.log(math.sqrt(math.pi) / 2.0)


def polynomial(coefficients: list[float], x: str) -> str:
    """SQL text of a polynomial, lowest power first."""
    out = f"{coefficients[-1]!r}D"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c!r}D)"
    return out


def _upper_tail(x: str) -> str:
    """SQL text of the upper normal tail at a non-negative x."""
    square = f"({x} * {x})"
    centre = f"0.5D - {x} * {polynomial(CENTRE_TOP, square)} / {polynomial(CENTRE_BOTTOM, square)}"
    tail = f"exp(-0.5D * {square}) * {polynomial(TAIL_TOP, x)} / {polynomial(TAIL_BOTTOM, x)}"
    fraction = x
    for k in range(16, 0, -1):
        fraction = f"({x} + {k}.0D / {fraction})"
    far = f"exp(-0.5D * {square}) / {math.sqrt(2.0 * math.pi)!r}D / {fraction}"
    return (
        f"CASE WHEN {x} <= {_CENTRE_LIMIT}D THEN {centre} "
        f"WHEN {x} <= {_TAIL_LIMIT!r}D THEN {tail} WHEN {x} IS NOT NULL THEN {far} END"
    )


def normal_sf(z: str) -> Column:
    """Upper tail probability of the standard normal at column `z`."""
    upper = _upper_tail(f"abs({z})")
    return F.expr(f"CASE WHEN {z} >= 0 THEN {upper} ELSE 1.0D - ({upper}) END")


def normal_two_sided(z: str) -> Column:
    return F.expr(f"2.0D * ({_upper_tail(f'abs({z})')})")


def add_normal_quantile(df: DataFrame, p: str, out: str) -> DataFrame:
    """Add the standard normal quantile of column `p`; NULL outside 0 < p < 1."""
    inside = F.expr(f"CASE WHEN {p} > 0 AND {p} < 1 THEN least({p}, 1.0D - {p}) END")
    df = df.withColumn("_root", F.sqrt(-F.ln(inside)))
    q, near, far = f"({p} - 0.5D)", "(_root - 1.6D)", "(_root - 5.0D)"
    r = f"(0.180625D - {q} * {q})"
    mid = f"{q} * {polynomial(MID_TOP, r)} / {polynomial(MID_BOTTOM, r)}"
    outer = (
        f"signum({q}) * CASE WHEN _root <= 5.0D THEN {polynomial(NEAR_TOP, near)} / {polynomial(NEAR_BOTTOM, near)} "
        f"ELSE {polynomial(FAR_TOP, far)} / {polynomial(FAR_BOTTOM, far)} END"
    )
    value = f"CASE WHEN _root IS NULL THEN NULL WHEN abs({q}) <= 0.425D THEN {mid} ELSE {outer} END"
    return df.withColumn(out, F.expr(value)).drop("_root")


def chi2_sf(x: str, df: str) -> Column:
    """Upper tail of chi-square at column `x` with an integer column `df` of degrees of freedom.

    A finite sum whose terms are carried as logarithms, so that neither a large
    statistic nor many degrees of freedom underflows part-way. Odd `df` starts
    from a normal tail, even `df` from nothing.
    """
    odd = f"({df} % 2 = 1)"
    half = f"({x} / 2.0D)"
    start = f"IF({odd}, 2.0D * ({_upper_tail(f'sqrt({x})')}), 0.0D)"
    first = f"IF({odd}, 0.5D * ln({half}) - {_HALF_LOG_PI!r}D, 0.0D)"
    terms = f"int({df} / 2)"
    total = (
        f"aggregate(sequence(1, greatest({terms}, 1)), named_struct('sum', {start}, 'term', {first}), "
        f"(acc, i) -> named_struct("
        f"'sum', acc.sum + IF(i <= {terms}, exp(acc.term - {half}), 0.0D), "
        f"'term', acc.term + ln({half}) - ln(i + IF({odd}, 0.5D, 0.0D))), acc -> acc.sum)"
    )
    return F.expr(
        f"CASE WHEN {x} IS NULL OR {df} < 1 THEN NULL WHEN {x} <= 0 THEN 1.0D ELSE least(1.0D, {total}) END"
    )
