import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.functions import (
    add_normal_quantile,
    chi2_sf,
    inhibition,
    log10_or_null,
    normal_sf,
    ratio,
    safe_sqrt,
    star_code,
    with_p_value,
)
from trialframe.functions.tails import beta_cdf, exact_rank_sum, f_tail, t_point, t_tail


def test_normal_tail_matches_erfc(table):
    zs = [-8.0, -3.0, -0.7, -0.6, 0.0, 0.3, 0.6744, 0.68, 1.96, 5.0, 5.66, 9.0, 20.0]
    got = table([(z,) for z in zs], "z double").select("z", normal_sf("z").alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)), rel=1e-12)


def test_normal_quantile_matches_stdlib(table):
    ps = [1e-300, 1e-12, 0.001, 0.07, 0.075, 0.2, 0.5, 0.9, 0.925, 0.999999]
    got = add_normal_quantile(table([(p,) for p in [*ps, 0.0, 1.0]], "p double"), "p", "q").collect()
    for r in got:
        if r.p in (0.0, 1.0):
            assert r.q is None
        else:
            assert r.q == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-12, abs=1e-14)


def test_chi2_tail(table):
    cases = [(0.0, 3), (0.5, 1), (3.84, 1), (5.99, 2), (11.07, 5), (40.0, 10), (30000.0, 30000), (900.0, 1000)]
    got = table(cases, "x double, df int").select("x", "df", chi2_sf("x", "df").alias("p")).collect()
    by = {(r.x, r.df): r.p for r in got}
    assert by[0.0, 3] == 1.0
    assert by[0.5, 1] == pytest.approx(math.erfc(math.sqrt(0.25)), rel=1e-12)
    assert by[3.84, 1] == pytest.approx(math.erfc(math.sqrt(1.92)), rel=1e-12)
    assert by[5.99, 2] == pytest.approx(math.exp(-5.99 / 2), rel=1e-12)
    assert by[11.07, 5] == pytest.approx(0.050009, abs=2e-6)
    poisson = sum(math.exp(-20 + i * math.log(20) - math.lgamma(i + 1)) for i in range(5))
    assert by[40.0, 10] == pytest.approx(poisson, rel=1e-12)
    assert by[30000.0, 30000] == pytest.approx(0.498914, abs=1e-4)
    assert 0.98 < by[900.0, 1000] < 1.0


def test_f_and_t_tails():
    assert f_tail(4.0, 2, 10) == pytest.approx((1 + 2 * 4.0 / 10) ** -5, rel=1e-12)
    assert t_tail(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-9)
    assert t_point(0.975, 10) == pytest.approx(2.2281388519649385, rel=1e-10)
    assert t_tail(1.0, 1) == pytest.approx(0.5, rel=1e-12)
    assert f_tail(float("nan"), 2, 10) is None and f_tail(3.0, 0, 10) is None
    assert beta_cdf(2, 3, 0.0) == 0.0 and beta_cdf(2, 3, 1.0) == 1.0


def test_exact_rank_sum_against_enumeration():
    from itertools import combinations

    for n1, n2 in [(3, 3), (4, 2), (5, 4), (1, 6)]:
        stats = []
        for chosen in combinations(range(n1 + n2), n1):
            stats.append(sum(chosen) - n1 * (n1 - 1) / 2)
        stats = np.array(stats)
        for w in range(n1 * n2 + 1):
            low, high = np.mean(stats <= w), np.mean(stats >= w)
            assert exact_rank_sum(w, n1, n2) == pytest.approx(min(1.0, 2 * min(low, high)))


def test_p_value_column(table):
    t = table([(1.96, 4, 20)], "s double, a int, b int")
    assert with_p_value(t, "normal", "s").first().p == pytest.approx(0.04999579, abs=1e-8)
    assert with_p_value(t, "chi2", "s", "a").first().p == pytest.approx(math.exp(-0.98) * 1.98, rel=1e-10)
    assert with_p_value(t, "t", "s", "b").first().p == pytest.approx(0.0640, abs=2e-4)
    assert with_p_value(t, "f", "s", "a", "b").first().p == pytest.approx(f_tail(1.96, 4, 20))
    with pytest.raises(ValueError):
        with_p_value(t, "gamma", "s")


def test_null_rules(table):
    t = table([(0.0,), (-4.0,), (9.0,), (None,)], "x double")
    got = t.select(
        log10_or_null(F.col("x")).alias("l"),
        log10_or_null(F.col("x"), 1.0).alias("l1"),
        safe_sqrt(F.col("x")).alias("r"),
        ratio(F.lit(1.0), F.col("x")).alias("d"),
        inhibition(F.col("x"), F.lit(0.0)).alias("i"),
    ).collect()
    assert [r.l is None for r in got] == [True, True, False, True]
    assert got[0].l1 == 0.0 and got[1].l1 is None
    assert [r.r for r in got] == [0.0, None, 3.0, None]
    assert got[0].d is None and got[3].d is None
    assert all(r.i is None for r in got)


def test_star_ladder(table):
    ps = [0.00005, 0.0005, 0.005, 0.05, 0.06, None]
    got = [r.s for r in table([(p,) for p in ps], "p double").select(star_code(F.col("p")).alias("s")).collect()]
    assert got == ["****", "***", "**", "*", "ns", None]
