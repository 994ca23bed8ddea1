"""Inputs at the edges of the operators: tails that cancel, missing ratings, zero maxima, perfect correlation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.functions.tails import exact_rank_sum, f_tail, f_tails, t_point, t_tail, t_tails, with_p_value

from trialframe import operators as op


def test_upper_rank_sum_tail_keeps_its_digits():
    assert math.isclose(exact_rank_sum(49 * 49, 49, 49), 2 / math.comb(98, 49), rel_tol=1e-9)
    for w in (0, 300, 1200, 1201, 2101, 2401):
        assert math.isclose(exact_rank_sum(w, 49, 49), exact_rank_sum(2401 - w, 49, 49), rel_tol=1e-12)


def test_severity_with_a_missing_count_is_null_in_both_forms(table):
    df = table([("a", 0.0, 2.0), ("a", 4.0, None), ("a", 2.0, 2.0), ("b", 1.0, 2.0)], "k string, s double, c double")
    assert {r.k: r.dis_sev for r in op.severity_index(df, ["k"], "s", "c").collect()} == {"a": None, "b": 100.0}
    assert {(r.k, r.dis_sev) for r in op.severity_window(df, ["k"], "s", "c").collect()} == {("a", None), ("b", 100.0)}


def test_perfect_correlation_has_p_zero(table):
    df = table([(float(k), 2.0 * k) for k in range(6)], "x double, y double")
    r = op.pearson(df, [], "x", "y").first()
    assert math.isclose(r.r, 1.0) and r.p < 1e-30


def test_small_untied_rank_sums_through_the_table(table):
    """W above its centre reached the exact table with sizes as doubles."""
    df = table([("a", float(k + 5)) for k in range(5)] + [("b", float(k)) for k in range(5)], "g string, v double")
    r = op.pairwise_ranksum(df, [], "g", "v").first()
    assert (r.w, r.p) == (25.0, pytest.approx(2 / 252, rel=1e-12))
    whole = op.compare_means(df, [], "g", "v", ref="a").collect()
    assert [x.p for x in whole] == [pytest.approx(2 / 252, rel=1e-12)] * 2
    rough = op.compare_means(df, [], "g", "v", ref="a", exact=False).collect()
    assert all(abs(x.p - 2 / 252) > 1e-3 for x in rough)


def test_published_rank_sum_points():
    """Greatest W with two-sided probability of at most 0.05, from the published small tables."""
    critical = {(4, 4): 0, (5, 5): 2, (6, 6): 5, (7, 7): 8, (8, 8): 13, (5, 8): 6, (10, 10): 23, (20, 20): 127}
    for (n1, n2), w in critical.items():
        assert exact_rank_sum(w, n1, n2) <= 0.05 < exact_rank_sum(w + 1, n1, n2)


@pytest.mark.parametrize("df2", [10.0**k for k in range(2, 16)])
def test_f_tail_at_any_degrees_of_freedom(df2):
    """With two degrees of freedom on top the tail has a closed form."""
    for f in (1e-6, 0.3, 1.0, 1.7, 40.0):
        assert f_tail(f, 2, df2) == pytest.approx(math.exp(-df2 / 2 * math.log1p(2 * f / df2)), rel=1e-11)
    assert f_tail(2.0, 4, df2) == pytest.approx(math.exp(-4) * 5, rel=1e-9 + 10 / df2)
    assert t_point(1 - t_tail(2.5, df2) / 2, df2) == pytest.approx(2.5, rel=1e-10)


def test_f_tail_with_two_on_the_bottom_and_cauchy_tail():
    df1 = np.array([0.5, 1, 3, 1e3, 1e9, 1e15])
    for f in (0.2, 1.0, 9.0, 1e6):
        lower = np.exp(-df1 / 2 * np.log1p(2 / (df1 * f)))
        np.testing.assert_allclose(f_tails(f, df1, 2.0), -np.expm1(-df1 / 2 * np.log1p(2 / (df1 * f))), rtol=1e-10)
        np.testing.assert_allclose(1 - f_tails(f, df1, 2.0), lower, atol=1e-12)
    t = np.array([1e-3, 0.7, 5.0, 1e8, 1e150])
    np.testing.assert_allclose(t_tails(t, 1.0), 2 / math.pi * np.arctan(1 / t), rtol=1e-11)


def test_tails_of_a_whole_column(table):
    df = table([(2.0, 4, 10**13), (None, 4, 10), (float("nan"), 4, 10), (2.0, 0, 10)], "f double, a long, b long")
    p = [r.p for r in with_p_value(df, "f", "f", "a", "b").collect()]
    assert p[0] == pytest.approx(math.exp(-4) * 5, rel=1e-9) and p[1:] == [None, None, None]
    assert with_p_value(df.filter(F.lit(False)), "f", "f", "a", "b").collect() == []


def test_rank_sum_plan_does_not_grow_with_the_levels(spark):
    sizes = []
    for levels in (5, 200):
        df = spark.range(400).selectExpr(f"concat('g', id % {levels}) AS g", "double(id * 7919 % 400) AS v")
        pairs = op.pairwise_ranksum(df, [], "g", "v", adjust="none")
        sizes.append(len(pairs._jdf.queryExecution().analyzed().toString().splitlines()))
        if levels == 200:
            rows = {(r.g1, r.g2): r for r in pairs.collect()}
            assert len(rows) == 200 * 199 // 2 and all(r.n1 == r.n2 == 2 and 0 <= r.w <= 4 and r.p is not None for r in rows.values())
    assert sizes[0] == sizes[1]
