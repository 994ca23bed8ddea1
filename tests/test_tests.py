"""Rank tests, linear models and distribution checks against direct formulas."""

import math
import random
from statistics import NormalDist

import brute
import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from trialframe import operators as op

RNG = np.random.default_rng(7)
GROUPS = {
    "a": np.round(RNG.normal(10, 3, 61)),
    "b": np.round(RNG.normal(12, 3, 55)),
    "c": np.round(RNG.normal(9, 2, 70)),
    "d": np.round(RNG.normal(10, 5, 53)),
}


def long(groups, slice_="s"):
    return [(slice_, g, float(v)) for g, vs in groups.items() for v in vs]


SCHEMA = "s string, g string, v double"


@pytest.fixture
def two_slices(table):
    shifted = {k: v * 2 + 1 for k, v in GROUPS.items() if k != "d"}
    extra = [("s", "a", None), ("s", None, 3.0), ("s", "b", float("nan"))]
    return table([*long(GROUPS), *long(shifted, "t"), *extra], SCHEMA), {"s": GROUPS, "t": shifted}


def check_rank_tests(two_slices):
    df, data = two_slices
    for r in op.kruskal(df, "s", "g", "v").collect():
        want = brute.kruskal(data[r.s])
        assert r.statistic == pytest.approx(want) and r.df == len(data[r.s]) - 1
        assert r.n == sum(map(len, data[r.s].values()))
    for name, table in [("dunn", op.dunn(df, "s", "g", "v")), ("pair", op.pairwise_ranksum(df, "s", "g", "v", block=2))]:
        got = rows(table, "s", "g1", "g2")
        assert len(got) == 6 + 3
        for s in data:
            part = [r for r in got if r["s"] == s]
            for r in part:
                if name == "dunn":
                    z = brute.dunn(data[s])[r["g1"], r["g2"]]
                else:
                    w, z = brute.rank_sum(data[s][r["g1"]], data[s][r["g2"]])
                    assert r["w"] == pytest.approx(w)
                assert r["z"] == pytest.approx(z) and r["p"] == pytest.approx(brute.normal2(z))
            assert [r["p_adj"] for r in part] == pytest.approx(list(brute.bh([r["p"] for r in part])))
    for r in op.stars_vs_reference(df, "s", "g", "v", "c").collect():
        w, z = brute.rank_sum(data[r.s]["c"], data[r.s][r.g2])
        assert (r.g1, r.w) == ("c", pytest.approx(w)) and r.z == pytest.approx(z)
    assert op.stars_vs_reference(df, "s", "g", "v", "d").filter("s = 't'").count() == 0


def test_rank_tests_small_path(two_slices):
    check_rank_tests(two_slices)


def test_rank_tests_staged_path(two_slices, staged_path):
    check_rank_tests(two_slices)


def check_order_statistics(df, data):
    every = {s: np.concatenate(list(g.values())) for s, g in data.items()}
    got = {r.s: r for r in op.quantiles(df.filter("g IS NOT NULL"), "s", "v", {"q1": 0.25, "q9": 0.9}).collect()}
    for s, x in every.items():
        assert got[s].q1 == pytest.approx(np.quantile(x, 0.25)) and got[s].q9 == pytest.approx(np.quantile(x, 0.9))
    for r in op.midrank(df.filter("g IS NOT NULL"), "s", "v").collect():
        assert r.midrank == brute.midranks(every[r.s])[list(every[r.s]).index(r.v)]
    points = op.order_index(df.filter("g IS NOT NULL"), "s", "v", block=4).collect()
    for s, x in every.items():
        mine = sorted((r.i, r.v) for r in points if r.s == s)
        assert [i for i, _ in mine] == list(range(1, len(x) + 1)) and [v for _, v in mine] == sorted(x)
    for r in op.describe(df.filter("g IS NOT NULL"), "s", "v").collect():
        x = np.sort(every[r.s])
        n, cut = len(x), int(len(x) * 0.1)
        m = x - x.mean()
        g1, g2 = np.mean(m**3) / np.mean(m**2) ** 1.5, np.mean(m**4) / np.mean(m**2) ** 2 - 3
        assert r.n == n and r.median == np.median(x) and r.trimmed == pytest.approx(x[cut:n - cut].mean())
        assert r.mad == pytest.approx(1.4826 * np.median(np.abs(x - np.median(x))))
        assert r.skew == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2))
        assert r.kurtosis == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
        assert r.se == pytest.approx(x.std(ddof=1) / math.sqrt(n)) and r.range == x.max() - x.min()
    for r in op.box_data(df.filter("g IS NOT NULL"), "s", "v").collect():
        x = every[r.s]
        q1, q3 = np.quantile(x, [0.25, 0.75])
        inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
        assert (r.lower, r.upper, r.outliers) == (inside.min(), inside.max(), len(x) - len(inside))
    out = op.identify_outliers(df.filter("g IS NOT NULL"), "s", "v")
    for s, x in every.items():
        q1, q3 = np.quantile(x, [0.25, 0.75])
        want = np.sum((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1)))
        assert out.filter(F.col("s") == s).count() == want
    for r in op.levene(df, "s", "g", "v").collect():
        dist = {k: np.abs(v - np.median(v)) for k, v in data[r.s].items()}
        x = np.concatenate(list(dist.values()))
        ssb = sum(len(d) * (d.mean() - x.mean()) ** 2 for d in dist.values())
        ssw = sum(np.sum((d - d.mean()) ** 2) for d in dist.values())
        assert r.f == pytest.approx(ssb / (len(dist) - 1) / (ssw / (len(x) - len(dist))))


def test_order_statistics_small_path(two_slices):
    check_order_statistics(*two_slices)


def test_order_statistics_staged_path(two_slices, staged_path):
    check_order_statistics(*two_slices)


def test_exact_rank_sum_for_small_untied_groups(table):
    df = table([("s", "a", 1.0), ("s", "a", 2.0), ("s", "a", 3.0), ("s", "b", 4.0), ("s", "b", 5.0), ("s", "b", 6.0)], SCHEMA)
    assert op.pairwise_ranksum(df, "s", "g", "v").first().p == pytest.approx(0.1)
    approximate = op.pairwise_ranksum(df, "s", "g", "v", exact=False).first()
    assert approximate.p == pytest.approx(brute.normal2(brute.rank_sum(np.arange(3), np.arange(3, 6))[1]))


def test_degenerate_groups(table):
    equal = table([("s", "a", 1.0), ("s", "a", 1.0), ("s", "b", 1.0), ("t", "a", 2.0)], SCHEMA)
    got = {r.s: r for r in op.kruskal(equal, "s", "g", "v").collect()}
    assert got["s"].statistic is None and got["s"].p is None and got["t"].p is None
    assert [r.p for r in op.pairwise_ranksum(equal, "s", "g", "v").collect()] == [None]
    assert [r.p_adj for r in op.dunn(equal, "s", "g", "v").collect()] == [None]
    aov = {r.s: r for r in op.anova_oneway(equal, "s", "g", "v").collect()}
    assert aov["s"].f is None and aov["t"].f is None
    assert {r.s: r.f for r in op.levene(equal, "s", "g", "v").collect()} == {"s": None, "t": None}
    shape = {r.s: r for r in op.shape_stats(equal, "s", "v").collect()}
    assert shape["s"].skew is None and shape["t"].kurtosis is None


def test_omnibus_with_two_groups_is_rank_sum(table):
    two = {k: GROUPS[k] for k in "ab"}
    r = op.omnibus(table(long(two), SCHEMA), "s", "g", "v").first()
    assert r.method == "rank-sum"
    assert r.p == pytest.approx(brute.normal2(brute.rank_sum(two["a"], two["b"])[1]))
    small = [("s", "a", 1.0), ("s", "a", 2.0), ("s", "a", 3.0), ("s", "b", 4.0), ("s", "b", 5.0), ("s", "b", 6.0)]
    assert op.omnibus(table(small, SCHEMA), "s", "g", "v").first().p == pytest.approx(0.1)


def test_oneway_splits_total(two_slices):
    df, data = two_slices
    for r in op.anova_oneway(df, "s", "g", "v").collect():
        x = np.concatenate(list(data[r.s].values()))
        assert r.ss_group + r.ss_resid == pytest.approx(np.sum((x - x.mean()) ** 2))
        assert r.f == pytest.approx(r.ms_group / r.ms_resid) and r.df_resid == len(x) - len(data[r.s])


def test_factorial_with_an_empty_cell(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame(
        [
            (t, p, d, float(rng.normal(ord(t) % 7 + (d == "7") * 2)))
            for t in "ABCD" for p in "xy" for d in "47" for _ in range(rng.integers(2, 6))
            if not (t == "C" and p == "x") and not (t == "D" and p == "y")
        ],
        columns=["treatment", "pathogen", "dpi", "v"],
    )
    factors = ["treatment", "pathogen", "dpi"]
    got = op.anova_factorial(spark.createDataFrame(frame), [], factors, "v").orderBy("term_ord").collect()
    want = brute.sequential_ss(frame, factors, "v")
    assert [(r.term, r.df) for r in got] == [(t, d) for t, d, _ in want]
    assert [r.ss for r in got] == pytest.approx([s for _, _, s in want], abs=1e-8)
    ends = op.anova_first_and_residual(spark.createDataFrame(frame), [], factors, "v").first()
    assert ends.ss_first == pytest.approx(want[0][2]) and ends.ss_resid == pytest.approx(want[-1][2])


def test_factorial_without_residual(table):
    cells = table([(a, b, float(i)) for i, (a, b) in enumerate([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")])],
                  "t string, p string, v double")
    assert [r.f for r in op.anova_factorial(cells, [], ["t", "p"], "v").collect()] == [None] * 4
    twice = cells.union(cells)  # constant inside each cell
    assert [r.f for r in op.anova_factorial(twice, [], ["t", "p"], "v").collect()] == [None] * 4


def test_residuals(two_slices):
    df, data = two_slices
    got = op.residuals(df, "s", "g", "v")
    for r in got.groupBy("s", "g").agg(F.avg("residual").alias("m"), F.first("fitted").alias("f")).collect():
        assert r.m == pytest.approx(0, abs=1e-9) and r.f == pytest.approx(data[r.s][r.g].mean())
    s = np.concatenate([v - v.mean() for v in GROUPS.values()])
    noise = math.sqrt(np.sum(s**2) / (len(s) - len(GROUPS)))
    one = got.filter("s = 's' AND g = 'a'").first()
    assert one.std_residual == pytest.approx(one.residual / (noise * math.sqrt(1 - 1 / len(GROUPS["a"]))))


def test_line_and_correlation(spark):
    x = np.array([1.0, 2, 3, 4, 5, 6, 7])
    y = np.array([2.1, 3.9, 6.2, 7.8, 10.1, 12.2, 13.7])
    df = spark.createDataFrame(pd.DataFrame({"x": [*x, None], "y": [*y, 1.0]}))
    line = op.ols_line(df, [], "x", "y").first()
    slope, intercept = np.polyfit(x, y, 1)
    s = math.sqrt(np.sum((y - slope * x - intercept) ** 2) / 5)
    assert (line.n, line.slope, line.intercept) == (7, pytest.approx(slope), pytest.approx(intercept))
    assert line.resid_sd == pytest.approx(s)
    r = np.corrcoef(x, y)[0, 1]
    corr = op.pearson(df, [], "x", "y").first()
    assert corr.r == pytest.approx(r) and corr.t == pytest.approx(r * math.sqrt(5 / (1 - r * r)))
    band = op.fit_band(df, [], "x", "y", points=3).orderBy("x").collect()
    assert [b.x for b in band] == [1.0, 4.0, 7.0]
    half = 2.570581835636314 * s * math.sqrt(1 / 7)
    assert band[1].hi - band[1].fit == pytest.approx(half) and band[1].fit - band[1].lo == pytest.approx(half)


def test_shapiro(table):
    sample = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    data = [("known", float(v)) for v in sample]
    data += [("three", v) for v in (1.0, 2.0, 4.0)]
    data += [("two", 1.0), ("two", 2.0), ("flat", 5.0), ("flat", 5.0), ("flat", 5.0), ("known", None)]
    got = {r.g: r for r in op.shapiro(table(data, "g string, v double"), "g", "v").collect()}
    assert got["known"].n == 11
    assert got["known"].w == pytest.approx(0.78881, abs=1e-5) and got["known"].p == pytest.approx(0.00670, abs=1e-5)
    # three values: W = (x3 - x1)^2 / 2 / SS
    w = 9 / 2 / (1 + 4 + 16 - 49 / 3)
    assert got["three"].w == pytest.approx(w)
    assert got["three"].p == pytest.approx(6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    assert (got["two"].w, got["two"].reason) == (None, "fewer than 3 values")
    assert (got["flat"].p, got["flat"].reason) == (None, "all values equal")


def test_shapiro_is_calibrated_and_bounded(spark):
    draws = spark.range(0, 300 * 24).select((F.col("id") % 300).alias("g"), F.randn(5).alias("v"))
    share = op.shapiro(draws, "g", "v").agg(F.avg((F.col("p") < 0.05).cast("int"))).first()[0]
    assert 0.01 < share < 0.1
    big = spark.range(0, 5001).select(F.lit("x").alias("g"), F.col("id").cast("double").alias("v"))
    assert op.shapiro(big, "g", "v").first().reason == "p extrapolated beyond 5000 values"


def test_shapiro_above_5000_values(spark):
    """W of a large slice, with ties and a second small slice, against a plain sum; p has a warning."""
    values = [round(random.Random(k).gauss(3, 2), 1) for k in range(6001)]
    data = [("big", v) for v in values] + [("flat", 1.0)] * 5002 + [("small", float(k * k)) for k in range(20)]
    got = {r.g: r for r in op.shapiro(spark.createDataFrame(data, "g string, v double"), "g", "v").collect()}
    n, x = len(values), sorted(values)
    m = [NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    ss, u, mean = sum(v * v for v in m), n**-0.5, sum(x) / n
    a1 = m[-1] / math.sqrt(ss) + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
    a2 = m[-2] / math.sqrt(ss) + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
    phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a1**2 - 2 * a2**2)
    weights = [-a1, -a2, *[v / math.sqrt(phi) for v in m[2:-2]], a2, a1]
    w = sum(a * v for a, v in zip(weights, x, strict=True)) ** 2 / sum((v - mean) ** 2 for v in x)
    assert got["big"].w == pytest.approx(w, rel=1e-9) and 0 <= got["big"].p <= 1
    assert (got["big"].n, got["big"].reason) == (6001, "p extrapolated beyond 5000 values")
    assert got["flat"].w is None and got["small"].reason is None and 0.8 < got["small"].w < 1


def test_histogram_edges(table):
    values = table([(float(v),) for v in range(30)] + [(29.0,)], "v double")
    got = op.hist_data(values, [], "v").orderBy("bin").collect()
    assert len(got) == 30 and [r["count"] for r in got] == [1] * 29 + [2]
    assert (got[0].lo, got[0].hi, got[29].hi) == (-0.5, 0.5, 29.5)
    flat = op.hist_data(table([(3.0,), (3.0,)], "v double"), [], "v", bins=4).orderBy("bin").collect()
    assert [r["count"] for r in flat] == [2, 0, 0, 0]


def test_qq_points(table):
    got = op.qq_data(table([(3.0,), (1.0,), (2.0,), (None,)], "v double"), [], "v").orderBy("i").collect()
    assert [r.sample for r in got] == [1.0, 2.0, 3.0]
    assert got[0].theoretical == pytest.approx(NormalDist().inv_cdf(0.625 / 3.25)) and got[1].theoretical == pytest.approx(0.0)


def test_levene_far_from_zero(table):
    """Two clusters on either side, far from zero: the distances differ only in their last digits."""
    low, high = [0.0, 3.0, 8.0, 1.0], [2.0, 9.0, 4.0, 20.0]
    data = [(g, sign * 1e8 + x) for g, xs in (("a", low), ("b", high)) for sign in (-1, 1) for x in xs]
    got = op.levene(table(data, "g string, v double"), [], "g", "v", center="mean").first()
    want = []
    for g in "ab":
        values = [v for k, v in data if k == g]
        mean = sum(values) / len(values)
        want.append([abs(v - mean) - 1e8 for v in values])
    inside = sum((d - sum(w) / len(w)) ** 2 for w in want for d in w)
    assert inside > 1 and abs(got.ss_resid - inside) < 1e-6 * inside
