"""Adjustment, pair tables and compact letters."""

import random
import re
import time
from itertools import combinations

import brute
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trialframe import operators as op
from trialframe.operators.multiple import largest_sets

PAIRS = "s string, g1 string, g2 string, p_adj double"


def pairs_of(levels, apart, slice_="s"):
    apart = {tuple(sorted(x)) for x in apart}
    return [(slice_, a, b, 0.01 if (a, b) in apart else 0.5) for a, b in combinations(sorted(levels), 2)]


# Published treatment summaries: treatment, mean, sd, n, se, letters.
GOLDEN = {
    "bc_confrontation": [
        ("JB524", 83.54430379746837, 6.3784538005285105, 24, 1.3019964299342472, "b"),
        ("JB767", 76.26582278481013, 8.779801553653794, 24, 1.7921694874455651, "c"),
        ("JB543", 74.99999999999999, 8.37367074497565, 24, 1.7092683832717859, "c"),
        ("JB951", 41.45569620253165, 6.282159342903363, 24, 1.2823404060809416, "d"),
        ("CTRL", 0.21097046413502082, 0.7147591171813661, 24, 0.14589959384137632, "a"),
    ],
    "bc_on_yeast": [
        ("JB524", 98.02083333333333, 1.8042195912175805, 12, 0.5208333333333334, "b"),
        ("JB951", 97.8125, 1.0825317547305484, 12, 0.31250000000000006, "b"),
        ("JB767", 96.35416666666667, 4.410032896874484, 12, 1.2730668400727942, "b"),
        ("JB543", 95.41666666666667, 4.438126822992973, 12, 1.2811768579763458, "b"),
        ("CTRL", 11.979166666666666, 16.689496674328566, 12, 4.817842698781481, "a"),
    ],
    "cf_confrontation": [
        ("JB624", 72.27060393727062, 11.470837109391598, 24, 2.34147482004928, "b"),
        ("JB767", 71.27043710377045, 12.392080183533773, 24, 2.5295227751093887, "b"),
        ("JB543", 70.9392726059393, 12.489498499986993, 24, 2.549408205685336, "b"),
        ("JB951", 48.03136469803134, 6.6021465362816585, 24, 1.347657518414451, "c"),
        ("CTRL", 1.3513513513513524, 2.390950640349685, 24, 0.4880507557531188, "a"),
    ],
    "cf_on_yeast": [
        ("JB767", 97.30392156862746, 3.856976972210314, 12, 1.1134133465819063, "b"),
        ("JB543", 96.5686274509804, 4.127820383924923, 12, 1.1915991049127392, "bc"),
        ("JB624", 95.83333333333333, 4.768687405805671, 12, 1.3766014787115413, "bc"),
        ("JB951", 91.1764705882353, 7.204381596421112, 12, 2.079725827019258, "c"),
        ("CTRL", 27.69607843137255, 25.034054607917483, 12, 7.226709083394476, "a"),
    ],
}


def test_golden_letters_and_arithmetic(table):
    data = []
    for name, lines in GOLDEN.items():
        letters = {t: set(x) for t, *_, x in lines}
        apart = [(a, b) for a, b in combinations(letters, 2) if not letters[a] & letters[b]]
        data += pairs_of(letters, apart, name)
    got = {(r.s, r.group): r.letters for r in op.compact_letters(table(data, PAIRS), "s").collect()}
    want = {(name, t): x for name, lines in GOLDEN.items() for t, *_, x in lines}
    assert got == want
    for lines in GOLDEN.values():
        assert [m for _, m, *_ in lines] == sorted((m for _, m, *_ in lines), reverse=True)
        assert all(se == pytest.approx(sd / n**0.5, rel=1e-14) for _, _, sd, n, se, _ in lines)


def test_letters_join_by_key_not_position(table):
    summary = table([("s", "b", 2.0), ("s", "a", 1.0), ("s", "z", 0.0)], "s string, g string, mean double")
    letters = op.compact_letters(table(pairs_of("ab", [("a", "b")]), PAIRS), "s")
    got = {r.g: r.letters for r in op.attach_letters(summary, letters, "s", "g").collect()}
    assert got == {"a": "a", "b": "b", "z": None}


def test_letters_of_many_levels(table):
    """More levels than any bit mask holds, and more sets than single letters."""
    levels = [f"t{i:03d}" for i in range(70)]
    apart = [(a, b) for a, b in combinations(levels, 2) if abs(int(a[1:]) - int(b[1:])) > 1]
    got = {r.group: r.letters for r in op.compact_letters(table(pairs_of(levels, apart), PAIRS), "s").collect()}
    assert got["t000"] == "a" and got["t001"] == "ab" and got["t069"] == ".q"
    assert len(got) == 70


def test_largest_sets_against_listing_all():
    rng = random.Random(1)
    for n in (1, 6, 8) * 40:
        apart = [p for p in combinations(range(n), 2) if rng.random() < 0.5]
        good = [s for k in range(1, n + 1) for s in combinations(range(n), k) if not any(set(p) <= set(s) for p in apart)]
        assert largest_sets(n, apart) == sorted(list(s) for s in good if not any(set(s) < set(t) for t in good))


def test_letters_of_80_irregular_levels_take_seconds(table):
    rng = random.Random(3)
    levels = [f"t{i:02d}" for i in range(80)]
    data = pairs_of(levels, [p for p in combinations(levels, 2) if rng.random() < 0.4])
    start = time.time()
    got = {r.group: r.letters for r in op.compact_letters(table(data, PAIRS), "s").collect()}
    assert time.time() - start < 60
    sets = {g: set(re.findall(r"\.*[a-zA-Z]", x)) for g, x in got.items()}
    assert all(bool(sets[a] & sets[b]) == (p >= 0.05) for _, a, b, p in data)


def test_adjustment_of_a_large_family(spark, staged_path):
    """Several chunks, ties over a third of the rows, NaN and NULL, two slices; no task takes a whole family."""
    rng = random.Random(2)
    data = [(s, i, rng.choice([0.01, rng.random() ** 3, rng.random()])) for s in "ab" for i in range(1500)]
    data += [("a", 5000, None), ("a", 5001, float("nan"))]
    df = spark.createDataFrame(data, "s string, i int, p double")
    for by in (["s"], []):
        table = op.adjust_bh(df, by, "p")
        assert table.columns == ["s", "i", "p", "p_adj"]
        assert "SinglePartition" not in table._jdf.queryExecution().toString()
        got = {(r.s, r.i): r.p_adj for r in table.collect()}
        for s in "ab" if by else [None]:
            family = [(k, i, p) for k, i, p in data if s in (None, k) and i < 5000]
            want = list(brute.bh([p for *_, p in family]))
            assert [got[k, i] for k, i, _ in family] == pytest.approx(want, rel=1e-12)
        assert got["a", 5000] is None and got["a", 5001] is None


def test_adjustment_of_one_large_chunk_takes_seconds(spark):
    """60,000 rows that one task reads, in two slices, with ties and nulls; no frame is read anew for each row."""
    rng = random.Random(4)
    data = [(s, i, rng.choice([0.01, None, rng.random() ** 3])) for s in "ab" for i in range(30_000)]
    df = spark.createDataFrame(data, "s string, i int, p double").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for by in (["s"], []):
            start = time.time()
            table = op.adjust_bh(df, by, "p")
            assert not re.search(r"RowFrame, (currentrow\$\(\)|\d+), unboundedfollowing", table._jdf.queryExecution().toString())
            got = {(r.s, r.i): r.p_adj for r in table.collect()}
            assert time.time() - start < 40
            for s in "ab" if by else [None]:
                family = [(k, i, p) for k, i, p in data if s in (None, k) and p is not None]
                assert [got[k, i] for k, i, _ in family] == pytest.approx(list(brute.bh([p for *_, p in family])), rel=1e-12)
            assert all(got[k, i] is None for k, i, p in data if p is None)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sets(st.sampled_from([(a, b) for a, b in combinations("abcdef", 2)])), min_size=4, max_size=8))
def test_letters_shared_iff_not_significant(table, relations):
    data = [p for i, apart in enumerate(relations) for p in pairs_of("abcdef", apart, f"s{i}")]
    got = {(r.s, r.group): set(r.letters) for r in op.compact_letters(table(data, PAIRS), "s").collect()}
    for s, a, b, p in data:
        assert bool(got[s, a] & got[s, b]) == (p >= 0.05)


def test_adjustment(table):
    ps = [0.04, 0.001, 0.03, 0.9, 0.03, None]
    got = op.adjust_bh(table([(i, p) for i, p in enumerate(ps)], "i int, p double"), [], "p").orderBy("i").collect()
    assert [r.p_adj for r in got[:5]] == pytest.approx(list(brute.bh(ps[:5]))) and got[5].p_adj is None
    assert all(r.p_adj >= r.p for r in got[:5])


def test_pair_tables(table):
    df = table([("s", "b"), ("s", "a"), ("s", "a"), ("s", "c"), ("t", "a"), ("t", None)], "s string, g string")
    assert [(r["g1"], r["g2"]) for r in rows(op.group_pairs(df, "s", "g"), "g1", "g2")] == [
        ("a", "b"), ("a", "c"), ("b", "c"),
    ]
    assert {(r.s, r.g1, r.g2) for r in op.vs_reference(df, "g", "b", "s").collect()} == {
        ("s", "b", "a"), ("s", "b", "c"),
    }
    full = op.full_pairs(table(pairs_of("abc", [("a", "b")]), PAIRS), "s")
    cells = {(r.g1, r.g2): r.p_adj for r in full.collect()}
    assert len(cells) == 9 and cells["b", "a"] == 0.01 and cells["c", "c"] == 1.0
    matrix = op.pair_matrix(full, "s", ["a", "b", "c"]).orderBy("g1").collect()
    assert [matrix[0][c] for c in "abc"] == [1.0, 0.01, 0.5]
