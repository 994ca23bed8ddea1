import pytest
from conftest import rows
from pyspark.sql import functions as F

from trialframe import operators as op
from trialframe.sources import nan_to_null, profile_schema, read_table, sort_table, stage, write_csv, write_table
from trialframe.sources.schemas import LESION


def test_recode_unmatched_is_null(table):
    t = table([("C",), ("357",), ("x",), (None,)], "isolate_id string")
    got = [r.t for r in op.recode(t, "isolate_id", {"C": "CTRL", "357": "JB543"}, "t").collect()]
    assert got == ["CTRL", "JB543", None, None]
    got = [r.t for r in op.recode(t, "isolate_id", {"C": "CTRL"}, "t", default="other").collect()]
    assert got == ["CTRL", "other", "other", "other"]


def test_column_verbs(table):
    t = table([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert op.select_positions(t, keep=[1, "c"]).columns == ["a", "c"]
    assert op.select_positions(t, drop=["a", 4]).columns == ["b", "c"]
    assert op.move_column(t, "d", before="b").columns == ["a", "d", "b", "c"]
    assert op.rename(t, {"a": "z"}).columns == ["z", "b", "c", "d"]
    assert op.drop_columns(t, ["a", "b"]).columns == ["c", "d"]
    with pytest.raises(ValueError):
        op.drop_columns(t, ["nope"])
    with pytest.raises(ValueError):
        op.select_positions(t, keep=[5])


def test_clean_names(table):
    names = ["Yeast ID", "yeastID", "% germ", "Größe (mm)", "1st", "yeast_id"]
    t = table([(1,) * 6], ", ".join(f"c{i} int" for i in range(6))).toDF(*names)
    assert op.clean_names(t).columns == [
        "yeast_id", "yeast_id_2", "percent_germ", "große_mm".replace("ß", ""), "x1st", "yeast_id_3",
    ]


def test_factor_levels_within_slice(table):
    t = table([("a", "x"), ("a", "y"), ("b", "y"), ("b", None), (None, "y")], "s string, f string")
    got = {(r.s, r.f): r.level_ord for r in op.as_factor(t, "f", "s").collect()}
    assert got == {("a", "x"): 1, ("a", "y"): 2, ("b", "y"): 1, ("b", None): None, (None, "y"): 1}


def test_level_order_and_reorder(table):
    t = table([("a", 1.0), ("a", 3.0), ("b", 9.0), ("c", 2.0), ("d", None)], "f string, v double")
    assert {r.f: r.level_ord for r in op.with_level_order(t, "f", ["c", "a"]).collect()} == {
        "a": 2, "b": None, "c": 1, "d": None,
    }
    assert {r.f: r.level_ord for r in op.reorder_levels(t, "f", "v").collect()} == {
        "b": 1, "a": 2, "c": 3, "d": None,
    }


def test_distinct_first_keeps_file_order(table):
    t = table([("i", "new", 2), ("i", "old", 1), ("j", "only", 3)], "isolate string, name string, row_id int")
    assert {r.isolate: r.name for r in op.distinct_first(t, "isolate", "row_id").collect()} == {
        "i": "old",
        "j": "only",
    }


def test_flag_threshold_keeps_null(table):
    t = table([(0.5,), (1.0,), (None,)], "v double")
    assert [r.flag for r in op.flag_threshold(t, "v", 1.0).collect()] == [0, 1, None]


def test_long_round_trip(table):
    t = table([("k", 1.0, 2.0), ("m", 3.0, None)], "id string, a double, b double")
    long = op.to_long(t, ["id"], "name", "value")
    back = long.groupBy("id").pivot("name", ["a", "b"]).agg(F.first("value"))
    assert rows(back, "id") == rows(t, "id")


def test_series_change(table):
    t = table([("s", 10.0, 9.0, 7.5)], "strain string, day1 double, day2 double, day3 double")
    got = op.series_data(t, "strain", ["day1", "day2", "day3"], "day", "weight").collect()
    assert [(r.day, r.weight) for r in got] == [(1, 0.0), (2, 1.0), (3, 2.5)]
    long = table([("s", 2, 9.0), ("s", 1, 10.0)], "id string, day int, v double")
    assert {r.day: r.delta for r in op.baseline_delta_long(long, "id", "day", "v").collect()} == {1: 0.0, 2: 1.0}


ASSAY = [
    ("Bc", 1, "CTRL", 40.0), ("Bc", 1, "A", 10.0), ("Bc", 1, "A", 20.0),
    ("Bc", 2, "CTRL", 80.0), ("Bc", 2, "A", 20.0), ("Bc", 2, "A", 40.0),
]
SCHEMA = "pathogen string, experiment int, treatmnt string, d double"


def test_maximum_per_experiment_or_pooled(table):
    t = table(ASSAY, SCHEMA)
    per = op.inhibition_pct(t, ["pathogen", "experiment"], "d").collect()
    assert sorted(r.perc_in for r in per) == [0.0, 0.0, 50.0, 50.0, 75.0, 75.0]
    pooled = op.inhibition_pct(t, ["pathogen"], "d").collect()
    assert sorted(r.perc_in for r in pooled) == [0.0, 50.0, 50.0, 75.0, 75.0, 87.5]


@pytest.mark.parametrize("by,max_by", [(["pathogen", "experiment"], None), (["pathogen"], None),
                                       (["pathogen"], ["pathogen", "experiment"])])
def test_one_pass_summary_equals_row_level(table, by, max_by):
    t = table(ASSAY, SCHEMA)
    fast = op.inhibition_summary(t, by, "treatmnt", "d", max_by=max_by)
    slow = op.treatment_summary(op.inhibition_pct(t, max_by or by, "d"), by, "treatmnt", "perc_in")
    for a, b in zip(rows(fast, *by, "treatmnt"), rows(slow, *by, "treatmnt")):
        assert a["n"] == b["n"] and a["mean"] == pytest.approx(b["mean"])
        assert a["sd"] == (None if b["sd"] is None else pytest.approx(b["sd"]))


def test_missing_values_propagate_or_are_skipped(table):
    t = table([*ASSAY, ("Bc", 2, "A", None)], SCHEMA)
    by = ["pathogen", "experiment"]
    kept = rows(op.inhibition_summary(t, by, "treatmnt", "d"), *by, "treatmnt")
    assert [r["mean"] for r in kept] == [75.0 - 12.5, 0.0, None, None]
    slow = rows(
        op.treatment_summary(op.inhibition_pct(t, by, "d"), by, "treatmnt", "perc_in"), *by, "treatmnt"
    )
    assert [r["mean"] for r in slow] == [r["mean"] for r in kept] and [r["n"] for r in slow] == [2, 1, 3, 1]
    skipped = rows(op.inhibition_summary(t, by, "treatmnt", "d", null_policy="skip"), *by, "treatmnt")
    assert [(r["mean"], r["n"]) for r in skipped] == [(62.5, 2), (0.0, 1), (62.5, 2), (0.0, 1)]


def test_missing_slice_key_forms_a_slice(table):
    t = table([(None, 1, "A", 5.0), (None, 1, "B", 10.0)], SCHEMA)
    assert sorted(r.perc_in for r in op.inhibition_pct(t, ["pathogen", "experiment"], "d").collect()) == [0.0, 50.0]


def test_zero_maximum_and_single_row(table):
    t = table([("p", 1, "A", 0.0), ("p", 1, "A", 0.0)], SCHEMA)
    assert all(r.perc_in is None for r in op.inhibition_pct(t, "pathogen", "d").collect())
    one = op.treatment_summary(t.limit(1), "pathogen", "treatmnt", "d").first()
    assert (one.mean, one.sd, one.n, one.se) == (0.0, None, 1, None)


def test_sliced_and_pooled(table):
    t = table(ASSAY, SCHEMA)
    got = op.sliced_and_pooled(t, "pathogen", "experiment", "treatmnt", "d")
    pooled = op.treatment_summary(t, "pathogen", "treatmnt", "d")
    sliced = op.treatment_summary(t, ["pathogen", "experiment"], "treatmnt", "d")
    for part, want, keys in [(1, pooled, ["treatmnt"]), (0, sliced, ["experiment", "treatmnt"])]:
        for a, b in zip(rows(got.filter(F.col("pooled") == part), *keys), rows(want, *keys)):
            assert a["mean"] == pytest.approx(b["mean"]) and a["n"] == b["n"]
            assert a["sd"] == (None if b["sd"] is None else pytest.approx(b["sd"]))


def test_rates_incidence_severity(table):
    t = table([("a", 1.0), ("a", 0.0), ("a", 1.0), ("b", None)], "g string, v double")
    got = {r.g: r for r in op.germination_rate(t, "g", "v", offset=1.0).collect()}
    assert got["a"].rate == pytest.approx(200 / 3 + 1) and got["b"].rate is None and got["b"].n == 1
    assert {r.g: r.incidence for r in op.incidence_pct(t, "g", "v", 0.5).collect()} == {
        "a": pytest.approx(200 / 3),
        "b": None,
    }
    ratings = table([("t", 0, 2), ("t", 1, 1), ("t", 3, 1)], "g string, scale int, n int")
    assert op.severity_index(ratings, "g", "scale", "n").first().dis_sev == pytest.approx(100 * 4 / 12)
    assert op.severity_index(ratings, "g", "scale", "n", max_scale=4.0).first().dis_sev == pytest.approx(25.0)
    index = [r.dis_sev for r in op.severity_window(ratings, "g", "scale", "n").collect()]
    assert index == [pytest.approx(100 / 3)] * 3


def test_sources(spark, table, tmp_path):
    t = table([("357", 1.5, "Bc", 4), ("SDI", float("nan"), "Cf", 7)], LESION)
    t.write.parquet(f"{tmp_path}/lesion.parquet")
    back = read_table(spark, str(tmp_path), 7)
    assert [r.av_ld for r in back.orderBy("treatment").collect()] == [1.5, None]
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path), "lesion", schema=table([], "nope int").schema)
    write_table(back, f"{tmp_path}/lesion.csv", fmt="csv")
    again = read_table(spark, str(tmp_path), "lesion", schema=LESION, fmt="csv")
    assert rows(again, "treatment") == rows(back, "treatment")
    write_csv(back, f"{tmp_path}/out", ["dpi"])
    out = spark.read.option("header", True).csv(f"{tmp_path}/out")
    assert [r.dpi for r in out.collect()] == ["7", "4"] and len(out.inputFiles()) == 1
    assert rows(stage(back), "treatment") == rows(back, "treatment")
    assert [r.av_ld for r in sort_table(back, ["av_ld"]).collect()] == [1.5, None]
    assert nan_to_null(t).filter("av_ld IS NULL").count() == 1
    prof = profile_schema(back).collect()
    assert [(r.column, r.type, r.non_null) for r in prof][1] == ("av_ld", "double", 1)
