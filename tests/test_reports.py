"""Whole reports on small raw tables in the declared schemas."""

from datetime import date

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from trialframe.plans import reports
from trialframe.sources.schemas import (
    CONFRONTATION,
    FERMENTATION,
    GERMINATION,
    LESION,
    PATHOGEN_ON_YEAST,
    PRESCREEN,
    SCREENED,
    SEVERITY,
)

RNG = np.random.default_rng(11)
DAY = date(2020, 1, 1)
EFFECT = {"C": 40.0, "357": 12.0, "461": 10.0, "707": 11.0, "957": 22.0}


def compute_all(report):
    return {name: df.collect() for name, df in report.items()}


@pytest.fixture
def confrontation(table):
    data = [
        (code, p, e, float(size + RNG.normal(0, 1)) / 2 + 2.5, float(RNG.uniform(0, 5)), float(RNG.uniform(5, 9)), 7, DAY, DAY)
        for p in ("Bc", "Cf") for e in (1, 2) for code, size in EFFECT.items() for _ in range(6)
    ]
    return table(data, CONFRONTATION)


def test_confrontation(confrontation):
    report = reports.confrontation_report(confrontation, pooled=True, levels=["CTRL", "JB951", "JB543"])
    clean = report["clean"]
    assert clean.columns[:2] == ["treatmnt", "pathogen"] and "ydiam_mm" in clean.columns
    tops = clean.groupBy("pathogen", "experiment").agg(F.min("perc_in").alias("low"), F.max("max_diam").alias("m"))
    assert all(r.low == 0.0 for r in tops.collect()) and len({r.m for r in tops.collect()}) == 4
    got = compute_all(report)
    for p in ("Bc", "Cf"):
        summary = [r for r in got["summary"] if r.pathogen == p]
        assert [r["mean"] for r in summary] == sorted((r["mean"] for r in summary), reverse=True)
        assert summary[-1].treatmnt == "CTRL" and summary[-1].letters == "a" and summary[-1].n == 12
    assert all(r.p < 0.001 for r in got["kruskal"]) and len(got["pairs"]) == 20 and len(got["pair_table"]) == 50
    assert {r.treatmnt: r.ord for r in got["bars"]}["JB543"] == 3
    assert len(got["zone_inhibition_band"]) == 80 and got["zone_inhibition_label"][0].r is not None


def test_pooled_diameter_uses_one_maximum(table):
    data = [
        (code, "Bc", e, size * e + float(RNG.normal(0, 1)) + 5, DAY, DAY)
        for e in (1, 2) for code, size in EFFECT.items() for _ in range(5)
    ]
    raw = table(data, PATHOGEN_ON_YEAST)
    pooled = reports.diameter_report(raw, pooled=True)
    assert pooled["clean"].select("max_diam").distinct().count() == 1
    apart = reports.diameter_report(raw, method="ranksum")
    assert apart["clean"].select("max_diam").distinct().count() == 2
    assert len(apart["summary"].collect()) == 10 and len(pooled["summary"].collect()) == 5


def test_germination(table):
    data = [
        (e, p, *(float(RNG.uniform() < chance) for chance in (0.9, 0.5, 0.1)), y, i, "", "")
        for e in (1, 2) for p in ("Bc", "Cf") for y in ("JB767", "JB951") for i in range(40)
    ]
    got = compute_all(reports.germination_report(table(data, GERMINATION), offset=1.0))
    assert set(got["clean"][0].asDict()) == {"experiment", "pathogen", "yeast_id", "treatmnt", "value"}
    assert len(got["clean"]) == 3 * len(data)
    best = [r for r in got["summary"] if (r.pathogen, r.yeast_id) == ("Bc", "JB767")]
    assert [r.treatmnt for r in best] == ["sdw", "wcs", "cfs"] and best[0].n == 80
    assert best[0].rate == pytest.approx(100 * best[0]["mean"] + 1) and best[0].letters != best[2].letters
    assert len(got["rates"]) == 24 and len(got["pairs"]) == 12


def test_fruit_reports(table):
    data = [
        (t, float(max(0.0, RNG.normal(8 if t in ("Bc", "Cf") else 4, 2))), p, d)
        for p in ("Botrytis", "Colletotrichum") for d in (4, 7)
        for t in ("357", "506", "461", "SDI", "Bc", "Cf", "switch") for _ in range(5)
        if (t, p) not in {("506", "Botrytis"), ("461", "Colletotrichum"), ("Bc", "Colletotrichum"), ("Cf", "Botrytis")}
    ]
    raw = table([*data, ("other", 1.0, "Botrytis", 4)], LESION)
    report = reports.lesion_report(raw)
    got = compute_all(report)
    assert len(got["clean"]) == len(data) and got["anova"][-1].term == "Residuals"
    assert len(got["kruskal_treatment_within"]) == 2 and {r.label for r in got["bars"]} >= {"Bc only", "Switch"}
    late = compute_all(reports.incidence_report(report["clean"]))
    assert all(0 <= r.incidence <= 100 for r in late["incidence"]) and len(late["incidence"]) == 10
    assert all(r.f is None for r in late["anova"])
    assert late["anova"][-1].df == 0


def test_severity(table):
    data = [
        (t, 7, p, float(scale), float(RNG.integers(1, 9)))
        for t in ("357", "SDI", "Bc") for p in ("Botrytis", "Colletotrichum") for scale in range(5)
    ]
    got = compute_all(reports.severity_report(table([*data, ("357", 4, "Botrytis", 1.0, 1.0)], SEVERITY)))
    assert len(got["severity"]) == 6 and all(0 < r.dis_sev < 100 for r in got["severity"])
    assert all(r.f is None for r in got["anova"])
    assert {r.stars for r in got["bars"] if r.pathogen == "Botrytis" and r.label != "Bc only"} == {"ns"}
    repeated = reports.severity_report(table(data, SEVERITY), per_row=True)
    assert repeated["severity"].count() == len(data)
    assert all(r.f is None for r in repeated["anova"].collect())
    assert repeated["kruskal_treatment"].first().n == len(data)


def test_tables_and_lines(table):
    screened = table(
        [(1, "i1", "yeast", "Pichia"), (2, "i1", "yeast", "Pichia"), (3, "i2", "bacteria", "B"),
         (4, None, "yeast", "P"), (5, "i3", "yeast", "Control"), (6, "i4", "yeast", "Pichia")], SCREENED)
    assert [(r.name, r.n) for r in reports.screened_table(screened).collect()] == [("Pichia", 2)]
    pre = table(
        [("s", "i", "b", p, "yeast", r, None, None, None, 5, DAY, DAY) for p in ("Bc", "Cf") for r in (1.0, 2.0)],
        PRESCREEN)
    assert [(r["mean"], r.n) for r in reports.prescreen_table(pre, "Bc").collect()] == [(3.0, 2)]
    assert reports.prescreen_table(pre).count() == 2
    ferm = table([("CTRL", *[100.0 - d for d in range(20)])], FERMENTATION)
    lines = reports.fermentation_lines(ferm).collect()
    assert [(r.day, r.weight) for r in lines] == [(d + 1, float(d)) for d in range(20)]
