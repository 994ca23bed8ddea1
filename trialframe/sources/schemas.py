"""Declared schemas of the assay tables (one per kind of experiment)."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "date": T.DateType(),
}


def _schema(columns: str) -> T.StructType:
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


CONFRONTATION = _schema(
    "isolate_id string, pathogen string, experiment int, radius_mm double, "
    "inhibition_zone double, yeast_diameter double, dpi int, inoc_date date, col_date date"
)
PATHOGEN_ON_YEAST = _schema(
    "isolate_id string, pathogen string, experiment int, diam_mm double, inoc_date date, col_date date"
)
VOLATILE = _schema(
    "isolate_id string, pathogen string, experiment int, diam_mm double, "
    "date_inoculation date, date_data_col date"
)
GERMINATION = _schema(
    "experiment int, pathogen string, sdw double, wcs double, cfs double, yeast_id string, "
    "reps int, spare_1 string, spare_2 string"
)
SCREENED = _schema("row_id long, isolate string, organism string, name string")
PRESCREEN = _schema(
    "sample string, isolate string, name string, pathogen string, organism string, radius_mm double, "
    "ydiam double, pattern string, iz double, dpi int, ino_date date, rec_date date"
)
LESION = _schema("treatment string, av_ld double, pathogen string, dpi int")
SEVERITY = _schema(
    "treatment string, dpi int, pathogen string, rating_scale double, total_rating double"
)
FERMENTATION = _schema(
    "strain string, " + ", ".join(f"day{d} double" for d in range(1, 21))
)

# Table name by its place in the collection.
COLLECTION = {
    1: ("confrontation", CONFRONTATION),
    2: ("pathogen_on_yeast", PATHOGEN_ON_YEAST),
    3: ("volatile", VOLATILE),
    4: ("germination", GERMINATION),
    5: ("screened", SCREENED),
    6: ("prescreen", PRESCREEN),
    7: ("lesion", LESION),
    8: ("severity", SEVERITY),
    9: ("fermentation", FERMENTATION),
}
