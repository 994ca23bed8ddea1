from .schemas import COLLECTION
from .staging import shared_dir, stage
from .tables import (
    nan_to_null,
    profile_schema,
    read_table,
    sort_table,
    write_chart_data,
    write_csv,
    write_table,
)

__all__ = [
    "COLLECTION",
    "nan_to_null",
    "profile_schema",
    "read_table",
    "shared_dir",
    "sort_table",
    "stage",
    "write_chart_data",
    "write_csv",
    "write_table",
]
