"""Reading and writing tables."""

from .delimited import infer_types, read_csv, read_table
from .writers import output_name, preview, write_csv, write_json, write_parquet

__all__ = [
    "infer_types", "output_name", "preview", "read_csv", "read_table", "write_csv", "write_json",
    "write_parquet",
]
