"""Sinks and the preview."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from ..operators.profile import ROW_ID


def output_name(path: str) -> str:
    """``/data/leads.csv`` -> ``/data/optimized_leads.csv``"""
    folder, base = os.path.split(path.rstrip("/"))
    return os.path.join(folder, f"optimized_{os.path.splitext(base)[0]}.csv")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write with a header and without the row id, one part file per task."""
    (
        df.drop(ROW_ID)
        .write.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .mode(mode)
        .csv(path)
    )


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.drop(ROW_ID).write.mode(mode).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a report frame for later rendering."""
    df.write.mode(mode).json(path)


def preview(df: DataFrame, rows: int = 10, order_by: str = ROW_ID) -> DataFrame:
    """The first rows in row order."""
    ordered = df.orderBy(order_by) if order_by in df.columns else df
    return ordered.limit(rows).drop(ROW_ID)
