"""Delimited text and Parquet sources, with column types inferred from the values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numbers import INTEGER, NUMBER
from ..functions.text import strip
from ..operators.dedup import with_row_id
from ..operators.profile import classes, col
from ..session import Staging
from .records import read_records

_ALL_DIGITS = r"^[+-]?\d{19,}$"
_BOOLEAN = r"^(True|TRUE|true|False|FALSE|false)$"


def _present(c: Column) -> Column:
    """The text, or NULL for a token that means "missing"."""
    return F.when(~c.isin(*rules.NA_TOKENS), c)


def infer_types(df: DataFrame) -> DataFrame:
    """Type every text column by its values: boolean, integer, float, or text as it is.

    Tokens that mean "missing" become NULL first. A column takes a type only when all its values fit, so
    one aggregate decides; integers with missing cells become doubles. Date-like text stays text.
    """
    text = [c for c, kind in classes(df).items() if kind == "string"]
    if not text:
        return df
    values = {c: _present(col(c)) for c in text}
    shapes = {"boolean": _BOOLEAN, "integer": INTEGER, "float": NUMBER}
    tests = []
    for i, v in enumerate(values.values()):
        bare = strip(v)
        tests += [F.count_if(v.isNull()).alias(f"missing{i}"), F.count(v).alias(f"n{i}")]
        tests += [F.count_if(bare.rlike(p)).alias(f"{kind}{i}") for kind, p in shapes.items()]
        tests.append(F.count_if(bare.rlike(_ALL_DIGITS)).alias(f"long{i}"))
    row = df.agg(*tests).first()

    def typed(i: int, c: str) -> Column:
        v, n = values[c], row[f"n{i}"]
        if n == 0:
            return v.cast("double")
        if row[f"boolean{i}"] == n:
            return F.lower(strip(v)) == "true"
        if row[f"integer{i}"] == n and not row[f"missing{i}"]:
            return strip(v).try_cast("long")
        if row[f"float{i}"] == n and not row[f"long{i}"]:
            return strip(v).try_cast("double")
        return v

    position = {c: i for i, c in enumerate(text)}
    return df.select(*[typed(position[c], c).alias(c) if c in position else col(c) for c in df.columns])


def spans_lines(spark: SparkSession, path: str, delimiter: str = ",") -> bool:
    """Whether any quoted field holds a line break: in some line a field opens with a quote and doesn't close.

    Quotes inside of unquoted fields, such as inch marks, open nothing.
    """
    sep = re.escape(delimiter)
    closed = rf'(^|{sep})"(?:[^"]++|"")*+"(?={sep}|$)'
    rest = F.regexp_replace("value", closed, "$1")
    return not spark.read.text(path).where(F.col("value").contains('"') & rest.rlike(rf'(^|{sep})"')).isEmpty()


def read_csv(
    spark: SparkSession, path: str, infer: bool = True, row_id: bool = True,
    multi_line: bool | None = None, delimiter: str = ",", staging: Staging | None = None,
) -> DataFrame:
    """Read delimited text with a header; all columns as text, then typed by their values.

    One cheap splittable scan finds out whether quoted fields hold line breaks. If so, records are put together from lines in
    parallel (:mod:`.records`, with tables in ``staging``); ``multi_line=True`` leaves such files to Spark's own reader, which
    takes a task for each file, and ``multi_line=False`` says that there are none.
    """
    if multi_line is None and spans_lines(spark, path, delimiter):
        df = read_records(spark, path, staging or Staging(spark), delimiter, row_id)
        return infer_types(df) if infer else df
    df = (
        spark.read.option("header", True)
        .option("multiLine", bool(multi_line))
        .option("escape", '"')
        .option("sep", delimiter)
        .option("nullValue", "")
        .csv(path)
    )
    if row_id:
        df = with_row_id(df)
    return infer_types(df) if infer else df


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read by extension: ``.parquet`` as Parquet, workbooks are refused, anything else as delimited text."""
    lower = path.lower().rstrip("/")
    if lower.endswith(".parquet"):
        return spark.read.parquet(path)
    if lower.endswith((".xlsx", ".xls")):
        raise ValueError("workbooks are not supported; export them to CSV")
    return read_csv(spark, path, **options)
