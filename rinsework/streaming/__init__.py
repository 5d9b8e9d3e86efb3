"""The cell cleaners on an unbounded table.

Dates, e-mails, phones, ages and text are plain projections, so they apply to a streaming DataFrame as they
stand. What needs the whole table — detection, gates, fills, outlier bounds — is decided on a batch first
and passed in here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..operators import columns
from ..operators.profile import classes, data_columns


def clean_cells(
    df: DataFrame,
    semantics: Mapping[str, str],
    date_modes: Mapping[str, str] | None = None,
    email_modes: Mapping[str, str] | None = None,
) -> DataFrame:
    """Clean dates, e-mails, phones, ages and text of a batch or streaming table by known semantic types."""
    kinds = classes(df)
    text = {
        t: [c for c, k in kinds.items() if k == "string" and semantics.get(c) == t]
        for t in ("date", "email", "phone")
    }
    df = columns.standardize_dates(
        df, {c: (date_modes or {}).get(c, "nullify") for c in text["date"]}
    )
    for c in text["email"]:
        df = columns.clean_emails(df, c, (email_modes or {}).get(c, "flag"))
    for c in text["phone"]:
        df = columns.clean_phones(df, c)
    ages = [c for c, k in kinds.items() if semantics.get(c) == "age" and k in ("integer", "float")]
    df = columns.clean_ages(df, ages)
    return columns.standardize_text(df, semantics)


def drop_duplicates_within(df: DataFrame, time: str, delay: str, keys: Sequence[str] | None = None) -> DataFrame:
    """Drop rows of a stream that repeat an earlier row on ``keys`` (all data columns but ``time`` by default), NULLs being equal.

    State is kept for each key until the watermark, ``delay`` behind the latest ``time``, has passed its row by as much, so it stays
    bounded; a repeat that comes later than that is a new row. Rows later than the watermark are dropped. On a batch table all repeats go.
    """
    wanted = list(keys) if keys is not None else [c for c in data_columns(df) if c != time]
    if not df.isStreaming:
        return df.dropDuplicates(wanted)
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(wanted)
