"""Interquartile-range outliers: bounds, audit counts and three treatments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from .profile import QUARTILES, TableStats, col, numeric_columns
from .quantiles import exact_quantiles, numeric, read_sketches, sketch_columns

TREATMENTS = ("clip", "median_replace", "remove_row")


@dataclass(frozen=True)
class Bounds:
    """Limits of one column; values strictly beyond them are outliers."""

    column: str
    low: float
    high: float
    median: float

    def beyond(self) -> Column:
        x = numeric(self.column)
        return F.coalesce((x < F.lit(self.low)) | (x > F.lit(self.high)), F.lit(False))


def bounds_from(
    quartiles: Mapping[str, tuple[float | None, float | None, float | None]],
    counts: Mapping[str, int],
    minimum: int = 1,
) -> list[Bounds]:
    """Bounds of every column that has ``minimum`` values and a non-zero interquartile range."""
    made = []
    for c, (q1, median, q3) in quartiles.items():
        if q1 is None or counts[c] < minimum or q3 == q1:
            continue
        reach = rules.IQR_FACTOR * (q3 - q1)
        made.append(Bounds(c, q1 - reach, q3 + reach, median))
    return made


def bounds_of_stats(stats: TableStats, minimum: int = 1) -> list[Bounds]:
    measured = {c: s for c, s in stats.columns.items() if s.kind in ("integer", "float")}
    return bounds_from(
        {c: (s.q1, s.median, s.q3) for c, s in measured.items()},
        {c: s.values for c, s in measured.items()},
        minimum,
    )


def iqr_bounds(
    df: DataFrame, columns: Sequence[str] | None = None, minimum: int = rules.MIN_VALUES_FOR_TREATMENT
) -> list[Bounds]:
    """Bounds of the numeric columns, all from the same table state."""
    names = list(columns) if columns is not None else numeric_columns(df)
    if not names:
        return []
    wanted = {c: QUARTILES for c in names}
    sketches = read_sketches(wanted, df.agg(*sketch_columns(wanted)).first())
    quartiles = exact_quantiles(df, wanted, sketches)
    return bounds_from(
        {c: tuple(q[p] for p in QUARTILES) for c, q in quartiles.items()},
        {c: s.count for c, s in sketches.items()},
        minimum,
    )


def outlier_counts(
    df: DataFrame, bounds: Sequence[Bounds], leaving: Sequence[Bounds] = ()
) -> tuple[dict[str, int], int]:
    """Outliers per bounded column, and the rows that stay when those of the ``leaving`` columns go; one pass."""
    doomed = reduce(or_, [b.beyond() for b in leaving], F.lit(False))
    row = df.agg(
        F.count_if(~doomed).alias("stay"),
        *[F.count_if(b.beyond()).alias(f"o{i}") for i, b in enumerate(bounds)],
    ).first()
    return {b.column: row[f"o{i}"] for i, b in enumerate(bounds)}, row["stay"]


def outlier_audit(df: DataFrame, columns: Sequence[str] | None = None, minimum: int = 1) -> DataFrame:
    """Long form: column, low, high, outliers."""
    bounds = iqr_bounds(df, columns, minimum)
    schema = "column string, low double, high double, outliers long"
    if not bounds:
        return df.sparkSession.createDataFrame([], schema)
    counted = df.agg(*[
        F.struct(
            F.lit(b.column).alias("column"), F.lit(b.low).alias("low"),
            F.lit(b.high).alias("high"), F.count_if(b.beyond()).alias("outliers"),
        ).alias(f"c{i}")
        for i, b in enumerate(bounds)
    ])
    return counted.select(F.inline(F.array(*[f"c{i}" for i in range(len(bounds))])))


def treat_outliers(
    df: DataFrame, bounds: Sequence[Bounds], treatment: Mapping[str, str] | str = "clip"
) -> DataFrame:
    """Clip, replace by the median, or drop the rows — per column; NULLs stay NULL.

    A clipped or replaced column becomes double. Rows are dropped once, however many of their columns
    are out of bounds, and the decision uses the values before any clipping.
    """
    chosen = {
        b.column: treatment if isinstance(treatment, str) else treatment.get(b.column, "clip")
        for b in bounds
    }
    unknown = set(chosen.values()) - set(TREATMENTS)
    if unknown:
        raise ValueError(f"unknown outlier treatment: {sorted(unknown)}")
    doomed = [b.beyond() for b in bounds if chosen[b.column] == "remove_row"]
    if doomed:
        df = df.where(~reduce(or_, doomed))
    changed: dict[str, Column] = {}
    for b in bounds:
        x = numeric(b.column)
        if chosen[b.column] == "clip":
            changed[b.column] = (
                F.when(x < b.low, F.lit(b.low)).when(x > b.high, F.lit(b.high)).otherwise(x)
            )
        elif chosen[b.column] == "median_replace":
            changed[b.column] = F.when(b.beyond(), F.lit(b.median)).otherwise(x)
    return df.select(*[changed.get(c, col(c)).alias(c) for c in df.columns])
