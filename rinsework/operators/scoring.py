"""Quality and health scores, as plain arithmetic and as Spark columns over a one-row audit."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from functools import reduce
from operator import sub

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Audit:
    """What an audit counts; everything the scores need."""

    rows: int
    cols: int
    null_count: int = 0
    null_density: float = 0.0
    duplicate_count: int = 0
    fuzzy_duplicate_count: int = 0
    fuzzy_key_col: str | None = None
    outlier_count: int = 0
    email_cols: list[str] = field(default_factory=list)
    date_cols: list[str] = field(default_factory=list)
    phone_cols: list[str] = field(default_factory=list)
    city_cols: list[str] = field(default_factory=list)
    numeric_str_cols: list[str] = field(default_factory=list)
    critical_cols: list[str] = field(default_factory=list)
    total_email_issues: int = 0
    dates_rejected: int = 0

    @property
    def quality(self) -> int:
        return _whole(reduce(sub, quality_penalties(asdict(self), _Numbers), 100))

    @property
    def health(self) -> int:
        return _whole(reduce(sub, health_penalties(asdict(self), _Numbers), 100))

    def frame(self, spark: SparkSession) -> DataFrame:
        """The audit as a one-row table."""
        return spark.createDataFrame(
            [tuple(asdict(self).values())],
            "rows long, cols long, null_count long, null_density double, duplicate_count long, "
            "fuzzy_duplicate_count long, fuzzy_key_col string, outlier_count long, "
            "email_cols array<string>, date_cols array<string>, phone_cols array<string>, "
            "city_cols array<string>, numeric_str_cols array<string>, critical_cols array<string>, "
            "total_email_issues long, dates_rejected long",
        )


def _whole(score: float) -> int:
    return max(0, int(score))


class _Numbers:
    """Arithmetic on Python numbers."""

    least = staticmethod(min)
    size = staticmethod(len)

    @staticmethod
    def rate(count, rows):
        return count / rows if rows else 0.0


class _Columns:
    """The same arithmetic on Spark columns."""

    size = staticmethod(F.size)

    @staticmethod
    def least(bound, c: Column) -> Column:
        return F.least(F.lit(float(bound)), c.cast("double"))

    @staticmethod
    def rate(count: Column, rows: Column) -> Column:
        return F.when(rows > 0, count / rows).otherwise(0.0)


def quality_penalties(a: Mapping, m) -> list:
    """Missing cells, duplicates, numbers kept as text, e-mails, dates, outliers, columns to normalise."""
    return [
        m.least(20, a["null_density"] * 1.5),
        m.least(15, m.rate(a["duplicate_count"], a["rows"]) * 100),
        m.least(15, m.size(a["numeric_str_cols"]) * 4),
        m.least(10, m.rate(a["total_email_issues"], a["rows"]) * 30),
        m.least(10, m.rate(a["dates_rejected"], a["rows"]) * 30),
        m.least(15, m.rate(a["outlier_count"], a["rows"]) * 5),
        m.least(15, (m.size(a["phone_cols"]) + m.size(a["city_cols"])) * 4),
    ]


def health_penalties(a: Mapping, m) -> list:
    """Missing cells, duplicates, outliers, near-duplicates, e-mails, numbers kept as text."""
    return [
        m.least(30, a["null_density"] * 2),
        m.least(20, m.rate(a["duplicate_count"], a["rows"]) * 100),
        m.least(15, m.rate(a["outlier_count"], a["rows"]) * 5),
        m.least(10, a["fuzzy_duplicate_count"] * (m.rate(a["rows"], a["rows"]) * 2)),
        m.least(10, m.rate(a["total_email_issues"], a["rows"]) * 20),
        m.least(10, m.size(a["numeric_str_cols"]) * 3),
    ]


def score_frame(audit: DataFrame) -> DataFrame:
    """Add quality_score and health_score to a table of audits, one per row."""
    a = {c: F.col(c) for c in audit.columns}

    def score(penalties: list[Column]) -> Column:
        return F.greatest(F.lit(0), reduce(sub, penalties, F.lit(100.0)).cast("long")).cast("long")

    return audit.select(
        "*",
        score(quality_penalties(a, _Columns)).alias("quality_score"),
        score(health_penalties(a, _Columns)).alias("health_score"),
    )


def improvement_percent(before: int, after: int) -> float:
    return round((after - before) / max(before, 1) * 100, 1)
