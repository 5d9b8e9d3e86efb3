"""Diagnose a table: profile, semantic types, audit and scores."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.fuzzy import Matcher
from ..operators.outliers import Bounds, bounds_of_stats
from ..operators.profile import ROW_ID, TableStats, collect_stats, data_columns, duplicate_count
from ..operators.report import EmailAudit, audit_cells, column_status, diagnostics_frame
from ..operators.scoring import Audit
from ..operators.semantics import detect_semantics
from ..session import Staging, concurrently

FUZZY_KEY_TYPES = ("text", "name", "email", "phone", "unknown")


@dataclass
class Diagnosis:
    """Everything a diagnosis found; the frames are built on demand."""

    spark: SparkSession
    stats: TableStats
    semantics: dict[str, str]
    audit: Audit
    email_audits: dict[str, EmailAudit]
    bounds: list[Bounds]
    matcher: Matcher | None = None

    @property
    def quality_score(self) -> int:
        return self.audit.quality

    @property
    def health_score(self) -> int:
        return self.audit.health

    def columns(self) -> DataFrame:
        """One row per column."""
        return diagnostics_frame(self.spark, self.stats, self.semantics, self.email_audits)

    def audit_frame(self) -> DataFrame:
        return self.audit.frame(self.spark)


def fuzzy_key(stats: TableStats, semantics: Mapping[str, str]) -> str | None:
    """The first free-text column with more than two distinct values."""
    for c, s in stats.columns.items():
        if semantics[c] in FUZZY_KEY_TYPES and s.kind == "string" and s.unique > 2:
            return c
    return None


def diagnose(
    df: DataFrame,
    semantic_overrides: Mapping[str, str] | None = None,
    fuzzy: bool = True,
    fuzzy_method: str = "indel",
    exact: bool = True,
    duplicates: int | None = None,
    staging: Staging | None = None,
) -> Diagnosis:
    """Profile and audit a table.

    ``fuzzy=False`` skips the count of near-duplicate values; ``exact=False`` takes distinct counts and quantiles
    from sketches. A known number of ``duplicates`` saves counting them. Without a ``staging`` to share, the tables
    that the count needed are deleted again.
    """
    spark = df.sparkSession
    own = Staging(spark) if staging is None else None
    staging = staging or own

    def count_duplicates() -> int:
        if duplicates is not None or not data_columns(df):
            return duplicates or 0
        return duplicate_count(df).first()["duplicate_count"]

    stats, semantics, repeated = concurrently(
        lambda: collect_stats(df, exact),
        lambda: detect_semantics(df, overrides=semantic_overrides),
        count_duplicates,
    )
    of_type = {t: [c for c, k in semantics.items() if k == t] for t in set(semantics.values())}
    email_columns = [c for c in of_type.get("email", []) if stats.columns[c].kind == "string"]
    bounds = bounds_of_stats(stats)
    key = fuzzy_key(stats, semantics)

    def match() -> tuple[Matcher | None, int]:
        if not (fuzzy and key):
            return None, 0
        order = ROW_ID if ROW_ID in df.columns else None
        matcher = Matcher(df, key, order, fuzzy_method, staging)
        return matcher, matcher.pair_count()

    (email_audits, outliers), (matcher, near) = concurrently(
        lambda: audit_cells(df, email_columns, bounds), match
    )
    if own is not None:
        matcher = None
        own.discard()
    audit = Audit(
        rows=stats.rows,
        cols=len(data_columns(df)),
        null_count=stats.null_count,
        null_density=stats.null_density,
        duplicate_count=repeated,
        fuzzy_duplicate_count=near,
        fuzzy_key_col=key,
        outlier_count=sum(outliers.values()),
        email_cols=of_type.get("email", []),
        date_cols=of_type.get("date", []),
        phone_cols=of_type.get("phone", []),
        city_cols=of_type.get("city", []),
        numeric_str_cols=[c for c, k in semantics.items() if k in ("numeric_string", "currency")],
        critical_cols=[
            c for c, s in stats.columns.items()
            if column_status(s, email_audits.get(c)).startswith("Critical")
        ],
        total_email_issues=sum(e.invalid for e in email_audits.values()),
    )
    return Diagnosis(spark, stats, semantics, audit, email_audits, bounds, matcher)
