"""Reports as DataFrames: column diagnostics, metrics, steps and a readable summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import emails, rules
from .impute import recommend
from .outliers import Bounds
from .profile import ROW_ID, ColumnStats, TableStats, col
from .semantics import is_age_name

# --- fixed values: metric names of a cleaning run, with the wording the summary uses --------------
METRICS = {
    "rows_before": "Original Row Count",
    "rows_after": "Cleaned Row Count",
    "nulls_filled": "Missing Values Filled",
    "duplicates_dropped": "Exact Duplicates Removed",
    "fuzzy_duplicates_dropped": "Fuzzy Duplicates Removed",
    "types_converted": "Data Types Standardized",
    "dates_detected": "Dates Detected",
    "dates_standardized": "Date Formats Standardized",
    "dates_rejected": "Invalid Dates Rejected",
    "emails_flagged": "Invalid Emails Flagged",
    "emails_nullified": "Invalid Emails Nullified",
    "emails_rows_removed": "Rows Removed (bad email)",
    "phones_corrected": "Phone Numbers Normalized",
    "phones_flagged_invalid": "Invalid Phones Flagged",
    "cities_normalized": "Cities Normalized",
    "outliers_clipped": "Outliers Clipped",
    "outliers_replaced": "Outliers Replaced (median)",
    "outlier_rows_removed": "Outlier Rows Removed",
}
# --- fixed values: metrics that only the metrics table lists --------------------------------------
MORE_METRICS = (
    "ages_nullified", "emails_found", "emails_valid", "emails_invalid", "emails_corrected",
    "emails_removed", "emails_remaining", "phones_found", "phones_valid", "phones_invalid",
    "phones_remaining",
)
EXAMPLES = 3


@dataclass
class EmailAudit:
    valid: int = 0
    malformed: int = 0
    suspicious: int = 0
    examples: list[str] = field(default_factory=list)

    @property
    def invalid(self) -> int:
        return self.malformed + self.suspicious


def audit_cells(
    df: DataFrame, email_columns: Sequence[str], bounds: Sequence[Bounds]
) -> tuple[dict[str, EmailAudit], dict[str, int]]:
    """E-mail verdicts and outlier counts of all columns in one pass, then a few examples per bad column in another."""
    wanted = []
    for i, c in enumerate(email_columns):
        verdict = emails.email_audit_class(col(c))
        wanted += [F.count_if(verdict == k).alias(f"{k}{i}") for k in ("valid", "malformed", "suspicious")]
    wanted += [F.count_if(b.beyond()).alias(f"out{i}") for i, b in enumerate(bounds)]
    if not wanted:
        return {}, {}
    row = df.agg(*wanted).first()
    audits = {
        c: EmailAudit(row[f"valid{i}"], row[f"malformed{i}"], row[f"suspicious{i}"]) for i, c in enumerate(email_columns)
    }
    examples = _examples(df, [c for c in email_columns if audits[c].invalid])
    for c, values in examples.items():
        audits[c].examples = values
    return audits, {b.column: row[f"out{i}"] for i, b in enumerate(bounds)}


def _examples(df: DataFrame, bad: Sequence[str]) -> dict[str, list[str]]:
    """The first invalid addresses of each column: one job, in which every task passes on no more than it takes."""
    if not bad:
        return {}
    place = F.col(ROW_ID) if ROW_ID in df.columns else F.monotonically_increasing_id()
    cells = F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("value"), emails.email_audit_class(col(c)).alias("verdict")) for c in bad])
    wrong = df.select(place.alias("place"), F.inline(cells)).where("verdict != 'valid'")
    first = F.row_number().over(Window.partitionBy("column").orderBy("place"))
    found = wrong.withColumn("nth", first).where(F.col("nth") <= EXAMPLES).orderBy("column", "nth").collect()
    return {c: [r["value"] for r in found if r["column"] == c] for c in bad}


def email_audit(df: DataFrame, column: str) -> DataFrame:
    """One row: valid, malformed, suspicious, invalid."""
    verdict = emails.email_audit_class(col(column))
    counts = df.agg(*[F.count_if(verdict == k).alias(k) for k in ("valid", "malformed", "suspicious")])
    return counts.withColumn("invalid", F.col("malformed") + F.col("suspicious"))


def column_status(s: ColumnStats, email: EmailAudit | None) -> str:
    """Clean, or the warning that matters most."""
    if s.sparsity > 50:
        return "Critical (High Sparsity)"
    if s.kind in ("integer", "float"):
        if abs(round(s.skewness or 0.0, 2)) > 1.0:
            return "Warning (High Skew)"
        if s.bad_ages and is_age_name(s.name):
            return f"Warning ({s.bad_ages} out-of-range ages)"
    elif email and email.invalid:
        return f"Warning ({email.invalid} invalid emails)"
    return "Clean"


def diagnostics_frame(
    spark: SparkSession,
    stats: TableStats,
    semantics: Mapping[str, str],
    email_audits: Mapping[str, EmailAudit],
) -> DataFrame:
    """One row per column: types, label, counts, statistics, status and the recommended fill."""

    def rounded(x: float | None, digits: int) -> float | None:
        return None if x is None else round(float(x), digits)

    rows = []
    for position, (name, s) in enumerate(stats.columns.items()):
        semantic = semantics[name]
        label, badge = rules.LABELS.get(semantic, rules.LABELS["text"])
        email = email_audits.get(name)
        rows.append((
            position, name, s.type, semantic, label, badge, s.nulls, s.sparsity, s.unique,
            rounded(s.skewness, 2), *(rounded(x, 4) for x in (s.mean, s.median, s.low, s.high, s.std)),
            None if s.kind in ("integer", "float") else s.mode, column_status(s, email), recommend(s, semantic),
            *((email.invalid, email.malformed, email.suspicious, email.examples) if email else (None,) * 4),
        ))
    return spark.createDataFrame(
        rows,
        "position int, column string, type string, semantic string, label string, badge string, "
        "null_count long, sparsity double, unique_count long, skewness double, mean double, "
        "median double, min double, max double, std double, mode string, status string, "
        "recommended string, email_issues long, email_malformed long, email_suspicious long, "
        "invalid_email_examples array<string>",
    )


def metrics_frame(spark: SparkSession, metrics: Mapping[str, int]) -> DataFrame:
    return spark.createDataFrame(list(metrics.items()), "metric string, value long")


def steps_frame(spark: SparkSession, steps: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(steps, 1)), "seq int, step string")


def summary_frames(
    spark: SparkSession, metrics: Mapping[str, int], diagnostics: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Two readable tables: the named metrics, and each column with its type, missing cells and status."""
    named = spark.createDataFrame(
        [(i, label, str(metrics.get(name, 0))) for i, (name, label) in enumerate(METRICS.items(), 1)],
        "seq int, metric string, value string",
    )
    columns = diagnostics.orderBy("position").select(
        F.col("column").alias("column_name"),
        F.col("label").alias("semantic_type"),
        F.format_string("%d (%s%%)", F.col("null_count"), F.col("sparsity").cast("string")).alias("nulls"),
        "status",
    )
    return named, columns
