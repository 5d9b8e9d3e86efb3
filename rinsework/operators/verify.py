"""The check of the finished table: what is still wrong, and may it be exported without a warning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, emails, phones
from ..functions.text import strip
from .outliers import Bounds, iqr_bounds
from .profile import col, data_columns, duplicate_count, is_missing


@dataclass(frozen=True)
class Verification:
    invalid_emails_remaining: int
    invalid_dates_remaining: int
    invalid_phones_remaining: int
    outliers_remaining: int
    duplicates_remaining: int
    nulls_remaining: int

    @property
    def all_clear(self) -> bool:
        """Outliers and missing cells do not block; everything else does."""
        return not (
            self.invalid_emails_remaining
            or self.invalid_dates_remaining
            or self.invalid_phones_remaining
            or self.duplicates_remaining
        )

    @property
    def export_status(self) -> str:
        return "PASS" if self.all_clear else "PASS WITH WARNINGS"

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(*asdict(self).values(), self.all_clear, self.export_status)],
            "invalid_emails_remaining long, invalid_dates_remaining long, invalid_phones_remaining long, "
            "outliers_remaining long, duplicates_remaining long, nulls_remaining long, "
            "all_clear boolean, export_status string",
        )


def post_clean_verify(
    df: DataFrame,
    semantics: Mapping[str, str],
    bounds: Sequence[Bounds] | None = None,
    duplicates: int | None = None,
) -> Verification:
    """Count what remains, in one pass plus the duplicate count. Known bounds and counts save passes."""
    if bounds is None:
        bounds = iqr_bounds(df, minimum=1)
    if duplicates is None:
        duplicates = duplicate_count(df).first()["duplicate_count"]
    names = data_columns(df)
    text = [c for c in names if df.schema[c].dataType.typeName() == "string"]
    of_type = {t: [c for c in text if semantics.get(c) == t] for t in ("email", "date", "phone")}
    judged = emails.with_normal_emails(df, {f"__email_{c}": c for c in of_type["email"]})
    judged = phones.with_e164(judged, {f"__phone_{c}": c for c in of_type["phone"]})

    def lost(kind: str) -> list[Column]:
        return [
            F.count_if(col(c).isNotNull() & col(f"__{kind}_{c}").isNull()) for c in of_type[kind]
        ]

    undated = [
        F.count_if(col(c).isNotNull() & ~dates.is_strict_date(strip(col(c)))) for c in of_type["date"]
    ]

    def total(counts: list) -> Column:
        return sum(counts, F.lit(0)).cast("long")

    row = judged.agg(
        total(lost("email")).alias("emails"),
        total(undated).alias("dates"),
        total(lost("phone")).alias("phones"),
        total([F.count_if(b.beyond()) for b in bounds]).alias("outliers"),
        total([F.count_if(is_missing(df, c)) for c in names]).alias("nulls"),
    ).first()
    return Verification(
        row["emails"], row["dates"], row["phones"], row["outliers"], duplicates, row["nulls"]
    )
