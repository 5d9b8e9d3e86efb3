"""Clean a table end to end, in a fixed order of steps, and report what was done.

types -> drop -> exact and fuzzy deduplication -> dates -> e-mails -> phones -> cities -> ages -> missing
values -> text -> outliers -> deduplication -> verification. The semantic types that steer the cell
cleaners are those found before the first step.

Each stretch between two decisions is one lazy chain; its result is written once to the staging folder, where the same
pass counts what the report needs, and the next decision reads only the columns it needs from there.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import columns, dedup, dictionary, fuzzy, impute, outliers, report
from ..operators.profile import ROW_ID, classes, col, data_columns
from ..operators.scoring import improvement_percent
from ..operators.semantics import detect_semantics, is_age_name
from ..operators.verify import Verification, post_clean_verify
from ..session import Staging
from .diagnose import FUZZY_KEY_TYPES, Diagnosis, diagnose
from .overrides import Overrides


@dataclass
class CleanResult:
    """The cleaned table with its report."""

    df: DataFrame
    before: Diagnosis
    after: Diagnosis
    steps: list[str]
    metrics: dict[str, int]
    verification: Verification
    staging: Staging

    @property
    def quality_before(self) -> int:
        return self.before.quality_score

    @property
    def quality_after(self) -> int:
        return self.after.quality_score

    @property
    def quality_improvement_pct(self) -> float:
        return improvement_percent(self.quality_before, self.quality_after)

    def metrics_frame(self) -> DataFrame:
        return report.metrics_frame(self.df.sparkSession, self.metrics)

    def steps_frame(self) -> DataFrame:
        return report.steps_frame(self.df.sparkSession, self.steps)

    def summary(self) -> tuple[DataFrame, DataFrame]:
        return report.summary_frames(self.df.sparkSession, self.metrics, self.after.columns())

    def discard(self) -> None:
        """Delete the staged tables, the cleaned one included; write it out first."""
        self.staging.discard()


def optimize(
    df: DataFrame,
    overrides: Mapping[str, str] | Overrides | None = None,
    order_by: str | None = None,
    semantic_overrides: Mapping[str, str] | None = None,
    fuzzy_dedup: bool = True,
    fuzzy_audit: bool = True,
    fuzzy_method: str = "indel",
    city_method: str = "weighted",
) -> CleanResult:
    """Run the cleaning steps on a table.

    ``order_by`` names a unique integer column that defines row order; without one, rows keep the order of
    their files. ``fuzzy_dedup=False`` keeps rows whose key merely resembles an earlier one;
    ``fuzzy_audit=False`` skips the near-duplicate counts of the two diagnoses; ``fuzzy_method`` and
    ``city_method`` are as in the fuzzy operators and :func:`dictionary.correct_names`.
    """
    spark = df.sparkSession
    staging = Staging(spark)
    choice = Overrides.parse(overrides, df.columns)
    metrics = dict.fromkeys([*report.METRICS, *report.MORE_METRICS], 0)
    steps: list[str] = []

    # one shuffle of whole rows serves the duplicate count and the deduplication
    df, counts = staging.write_counted(dedup.with_row_id(df, order_by), "input")
    rows = counts["rows"]
    distinct, counts = staging.write_counted(dedup.drop_exact_duplicates(df), "distinct")
    left = counts["rows"]
    before = diagnose(
        df, semantic_overrides, fuzzy_audit, fuzzy_method, duplicates=rows - left,
        staging=staging,
    )
    initial = before.semantics
    metrics["rows_before"] = rows

    # types, columns to drop
    gone = [c for c in df.columns if c in choice.dropped and c != ROW_ID]
    # the gates look at all rows, the conversion then applies to the distinct ones
    gates = columns.type_gates(df, {c: s for c, s in initial.items() if c not in gone})
    converted = {c: new for c, (_, new) in gates.items()}
    df = columns.apply_types(distinct, gates)
    for c, new in converted.items():
        steps.append(f"Converted text column '{c}' to {'numeric' if new == 'double' else new} values.")
    metrics["types_converted"] = len(converted)
    df = columns.drop_columns(df, gone)
    steps += [f"Dropped column '{c}' as requested." for c in gone]
    if not data_columns(df):
        raise ValueError("every column is dropped")
    choice.check_fill(classes(df))

    # deduplication; dropped and converted columns may have made more rows equal
    if gone or converted:
        df, counts = staging.write_counted(dedup.drop_exact_duplicates(df), "typed")
        left = counts["rows"]
    metrics["duplicates_dropped"] = rows - left
    if left < rows:
        steps.append(f"Removed {rows - left} exact duplicate row(s).")
    rows = left
    kinds = classes(df)
    key = next(
        (
            c for c in data_columns(df)
            if kinds[c] == "string" and initial[c] in FUZZY_KEY_TYPES and before.stats.columns[c].unique > 2
        ),
        None,
    )
    if fuzzy_dedup and key:
        matcher = before.matcher
        if matcher is None or matcher.key != key:
            matcher = fuzzy.Matcher(df, key, ROW_ID, fuzzy_method, staging=staging)
        df, counts = staging.write_counted(matcher.drop_similar(df), "fuzzy")
        left = counts["rows"]
        metrics["fuzzy_duplicates_dropped"] = rows - left
        if left < rows:
            steps.append(f"Removed {rows - left} fuzzy duplicate row(s) by '{key}'.")
        rows = left

    # cells: one projection with status columns, staged once; the same pass counts the statuses
    text = {t: [c for c in data_columns(df) if initial[c] == t and kinds[c] == "string"]
            for t in ("date", "email", "phone", "city")}
    date_modes = {c: choice.date_modes.get(c, "nullify") for c in text["date"]}
    email_modes = {c: choice.email_modes.get(c, "flag") for c in text["email"]}
    marks: dict[str, list[tuple[str, str]]] = {t: [] for t in ("date", "email", "phone", "city", "age")}

    def mark(kind: str, column: str) -> str:
        name = f"__{kind}_status_{len(marks[kind])}"
        marks[kind].append((column, name))
        return name

    names = data_columns(df)
    if date_modes:
        df = columns.standardize_dates(df, date_modes, {c: mark("date", c) for c in date_modes})
    for c, mode in email_modes.items():
        # rows of a rejected address leave after the counting
        df = columns.clean_emails(df, c, "flag" if mode == "remove" else mode, mark("email", c))
    for c in text["phone"]:
        df = columns.clean_phones(df, c, mark("phone", c))
    for c in text["city"]:
        df = dictionary.correct_names(df, c, staging, method=city_method, changed_flag=mark("city", c))
    doomed = F.lit(False)
    for c, name in marks["email"]:
        if email_modes[c] == "remove":
            doomed = doomed | F.coalesce(F.col(name) == "invalid", F.lit(False))
    ages = [c for c in names if is_age_name(c) or initial[c] == "age"]
    if any(kinds[c] == "string" for c in ages):
        df = columns.coerce_ages(df, ages, among=~doomed)
    ages = [c for c in ages if classes(df)[c] in ("integer", "float")]
    if ages:
        df = columns.clean_ages(df, ages, {c: mark("age", c) for c in ages})
    stays = ~F.col("__removed")
    wanted: dict[str, Column] = {}
    for kind, statuses, scope in (
        ("date", ("converted", "rejected"), F.lit(True)),
        ("email", ("valid", "corrected", "invalid"), F.lit(True)),
        ("phone", ("valid", "corrected", "unknown", "invalid"), stays),
    ):
        for _, name in marks[kind]:
            wanted |= {f"{name}:{s}": (F.col(name) == s) & scope for s in statuses}
    for kind in ("city", "age"):
        wanted |= {f"{name}:true": F.col(name) & stays for _, name in marks[kind]}
    wanted["removed"] = F.col("__removed")
    df, counts = staging.write_counted(
        df.withColumn("__removed", doomed), "cells", **{name: F.count_if(c) for name, c in wanted.items()})
    before.matcher = None
    staging.discard(keep=("cells",))  # nothing reads the earlier stages any more

    for c, name in marks["date"]:
        good, bad = counts[f"{name}:converted"], counts[f"{name}:rejected"]
        metrics["dates_detected"] += good + bad
        metrics["dates_standardized"] += good
        metrics["dates_rejected"] += bad
        if good + bad:
            fate = "emptied" if date_modes[c] == "nullify" else "kept"
            steps.append(f"Date column '{c}': {good} of {good + bad} as YYYY-MM-DD, {bad} invalid {fate}.")
    for c, name in marks["email"]:
        valid, fixed, bad = (counts[f"{name}:{s}"] for s in ("valid", "corrected", "invalid"))
        metrics["emails_found"] += valid + fixed + bad
        metrics["emails_valid"] += valid
        metrics["emails_corrected"] += fixed
        metrics["emails_invalid"] += bad
        outcome = {"flag": "emails_flagged", "nullify": "emails_nullified", "remove": "emails_removed"}
        metrics[outcome[email_modes[c]]] += bad
        if bad:
            steps.append(f"E-mail column '{c}': {valid} valid, {fixed} corrected, {bad} invalid.")
    metrics["emails_rows_removed"] = counts["removed"]
    for c, name in marks["phone"]:
        valid, fixed, unknown, bad = (counts[f"{name}:{s}"] for s in ("valid", "corrected", "unknown", "invalid"))
        metrics["phones_found"] += valid + fixed + unknown + bad
        metrics["phones_valid"] += valid
        metrics["phones_corrected"] += fixed
        metrics["phones_invalid"] += bad
        metrics["phones_flagged_invalid"] += bad
        if fixed:
            steps.append(f"Normalized {fixed} phone number(s) in '{c}' to E.164.")
        if bad:
            steps.append(f"Emptied {bad} invalid phone number(s) in '{c}'.")
    metrics["cities_normalized"] = sum(counts[f"{name}:true"] for _, name in marks["city"])
    if metrics["cities_normalized"]:
        steps.append(f"Normalized {metrics['cities_normalized']} city name(s).")
    for c, name in marks["age"]:
        bad = counts[f"{name}:true"]
        metrics["ages_nullified"] += bad
        if bad:
            steps.append(f"Emptied {bad} age(s) outside 0-120 in '{c}'.")
    df = df.where(stays).select(*[col(c) for c in names], ROW_ID)

    # missing values and text, steered by the cleaned cells
    semantics = detect_semantics(df, overrides=semantic_overrides)
    strategies = {c: choice.fill.get(c, "Auto") for c in names}
    df, filled = impute.impute(df, strategies, semantics)
    for c, (strategy, value, cells) in filled.items():
        metrics["nulls_filled"] += cells
        how = f"custom value '{value}'" if strategy.startswith(impute.CUSTOM) else f"its {strategy}"
        steps.append(f"Filled {cells} missing cell(s) of '{c}' with {how}.")
    df = columns.standardize_text(df, semantics)

    # outliers, then rows that became equal
    bounds = outliers.iqr_bounds(df)
    leaving = [b for b in bounds if choice.outliers.get(b.column) == "remove_row"]
    found, left = outliers.outlier_counts(df, bounds, leaving)
    bounds = [b for b in bounds if found[b.column]]
    done = {
        "clip": ("outliers_clipped", "Clipped {n} outlier(s) in '{c}' to [{lo:.2f}, {hi:.2f}]."),
        "median_replace": ("outliers_replaced", "Replaced {n} outlier(s) in '{c}' by the median {m:.2f}."),
        "remove_row": ("outlier_rows_removed", "Removed the rows of {n} outlier(s) in '{c}'."),
    }
    for b in bounds:
        metric, sentence = done[choice.outliers.get(b.column, "clip")]
        metrics[metric] += found[b.column]
        steps.append(sentence.format(n=found[b.column], c=b.column, lo=b.low, hi=b.high, m=b.median))
    df = outliers.treat_outliers(df, bounds, choice.outliers)
    df, counts = staging.write_counted(dedup.drop_exact_duplicates(df), "final")
    staging.discard(keep=("final",))
    metrics["rows_after"] = counts["rows"]
    if metrics["rows_after"] < left:
        again = left - metrics["rows_after"]
        metrics["duplicates_dropped"] += again
        steps.append(f"Removed {again} row(s) that cleaning had made equal.")

    # verification of the finished table
    after = diagnose(
        df, semantic_overrides, fuzzy_audit, fuzzy_method, duplicates=0, staging=staging
    )
    after.matcher = None
    after.audit.dates_rejected = metrics["dates_rejected"]
    verification = post_clean_verify(df, after.semantics, after.bounds, after.audit.duplicate_count)
    for kind, metric in (("email", "emails_remaining"), ("phone", "phones_remaining")):
        metrics[metric] = sum(after.stats.columns[c].values for c in names if initial[c] == kind)
    staging.discard(keep=("final",))
    return CleanResult(df.drop(ROW_ID), before, after, steps, metrics, verification, staging)

