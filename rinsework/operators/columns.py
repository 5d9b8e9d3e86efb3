"""Column cleaners as table operators: each returns the table with one column cleaned.

All are projections (or a filter) over the expressions in ``rinsework.functions`` and hence also run on a
streaming table. A ``status`` argument names an extra column that says what happened to each cell.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, emails, numbers, phones, rules, text
from .profile import classes, col

DATE_MODES = ("nullify", "standardize", "keep")
EMAIL_MODES = ("flag", "nullify", "remove")


def _replace(df: DataFrame, changed: Mapping[str, Column], extra: Mapping[str, Column]) -> DataFrame:
    return df.select(
        *[changed.get(c, col(c)).alias(c) for c in df.columns],
        *[e.alias(name) for name, e in extra.items()],
    )


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop the named columns; names the table does not have are ignored."""
    doomed = set(names)
    return df.select(*[col(c) for c in df.columns if c not in doomed])


def type_gates(df: DataFrame, semantics: Mapping[str, str]) -> dict[str, tuple[Column, str]]:
    """Which text columns become numbers or booleans: ``{column: (converted cell, new type)}``.

    A numeric column needs half of all its rows to convert, a boolean one four fifths, NULLs counting
    against it. All gates share one pass.
    """
    kinds = classes(df)
    tries: dict[str, tuple[Column, float, str]] = {}
    for c, semantic in semantics.items():
        if kinds.get(c) != "string":
            continue
        if semantic in ("numeric_string", "currency"):
            tries[c] = (numbers.numeric_string(col(c)), rules.NUMERIC_GATE, "double")
        elif semantic == "boolean":
            tries[c] = (numbers.boolean_string(col(c)), rules.BOOLEAN_GATE, "boolean")
    if not tries:
        return {}
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(value).alias(f"n{i}") for i, (value, _, _) in enumerate(tries.values())],
    ).first()
    return {
        c: (value, new)
        for i, (c, (value, gate, new)) in enumerate(tries.items())
        if row[f"n{i}"] / max(row["rows"], 1) >= gate
    }


def apply_types(df: DataFrame, gates: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """Convert the columns that passed; cells that do not convert become NULL."""
    return _replace(df, {c: value for c, (value, _) in gates.items()}, {})


def convert_types(df: DataFrame, semantics: Mapping[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """Decide and apply the type conversions; returns the table and the new types by column."""
    gates = type_gates(df, semantics)
    return apply_types(df, gates), {c: new for c, (_, new) in gates.items()}


def standardize_dates(
    df: DataFrame, modes: Mapping[str, str], status: Mapping[str, str] | None = None,
    as_type: str = "string", extended: bool = True,
) -> DataFrame:
    """Bring text columns of dates to ``YYYY-MM-DD``; ``modes`` is ``{column: nullify|standardize|keep}``.

    ``as_type`` may be ``date`` or ``timestamp`` instead, in which case nothing unparsable can be kept. Timestamps
    carry the clock time that the cell spells, brought to UTC where it names an offset.
    """
    bad = set(modes.values()) - set(DATE_MODES)
    if bad:
        raise ValueError(f"unknown date mode: {sorted(bad)}")
    status = status or {}
    active = {c: m for c, m in modes.items() if m != "keep"}
    if not active:
        return _replace(df, {}, {name: F.lit(None).cast("string") for name in status.values()})
    parsed = {c: f"__date_{i}" for i, c in enumerate(active)}
    wide = dates.with_parsed_dates(df, {p: c for c, p in parsed.items()}, extended)
    changed = {
        c: dates.standard_date(col(c), F.col(parsed[c]), m) if as_type == "string"
        else F.timestamp_seconds(F.unix_seconds(F.col(parsed[c]).cast("timestamp")) + dates.seconds_of_day(col(c)))
        if as_type == "timestamp" else F.col(parsed[c]).cast(as_type)
        for c, m in active.items()
    }
    extra = {
        name: dates.date_status(col(c), F.col(parsed[c])) if c in active else F.lit(None).cast("string")
        for c, name in status.items()
    }
    return wide.select(
        *[changed.get(c, col(c)).alias(c) for c in df.columns],
        *[e.alias(name) for name, e in extra.items()],
    )


def clean_emails(df: DataFrame, column: str, mode: str = "flag", status: str | None = None) -> DataFrame:
    """Normalise valid addresses; leave (``flag``), empty (``nullify``) or drop the rows of (``remove``)
    invalid ones. Blank cells are left alone."""
    if mode not in EMAIL_MODES:
        raise ValueError(f"unknown e-mail mode: {mode!r}")
    verdict, normal = "__email_status", F.col("__email")
    judged = emails.with_normal_emails(df, {"__email": column})
    judged = judged.select("*", emails.email_status(col(column), normal).alias(verdict))
    if mode == "remove":
        judged = judged.where(F.coalesce(F.col(verdict) != "invalid", F.lit(True)))
    kept = F.lit(None).cast("string") if mode == "nullify" else col(column)
    cleaned = (
        F.when(F.col(verdict).isNull(), col(column)).when(normal.isNotNull(), normal).otherwise(kept)
    )
    return judged.select(
        *[cleaned.alias(c) if c == column else col(c) for c in df.columns],
        *([F.col(verdict).alias(status)] if status else []),
    )


def clean_phones(
    df: DataFrame, column: str, status: str | None = None,
    plans: Sequence[rules.PhoneRule] | DataFrame = rules.PHONE_RULES,
    default_country: str = rules.DEFAULT_COUNTRY, keep_invalid: bool = False,
) -> DataFrame:
    """Bring phone numbers to E.164; invalid ones become NULL (or stay, with ``keep_invalid``). Blank cells and
    numbers of an unassigned calling code (status ``unknown``) are left alone. ``plans`` may be a table of plans."""
    by_table = isinstance(plans, DataFrame)
    wide = (phones.with_e164_by_table if by_table else phones.with_e164)(df, {"__e164": column}, plans, default_country)
    number = F.col("__e164")
    verdict = phones.phone_status(col(column), number)
    kept = F.coalesce(number, col(column)) if keep_invalid else number
    stays = text.is_blank(col(column)) | (number.isNull() & phones.is_unlisted(col(column)))
    cleaned = F.when(stays, col(column)).otherwise(kept)
    return wide.select(
        *[cleaned.alias(c) if c == column else col(c) for c in df.columns],
        *([verdict.alias(status)] if status else []),
    )


def clean_ages(df: DataFrame, columns: Sequence[str], flags: Mapping[str, str] | None = None) -> DataFrame:
    """Empty numeric ages outside 0-120. ``flags`` names boolean columns that mark the emptied cells."""
    return _replace(
        df,
        {c: numbers.age_in_range(col(c)) for c in columns},
        {name: numbers.age_out_of_range(col(c)) for c, name in (flags or {}).items()},
    )


def coerce_ages(df: DataFrame, columns: Sequence[str], among: Column | None = None) -> DataFrame:
    """Turn text columns of ages into numbers where at least half of the rows (those ``among``) convert."""
    kinds = classes(df)
    tries = {c: numbers.to_double(text.strip(col(c))) for c in columns if kinds[c] == "string"}
    if not tries:
        return df
    judged = df if among is None else df.where(among)
    row = judged.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(tries.values())],
    ).first()
    passed = {
        c: v
        for i, (c, v) in enumerate(tries.items())
        if row[f"n{i}"] / max(row["rows"], 1) >= rules.NUMERIC_GATE
    }
    return _replace(df, passed, {})


STRUCTURED = ("email", "phone", "date", "boolean", "numeric_string", "currency", "id")


def standardize_text(df: DataFrame, semantics: Mapping[str, str]) -> DataFrame:
    """Trim every text column; title-case those without structured content."""
    return _replace(
        df,
        {
            c: text.standardize_text(col(c), semantics.get(c, "text") in STRUCTURED)
            for c, kind in classes(df).items()
            if kind == "string"
        },
        {},
    )
