"""Semantic types: decided by column name, else by rates over all values of a column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, rules
from ..functions.numbers import strip_currency
from ..functions.similarity import nearest_weighted
from ..functions.text import strip
from .profile import classes, col


def by_name(column: str) -> str | None:
    """The type a column name settles, if any; the first matching hint set wins."""
    name = column.lower().replace(" ", "_").replace("-", "_")
    tokens = set(name.split("_")) | {name}
    for semantic, hints in rules.NAME_HINTS:
        if tokens & hints:
            return semantic
        if semantic == "id" and (name.endswith("_id") or name.startswith("id_")):
            return semantic
    return None


def is_age_name(column: str) -> bool:
    return column.lower().replace(" ", "_").replace("-", "_") in dict(rules.NAME_HINTS)["age"]


#: The types that values can decide, tested in this order: (type, shares that must exceed a limit; 1 means all).
DECISIONS: tuple[tuple[str, dict[str, float]], ...] = (
    ("boolean", {"boolean_rate": 1.0}),
    ("email", {"email_rate": 0.5}),
    ("date", {"date_hint_rate": 0.5, "date_rate": 0.65}),
    ("currency", {"number_rate": 0.7, "symbol_rate": 0.3}),
    ("numeric_string", {"number_rate": 0.7}),
    ("phone", {"phone_rate": 0.6}),
)
CITY_RATE, CITY_VALUES = 0.5, 3
#: Texts up to this length are counted before they are judged.
COUNTED_CHARS = 100


def _passes(share: Column, limit: float) -> Column:
    return share == 1 if limit == 1 else share > limit


def semantic_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: how large a share of all its values looks like each type, and the type that decides.

    Copies of a value are counted and judged once; only texts beyond ``COUNTED_CHARS`` are judged where they are, so that they
    needn't travel. Columns without a value have no row.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), strip(col(c).cast("string")).alias("value")) for c in columns])
    values = df.select(F.inline(cells)).where(F.col("value").isNotNull())
    short = F.length("value") <= COUNTED_CHARS
    counted = values.where(short).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.unionByName(values.where(~short).withColumn("n", F.lit(1).cast("long")))
    parsed = dates.with_parsed_dates(counted, {"date": "value"})
    v = F.col("value")
    shares = {
        "boolean_rate": F.lower(v).isin(*rules.TRUE_WORDS, *rules.FALSE_WORDS),
        "email_rate": v.contains("@"),
        "date_hint_rate": v.rlike(rules.DATE_HINT),
        "date_rate": F.col("date").isNotNull(),
        "number_rate": strip_currency(v).rlike(rules.PLAIN_NUMBER),
        "symbol_rate": v.rlike(f"[{rules.CURRENCY_SYMBOLS}]"),
        "phone_rate": v.rlike(rules.PHONE_SHAPE),
    }
    judged = parsed.select("column", "n", *[F.when(test, F.col("n")).otherwise(0).alias(name) for name, test in shares.items()])
    found = judged.groupBy("column").agg(
        F.sum("n").alias("sampled"), *[(F.sum(name) / F.sum("n")).alias(name) for name in shares])
    decided = None
    for semantic, limits in DECISIONS:
        fits = F.lit(True)
        for name, limit in limits.items():
            fits = fits & _passes(F.col(name), limit)
        decided = F.when(fits, semantic) if decided is None else decided.when(fits, semantic)
    return found.withColumn("decided", decided)


def city_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, city_rate): the share of a column's values that resemble a known city, from its distinct values.

    Copies are counted before the comparison. A text more than eight times as long as any name cannot reach the score.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), strip(col(c).cast("string")).alias("value")) for c in columns])
    values = df.select(F.inline(cells)).where(F.col("value").isNotNull())
    short = F.length("value") <= 8 * max(map(len, rules.CITIES)) + 8
    counted = values.groupBy("column", F.when(short, F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    best = nearest_weighted(rules.CITIES, rules.CITY_DETECT_SCORE).asNondeterministic()(F.coalesce("value", F.lit("")))
    matched = counted.select("column", "n", best.alias("best"))
    hits = F.coalesce(F.sum(F.when(F.col("best.match").isNotNull(), F.col("n"))), F.lit(0))
    return matched.groupBy("column").agg((hits / F.sum("n")).alias("city_rate"))


def detect_semantics(df: DataFrame, overrides: Mapping[str, str] | None = None) -> dict[str, str]:
    """Semantic type of every data column.

    Numbers, booleans and dates take the label of their physical type. Text columns are settled by name, else by
    all their values; those that no shape decides are cities if enough values resemble one, else text.
    """
    overrides = overrides or {}
    found, unsettled = {}, []
    for c, kind in classes(df).items():
        if c in overrides:
            found[c] = overrides[c]
        elif kind in ("boolean", "date", "integer", "float"):
            found[c] = kind
        elif kind == "other":
            found[c] = "text"
        else:
            settled = by_name(c)
            if settled is None:
                unsettled.append(c)
            else:
                found[c] = settled
    if unsettled:
        rates = {r["column"]: r for r in semantic_rates(df, unsettled).collect()}
        for c in unsettled:
            found[c] = (rates[c]["decided"] or "text") if c in rates else "unknown"
        maybe = [c for c, r in rates.items() if r["decided"] is None and r["sampled"] >= CITY_VALUES]
        if maybe:
            for r in city_rates(df, maybe).collect():
                if r["city_rate"] > CITY_RATE:
                    found[r["column"]] = "city"
    return {c: found[c] for c in classes(df)}
