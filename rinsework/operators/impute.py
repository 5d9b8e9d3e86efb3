"""Filling missing values: every fill value comes from one profile, then one projection applies them all."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .profile import (
    ColumnStats, TableStats, add_modes, add_quartiles, col, collect_stats, is_missing,
)

STRATEGIES = ("Auto", "Skip", "Drop", "Median", "Mean", "Mode")
CUSTOM = "Custom:"


def recommend(stats: ColumnStats, semantic: str) -> str:
    """Median for skewed numbers, Mean for other numbers, Skip for e-mail/phone/date, else Mode."""
    if stats.kind in ("integer", "float"):
        return "Median" if abs(round(stats.skewness or 0.0, 2)) > 1.0 else "Mean"
    return "Skip" if semantic in ("email", "phone", "date") else "Mode"


def check_strategy(name: str, kind: str, strategy: str) -> None:
    """Raise ValueError for a strategy that is unknown or cannot apply to the column."""
    if strategy.startswith(CUSTOM):
        if kind in ("integer", "float"):
            text = strategy[len(CUSTOM):].strip()
            try:
                float(text)
            except ValueError:
                raise ValueError(f"column {name!r} is numeric, {text!r} is not") from None
    elif strategy not in STRATEGIES:
        raise ValueError(f"unknown fill strategy for {name!r}: {strategy!r}")
    elif strategy in ("Median", "Mean") and kind not in ("integer", "float"):
        raise ValueError(f"column {name!r} is not numeric: cannot fill with its {strategy.lower()}")


def fill_value(stats: ColumnStats, strategy: str) -> Any:
    """The value that replaces missing cells, or None to leave the column alone."""
    if strategy.startswith(CUSTOM):
        text = strategy[len(CUSTOM):].strip()
        return float(text) if stats.kind in ("integer", "float") else text
    if strategy == "Median":
        return None if stats.median is None else round(stats.median, 4)
    if strategy == "Mean":
        return None if stats.mean is None else round(stats.mean, 4)
    if strategy == "Mode":
        if stats.mode is None or stats.kind not in ("integer", "float"):
            return stats.mode
        if stats.kind == "integer":
            return int(stats.mode)
        return Decimal(stats.mode) if stats.type.startswith("decimal") else float(stats.mode)
    return None


def filled(df: DataFrame, name: str, value: Any) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.IntegralType, T.FractionalType, T.DecimalType)):
        if isinstance(value, Decimal) or isinstance(dtype, T.IntegralType) and float(value).is_integer():
            exact = value if isinstance(value, (int, Decimal)) else int(value)
            fill = F.lit(str(exact)).cast(dtype)
        else:
            return F.when(is_missing(df, name), F.lit(float(value))).otherwise(col(name).cast("double"))
    elif isinstance(dtype, T.StringType):
        fill = F.lit(str(value))
    else:
        fill = F.lit(value).try_cast(dtype)
    return F.when(is_missing(df, name), fill).otherwise(col(name))


def impute(
    df: DataFrame,
    strategies: Mapping[str, str],
    semantics: Mapping[str, str] | None = None,
    stats: TableStats | None = None,
) -> tuple[DataFrame, dict[str, tuple[str, Any, int]]]:
    """Fill the named columns; returns the table and ``{column: (strategy, value, cells filled)}``.

    ``Auto`` follows the recommendation for the column's semantic type. One pass finds missing cells, means and
    skewness; medians and modes are computed only for the columns that are to be filled with them.
    """
    if stats is None:
        stats = collect_stats(
            df.select(*[col(c) for c in df.columns if c in strategies]), frequencies=False, quantiles=False
        )
    chosen: dict[str, str] = {}
    for name, strategy in strategies.items():
        s = stats.columns[name]
        check_strategy(name, s.kind, strategy)
        if s.nulls and s.kind != "other":
            auto = strategy == "Auto"
            chosen[name] = recommend(s, (semantics or {}).get(name, "text")) if auto else strategy
    add_quartiles(df, stats, [c for c, k in chosen.items() if k == "Median" and stats.columns[c].median is None])
    add_modes(df, stats, [c for c, k in chosen.items() if k == "Mode" and stats.columns[c].mode is None])

    applied: dict[str, tuple[str, Any, int]] = {}
    changed: dict[str, Column] = {}
    for name, strategy in chosen.items():
        s = stats.columns[name]
        value = fill_value(s, strategy)
        if value is not None:
            changed[name] = filled(df, name, value)
            applied[name] = (strategy, value, s.nulls)
    return df.select(*[changed.get(c, col(c)).alias(c) for c in df.columns]), applied
