"""Nearest-dictionary lookup, and city normalisation built on it.

Short lists of names travel as a constant, and every distinct text is scored against them behind a bound of shared letters; of a
table of names, texts meet those they share bigrams with (:mod:`.lookup`). The corrections that result are joined back by text — as a broadcast only when they were
counted and found few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.similarity import nearest_levenshtein, nearest_weighted
from ..functions.text import strip
from ..session import Staging
from . import lookup
from .profile import col

BROADCAST_ROWS = 100_000


def nearest_names(
    df: DataFrame,
    column: str,
    names: Sequence[str] | DataFrame = rules.CITIES,
    cutoff: float = rules.CITY_FIX_SCORE,
    method: str = "weighted",
) -> DataFrame:
    """(value, match, score) for every distinct trimmed text; match is NULL below the cut-off.

    ``weighted`` is the case-sensitive weighted ratio; ``levenshtein`` a plain Spark expression. Equal
    scores go to the earlier name. A dictionary of any length may come as a DataFrame ``(name, rank)`` for the weighted score.
    """
    if isinstance(names, DataFrame):
        if method != "weighted":
            raise ValueError("a dictionary as a DataFrame needs the weighted score")
        return lookup.nearest(df, column, names, cutoff)
    values = (
        df.select(strip(col(column)).alias("value")).where(F.col("value").isNotNull()).distinct()
    )
    if method == "levenshtein":
        best = nearest_levenshtein(F.col("value"), names)
        close = best["score"] >= cutoff
        return values.select(
            "value", F.when(close, best["match"]).alias("match"), F.when(close, best["score"]).alias("score")
        )
    if method != "weighted":
        raise ValueError(f"unknown method {method!r}")
    best = nearest_weighted(names, cutoff).asNondeterministic()(F.col("value"))
    return values.select("value", best.alias("best")).select("value", "best.match", "best.score")


def correct_names(
    df: DataFrame,
    column: str,
    staging: Staging,
    names: Sequence[str] = rules.CITIES,
    cutoff: float = rules.CITY_FIX_SCORE,
    method: str = "weighted",
    changed_flag: str | None = None,
) -> DataFrame:
    """Replace each text by its nearest name where one is close enough, and trim the others.

    ``changed_flag`` names an extra boolean column that marks the corrected cells.
    """
    # staged before it is filtered: a filter on the match would be pushed below the distinct
    nearest = staging.write(nearest_names(df, column, names, cutoff, method), "nearest")
    fixes = nearest.where("match <> value").select(
        F.col("value").alias("__value"), F.col("match").alias("__match")
    )
    if fixes.count() <= BROADCAST_ROWS:
        fixes = F.broadcast(fixes)
    joined = df.join(fixes, strip(col(column)) == F.col("__value"), "left")
    out = [
        F.coalesce(F.col("__match"), strip(col(column))).alias(c) if c == column else col(c)
        for c in df.columns
    ]
    if changed_flag:
        out.append(F.col("__match").isNotNull().alias(changed_flag))
    return joined.select(*out)
