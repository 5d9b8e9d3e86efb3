"""Column profiles that are stored and merged, so that a new day of data doesn't rescan the others.

A profile has one row for each part of a table (a day, a file, a partition) and column: exact counts, extremes and moments, an
HLL sketch of the distinct values and, for numbers, a KLL sketch of the quantiles. Profiles of any parts are merged by their
sketches and sums alone. Distinct counts are off by about ``1.04 / sqrt(2 ** HLL_BITS)`` of their value (one deviation);
quantiles by about ``RANK_ERROR`` of the rows in rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import classes, col, is_missing

HLL_BITS, KLL_SIZE = 12, 400
DISTINCT_ERROR, RANK_ERROR = 1.04 / 2 ** (HLL_BITS / 2), 0.01


def sketch(df: DataFrame, columns: Sequence[str], part: Column | None = None) -> DataFrame:
    """``(part, column, rows, nulls, low, high, mean, m2, distinct_sketch, quantile_sketch)``, a row for each part and column.

    ``part`` says which part a row belongs to; without it the table is one part, named ''. Numbers that are no number count as
    missing; text columns have no extremes, moments and quantiles. One pass, whose shuffle carries sketches only.
    """
    kinds = classes(df)

    def state(c: str) -> Column:
        value = F.when(~is_missing(df, c), col(c))
        number = value.cast("double") if kinds[c] in ("integer", "float") else F.lit(None).cast("double")
        mean = F.avg(number)
        return F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(value.isNull()).alias("nulls"),
            F.min(number).alias("low"), F.max(number).alias("high"), mean.alias("mean"),
            (F.var_pop(number) * F.count(number)).alias("m2"),
            F.hll_sketch_agg(value.cast("string"), HLL_BITS).alias("distinct_sketch"),
            (F.kll_sketch_agg_double(number, KLL_SIZE) if kinds[c] in ("integer", "float") else F.lit(None).cast("binary")).alias("quantile_sketch"),
        )

    named = df.withColumn("__part", F.lit("") if part is None else part.cast("string"))
    states = named.groupBy(F.col("__part").alias("part")).agg(*[state(c).alias(f"s{i}") for i, c in enumerate(columns)])
    return states.select("part", F.inline(F.array(*[f"s{i}" for i in range(len(columns))])))


def merge(profiles: DataFrame, part: Column | None = None) -> DataFrame:
    """Profiles of the same columns in one: a row for each column, and for each new ``part`` if one is given.

    The moments are added up around the common mean, which loses no digits however far parts lie apart.
    """
    named = profiles.withColumn("__part", F.lit("") if part is None else part.cast("string"))
    filled = F.col("rows") - F.col("nulls")
    # moments of a part without numbers take no part
    moments = F.when(F.col("mean").isNotNull(), F.struct(filled.alias("n"), "mean", "m2"))
    merged = named.groupBy(F.col("__part").alias("part"), "column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.collect_list(moments).alias("moments"),  # one entry for each part
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
    )
    n = F.aggregate("moments", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    mean = F.aggregate("moments", F.lit(0.0), lambda a, x: a + x["mean"] * x["n"]) / F.nullif(n, F.lit(0))
    with_mean = merged.withColumn("mean", mean)
    m2 = F.aggregate("moments", F.lit(0.0), lambda a, x: a + x["m2"] + x["n"] * F.pow(x["mean"] - F.col("mean"), F.lit(2)))
    return with_mean.withColumn("m2", F.when(F.col("mean").isNotNull(), m2)).select(*profiles.columns)


def read(profiles: DataFrame, probabilities: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``(part, column, rows, nulls, sparsity, distinct, low, high, mean, std, quantiles)`` of stored profiles, whole or merged."""
    filled = F.col("rows") - F.col("nulls")
    numbers = F.col("mean").isNotNull()
    quantiles = F.array(*[F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(p))) for p in probabilities])
    return profiles.select(
        "part", "column", "rows", "nulls", F.round(F.col("nulls") * 100.0 / F.col("rows"), 2).alias("sparsity"),
        F.hll_sketch_estimate("distinct_sketch").alias("distinct"), "low", "high", "mean",
        F.when(filled > 1, F.sqrt(F.col("m2") / (filled - 1))).alias("std"), F.when(numbers, quantiles).alias("quantiles"))
