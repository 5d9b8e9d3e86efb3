"""Running totals within groups of any size.

A window over a whole group would put a hot group into one task. Here a group is cut into buckets by the leading
digits of a shuffled order key; windows run within buckets, and each bucket's offset comes from the small table of
bucket totals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows a bucket should hold at most, if all rows were one group.
BUCKET_ROWS = 50_000


def shuffle_key(*parts: str) -> Column:
    """A hexadecimal order key that reruns reproduce: MD5 of the parts as text, nulls as empty."""
    return F.md5(F.concat_ws("/", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]))


def digits_for(rows: int) -> int:
    """Hexadecimal digits that cut ``rows`` rows into buckets of about ``BUCKET_ROWS``, two at least."""
    return max(2, math.ceil(math.log(max(1, rows) / BUCKET_ROWS, 16)))


def running_total(df: DataFrame, group: str, order: str, value: str, total: str, digits: int, *ties: str) -> DataFrame:
    """Add ``total``: the sum of ``value`` over the rows of the same ``group`` up to and with this one.

    Rows are ordered by the hexadecimal key ``order``, then ``ties``. A null group is a group. ``df`` is read twice,
    so callers pass a written table.
    """
    cut = df.withColumn("_bucket", F.substring(order, 1, digits))
    sums = cut.groupBy(F.col(group).alias("_g"), F.col("_bucket").alias("_b")).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_g", "_b", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(group, "_bucket").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.withColumn("_within", F.sum(value).over(within))
    joined = rows.join(offsets, rows[group].eqNullSafe(offsets["_g"]) & (rows["_bucket"] == offsets["_b"]))
    return joined.withColumn(total, F.col("_offset") + F.col("_within")).drop(
        "_bucket", "_g", "_b", "_offset", "_within"
    )
