"""Row identity and exact deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import ROW_ID, col, data_columns, duplicate_count

#: Bits of the bitmap that marks fingerprints which occur more than once.
FINGERPRINT_BITS = 1 << 28


def with_row_id(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """Add the row id that defines "first". A unique integer column may serve as it.

    Without one the id follows the order of the files; add it directly on a scan and stage the result, so
    that every later step sees the same ids.
    """
    if ROW_ID in df.columns:
        return df
    rid = col(order_by).cast("long") if order_by else F.monotonically_increasing_id()
    return df.select("*", rid.alias(ROW_ID))


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """One row per distinct combination of the data columns, NULLs being equal; the first row survives.

    Copies collapse before the shuffle, so a row repeated across a third of the table costs one row per
    task. With a row id the smallest one is kept, otherwise any copy, since copies are identical.
    """
    keys = [col(c) for c in data_columns(df)]
    if ROW_ID not in df.columns:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).drop("__n").select(*df.columns)
    return df.groupBy(*keys).agg(F.min(ROW_ID).alias(ROW_ID)).select(*[col(c) for c in df.columns])


def drop_exact_duplicates_by_fingerprint(df: DataFrame, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """What :func:`drop_exact_duplicates` returns, while rows that are certainly unique don't travel.

    Equal rows have equal 64-bit fingerprints. Those that occur twice are marked in a bitmap of ``bits`` bits, which is broadcast
    (32 MB at most by default); rows whose bit is clear stay where they are, and only the others are shuffled and compared in
    full, so collisions cost work but change nothing. ``df`` is read three times: pass a scan or a staged table.
    """
    sure, suspects = _by_fingerprint(df, bits)
    return sure.unionByName(drop_exact_duplicates(suspects))


def duplicate_count_by_fingerprint(df: DataFrame, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """What :func:`profile.duplicate_count` returns, from fingerprints of all rows and the whole rows of suspects only."""
    sure, suspects = _by_fingerprint(df, bits)
    unique = sure.agg(F.count(F.lit(1)).alias("rows"), F.lit(0).cast("long").alias("duplicate_count"))
    both = unique.unionByName(duplicate_count(suspects))
    return both.agg(F.sum("rows").alias("rows"), F.sum("duplicate_count").alias("duplicate_count"))


def _by_fingerprint(df: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows that no other row equals, and those that may have equals."""
    place = F.pmod(fingerprint(df), F.lit(bits))
    prints = df.select(fingerprint(df).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = prints.select(F.pmod("h", F.lit(bits)).alias("place"))
    marks = repeated.groupBy(F.bitmap_bucket_number("place").alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("__bits"))
    # at most bits / 32,768 rows of 4 KB
    marked = df.withColumn("__place", place).withColumn("__bucket", F.bitmap_bucket_number("__place"))
    marked = marked.join(F.broadcast(marks), "__bucket", "left")
    bit = "bitmap_bit_position(__place)"
    byte = f"cast(conv(hex(substring(__bits, cast({bit} div 8 as int) + 1, 1)), 16, 10) as bigint)"
    suspect = F.coalesce(F.expr(f"bit_get({byte}, cast({bit} % 8 as int)) = 1"), F.lit(False))
    columns = [col(c) for c in df.columns]
    return marked.where(~suspect).select(*columns), marked.where(suspect).select(*columns)


def fingerprint(df: DataFrame) -> Column:
    """A 64-bit hash of the data columns; equal rows have equal ones, NULLs being equal."""
    return F.xxhash64(*[col(c) for c in data_columns(df)])
