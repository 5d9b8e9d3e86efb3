"""Delimited text whose quoted fields hold line breaks, read in parallel.

A line begins outside or inside of a quoted field, and what it does to that is one of four things: nothing, the other state, always
outside, always inside. So the state at any line follows from the last line that fixes it and the parity of the changes since.
Lines are read in the blocks that tasks read anyway; windows run within blocks, a small table of blocks carries the state and
the number of records from one block to the next, and only lines of records that span several lines are shuffled, to be joined.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.profile import ROW_ID
from ..session import Staging


def _leaves_open(line: Column, sep: str) -> Column:
    """Whether a line that begins outside of a quoted field ends inside of one. Quotes inside of unquoted fields open nothing."""
    closed = rf'(^|{sep})"(?:[^"]++|"")*+"(?={sep}|$)'
    return F.regexp_replace(line, closed, "$1").rlike(rf'(^|{sep})"')


def _states(lines: DataFrame, sep: str) -> DataFrame:
    """Add ``after_out`` and ``after_in``: whether the line ends inside of a quoted field, if it begins outside or inside of one."""
    ends = rf'^(?:[^"]++|"")*+"(?={sep}|$)'
    value = F.col("value")
    rest = F.regexp_replace(value, ends, "")
    return lines.withColumns({
        "after_out": value.contains('"') & _leaves_open(value, sep),
        # what follows the field that ends here begins with a separator, or with nothing
        "after_in": ~value.rlike(ends) | _leaves_open(rest, sep),
    })


def records(spark: SparkSession, path: str, staging: Staging, delimiter: str = ",") -> DataFrame:
    """``(file, number, record)``: the records of all files, numbered from 0 within each, the header being one of them.

    Line breaks inside of a record become ``\\n``. A file whose last quoted field never closes ends with a record that holds the rest.
    """
    sep = re.escape(delimiter)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value")
    lines = staging.write(_states(lines, sep), "lines")
    order = Window.partitionBy("file", "block").orderBy("line")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    swap = F.when(F.col("after_out") & ~F.col("after_in"), 1).otherwise(0)
    swaps = F.coalesce(F.sum(swap).over(before), F.lit(0))
    # the state that the last fixing line left, and the swaps that had happened by then
    marked = lines.withColumn("swaps", swaps)
    fixes = F.when(F.col("after_out") == F.col("after_in"), F.struct(F.col("after_in").alias("state"), "swaps"))
    marked = marked.withColumn("fixed", F.last(fixes, ignorenulls=True).over(before))
    odd = lambda c: (c % 2) == 1

    def begins(start: Column) -> Column:
        since = F.when(F.col("fixed").isNotNull(), F.col("swaps") - F.col("fixed.swaps")).otherwise(F.col("swaps"))
        return F.when(F.col("fixed").isNotNull(), F.col("fixed.state")).otherwise(start) != odd(since)

    def ends(inside: Column) -> Column:
        return F.when(inside, F.col("after_in")).otherwise(F.col("after_out"))

    both = marked.withColumns({"in_out": begins(F.lit(False)), "in_in": begins(F.lit(True))})
    both = staging.write(both.withColumns({"end_out": ends(F.col("in_out")), "end_in": ends(F.col("in_in"))}).drop("fixed", "swaps"), "states")
    # a row for each block: what it does to the state, and how many records begin in it in either case
    blocks = both.groupBy("file", "block").agg(
        F.max_by("end_out", "line").alias("after_out"), F.max_by("end_in", "line").alias("after_in"),
        F.count_if(~F.col("in_out")).alias("starts_out"), F.count_if(~F.col("in_in")).alias("starts_in"))
    per_file = Window.partitionBy("file").orderBy("block")
    earlier = per_file.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("swaps", F.coalesce(F.sum(swap).over(earlier), F.lit(0)))
    blocks = blocks.withColumn("fixed", F.last(fixes, ignorenulls=True).over(earlier)).withColumn("start", begins(F.lit(False)))
    blocks = blocks.withColumn("starts", F.when(F.col("start"), F.col("starts_in")).otherwise(F.col("starts_out")))
    blocks = blocks.withColumn("first", F.coalesce(F.sum("starts").over(earlier), F.lit(0)))
    placed = both.join(blocks.select("file", "block", "start", "first"), ["file", "block"])
    placed = placed.withColumn("inside", F.when(F.col("start"), F.col("in_in")).otherwise(F.col("in_out")))
    number = F.col("first") + F.sum(F.when(F.col("inside"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    numbered = placed.select("file", "block", "line", "value", "inside", ends(F.col("inside")).alias("open"), number.alias("number"))
    numbered = staging.write(numbered, "numbered")
    alone = numbered.where("NOT inside AND NOT open").select("file", "number", F.col("value").alias("record"))
    parts = numbered.where("inside OR open").groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("parts"))
    return alone.unionByName(parts.select("file", "number", F.array_join("parts.value", "\n").alias("record")))


def read_records(spark: SparkSession, path: str, staging: Staging, delimiter: str = ",", row_id: bool = True) -> DataFrame:
    """The rows of delimited text with a header, all columns as text, empty cells missing; ``ROW_ID`` follows the order of files and records.

    Rows come in that order, as from Spark's own reader: a preview shows the first ones. Blank records are left out. The header is that of the first file; every file has one.
    """
    found = staging.write(records(spark, path, staging, delimiter), "records")
    options = {"sep": delimiter, "escape": '"', "nullValue": "", "mode": "PERMISSIVE"}
    header = found.where("number = 0").orderBy("file").first()
    if header is None:
        raise ValueError(f"no header in {path}")
    names = spark.read.options(header=True, multiLine=True, **options).csv(spark.sparkContext.parallelize([header["record"]], 1)).columns
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    sizes = found.groupBy("file").agg(F.max("number").alias("n"))
    offsets = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    rows = found.where("number > 0 AND record != ''").join(F.broadcast(offsets), "file")  # a row for each file
    parsed = rows.select(F.from_csv("record", schema, options).alias("r"), (F.col("offset") + F.col("number") - 1).alias(ROW_ID))
    return parsed.orderBy(ROW_ID).select("r.*", *([ROW_ID] if row_id else []))
