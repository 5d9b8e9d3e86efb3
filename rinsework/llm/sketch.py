"""Document fingerprints: threshold-scaled sketches of five-word shingles, in DataFrame expressions only.

A fingerprint holds every distinct shingle hash below the fixed share ``1 / SCALE`` of the hash space, and the smallest
hash of the text whatever its size, so that texts with few words have one too. Hashes are the first 16 hexadecimal digits of MD5, so that
hashes compare as text, and any engine can make them. Two fingerprints of one scale merge by union; containment uses
only hashes below the threshold, which are a fair sample of either text, however unequal their lengths.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
#: One hash in so many is kept.
SCALE = 8
_DIGITS = 16
#: Hashes below this text are kept.
THRESHOLD = format(16**_DIGITS // SCALE, f"0{_DIGITS}x")
_WORD = "[^ \\t-\\r]+"
_FIRST = -(2**63)


def shingles(text: Column) -> Column:
    """The distinct shingle hashes of a text. Texts of one to four words have one shingle, all their words."""
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1)))
        found = F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, SHINGLE), " ")), 1, _DIGITS))
        return F.when(F.size(w) > 0, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(words), hashes)[0]


def sketch(text: Column) -> Column:
    """The sorted hashes that a text's fingerprint keeps; none for a text without words."""
    def keep(found: Column) -> Column:
        low = F.filter(found, lambda h: h < F.lit(THRESHOLD))
        return F.when((F.size(low) == 0) & (F.size(found) > 0), F.array(F.array_min(found))).otherwise(F.array_sort(low))

    return F.transform(F.array(shingles(text)), keep)[0]


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda h: h < F.lit(THRESHOLD))
    return F.when(F.size(low) == 0, F.slice(both, 1, 1)).otherwise(low)


def containment(a: Column, b: Column) -> Column:
    """The estimated share of a's shingles that b has; null if a has no hash below the threshold."""
    low = F.filter(a, lambda h: h < F.lit(THRESHOLD))
    return F.when(F.size(low) > 0, F.size(F.array_intersect(low, b)) / F.size(low))


def likeness(a: Column, b: Column) -> Column:
    """The share of common hashes among all hashes of two sketches; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def _range_of(key: Column, splits: list[int]) -> Column:
    """How many of the ascending splits are at most the key, by binary search."""
    known = F.from_json(F.lit(json.dumps(splits)), "array<bigint>")
    steps = [1 << k for k in range(len(splits).bit_length() - 1, -1, -1)]

    def search(at: Column, step: Column) -> Column:
        inside = (at + step <= len(splits)) & (F.get(known, at + step - 1) <= key)
        return F.when(inside, at + step).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), search)


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """``(doc_id, text, own, next_text, next_own)``: each row with its sketch, beside the next row in ascending ``doc_id``.

    The last row is beside the first. Rows of one id are ordered by text; null ids come first; null texts are empty.
    Texts are shuffled once, into ``ranges`` id ranges of about equal size, each of which is ordered by itself. A copy
    of every range's first row (so many rows as ranges) joins the range before it, as the next of its last row.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = named.withColumn("key", F.coalesce("doc_id", F.lit(_FIRST)))
    shares = [k / ranges for k in range(1, ranges)] or [0.5]
    splits = named.agg(F.percentile_approx("key", shares, 100 * ranges).alias("s")).first()["s"]
    placed = named.withColumn("range", _range_of(F.col("key"), sorted(set(splits or []))))
    lowest = placed.groupBy("range").agg(F.min("key").alias("key"))
    # at most one row for each range is broadcast
    firsts = placed.select("range", "key", "text").join(F.broadcast(lowest), ["range", "key"])
    firsts = firsts.groupBy("range").agg(F.min("text").alias("text"))
    ring = Window.orderBy("range")
    guests = firsts.select(
        F.lit(None).cast("long").alias("doc_id"), "text", F.lit(_FIRST).alias("key"),
        F.coalesce(F.lag("range").over(ring), F.max("range").over(Window.partitionBy())).alias("range"), F.lit(True).alias("guest"))
    every = placed.select("doc_id", "text", "key", "range", F.lit(False).alias("guest")).union(guests)
    sketched = every.repartition("range").withColumn("own", sketch(F.col("text")))
    order = Window.partitionBy("range").orderBy("guest", "key", "text")
    beside = sketched.withColumns({"next_text": F.lead("text").over(order), "next_own": F.lead("own").over(order)})
    return beside.where(~F.col("guest")).select("doc_id", "text", "own", "next_text", "next_own")


def fingerprints(docs: DataFrame, ranges: int) -> DataFrame:
    """Fingerprints of every text, and of the text with its last quarter replaced by the beginning of the next document.

    Columns as the query's contract lists them. Equal texts have equal fingerprints; a text without words has the empty
    one. An empty table gives an empty result; a single document is its own next one.
    """
    rows = with_next(docs, ranges).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(
        F.expr("left(text, n_chars - floor(n_chars / 4))"), F.expr("left(next_text, cast(floor(n_chars / 4) as int))")))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", sketch(F.col("edited")).alias("changed"), "next_own")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("own", ",").alias("fingerprint"),
        F.array_join("changed", ",").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
