"""Nearest names from a dictionary of any length, by an inverted index of bigrams.

Texts and names are cut into bigrams, words padded by blanks, and joined on them; equal bigrams of one text are numbered. A pair
that can reach the cut-off shares a least number of bigrams, or a whole word (a text of one letter: that letter), so a count over
the join leaves few pairs to score. The least number follows from the longest common subsequence that the weighted score needs:
of two pieces with ``s`` characters together and a ratio of ``r``, at most ``(1 - r) s`` characters match nothing, each of which
breaks up at most one and a half of the ``s / 2 - 1`` bigrams a side has. It holds from a cut-off of ``LEAST`` and for names of
``SHORTEST`` characters; below that every text would have to meet every name, which :func:`dictionary.nearest_names` does for short lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import weighted_score
from ..functions.text import strip
from .profile import col

LEAST, SHORTEST = 80.0, 4
#: Entries of an index that may be broadcast, once counted; beyond it both sides are shuffled.
BROADCAST_ENTRIES = 200_000
_BLANKS = "[\\t-\\r\\x1c-\\x20\\x85\\xA0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
_WHOLE = 1_000  # what a shared word counts


def _bigrams(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), F.lit(1))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _BLANKS), lambda w: w != "")


def _entries(text: Column) -> Column:
    """What a text is found by: ``(key, weight)`` of its bigrams, numbered if they repeat, its words and, if alone, its letter."""
    padded = F.concat(F.lit(" "), F.regexp_replace(text, _BLANKS, " "), F.lit(" "))
    grams = F.concat(_bigrams(padded), F.when(text.rlike("[\\x{0}-\\x{1f}\\x{7f}-\\x{ffff}]|  "), _bigrams(text)).otherwise(F.array().cast("array<string>")))

    def numbered(all_: Column) -> Column:
        return F.transform(all_, lambda g, i: F.concat(g, F.lit("#"), F.size(F.filter(F.slice(all_, 1, i + 1), lambda x: x == g)).cast("string")))

    once = F.transform(F.array(grams), lambda g: F.when(
        F.size(F.array_distinct(g)) == F.size(g), F.transform(g, lambda x: F.concat(x, F.lit("#1")))).otherwise(numbered(g)))[0]
    keys = F.concat(
        F.transform(once, lambda g: F.struct(g.alias("key"), F.lit(1).alias("weight"))),
        F.transform(F.array_distinct(_words(text)), lambda w: F.struct(F.concat(F.lit("="), w).alias("key"), F.lit(_WHOLE).alias("weight"))))
    return keys


def _letters(text: Column) -> Column:
    return F.transform(F.array_distinct(F.split(text, "")), lambda x: F.struct(F.concat(F.lit("^"), x).alias("key"), F.lit(_WHOLE).alias("weight")))


def _sized(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Add the lengths that the bound needs: of the text, of its words, and of its distinct words."""
    words = F.array_join(_words(F.col(text)), " ")
    return df.withColumns({f"{prefix}len": F.length(text), f"{prefix}words": F.length(words),
                           f"{prefix}distinct": F.length(F.array_join(F.array_distinct(_words(F.col(text))), " "))})


def _least_shared(cutoff: float) -> Column:
    """The bigrams a pair must share at least, from the columns ``t…`` and ``c…`` of :func:`_sized`."""
    def kept(ratio: float) -> float:
        return 1.5 * ratio - 1

    whole = (F.col("tlen") + F.col("clen")) * kept(cutoff / 100) - 1
    by_words = (F.col("tdistinct") + F.col("cdistinct")) * kept(cutoff / 95) - 1
    ratio = min(cutoff / 90, 1.0)
    stretch = F.least("tlen", "clen", "twords", "cwords") * (2 / (2 - ratio)) * kept(ratio) - 1
    spread = F.greatest("tlen", "clen") / F.least("tlen", "clen")
    return F.greatest(F.lit(1), F.ceil(F.least(whole, F.when(spread < 1.5, by_words).otherwise(stretch)) - 1e-6))


def candidates(values: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """``(value, name, rank)`` of all pairs that may score ``cutoff`` or more, and a few others.

    ``values (value)`` are distinct texts, ``names (name, rank)`` distinct names of at least ``SHORTEST`` characters.
    """
    if cutoff < LEAST:
        raise ValueError(f"the bound needs a cut-off of {LEAST} or more")
    known = _sized(names, "name", "c")
    listed = known.select("name", "rank", "clen", "cwords", "cdistinct", F.explode(F.concat(_entries(F.col("name")), _letters(F.col("name")))).alias("e"))
    index = listed.select("name", "rank", "clen", "cwords", "cdistinct", "e.key", F.col("e.weight").alias("weight"))
    if index.count() <= BROADCAST_ENTRIES:
        index = F.broadcast(index)
    # no text of more than eight times a name's length scores above 60
    longest = names.agg(F.max(F.length("name"))).first()[0] or 0
    texts = _sized(values.where(F.length("value").between(1, 8 * longest)), "value", "t")
    keys = F.when(F.length("value") == 1, F.concat(_entries(F.col("value")), _letters(F.col("value")))).otherwise(_entries(F.col("value")))
    asked = texts.select("value", "tlen", "twords", "tdistinct", F.explode(keys).alias("e")).select(
        "value", "tlen", "twords", "tdistinct", "e.key")
    met = asked.join(index, "key").where(F.greatest("tlen", "clen") <= 8 * F.least("tlen", "clen"))
    shared = met.groupBy("value", "rank").agg(
        F.sum("weight").alias("shared"), *[F.first(c).alias(c) for c in ("name", "tlen", "twords", "tdistinct", "clen", "cwords", "cdistinct")])
    return shared.where(F.col("shared") >= _least_shared(cutoff)).select("value", "name", "rank")


def nearest(df: DataFrame, column: str, names: DataFrame, cutoff: float) -> DataFrame:
    """``(value, match, score)`` for every distinct trimmed text of a column; match and score are NULL below the cut-off.

    ``names (name, rank)`` is the dictionary; equal scores go to the lower rank, null names are ignored, and of a name that repeats
    the lowest rank counts. The score is the weighted one of :func:`rinsework.functions.similarity.weighted_scores`.
    """
    values = df.select(strip(col(column)).alias("value")).where(F.col("value").isNotNull()).distinct()
    wanted = names.where("name IS NOT NULL").groupBy("name").agg(F.min("rank").alias("rank"))
    pairs = candidates(values, wanted, cutoff)
    scored = pairs.withColumn("score", weighted_score(cutoff)(F.col("value"), F.col("name"))).where(F.col("score") >= cutoff)
    best = scored.groupBy("value").agg(F.max(F.struct("score", (-F.col("rank")).alias("order"), "name")).alias("best"))
    found = best.select(F.col("value").alias("__value"), F.col("best.name").alias("match"), F.col("best.score").alias("score"))
    return values.join(found, F.col("value") == F.col("__value"), "left").select("value", "match", "score")
