"""Mixing sources to target weights by weighted fair queueing.

Documents are shuffled within their source by a hash. A document's virtual finish time is the running number of its
source's words up to its end, divided by the source's target; a source below its target starts over, up to three times.
All (document, pass) items are ranked by finish time, and the mix ends where the budget, the words of all documents, is
reached. Finish times of all sources advance together, so every source comes near its target wherever the cut falls.

Only the cut is searched for in the ranking: counts over equal ranges of finish time narrow it down to a range of few
rows, which is ordered exactly. Nothing else needs the global order, because an item is taken if and only if it's
before the cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rinsework.session import Staging

from .names import unused
from .running import digits_for, running_total, shuffle_key

WEIGHTS = (5, 2, 1)
#: Times a document may be taken.
PASSES = 3
#: Ranges that the search for the cut splits into, and rows that it orders at last.
_RANGES, _FEW = 1_000, 50_000
_SIZE = "regexp_count(text, '[^ \\\\t-\\\\r]+')"


def targets(sizes: DataFrame) -> DataFrame:
    """Add ``rank`` and ``target`` to ``sizes (source, source_size)``, one row for each source.

    Sources by code point, null last, weigh 5, 2, 1, repeating. They share the total by weight; none exceeds three times
    its size, and the excess goes to the others by weight until none is above. The windows run over sources, not rows.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight)
    every = Window.partitionBy()
    # sources in the order in which they reach their limit; the level is the share of one unit of weight
    before = Window.orderBy(F.col("source_size") * PASSES / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every)
    level = (total - PASSES * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = ranked.withColumn("limit", F.col("source_size") * PASSES / F.col("weight")).withColumn("level", level)
    fitting = levels.withColumn("share", F.min(F.when(F.col("level") <= F.col("limit"), F.struct("limit", "rank", "level"))).over(every))
    target = F.least(F.col("source_size") * F.lit(float(PASSES)), F.col("weight") * F.coalesce("share.level", F.lit(0.0)))
    return fitting.select("source", "source_size", "rank", target.alias("target"))


def mix(docs: DataFrame, staging: Staging) -> DataFrame:
    """``(doc_id, source, text_key, size, source_size, target, taken, passes)`` for every row of ``docs (doc_id, text, source)``.

    ``size`` counts words (runs without ASCII white space; a null text has none); ``passes`` says how often the document
    is in the mix, ``taken`` how many words that makes. Ids and sources may be null or repeat; documents without words are
    never taken. All choices come from MD5 of the id, so reruns agree.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("text_key"),
                       F.coalesce(F.expr(_SIZE), F.lit(0)).cast("long").alias("size")).withColumn("order", shuffle_key("doc_id"))
    rows = staging.write(rows, "sizes")
    sizes = staging.write(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    counted = rows.count()
    running = running_total(rows, "source", "order", "size", "upto", digits_for(counted), "doc_id", "size")
    named = sizes.withColumnRenamed("source", "_source")
    timed = running.join(named, running["source"].eqNullSafe(named["_source"]))
    timed = staging.write(timed.drop("_source", "order"), "timed")

    finish = "({pass} * source_size + upto) / target"
    items = timed.where("size > 0 AND target > 0").select(
        "size", "rank", "upto", "source_size", "target", F.explode(F.expr("sequence(0, least(2, cast(ceil(target / source_size) as int) - 1))")).alias("pass")
    ).select("size", "rank", F.expr(finish.format(**{"pass": "pass"})).alias("finish"))
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cut = _cut(items, budget)
    passes = sum(
        ((F.expr(finish.format(**{"pass": k})) < cut[0]) | ((F.expr(finish.format(**{"pass": k})) == cut[0]) & (F.col("rank") <= cut[1])))
        .cast("long") * (F.lit(k) < F.ceil(F.col("target") / F.col("source_size"))).cast("long")
        for k in range(PASSES)
    )
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), passes).otherwise(F.lit(0)).cast("long")
    out = timed.withColumn("passes", taken)
    return out.select("doc_id", "source", "text_key", "size", "source_size", "target",
                      (F.col("size") * F.col("passes")).alias("taken"), "passes")


def mixed(docs: DataFrame, staging: Staging) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as :func:`mix` takes it. All columns stay, whatever their names.

    Rows that agree in ``doc_id``, ``source`` and text are copies of one row, which comes as often as all of them.
    """
    d, s, t, n = unused(docs.columns, "_d", "_s", "_t", "_n")
    chosen = mix(docs, staging).where("passes > 0").groupBy("doc_id", "source", "text_key").agg(F.sum("passes").alias("passes"))
    chosen = chosen.select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("text_key").alias(t), F.col("passes").alias(n))
    same = (docs["doc_id"].eqNullSafe(chosen[d]) & docs["source"].eqNullSafe(chosen[s])
            & (F.xxhash64(docs["text"]) == chosen[t]))
    rows = docs.join(chosen, same).dropDuplicates([d, s, t])
    return rows.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*[docs[c] for c in docs.columns])


def _cut(items: DataFrame, budget: int) -> tuple[float, int]:
    """The last (finish time, source rank) in ascending order whose running size is within the budget; (-1, 0) if none is."""
    before, lo, hi = 0, 0.0, items.agg(F.max("finish")).first()[0]
    if hi is None:
        return -1.0, 0
    hi = hi * (1 + 1e-9) + 1e-9
    while True:
        width = (hi - lo) / _RANGES
        inside = items.where((F.col("finish") >= lo) & (F.col("finish") < hi))
        slot = F.least(F.floor((F.col("finish") - lo) / width), F.lit(_RANGES - 1)).alias("slot")
        sums = inside.groupBy(slot).agg(F.sum("size").alias("size"), F.count("*").alias("n"),
                                        F.min("finish").alias("first"), F.max("finish").alias("last"))
        running = F.sum("size").over(Window.orderBy("slot"))  # at most _RANGES rows
        after = sums.withColumn("upto", running + before).orderBy("slot").where(F.col("upto") > budget).first()
        if after is None:
            # all of it fits
            top = inside.agg(F.max(F.struct("finish", "rank")).alias("m")).first()["m"]
            return top["finish"], top["rank"]
        before = after["upto"] - after["size"]
        narrow = (after["first"], after["last"])
        if after["n"] <= _FEW or narrow[0] == narrow[1]:
            break
        lo, hi = narrow[0], max(narrow[1] * (1 + 1e-15), narrow[1] + 5e-324)
    last = items.where((F.col("finish") >= narrow[0]) & (F.col("finish") <= narrow[1]))
    upto = F.sum("size").over(Window.orderBy("finish", "rank")) + before
    fits = last.withColumn("upto", upto).where(F.col("upto") <= budget).agg(F.max(F.struct("finish", "rank")).alias("m")).first()["m"]
    if fits is not None:
        return fits["finish"], fits["rank"]
    lower = items.where(F.col("finish") < narrow[0]).agg(F.max(F.struct("finish", "rank")).alias("m")).first()["m"]
    return (lower["finish"], lower["rank"]) if lower is not None else (-1.0, 0)
