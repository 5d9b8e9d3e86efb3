"""Near-duplicate documents by weighted Jaccard similarity of five-word shingles, with BagMinHash signatures.

A shingle that occurs ``w`` times covers the levels ``[0, w)``. The levels are cut into the dyadic blocks [0,1), [1,2),
[2,4), [4,8), …; every (shingle, block) owns a Poisson process whose rate is the block's width, and each point of a
process falls on one of the ``components`` of the signature. A component's value is its earliest point over all levels
a text covers. A block that a text covers whole uses the first point of its process at once; a block that it covers in
part, and all later points, come from splitting the process into halves: a point belongs to one half, the other half
draws its own. Two texts therefore see the same points wherever their levels overlap, so components agree with a
probability equal to the weighted Jaccard similarity, and a count of thousands costs only its logarithm.

Plan: one pass over the texts writes signatures' band keys. Equal texts collapse to one representative. Buckets (equal
band keys) propose the pairs (member, most central member); the exact overlap of each is verified. Buckets whose members
are not all in one class after that are finished exactly: their families are cut into chunks of bounded size, and every
chunk pair that can still link two classes is compared in one task by a matrix product, which returns only links that
connect. Nothing is capped, and no bucket's pairs are listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinsework.session import Staging

from . import words
from .graph import components as connected
from .names import unused

SIMILARITY = 0.8
BANDS, ROWS = 32, 6
#: Documents and shingles in a chunk of a family.
CHUNK_DOCS, CHUNK_SHINGLES = 400, 300_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _uniform(state: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from 64-bit states."""
    return ((state >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def _draw(key: np.ndarray, n: np.ndarray, what: int) -> np.ndarray:
    return words.mix(key + (n.astype(np.uint64) * np.uint64(4) + np.uint64(what)) * _GOLD)


def _node_key(shingle: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    return words.mix(shingle ^ words.mix(low.astype(np.uint64) * np.uint64(2) * _GOLD + width.astype(np.uint64)))


def signatures(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, rows: int, size: int) -> np.ndarray:
    """The signatures of ``rows`` multisets, given as distinct shingles with counts; infinite where a row is empty."""
    best = np.full(rows * size, np.inf)
    ceiling = np.full(rows, np.inf)
    blocks = [(np.arange(len(row)), np.zeros(len(row), dtype=np.int64), 1)]
    low = 1
    while len(row) and low < count.max():
        at = np.flatnonzero(count > low)
        blocks.append((at, np.full(len(at), low), low))
        low *= 2
    at = np.concatenate([b[0] for b in blocks])
    doc, shingle, weight = row[at], shingle[at], count[at]
    low = np.concatenate([b[1] for b in blocks]).astype(np.int64)
    width = np.concatenate([np.full(len(b[0]), b[2], dtype=np.int64) for b in blocks])
    key, step = _node_key(shingle, low, width), np.zeros(len(at), dtype=np.int64)
    time = -np.log(_uniform(_draw(key, step, 0))) / width
    part = _draw(key, step, 1)  # decides the component of the current point, and the half that it falls into
    used = np.zeros(len(at), dtype=bool)
    while len(doc):
        fresh = ~used & (low + width <= weight)  # fully covered: the point counts
        if fresh.any():
            np.minimum.at(best, doc[fresh] * size + (part[fresh] % np.uint64(size)).astype(np.int64), time[fresh])
            used = used | fresh
            ceiling = best.reshape(rows, size).max(axis=1)
        leaf = used & (width == 1)
        step = step + leaf
        time[leaf] -= np.log(_uniform(_draw(key[leaf], step[leaf], 0)))
        part[leaf] = _draw(key[leaf], step[leaf], 1)
        used = used & ~leaf
        split = (width > 1) & (used | (low + width > weight))
        if split.any():
            rest = ~split
            half = width[split] // 2
            right = (_draw(part[split], np.zeros(len(half), dtype=np.int64), 2) >> np.uint64(63)).astype(bool)
            new = [[x[rest] for x in (doc, shingle, weight, low, width, key, step, time, part, used)]]
            for side in (0, 1):
                holds = right == bool(side)
                lo = low[split] + side * half
                k = _node_key(shingle[split], lo, half)
                own = time[split] - np.log(_uniform(_draw(k, np.zeros(len(half), dtype=np.int64), 0))) / half
                new.append([
                    doc[split], shingle[split], weight[split], lo, half, k, np.zeros(len(half), dtype=np.int64),
                    np.where(holds, time[split], own),
                    np.where(holds, part[split], _draw(k, np.zeros(len(half), dtype=np.int64), 1)),
                    np.where(holds, used[split], False),
                ])
            doc, shingle, weight, low, width, key, step, time, part, used = (np.concatenate(x) for x in zip(*new))
        live = (time <= ceiling[doc]) & (low < weight)
        doc, shingle, weight, low, width, key, step, time, part, used = (
            x[live] for x in (doc, shingle, weight, low, width, key, step, time, part, used)
        )
    return best.reshape(rows, size)


def band_keys(signature: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, per_band)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, (len(signature), 1))
    for k in range(per_band):
        key = words.mix(key ^ words.mix(bits[:, :, k] + np.uint64(k + 1)))
    return key.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two lists of shingles, as multisets. Two empty ones are equal."""
    if not len(a) and not len(b):
        return 1.0
    x, m = np.unique(a, return_counts=True)
    y, n = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(m[i], n[j]).sum())
    return both / (len(a) + len(b) - both)


def _sign(bands: int, per_band: int):
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.string()), ("text_key", pa.string()),
                        ("shingles", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            lengths = np.asarray(words.pc.utf8_length(texts))
            for lo, hi in words.slices(lengths):
                part = texts.slice(lo, hi - lo)
                row, shingle, count = words.multisets(part)
                signed = signatures(row, shingle, count, hi - lo, bands * per_band)
                sizes = np.bincount(row, weights=count, minlength=hi - lo).astype(np.int64)
                keys = band_keys(signed, bands, per_band)
                known = sizes > 0
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                    words.pc.if_else(pa.array(known), batch.column(1).slice(lo, hi - lo), ""), pa.array(sizes),
                    pa.ListArray.from_arrays(
                        np.concatenate([[0], np.cumsum(known * bands)]).astype(np.int32), keys[known].ravel()),
                ], schema=schema)

    return run


def _verified(similarity: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            length = np.asarray(words.pc.utf8_length(left)) + np.asarray(words.pc.utf8_length(right))
            keep = []
            for lo, hi in words.slices(length):
                sides = []
                for texts in (left, right):
                    values, owner = words.shingles(texts.slice(lo, hi - lo))
                    sides.append(np.split(values, np.cumsum(np.bincount(owner, minlength=hi - lo))[:-1]))
                keep += [overlap(x, y) >= similarity for x, y in zip(*sides)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(mask), batch.column(1).filter(mask)], schema=schema
            )

    return run


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest position reachable from each of ``n`` positions over the links (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _chunk_links(similarity: float):
    """Links between the documents of two chunks, reduced to one edge for each document that gains one."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids = group["rid"].to_numpy()
        second = group["second"].to_numpy(zero_copy_only=False)
        main = group["main"].to_numpy(zero_copy_only=False)
        row, shingle, count = words.multisets(group["text"].combine_chunks())
        sizes = np.bincount(row, weights=count, minlength=len(ids))
        # the k-th occurrence of a shingle is an element of its own: sets of those overlap as the multisets do
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        element = words.mix(np.repeat(shingle, count) + nth.astype(np.uint64) * _GOLD)
        owner = np.repeat(row, count)
        _, code, seen = np.unique(element, return_inverse=True, return_counts=True)
        shared = seen[code] > 1
        owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1]
        both = np.zeros((len(ids), len(ids)), dtype=np.float32)
        for lo in range(0, int(code.max()) + 1 if len(code) else 0, 4096):
            inside = (code >= lo) & (code < lo + 4096)
            dense = np.zeros((len(ids), 4096), dtype=np.float32)
            dense[owner[inside], code[inside] - lo] = 1
            both += dense @ dense.T
        union = sizes[:, None] + sizes[None, :] - both
        i, j = np.nonzero(np.triu((both >= similarity * union - 1e-6 * union) & (union > 0), 1))
        wanted = ~(main[i] & main[j])
        if second.any():  # two different chunks: pairs within one are compared where it meets itself
            wanted &= second[i] != second[j]
        i, j = i[wanted], j[wanted]
        exact = both[i, j].astype(np.float64) / (sizes[i] + sizes[j] - both[i, j]) >= similarity
        label = _spanning(i[exact], j[exact], len(ids))
        at = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[label[at]], pa.int64()), "b": pa.array(ids[at], pa.int64())})

    return run


def _text_classes(docs: DataFrame, staging: Staging, similarity: float, bands: int, per_band: int) -> DataFrame:
    """``(doc_id, row_key, first)`` for every row with an id: the md5 of its text, and the smallest id in its text's class.

    A class holds the texts that links between texts reach. Its nodes are texts, named by a 64-bit hash (``rid``): one
    ``doc_id`` may have several texts, and what links one of them says nothing about the others.
    """
    named = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("text_key"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    signed = staging.write(
        named.mapInArrow(
            _sign(bands, per_band), "doc_id long, row_key string, text_key string, shingles long, keys array<long>"),
        "signatures",
    )
    by_text = signed.groupBy("text_key").agg(F.min("doc_id").alias("lowest"))
    by_text = staging.write(by_text.withColumn("rid", F.xxhash64("text_key")), "representatives")
    reps = signed.join(by_text.withColumnRenamed("lowest", "doc_id"), ["text_key", "doc_id"])
    reps = reps.groupBy("rid").agg(F.min(F.struct("doc_id", "text_key", "shingles", "keys")).alias("s"))
    reps = staging.write(reps.select("rid", "s.*"), "distinct")
    entries = reps.select("rid", "shingles", F.explode("keys").alias("key"))
    crowded = entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = staging.write(entries.join(crowded, "key").select("key", "rid", "shingles", "size"), "buckets")

    # each text's first trial is the most central text that it shares a bucket with
    central = members.groupBy("rid").agg(F.sum("size").alias("central"))
    scored = members.join(central, "rid")
    pivots = scored.groupBy("key").agg(F.max(F.struct("central", -F.col("rid"))).alias("top"))
    near = scored.join(pivots, "key").select("rid", "top", F.struct("central", -F.col("rid")).alias("own"))
    stars = staging.write(near.where("own != top").groupBy("rid", (-F.col("top.col2")).alias("pivot")).agg(
        F.first("top.central").alias("central")), "stars")
    trials = stars.groupBy("rid").agg(F.max_by("pivot", F.struct("central", -F.col("pivot"))).alias("pivot"))
    trials = staging.write(trials, "trials")

    # one row for each text that takes part, whatever the number of rows that hold it
    involved = stars.select("rid").union(stars.select(F.col("pivot").alias("rid"))).distinct()
    involved = involved.join(reps.select("rid", "doc_id", "text_key"), "rid")
    texts = named.join(involved, ["doc_id", "text_key"]).dropDuplicates(["rid"])
    texts = staging.write(texts.select("rid", "text"), "texts")
    pairs = (
        trials.join(texts, "rid").withColumnRenamed("text", "left")
        .join(texts.select(F.col("rid").alias("pivot"), F.col("text").alias("right")), "pivot")
        .select(F.col("pivot").alias("a"), F.col("rid").alias("b"), "left", "right")
    )
    first = staging.write(pairs.mapInArrow(_verified(similarity), "a long, b long"), "links")
    families = connected(stars.select(F.col("pivot").alias("a"), F.col("rid").alias("b")), staging)
    classes = connected(first, staging)

    # families whose documents are in several classes, and have a pair that wasn't tried: three documents or more
    def labelled(ids: DataFrame, labels: DataFrame, name: str) -> DataFrame:
        found = labels.select(F.col("node").alias("rid"), F.col("component").alias("_c"))
        return ids.join(found, "rid", "left").withColumn(name, F.coalesce("_c", "rid")).drop("_c")

    sized = members.groupBy("rid").agg(F.first("shingles").alias("shingles"))
    placed = staging.write(labelled(labelled(sized, families, "family"), classes, "class"), "placed")
    per_class = placed.groupBy("family", "class").agg(F.count("*").alias("n"), F.sum("shingles").alias("weight"))
    main = F.col("class") == F.col("largest")
    unsettled = per_class.groupBy("family").agg(
        F.count("*").alias("classes"), F.sum("n").alias("docs"), F.max_by("class", F.struct("n", -F.col("class"))).alias("largest"),
    ).where("classes > 1 AND docs > 2").select("family", "largest")

    def chunks(inside: Column) -> Column:
        n, weight = (F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0)) for c in ("n", "weight"))
        return F.greatest(F.ceil(n / CHUNK_DOCS), F.ceil(weight / CHUNK_SHINGLES)).cast("int")

    plan = per_class.join(unsettled, "family").groupBy("family", "largest").agg(
        chunks(main).alias("mains"), chunks(~main).alias("rests"))
    open_docs = placed.join(plan, "family").select("rid", "family", main.alias("main"), "mains", "rests")
    # chunk numbers: the largest class comes after the rest; two chunks of the largest class need no trial
    spot = F.pmod(F.xxhash64("rid"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("rests"))).cast("int")
    partners = F.col("rests") + F.when(F.col("main"), 0).otherwise(F.col("mains")) - 1
    placed_twice = open_docs.withColumn("number", F.when(F.col("main"), F.col("rests")).otherwise(0) + spot).withColumn(
        "other", F.explode(F.sequence(F.lit(0), partners))
    ).select(
        "family", F.least("number", "other").alias("i"), F.greatest("number", "other").alias("j"),
        (F.col("number") > F.col("other")).alias("second"), "main", "rid",
    )
    second = placed_twice.join(texts, "rid").groupBy("family", "i", "j").applyInArrow(
        _chunk_links(similarity), "a long, b long")
    links = first.union(staging.write(second, "later-links"))
    final = connected(links, staging).select(F.col("node").alias("rid"), "component")
    linked = final.union(final.select(F.col("component").alias("rid"), "component")).distinct().join(by_text, "rid")
    linked = staging.write(linked.select("rid", "component", "lowest"), "linked")
    firsts = linked.groupBy("component").agg(F.min("lowest").alias("first"))
    firsts = linked.join(firsts, "component").select("rid", "first")
    placed_texts = by_text.join(firsts, "rid", "left").select("text_key", F.coalesce("first", "lowest").alias("first"))
    return staging.write(signed.select("doc_id", "row_key", "text_key").join(placed_texts, "text_key").drop("text_key"), "classes")


def near_duplicates(
    docs: DataFrame, staging: Staging, similarity: float = SIMILARITY, bands: int = BANDS, per_band: int = ROWS
) -> DataFrame:
    """``(doc_id, class_id)`` for every row of ``docs (doc_id, text)``.

    Texts link if the weighted Jaccard similarity of their five-word shingle multisets is ``similarity`` or more;
    ``class_id`` is the smallest ``doc_id`` reachable over links. Null texts count as empty. Texts without words are
    copies of each other. Rows with a null ``doc_id`` get a null class and link with nothing. Rows that share a
    ``doc_id`` are one document and share a class. Candidates are pairs that agree on a band: at similarity 0.8 a pair is missed with probability 6e-5.
    """
    rows = _text_classes(docs, staging, similarity, bands, per_band)
    # the texts of one document join their classes
    several = rows.groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("_hi")).where("a != _hi")
    joined = connected(rows.join(several, "doc_id").select("a", F.col("first").alias("b")), staging)
    joined = joined.select(F.col("node").alias("first"), "component")
    named_class = rows.join(joined, "first", "left").select("doc_id", F.coalesce("component", "first").alias("class_id"))
    null_ids = docs.where("doc_id IS NULL").select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return named_class.union(null_ids)


def keep_one(docs: DataFrame, staging: Staging, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows whose text has a near copy, over links between texts, under a smaller ``doc_id``.

    Equal rows of a kept id collapse to one. Of an id that repeats with different texts, only the rows go whose own text
    is kept elsewhere. All columns stay, under whatever names; rows with a null ``doc_id`` stay.
    """
    rows = _text_classes(docs, staging, similarity, BANDS, ROWS)
    names = unused(docs.columns, "_dropped", "_key")
    dropped = rows.where("doc_id != first").select("doc_id", "row_key").toDF(*names)
    same = (docs["doc_id"] == dropped[names[0]]) & (F.md5(F.coalesce(docs["text"], F.lit(""))) == dropped[names[1]])
    left = docs.join(dropped.distinct(), same, "left_anti")
    known = left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    return known.unionByName(left.where("doc_id IS NULL"))
