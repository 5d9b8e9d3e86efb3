"""Compression of vectors to codes of one byte a part: product quantisation in whole numbers, with value dictionaries.

A component ``x`` becomes the integer ``floor(SCALE * x)``; a vector is cut into ``PARTS`` consecutive parts, and each part is
coded by the nearest entry of its part's codebook. A codebook starts as the parts of the vectors of smallest ids and is
refined ``ROUNDS`` times: parts are assigned to their nearest entry, and an entry becomes the floor of its parts' mean.

Distances come from value dictionaries. For every dimension, a batch's distinct integers are numbered and their squared
differences to that dimension's value of all entries are tabulated once. The distances of a part to all entries are then a
gather and an add for each of its dimensions, over dictionary numbers.

Plan: the integers are written once, as columns. Each round is one pass that sends the sums and counts of each task's entries to
the shuffle, as many rows as there are entries; the driver sees nothing but codebooks, whose size follows from the
parameters and the dimensions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinsework.session import Staging

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Integers end here, so that squared distances of parts of up to 256 dimensions are exact in 64 bits.
LIMIT = 1 << 26
#: Vectors whose distances are held at once.
_TILE = 2_048
_FINITE = "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"

Codebooks = list[np.ndarray]


def cuts(dims: int, parts: int = PARTS) -> list[slice]:
    """Consecutive parts of equal length, or as equal as ``dims`` allows."""
    return [slice(dims * k // parts, dims * (k + 1) // parts) for k in range(parts)]


def digest(books: Codebooks) -> str:
    """SHA-256 of all entries' components by part, entry and position, as decimal text."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def dictionary(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct integers, ascending, and the number of each value among them."""
    low = int(values.min())
    width = int(values.max()) - low + 1
    if width > 1 << 20:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(width, dtype=bool)
    seen[values - low] = True
    return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[values - low]


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part, the number of its nearest entry (the lower one of equals) and its squared distance."""
    n, width = values.shape
    best, error = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if not n or not width:
        return best, error
    reach = max(int(values.max()), int(book.max())) - min(int(values.min()), int(book.min()))
    kind = np.int32 if reach * reach * width < 1 << 31 else np.int64
    coded = [dictionary(values[:, k]) for k in range(width)]
    tables = [((known[:, None] - book[:, k]) ** 2).astype(kind) for k, (known, _) in enumerate(coded)]
    part = np.empty((min(n, _TILE), len(book)), dtype=kind)
    for a in range(0, n, _TILE):
        rows = slice(a, min(a + _TILE, n))
        total = tables[0][coded[0][1][rows]]
        for table, (_, codes) in zip(tables[1:], coded[1:]):
            total += table.take(codes[rows], axis=0, out=part[: len(total)], mode="clip")
        best[rows] = total.argmin(axis=1)
        error[rows] = total[np.arange(len(total)), best[rows]]
    return best, error


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), -1)


def _sums(books: Codebooks, dims: int):
    """Per task: count and componentwise sum of the parts that are nearest to each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = cuts(dims, len(books))
        counts = [np.zeros(len(b), dtype=np.int64) for b in books]
        sums = [np.zeros_like(b) for b in books]
        for batch in batches:
            values = _matrix(batch.column(0))
            for k, part in enumerate(parts):
                best = nearest(values[:, part], books[k])[0]
                counts[k] += np.bincount(best, minlength=len(books[k]))
                np.add.at(sums[k], best, values[:, part])
        for k, book in enumerate(books):
            used = np.flatnonzero(counts[k])
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(np.full(len(used), k), pa.int32()), "entry": pa.array(used, pa.int32()),
                "n": pa.array(counts[k][used], pa.int64()),
                "sums": pa.array(list(sums[k][used]), pa.list_(pa.int64()))})

    return run


def integers(vectors: DataFrame, staging: Staging) -> DataFrame:
    """``(vec_id, label, v)``: the integers of every row whose vector is neither null nor holds null or non-finite components."""
    whole = F.transform("embedding", lambda x: F.least(F.greatest(
        F.floor(x.cast("double") * SCALE), F.lit(float(-LIMIT))), F.lit(float(LIMIT))).cast("int"))
    kept = vectors.where(_FINITE).select(F.col("vec_id").cast("long").alias("vec_id"), "label", whole.alias("v"))
    return staging.write(kept, "integers")


def fit(kept: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """The codebooks of all vectors ``kept (vec_id, v)``, each of ``dims`` integers."""
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    first = np.array([r["v"] for r in start], dtype=np.int64).reshape(len(start), dims)
    books = [first[:, part] for part in cuts(dims, parts)]
    widest = max(b.shape[1] for b in books)
    for _ in range(rounds):
        found = kept.select("v").mapInArrow(_sums(books, dims), "part int, entry int, n long, sums array<long>")
        summed = found.groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(widest)]).alias("sums"))
        books = [b.copy() for b in books]
        for row in summed.collect():  # at most entries times parts
            book = books[row["part"]]
            book[row["entry"]] = np.array(row["sums"][: book.shape[1]], dtype=np.int64) // row["n"]
    return books


def encode(kept: DataFrame, books: Codebooks, dims: int) -> DataFrame:
    """``(vec_id, label, code, error)``: two hexadecimal digits for each part, and the squared distances' sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column(2))
            found = [nearest(values[:, part], book) for part, book in zip(cuts(dims, len(books)), books)]
            codes = np.stack([x[0] for x in found], axis=1).astype(np.uint8)
            text = codes.tobytes().hex()
            step = 2 * len(books)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column(0), "label": batch.column(1),
                "code": pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()),
                "error": pa.array(sum(x[1] for x in found), pa.int64())})

    label = kept.schema["label"].dataType.simpleString()
    return kept.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``codes`` with ``approximate``: the entries that ``code`` names, scaled back. A null code gives null."""
    entries = [F.array(*[F.array(*[F.lit(x / SCALE) for x in entry]) for entry in book.tolist()]) for book in books]
    places = [F.conv(F.substring("code", 2 * k + 1, 2), 16, 10).cast("int") for k in range(len(books))]
    return codes.withColumn("approximate", F.concat(*[F.get(e, p) for e, p in zip(entries, places)]))


def compress(vectors: DataFrame, staging: Staging) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` for every row of ``vectors (vec_id, embedding, label)`` kept.

    Rows whose vector is null or holds null or non-finite components are dropped. Ids may repeat or be null: codebooks
    start from rows by id, nulls last, then by their integers, and every row is coded. ``label_error`` sums the errors of
    rows of one label, null being a label. Vectors of another length have codebooks of their own (parts as equal as can be
    where the length isn't a multiple of ``PARTS``); an empty vector is at distance 0 of entry 0. Integers beyond
    ``LIMIT`` count as ``LIMIT``. An empty table gives an empty result. Other columns of ``vectors`` are not read.
    """
    kept = integers(vectors, staging)
    coded = []
    for dims in sorted(r["dims"] for r in kept.select(F.size("v").alias("dims")).distinct().collect()):
        own = kept.where(F.size("v") == dims)
        books = fit(own, dims)
        coded.append(encode(own, books, dims).withColumn("codebooks_sha256", F.lit(digest(books))))
    none = kept.limit(0).selectExpr("vec_id", "label", "'' AS code", "0L AS error", "'' AS codebooks_sha256")
    rows = staging.write(reduce(DataFrame.union, coded, none), "codes")
    sums = rows.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    joined = rows.join(sums, rows["label"].eqNullSafe(sums["same"]))
    return joined.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
