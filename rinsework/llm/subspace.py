"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors of cosine ``c`` or more lie within squared distance ``2 - 2c``. A seeded rotation spreads any structure over
all coordinates; the rotated vector is split into blocks, and each block gets a share of the squared distance in
proportion to its dimensions. If two vectors are within the whole budget, they are within the block's budget in at
least one block. So each block is range-joined by a grid over its leading coordinates, whose cells are as wide as
the block's radius, and every candidate is verified exactly, in double precision, where it is found. A pair that
several blocks find counts in the first of them.

Equal vectors are one point with a weight. A cell is cut into chunks of at most ``CHUNK`` rows by count, and pairs of
chunks meet in tasks of bounded size, which return counts and one connecting edge for each linked point, never the
pairs. So neither a dense cluster nor a common vector makes output grow with its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinsework.session import Staging

from .bagminhash import _spanning
from .graph import components

COSINE = 0.95
#: Dimensions of a block, and of the grid over its leading coordinates.
BLOCK, GRID = 16, 2
#: Rows of a cell that one chunk holds; vectors compared at once.
CHUNK, _TILE = 12_000, 1_024
_SLACK = 1e-9


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix, the same for every call."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dims).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int, block: int = BLOCK) -> list[slice]:
    return [slice(i, min(i + block, dims)) for i in range(0, dims, block)]


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares of tiny or huge numbers stay in range
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(rows, -1)


def _cells(cosine: float, block: int, grid: int):
    schema = pa.schema([("rid", pa.int64()), ("dims", pa.int32()), ("block", pa.int32()), ("cell", pa.string()), ("home", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pa.compute.list_value_length(batch.column(1)))
            for dims in np.unique(sizes):
                own = np.flatnonzero(sizes == dims)
                ids = np.asarray(batch.column(0))[own]
                turned = _unit(_matrix(batch.column(1).take(pa.array(own)), len(own))) @ rotation(int(dims))
                for b, part in enumerate(blocks(int(dims), block)):
                    width = np.sqrt((2 - 2 * cosine) * (part.stop - part.start) / dims) * (1 + _SLACK) + _SLACK
                    axes = min(grid, part.stop - part.start)
                    at = np.floor(turned[:, part.start : part.start + axes] / width).astype(np.int64)
                    for offset in product((-1, 0, 1), repeat=axes):
                        if offset < (0,) * axes:
                            continue  # of two opposite neighbours, one visits the other
                        cells = [",".join(map(str, c)) for c in (at + offset).tolist()]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(ids), pa.array(np.full(len(ids), dims, dtype=np.int32)),
                            pa.array(np.full(len(ids), b, dtype=np.int32)), pa.array(cells),
                            pa.array(np.full(len(ids), not any(offset)))], schema=schema)

    return run


def _compare(cosine: float, block: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        own, n = key[1].as_py(), group.num_rows
        ids, weight = group["rid"].to_numpy(), group["weight"].to_numpy()
        home, second = (group[c].to_numpy(zero_copy_only=False) for c in ("home", "second"))
        given = _matrix(group["embedding"], n)
        unit = _unit(given)
        dims = unit.shape[1]
        turned = unit @ rotation(dims)
        parts = blocks(dims, block)
        limits = np.array([(2 - 2 * cosine) * (p.stop - p.start) / dims + _SLACK for p in parts])
        near = turned[:, parts[own]].astype(np.float32)
        square, one = (near**2).sum(axis=1)[:, None], np.ones((n, 1), dtype=np.float32)
        # one product gives the squared distance less the limit
        asks = np.concatenate([-2 * near, square - np.float32(limits[own] + 1e-5), one], axis=1)
        told = np.concatenate([near, one, square], axis=1).T
        counts, links = np.zeros(n, dtype=np.int64), []
        within = key[3] == key[4]  # else one of the two chunks may be empty
        left, right = (np.arange(n),) * 2 if within else (np.flatnonzero(~second), np.flatnonzero(second))
        for a in range(0, len(left), _TILE):
            i = left[a : a + _TILE]
            for c in range(a if within else 0, len(right), _TILE):
                j = right[c : c + _TILE]
                x, y = np.divmod(np.flatnonzero(asks[i] @ told[:, j] <= 0), len(j))
                x, y = i[x], j[y]
                fit = home[x] | home[y]
                if within and a == c:
                    fit &= x < y
                x, y = x[fit], y[fit]
                for s in range(0, len(x), 50_000):
                    p, q = x[s : s + 50_000], y[s : s + 50_000]
                    close = np.einsum("ij,ij->i", unit[p], unit[q]) >= cosine
                    p, q = p[close], q[close]
                    moved = (turned[p] - turned[q]) ** 2
                    inside = np.stack([moved[:, part].sum(axis=1) for part in parts], axis=1) <= limits
                    first = inside.argmax(axis=1) == own
                    p, q = p[first], q[first]
                    np.add.at(counts, p, weight[q])
                    np.add.at(counts, q, weight[p])
                    links.append((p, q))
        p = np.concatenate([x[0] for x in links] or [np.zeros(0, int)])
        q = np.concatenate([x[1] for x in links] or [np.zeros(0, int)])
        root = _spanning(p, q, n)
        at = np.flatnonzero(counts)
        return pa.table({"a": pa.array(ids[root[at]], pa.int64()), "b": pa.array(ids[at], pa.int64()), "n": pa.array(counts[at], pa.int64())})

    return run


def near_vectors(vectors: DataFrame, staging: Staging, cosine: float = COSINE, block: int = BLOCK, grid: int = GRID) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors (vec_id, embedding)``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. Rows are vectors of their own, whatever their ids: repeated rows link with each other, and different
    vectors of one id link only if they are near. Rows with a null ``vec_id`` link with nothing and belong to no component. Other
    columns aren't read; an empty table gives an empty result.
    """
    keyed = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.struct(
            F.xxhash64(F.lit(1), "embedding").alias("h1"), F.xxhash64(F.lit(2), "embedding").alias("h2")).alias("key"))
    fine = keyed.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0").where(
        "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x != 0)")
    # a point's number is fixed by writing it; ids may repeat
    points = staging.write(fine.groupBy("key").agg(
        F.min("vec_id").alias("lowest"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"),
    ).withColumn("rid", F.monotonically_increasing_id()), "points")
    cells = staging.write(points.select("rid", "embedding").mapInArrow(
        _cells(cosine, block, grid), "rid long, dims int, block int, cell string, home boolean"), "cells")
    place = ["dims", "block", "cell"]
    # a cell matters if it's somebody's home and holds two rows
    sizes = cells.groupBy(*place).agg(F.count("*").alias("n"), F.max("home").alias("lived")).where("lived AND n > 1")
    sizes = sizes.select(*place, F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    chunked = cells.join(sizes, place).withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int"))
    meeting = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        *place, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
        (F.col("chunk") > F.col("other")).alias("second"), "home", "rid")
    full = meeting.join(points.select("rid", "weight", "embedding"), "rid")
    found = staging.write(full.groupBy(*place, "i", "j").applyInArrow(_compare(cosine, block), "a long, b long, n long"), "links")
    counts = found.groupBy(F.col("b").alias("rid")).agg(F.sum("n").alias("linked"))
    joined = components(found.select("a", "b"), staging).withColumnRenamed("node", "rid")
    placed = points.select("key", "rid", "weight", "lowest").join(counts, "rid", "left").join(joined, "rid", "left").select(
        "key", "lowest", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("linked"), "component", "rid")
    placed = staging.write(placed, "placed")
    # components are told by their smallest id; a component's first point stands for itself
    inside = placed.where("component IS NOT NULL").select("component", "lowest").union(
        placed.join(placed.select(F.col("component").alias("rid")).where("rid IS NOT NULL").distinct(), "rid").select("rid", "lowest"))
    firsts = inside.groupBy(F.col("component").alias("_c")).agg(F.min("lowest").alias("first"))
    per_point = placed.join(firsts, F.coalesce("component", "rid") == F.col("_c"), "left").select(
        "key", "linked", F.coalesce("first", "lowest").alias("component"))
    per_point = staging.write(per_point, "per-point")
    in_points = keyed["vec_id"].isNotNull() & (keyed["key"] == per_point["key"])
    rows = keyed.join(per_point, in_points, "left").select(
        "vec_id", F.coalesce("linked", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
