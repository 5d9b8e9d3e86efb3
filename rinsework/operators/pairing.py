"""Similar forms within the cells of a block index, compared in batches and counted or returned as edges.

The index deals forms to cells of bounded size (see :mod:`.fuzzy`). A task receives its cells in order and compares the forms
of each in vector steps: lengths and slices, the place of the pair's smallest shared bigrams, which makes one cell answer for
a pair, and then the exact score. What leaves a task is what was asked for: counts, edges, or the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.subsequence import Texts

#: What a task reads of the index; ``late`` marks forms that only meet those that aren't.
INDEX = ("cell", "cls", "shared", "slice", "apart", "late", "node", "form", "members", "own_cls", "prefix")
_PAIRS, _CELLS = 200_000, 4_000_000  # pairs at once; comparisons of bigrams at once
OUTPUT = {
    "pairs": "a long, b long, form_a string, form_b string, members_a long, members_b long, score int",
    "edges": "a long, b long",
    "late": "b long",
    "count": "n decimal(38,0)",
}


def in_cells(index: DataFrame, late: DataFrame | None = None) -> DataFrame:
    """The rows of an index in the order of their cells, each cell in one task; ``late`` holds the second side, if any."""
    # the cells are spread by key over as many tasks as there are: pairs, not bytes, make the work here
    spark = index.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = index.withColumn("late", F.lit(False))
    if late is not None:
        rows = rows.unionByName(late.withColumn("late", F.lit(True)))
    cell = F.concat_ws("|", "cls", "sig", "cell_a", "cell_b").alias("cell")
    rows = rows.select(cell, (F.col("cell_a") != F.col("cell_b")).alias("apart"), *[c for c in INDEX if c not in ("cell", "apart")])
    return rows.select(*INDEX).repartition(tasks, "cell").sortWithinPartitions("cell")


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows regrouped so that no cell is cut."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column(0)
        changes = np.flatnonzero(np.asarray(pc.not_equal(cells[1:], cells[:-1])))
        same = waiting and waiting[-1].column(0)[-1] == cells[0]
        cut = int(changes[-1]) + 1 if len(changes) else 0
        if not cut and same:
            waiting.append(batch)
            continue
        if not cut:  # a cell begins with the batch and goes on after it
            if waiting:
                yield pa.Table.from_batches(waiting)
            waiting = [batch]
            continue
        yield pa.Table.from_batches([*waiting, batch.slice(0, cut)])
        waiting = [batch.slice(cut)]
    if waiting:
        yield pa.Table.from_batches(waiting)


def _pairs_of(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within each run of rows, about ``_PAIRS`` at a time."""
    for n in np.unique(sizes[sizes > 1]):
        first = starts[sizes == n]
        per_row = max(1, _PAIRS // int(n))  # rows of a large cell, or cells of a small one, at once
        if n * (n - 1) // 2 > _PAIRS:
            for s in first:
                for a in range(0, int(n), per_row):
                    i = np.arange(a, min(a + per_row, int(n)))
                    x, y = np.repeat(i, n), np.tile(np.arange(n), len(i))
                    later = y > x
                    yield s + x[later], s + y[later]
            continue
        x, y = np.triu_indices(int(n), 1)
        step = max(1, _PAIRS // len(x))
        for a in range(0, len(first), step):
            s = first[a : a + step, None]
            yield (s + x).ravel(), (s + y).ravel()


class _Rows:
    """The columns of some whole cells as arrays."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        cell = pc.dictionary_encode(table["cell"].combine_chunks()).indices.to_numpy()
        self.starts = np.flatnonzero(np.diff(cell, prepend=-1))
        self.sizes = np.diff(np.append(self.starts, len(cell)))
        for name in ("cls", "slice", "node", "members", "own_cls"):
            setattr(self, name, table[name].to_numpy())
        for name in ("apart", "late"):
            setattr(self, name, table[name].to_numpy(zero_copy_only=False))
        forms = pc.dictionary_encode(table["form"].combine_chunks())
        self.form = forms.indices.to_numpy()
        self.spelling = forms.dictionary
        self.texts = Texts(forms.dictionary.to_pylist())
        self.length = self.texts.lengths[self.form]
        self._number(table["shared"].combine_chunks(), table["prefix"].combine_chunks())

    def _number(self, shared: pa.ListArray, prefix: pa.ListArray) -> None:
        """Bigrams as numbers in the index' order: ``prefix`` padded, the last one of the cell, and how many those are."""
        grams = pc.dictionary_encode(pa.chunked_array([shared.flatten(), prefix.flatten()]).combine_chunks())
        names = np.array(grams.dictionary.to_pylist(), dtype=object)
        rank = np.empty(len(names), dtype=np.int64)
        rank[np.argsort(names)] = np.arange(len(names))
        number = rank[grams.indices.to_numpy()]
        self.depth = np.asarray(pc.list_value_length(shared)).astype(np.int64)
        ends = np.cumsum(self.depth)
        split = int(ends[-1])
        self.last = np.maximum.reduceat(number[:split], ends - self.depth)
        sizes = np.asarray(pc.list_value_length(prefix)).astype(np.int64)
        # only bigrams up to the cell's last one decide whether the pair belongs here
        owner = np.repeat(np.arange(len(sizes)), sizes)
        kept = number[split:] <= self.last[owner]
        owner, value = owner[kept], number[split:][kept]
        counts = np.bincount(owner, minlength=len(sizes))
        place = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
        self.low = np.full((len(sizes), int(counts.max(initial=0))), -1, dtype=np.int64)
        self.low[owner, place] = value

    def first_here(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the pair's smallest shared bigrams are the cell's."""
        out = np.empty(len(i), dtype=bool)
        width = self.low.shape[1]
        step = max(1, _CELLS // max(1, width * width))
        for a in range(0, len(i), step):
            own, other = self.low[i[a : a + step]], self.low[j[a : a + step]]
            common = ((own[:, :, None] == other[:, None, :]) & (own >= 0)[:, :, None]).sum(axis=(1, 2))
            out[a : a + step] = common == self.depth[i[a : a + step]]
        return out

    def similar(self, score: bool, slack: float, two_sided: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(i, j, score)`` of the cells' pairs that reach the cut-off; without ``score``, those that lengths allow."""
        for i, j in _pairs_of(self.starts, self.sizes):
            fits = np.maximum(self.own_cls[i], self.own_cls[j]) == self.cls[i]
            fits &= ~self.apart[i] | (self.slice[i] != self.slice[j])
            total = self.length[i] + self.length[j]
            fits &= np.abs(self.length[i] - self.length[j]) < slack * total
            if two_sided:
                fits &= self.late[i] != self.late[j]
            i, j = i[fits], j[fits]
            own = self.first_here(i, j)
            i, j = i[own], j[own]
            found = np.zeros(len(i), dtype=np.int64)
            if score:
                total = self.length[i] + self.length[j]
                found = np.rint(200.0 * self.texts.common(self.form[i], self.form[j]) / np.maximum(total, 1)).astype(np.int64)
                near = found >= rules.FUZZY_SCORE
                i, j, found = i[near], j[near], found[near]
            # the earlier side first, else the smaller node
            turn = np.where(self.late[i] == self.late[j], self.node[i] > self.node[j], self.late[i])
            yield np.where(turn, j, i), np.where(turn, i, j), found


def meet(index: DataFrame, output: str, score: bool, slack: float, late: DataFrame | None = None) -> DataFrame:
    """The similar pairs of an index, or of an index and a ``late`` one, as ``OUTPUT[output]`` lists them.

    Every pair is found in one cell only. ``a`` is the form of the smaller node, or the one that isn't late; ``late`` names the late
    forms that have a similar one, possibly several times; ``count`` sums the products of members, a row for each task's cells.
    Without ``score``, pairs of allowed lengths come with a score of 0.
    """
    two_sided = late is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            rows = _Rows(table)
            total = 0
            for i, j, found in rows.similar(score, slack, two_sided):
                if output == "count":
                    total += sum((rows.members[i] * rows.members[j].astype(object)).tolist()) if len(i) else 0
                elif output == "late":
                    yield pa.RecordBatch.from_pydict({"b": pa.array(np.unique(rows.node[j]), pa.int64())})
                else:
                    columns = {"a": pa.array(rows.node[i], pa.int64()), "b": pa.array(rows.node[j], pa.int64())}
                    if output == "pairs":
                        columns |= {"form_a": rows.spelling.take(pa.array(rows.form[i])), "form_b": rows.spelling.take(pa.array(rows.form[j])),
                                    "members_a": pa.array(rows.members[i], pa.int64()), "members_b": pa.array(rows.members[j], pa.int64()),
                                    "score": pa.array(found, pa.int32())}
                    yield pa.RecordBatch.from_pydict(columns)
            if total:
                yield pa.RecordBatch.from_pydict({"n": pa.array([total], pa.decimal128(38, 0))})

    return in_cells(index, late).mapInArrow(run, OUTPUT[output])
