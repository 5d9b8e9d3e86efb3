"""Exact quantiles of many columns without ever holding a whole column in one place.

The built-in ``percentile`` keeps a value -> count map of the entire column in the final task. That is
fine for columns with few distinct values and hopeless for wide ranges of doubles at scale. So:

* columns with few distinct values (checked by ``approx_count_distinct``) share one ``percentile`` pass;
* for the others every wanted rank is bracketed: ``percentile_approx`` proposes a narrow interval, one
  aggregate counts what lies below and inside it, and the interval is accepted only when those exact
  counts prove that the rank is inside. Each round shrinks the interval several hundredfold; once it holds
  few values, or copies of a single one, they are counted exactly and the rank is read off.

Every round is one aggregation pass for all columns together and shuffles only aggregate buffers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil, floor
from operator import or_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..session import Staging, concurrently

MAP_LIMIT = 200_000  # distinct values a single aggregation buffer may hold
_ACCURACY = 10_000
_MARGIN = 0.0005
_ROUNDS = 24
_SMALL = 1_000  # values an interval may always hold
_PART = 0.02  # the share of the table that an interval may hold when its rows are written out


@dataclass
class _Rank:
    """One wanted quantile: 0-based target ranks and the interval known to contain them."""

    column: str
    probability: float
    position: float
    low: float | None = None
    high: float | None = None
    below: int = 0
    inside: int = 0
    distinct: int = 0  # an upper bound
    margin: float = _MARGIN

    @property
    def first(self) -> int:
        return floor(self.position)

    @property
    def last(self) -> int:
        return ceil(self.position)

    def contains(self, c: Column) -> Column:
        test = c.isNotNull()
        if self.low is not None:
            test = test & (c >= F.lit(self.low))
        if self.high is not None:
            test = test & (c <= F.lit(self.high))
        return test


def numeric(name: str) -> Column:
    """A column as double, with NaN treated as missing."""
    c = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(c), c)


@dataclass(frozen=True)
class Sketch:
    """What one pass tells about a column: its values, roughly how many distinct ones, and an interval that
    should contain each wanted quantile."""

    count: int
    distinct: int
    edges: dict[float, tuple[float, float]]


def sketch_columns(wanted: Mapping[str, Sequence[float]]) -> list[Column]:
    """Aggregates from which :func:`read_sketches` makes sketches; they may join any other aggregation."""
    made = []
    for i, (c, probabilities) in enumerate(wanted.items()):
        x = numeric(c)
        around = [q for p in probabilities for q in (max(0.0, p - _MARGIN), min(1.0, p + _MARGIN))]
        made += [
            F.count(x).alias(f"__count{i}"),
            F.approx_count_distinct(x).alias(f"__distinct{i}"),
            F.percentile_approx(x, around, _ACCURACY).alias(f"__edges{i}"),
        ]
    return made


def read_sketches(wanted: Mapping[str, Sequence[float]], row: Row) -> dict[str, Sketch]:
    found = {}
    for i, (c, probabilities) in enumerate(wanted.items()):
        edges = row[f"__edges{i}"] or [None] * (2 * len(probabilities))
        found[c] = Sketch(
            row[f"__count{i}"], row[f"__distinct{i}"],
            {p: tuple(edges[2 * j : 2 * j + 2]) for j, p in enumerate(probabilities)},
        )
    return found


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    sketches: Mapping[str, Sketch] | None = None,
    map_limit: int = MAP_LIMIT,
) -> dict[str, dict[float, float | None]]:
    """Linear-interpolation quantiles ``{column: {probability: value}}``; None for empty columns.

    ``sketches`` that rode on another pass save one.
    """
    if not wanted:
        return {}
    if sketches is None:
        sketches = read_sketches(wanted, df.agg(*sketch_columns(wanted)).first())
    found: dict[str, dict[float, float | None]] = {
        c: {p: None for p in ps} for c, ps in wanted.items()
    }
    budget, few, many = map_limit, {}, {}
    for c in sorted(wanted, key=lambda c: sketches[c].distinct):
        if sketches[c].count == 0:
            continue
        if sketches[c].distinct <= budget:
            few[c] = list(wanted[c])
            budget -= sketches[c].distinct
        else:
            many[c] = list(wanted[c])

    def count_few() -> None:
        row = df.agg(*[
            F.percentile(numeric(c), F.array(*map(F.lit, ps))).alias(f"q{i}")
            for i, (c, ps) in enumerate(few.items())
        ]).first()
        for i, (c, ps) in enumerate(few.items()):
            found[c] = dict(zip(ps, row[f"q{i}"]))

    def narrow_many() -> None:
        ranks = [
            _Rank(c, p, p * (sketches[c].count - 1), inside=sketches[c].count, distinct=sketches[c].distinct)
            for c, ps in many.items()
            for p in ps
        ]
        staging = Staging(df.sparkSession)
        table = _narrow(df, ranks, sketches, map_limit, staging)
        for rank, value in _read_off(table, ranks):
            found[rank.column][rank.probability] = value
        staging.discard()

    jobs = [job for job, columns in ((count_few, few), (narrow_many, many)) if columns]
    if jobs:
        concurrently(*jobs)
    return found


def _inside(df: DataFrame, ranks: list[_Rank]) -> DataFrame:
    """The wanted columns, holding only values inside an interval, and only rows that have one."""
    columns = dict.fromkeys(r.column for r in ranks)
    kept = {
        c: F.when(reduce(or_, [r.contains(numeric(c)) for r in ranks if r.column == c]), numeric(c)) for c in columns
    }
    return df.select(*[v.alias(c) for c, v in kept.items()]).where(
        reduce(or_, [F.col(f"`{c}`").isNotNull() for c in columns])
    )


def _narrow(
    df: DataFrame, ranks: list[_Rank], sketches: Mapping[str, Sketch], map_limit: int, staging: Staging
) -> DataFrame:
    """Narrow the intervals until they hold few distinct values; returns a table with all rows inside them.

    Once every interval is a small part of the table, the rows inside are written out, and later rounds read those.
    """
    limit = max(_SMALL, map_limit // len(ranks))
    staged = False
    for attempt in range(_ROUNDS):
        wide = [r for r in ranks if r.distinct > limit]
        if not wide:
            return df
        if not staged and all(r.inside <= _PART * sketches[r.column].count for r in ranks):
            df, staged = staging.write(_inside(df, ranks), "inside"), True
        trials = _propose(df, wide) if attempt else [
            _Rank(r.column, r.probability, r.position, *sketches[r.column].edges[r.probability])
            for r in wide
        ]
        counts = df.agg(*[
            expression
            for i, (r, t) in enumerate(zip(wide, trials))
            for expression in (
                F.count_if(r.contains(numeric(t.column)) & (numeric(t.column) < t.low)).alias(f"u{i}"),
                F.count_if(t.contains(numeric(t.column))).alias(f"n{i}"),
            )
        ]).first()
        for i, (r, t) in enumerate(zip(wide, trials)):
            below, inside = r.below + counts[f"u{i}"], counts[f"n{i}"]
            if below <= r.first and r.last < below + inside:
                r.low, r.high, r.below, r.inside = t.low, t.high, below, inside
                r.distinct = 1 if r.low == r.high else inside
                continue
            r.margin *= 4
            if r.first < below:  # the proposal starts too high: extend it down to the old start
                r.high, r.inside = t.high, below - r.below + inside
            else:  # it ends too low: extend it up to the old end
                r.low, r.below, r.inside = t.low, below, r.inside + r.below - below
    raise RuntimeError("quantile intervals did not converge")


def _propose(df: DataFrame, ranks: list[_Rank]) -> list[_Rank]:
    """A narrower interval per rank; ranks that still share an interval share one sketch."""
    shared: dict[tuple, list[_Rank]] = {}
    for r in ranks:
        shared.setdefault((r.column, r.low, r.high), []).append(r)

    def edges(r: _Rank) -> tuple[float, float]:
        start = (r.first - r.below) / r.inside - r.margin
        end = (r.last + 1 - r.below) / r.inside + r.margin
        return max(0.0, start), min(1.0, end)

    row = df.agg(*[
        F.percentile_approx(
            F.when(group[0].contains(numeric(group[0].column)), numeric(group[0].column)),
            [p for r in group for p in edges(r)],
            _ACCURACY,
        ).alias(f"b{i}")
        for i, group in enumerate(shared.values())
    ]).first()
    proposals = {
        id(r): row[f"b{i}"][2 * j : 2 * j + 2]
        for i, group in enumerate(shared.values())
        for j, r in enumerate(group)
    }
    return [_Rank(r.column, r.probability, r.position, *proposals[id(r)]) for r in ranks]


def _read_off(df: DataFrame, ranks: list[_Rank]) -> list[tuple[_Rank, float]]:
    """Count the few distinct values inside each interval and interpolate between the target ranks."""
    hits = F.array_compact(F.array(*[
        F.when(
            r.contains(numeric(r.column)),
            F.struct(F.lit(i).alias("rank"), numeric(r.column).alias("value")),
        )
        for i, r in enumerate(ranks)
    ]))
    counted = (
        df.select(F.explode(hits).alias("hit"))
        .groupBy("hit.rank", "hit.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = F.sum("n").over(Window.partitionBy("rank").orderBy("value"))

    def pick(attribute: str) -> Column:
        target = F.create_map(*[
            F.lit(x) for i, r in enumerate(ranks) for x in (i, getattr(r, attribute) - r.below)
        ])
        return F.min(F.when(F.col("upto") > F.element_at(target, F.col("rank")), F.col("value")))

    rows = (
        counted.withColumn("upto", upto)
        .groupBy("rank")
        .agg(pick("first").alias("a"), pick("last").alias("b"))
        .collect()
    )
    return [
        (r, row.a + (row.b - row.a) * (r.position - r.first))
        for row in rows
        for r in [ranks[row["rank"]]]
    ]
