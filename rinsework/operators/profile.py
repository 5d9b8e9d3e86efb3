"""Column and table profiles: null counts, numeric statistics, distinct counts, modes, duplicates.

One aggregation pass serves every column at once; distinct counts and modes share one value-frequency
shuffle, in which copies of a value collapse before they travel.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from ..functions.text import is_blank
from ..session import Staging, concurrently
from .quantiles import Sketch, exact_quantiles, numeric, read_sketches, sketch_columns

ROW_ID = "_rid"
QUARTILES = (0.25, 0.5, 0.75)


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def type_class(dtype: T.DataType) -> str:
    """boolean / date / integer / float / string / other — the coarse class that steers everything."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return "float"
    return "string" if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)) else "other"


def classes(df: DataFrame) -> dict[str, str]:
    return {f.name: type_class(f.dataType) for f in df.schema.fields if f.name != ROW_ID}


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, k in classes(df).items() if k in ("integer", "float")]


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a floating-point column."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return col(name).isNull() | F.isnan(col(name))
    return col(name).isNull()


# --- whole-table statistics ----------------------------------------------------------------------


def base_stats(df: DataFrame) -> DataFrame:
    """One row: rows, cols, columns."""
    names = data_columns(df)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(len(names)).cast("long").alias("cols"),
        F.array(*map(F.lit, names)).alias("columns"),
    )


def null_density(df: DataFrame) -> DataFrame:
    """One row: null_count over all cells and its share in percent (2 dp, 0 for no cells)."""
    names = data_columns(df)
    nulls = sum((F.count_if(is_missing(df, c)) for c in names), F.lit(0))
    cells = F.count(F.lit(1)) * len(names)
    return df.agg(
        nulls.cast("long").alias("null_count"),
        F.when(cells > 0, F.round(nulls / cells * 100, 2)).otherwise(0.0).alias("null_density"),
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: rows, duplicate_count = rows that repeat an earlier row on every data column."""
    names = [col(c) for c in data_columns(df)]
    per_row = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    return per_row.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_count"),
    )


def blank_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form: column, nulls, blanks (NULL or nothing but whitespace), filled."""
    aggregated = df.agg(*[
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(col(c).isNull()).alias("nulls"),
            F.count_if(is_blank(col(c))).alias("blanks"),
            F.count_if(~is_blank(col(c))).alias("filled"),
        ).alias(f"c{i}")
        for i, c in enumerate(columns)
    ])
    return aggregated.select(F.inline(F.array(*[f"c{i}" for i in range(len(columns))])))


def _values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) of every cell that isn't missing, as text."""

    def as_text(c: str) -> Column:
        value = col(c)
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            value = value + F.lit(0.0)  # -0.0 and 0.0 are one value
        return F.when(~is_missing(df, c), value.cast("string"))

    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), as_text(c).alias("value")) for c in columns
    ])
    return df.select(F.inline(cells)).where(F.col("value").isNotNull())


def value_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for every distinct non-null value, as text; one shuffle for all columns."""
    return _values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _commonest(df: DataFrame, columns: Sequence[str]) -> Column:
    """Orders (value, n) of one column: the most frequent first, then the smallest; numbers by their size."""
    kinds = classes(df)
    whole = [c for c in columns if kinds[c] == "integer" or isinstance(df.schema[c].dataType, T.DecimalType)]
    real = [c for c in columns if kinds[c] == "float" and c not in whole]
    # decimal(38, 10) would cut nothing but the digits of decimals finer than that, which then compare as doubles
    size = F.struct(
        F.when(F.col("column").isin(whole), F.col("value").try_cast("decimal(38,10)")).alias("exact"),
        F.when(F.col("column").isin(whole + real), F.col("value").try_cast("double")).alias("number"),
    )
    return F.struct((-F.col("n")).alias("rank"), size.alias("size"), "value")


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, unique_count, mode): most frequent value as text, the smallest one on ties; numbers by their size."""
    first = F.min(_commonest(df, columns))
    return value_frequencies(df, columns).groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_count"), first["value"].alias("mode")
    )


def heavy_modes(df: DataFrame, columns: Sequence[str], staging: Staging, buckets: int = 65_536, first: int = 64) -> DataFrame:
    """(column, mode, n) as :func:`modes` finds them, without a shuffle of all distinct values where some are common.

    Cells are counted by hash bucket, of which there are ``buckets`` for each column whatever the data. The values of the ``first``
    fullest buckets are counted exactly; their best count bounds the mode from below, and a bucket with fewer cells holds no
    value as common. So the values of all other buckets that reach the bound are counted too, and nothing else. Where no
    value is common, most buckets reach it, and the result costs as much as the full count. ``df`` is read three times.
    """
    cells = _values(df, columns).withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(buckets)))
    counts = staging.write(cells.groupBy("column", "bucket").agg(F.count(F.lit(1)).alias("n")), "buckets")
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "bucket"))
    ranked = staging.write(counts.withColumn("place", place), "ranked")

    def counted(chosen: DataFrame) -> DataFrame:
        # at most so many rows as buckets times columns are broadcast
        inside = cells.join(F.broadcast(chosen.select("column", "bucket")), ["column", "bucket"])
        return inside.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))

    early = staging.write(counted(ranked.where(F.col("place") <= first)), "early")
    bound = early.groupBy("column").agg(F.max("n").alias("bound"))
    rest = ranked.where(F.col("place") > first).join(F.broadcast(bound), "column").where("n >= bound")
    every = early.unionByName(counted(rest))
    best = F.min(_commonest(df, columns))
    return every.groupBy("column").agg(best["value"].alias("mode"), F.max("n").alias("n"))


# --- per-column statistics -----------------------------------------------------------------------


@dataclass
class ColumnStats:
    """What the profile knows about one column; numeric fields stay None elsewhere."""

    name: str
    type: str
    kind: str
    rows: int
    nulls: int
    unique: int = 0
    skewness: float | None = None
    mean: float | None = None
    median: float | None = None
    low: float | None = None
    high: float | None = None
    std: float | None = None
    q1: float | None = None
    q3: float | None = None
    mode: str | None = None
    bad_ages: int = 0

    @property
    def values(self) -> int:
        return self.rows - self.nulls

    @property
    def sparsity(self) -> float:
        return round(self.nulls / self.rows * 100, 2) if self.rows else 0.0


@dataclass
class TableStats:
    rows: int
    columns: dict[str, ColumnStats] = field(default_factory=dict)

    @property
    def null_count(self) -> int:
        return sum(c.nulls for c in self.columns.values())

    @property
    def null_density(self) -> float:
        cells = self.rows * len(self.columns)
        return round(self.null_count / cells * 100, 2) if cells else 0.0


def collect_stats(
    df: DataFrame, exact: bool = True, frequencies: bool = True, quantiles: bool = True
) -> TableStats:
    """Profile every column: one moments pass, one value-frequency pass, one quantile pass.

    ``frequencies=False`` leaves out distinct counts and modes, ``quantiles=False`` the quartiles.
    ``exact=False`` replaces distinct counts and quartiles by sketches that ride on the first pass, so that
    only the modes of non-numeric columns need a shuffle.
    """
    kinds = classes(df)
    measured = [c for c, k in kinds.items() if k in ("integer", "float")]
    wanted = {c: QUARTILES for c in measured} if quantiles and exact else {}
    moments = [F.count(F.lit(1)).alias("rows"), *sketch_columns(wanted)]
    for i, c in enumerate(kinds):
        moments.append(F.count_if(is_missing(df, c)).alias(f"null{i}"))
        if c in measured:
            x = numeric(c)
            moments += [
                F.skewness(x).alias(f"skew{i}"), F.avg(x).alias(f"mean{i}"),
                F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"), F.stddev_samp(x).alias(f"std{i}"),
                F.count_if((x < rules.AGE_RANGE[0]) | (x > rules.AGE_RANGE[1])).alias(f"age{i}"),
            ]
            if quantiles and not exact:
                moments.append(F.percentile_approx(x, list(QUARTILES), 10_000).alias(f"q{i}"))
        if frequencies and not exact and kinds[c] != "other":
            moments.append(F.approx_count_distinct(col(c)).alias(f"near{i}"))
    by_frequency = [c for c, k in kinds.items() if k != "other" and (exact or c not in measured)]

    def measure() -> TableStats:
        row = df.agg(*moments).first()
        stats = _from_moments(df, kinds, measured, row.asDict())
        if wanted:
            add_quartiles(df, stats, measured, read_sketches(wanted, row))
        return stats

    if not (frequencies and by_frequency):
        return measure()
    stats, found = concurrently(measure, lambda: modes(df, by_frequency).collect())
    _set_modes(stats, found)
    return stats


def _from_moments(
    df: DataFrame, kinds: dict[str, str], measured: Sequence[str], row: dict
) -> TableStats:
    stats = TableStats(rows=row["rows"])
    for i, (c, kind) in enumerate(kinds.items()):
        s = ColumnStats(c, df.schema[c].dataType.simpleString(), kind, row["rows"], row[f"null{i}"])
        if c in measured and s.values:
            s.mean, s.low, s.high = row[f"mean{i}"], row[f"min{i}"], row[f"max{i}"]
            s.std, s.skewness, s.bad_ages = row[f"std{i}"], row[f"skew{i}"], row[f"age{i}"]
            s.q1, s.median, s.q3 = row.get(f"q{i}", (None, None, None))
        s.unique = row.get(f"near{i}", 0)
        stats.columns[c] = s
    return stats


def _set_modes(stats: TableStats, found: Sequence[Row]) -> None:
    for r in found:
        s = stats.columns[r["column"]]
        s.unique, s.mode = r["unique_count"], r["mode"]


def add_modes(df: DataFrame, stats: TableStats, columns: Sequence[str]) -> None:
    """Complete the stats of these columns with exact distinct counts and modes."""
    if columns and stats.rows:
        _set_modes(stats, modes(df, columns).collect())


def add_quartiles(
    df: DataFrame, stats: TableStats, columns: Sequence[str], sketches: Mapping[str, Sketch] | None = None
) -> None:
    """Complete the stats of these numeric columns with exact quartiles."""
    for c, q in exact_quantiles(df, {c: QUARTILES for c in columns}, sketches).items():
        s = stats.columns[c]
        s.q1, s.median, s.q3 = (q[p] for p in QUARTILES)


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Long form, one row per column: nulls, sparsity, uniques and numeric statistics (4 dp)."""
    spark = df.sparkSession
    stats = collect_stats(df.select(*map(col, columns or data_columns(df))))

    def rounded(x: float | None, digits: int = 4) -> float | None:
        return None if x is None else round(x, digits)

    return spark.createDataFrame(
        [
            (s.name, s.nulls, s.sparsity, s.unique, rounded(s.skewness, 2), rounded(s.mean),
             rounded(s.median), rounded(s.low), rounded(s.high), rounded(s.std), s.mode)
            for s in stats.columns.values()
        ],
        "column string, null_count long, sparsity double, unique_count long, skewness double, "
        "mean double, median double, min double, max double, std double, mode string",
    )
