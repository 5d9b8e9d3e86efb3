"""Profiles, exact quantiles, outliers, imputation."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rinsework import Staging
from rinsework.operators import dedup, impute, outliers, profile, sketches
from rinsework.operators.quantiles import exact_quantiles


def numbers(kind):
    rng = random.Random(7)
    if kind == "spread":
        return [rng.lognormvariate(0, 3) for _ in range(5000)]
    if kind == "hot":  # one value holds a third of the rows
        return [42.0 if rng.random() < 0.34 else rng.gauss(40, 5) for _ in range(5000)]
    if kind == "signed":
        return [rng.choice([-0.0, 0.0, -1.5, 2.5]) if rng.random() < 0.5 else rng.uniform(-1e9, 1e9) for _ in range(999)]
    return [3.0]


@pytest.mark.parametrize("kind", ["spread", "hot", "signed", "single"])
@pytest.mark.parametrize("map_limit", [100_000, 8])
def test_quantiles_are_exact_by_either_way(spark, kind, map_limit):
    values = numbers(kind)
    frame = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double").repartition(3)
    probabilities = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)
    found = exact_quantiles(frame, {"x": probabilities}, map_limit=map_limit)["x"]
    expected = pd.Series(values).quantile(probabilities)
    assert list(found.values()) == pytest.approx(list(expected), rel=1e-12)


def test_quantiles_of_an_empty_column(spark):
    frame = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(frame, {"x": (0.5,)}) == {"x": {0.5: None}}


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [("b", 1, 1.0, True), ("a", 2, None, True), ("b", 3, float("nan"), None), ("a", 4, 100.0, False),
         (None, 5, -0.0, True), (None, 6, 0.0, True)],
        "word string, n long, x double, flag boolean",
    )


def test_profile(people):
    stats = profile.collect_stats(people)
    word, n, x, flag = (stats.columns[c] for c in people.columns)
    assert (word.nulls, word.unique, word.mode, word.sparsity) == (2, 2, "a", 33.33)  # ties: the smallest
    assert (n.mean, n.median, n.low, n.high, n.unique) == (3.5, 3.5, 1, 6, 6)
    assert n.std == pytest.approx(1.8708286933869707)
    assert (x.nulls, x.unique) == (2, 3)  # NaN is missing, -0.0 equals 0.0
    assert (flag.kind, flag.mode) == ("boolean", "true")
    assert (stats.null_count, stats.null_density) == (5, 20.83)


def test_sketched_profile_agrees_on_small_data(people):
    exact, near = profile.collect_stats(people), profile.collect_stats(people, exact=False)
    assert near.columns["n"].unique == exact.columns["n"].unique
    assert near.columns["word"].mode == exact.columns["word"].mode


def test_skewness_is_the_population_one(spark):
    values = [1.0, 2.0, 2.0, 3.0, 50.0]
    stats = profile.collect_stats(spark.createDataFrame([(v,) for v in values], "x double"))
    s = pd.Series(values)
    expected = ((s - s.mean()) ** 3).mean() / s.std(ddof=0) ** 3
    assert stats.columns["x"].skewness == pytest.approx(expected)


def test_table_counts(people):
    twice = people.union(people)
    assert profile.duplicate_count(twice).first().asDict() == {"rows": 12, "duplicate_count": 6}
    assert profile.base_stats(people).first().asDict() == {
        "rows": 6, "cols": 4, "columns": ["word", "n", "x", "flag"]}
    assert profile.null_density(people).first().asDict() == {"null_count": 5, "null_density": 20.83}


def test_empty_table(people):
    stats = profile.collect_stats(people.limit(0))
    assert (stats.rows, stats.null_density, stats.columns["n"].mean) == (0, 0.0, None)


@pytest.fixture(scope="module")
def spiked(spark):
    rows = [(i, float(i % 10), 5.0) for i in range(40)] + [(40, 1000.0, 5.0), (41, -1000.0, 9.0), (42, None, None)]
    return spark.createDataFrame(rows, "i long, x double, flat double")


def test_bounds_skip_columns_without_spread(spiked):
    assert [b.column for b in outliers.iqr_bounds(spiked, ["x", "flat"])] == ["x"]
    few = spiked.limit(3)
    assert outliers.iqr_bounds(few, ["x"]) == [] and outliers.iqr_bounds(few, ["x"], minimum=1) != []


def test_treatments(spiked):
    bounds = outliers.iqr_bounds(spiked, ["x"])
    assert outliers.outlier_counts(spiked, bounds) == ({"x": 2}, 43)
    assert outliers.outlier_counts(spiked, bounds, bounds) == ({"x": 2}, 41)

    def treated(treatment):
        frame = outliers.treat_outliers(spiked, bounds, treatment)
        return {r["i"]: r["x"] for r in frame.collect()}

    clipped = treated("clip")
    assert (clipped[40], clipped[41], clipped[42]) == (bounds[0].high, bounds[0].low, None)
    replaced = treated("median_replace")
    assert replaced[40] == replaced[41] == bounds[0].median and replaced[42] is None
    removed = treated("remove_row")
    assert set(removed) == set(range(40)) | {42}
    with pytest.raises(ValueError):
        treated("ignore")


def test_remove_row_counts_a_row_once(spark):
    rows = [(i, float(i % 7), float(i % 5)) for i in range(30)] + [(30, 999.0, 999.0)]
    frame = spark.createDataFrame(rows, "i long, x double, y double")
    bounds = outliers.iqr_bounds(frame, ["x", "y"])
    assert outliers.treat_outliers(frame, bounds, "remove_row").count() == 30


def test_imputation(spark):
    frame = spark.createDataFrame(
        [(1, 50000.0, "NY"), (2, 52000.0, "NY"), (3, 48000.0, "LA"), (4, 51000.0, None), (None, 1e6, "SF"), (6, None, None)],
        "n long, income double, city string",
    )
    filled, applied = impute.impute(frame, {"n": "Auto", "income": "Auto", "city": "Auto"})
    assert applied == {"n": ("Mean", 3.2, 1), "income": ("Median", 51000.0, 1), "city": ("Mode", "NY", 2)}
    assert filled.where("n IS NULL OR income IS NULL OR city IS NULL").isEmpty()
    custom, applied = impute.impute(frame, {"income": "Custom: 99.0", "city": "Custom:none", "n": "Skip"})
    assert applied == {"income": ("Custom: 99.0", 99.0, 1), "city": ("Custom:none", "none", 2)}
    assert custom.agg(F.count("n")).first()[0] == 5


@pytest.mark.parametrize("column, strategy", [
    ("income", "Custom:much"), ("city", "Mean"), ("city", "Median"), ("city", "Guess"),
])
def test_strategies_that_cannot_apply(spark, column, strategy):
    frame = spark.createDataFrame([(1.0, "a"), (None, None)], "income double, city string")
    with pytest.raises(ValueError):
        impute.impute(frame, {column: strategy})


def test_email_phone_and_date_columns_are_not_filled(spark):
    frame = spark.createDataFrame([("a@b.com",), (None,)], "v string")
    for semantic in ("email", "phone", "date"):
        assert impute.impute(frame, {"v": "Auto"}, {"v": semantic})[1] == {}


def test_heavy_modes_equal_full_counts(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 2, 3, 40 + rng.randrange(500)]), rng.choice(["a", "b", None]), rng.randrange(9), float(rng.randrange(3)), i)
            for i in range(900)]
    frame = spark.createDataFrame(rows, "few long, two string, tie long, real double, unique long")
    expected = {r["column"]: r["mode"] for r in profile.modes(frame, frame.columns).collect()}
    for buckets, first in ((65_536, 64), (7, 1), (40, 2), (1, 1)):
        got = profile.heavy_modes(frame, frame.columns, Staging(spark), buckets, first).collect()
        assert {r["column"]: r["mode"] for r in got} == expected
        counts = {c: max(Counter(x for x in column if x is not None).values()) for c, column in zip(frame.columns, zip(*rows))}
        assert {r["column"]: r["n"] for r in got} == counts
    assert profile.heavy_modes(frame.limit(0), frame.columns, Staging(spark)).collect() == []


def test_only_values_of_full_buckets_are_counted(spark, monkeypatch):
    """A column with a common value: of 5,000 distinct ones, the exact pass shuffles those of a few buckets."""
    frame = spark.range(10_000).selectExpr("CASE WHEN id % 2 = 0 THEN -1 ELSE id END AS v")
    staging = Staging(spark)
    assert [(r["mode"], r["n"]) for r in profile.heavy_modes(frame, ["v"], staging, first=3).collect()] == [("-1", 5_000)]
    early = next(p for p, name in staging._written.items() if name == "early")
    assert spark.read.parquet(early).count() < 20


def test_merged_profiles_equal_whole_ones(spark):
    rng = random.Random(6)
    rows = [(i % 13, rng.choice([None, float("nan"), 1e9 + rng.gauss(0, 1)]) if i % 13 == 5 else rng.gauss(i % 13, 3), rng.randrange(3_000),
             rng.choice(["x", "y", None]), None) for i in range(20_000)]
    frame = spark.createDataFrame(rows, "day int, x double, k long, t string, nothing double")
    columns = ["x", "k", "t", "nothing"]
    staging = Staging(spark)
    parts = staging.write(sketches.sketch(frame, columns, F.col("day")), "days")
    assert parts.count() == 13 * len(columns)
    merged = {r["column"]: r for r in sketches.read(sketches.merge(parts), (0.1, 0.5, 0.9)).collect()}
    in_two_steps = sketches.merge(sketches.merge(parts, F.when(F.col("part").cast("int") < 6, "a").otherwise("b")))
    whole = {r["column"]: r for r in sketches.read(sketches.sketch(frame, columns), (0.1, 0.5, 0.9)).collect()}
    for found in (merged, {r["column"]: r for r in sketches.read(in_two_steps, (0.1, 0.5, 0.9)).collect()}):
        for c in columns:
            for name in ("rows", "nulls", "sparsity", "low", "high"):
                assert found[c][name] == whole[c][name], (c, name)
            for name in ("mean", "std"):
                assert (found[c][name] is None) == (whole[c][name] is None)
                assert found[c][name] is None or abs(found[c][name] - whole[c][name]) <= 1e-9 * abs(whole[c][name])
    for j, c in ((1, "x"), (2, "k"), (3, "t")):
        values = [r[j] for r in rows if r[j] is not None and r[j] == r[j]]
        assert abs(merged[c]["distinct"] - len(set(values))) <= 4 * sketches.DISTINCT_ERROR * len(set(values)) + 1
        if c != "t":
            for p, q in zip((0.1, 0.5, 0.9), merged[c]["quantiles"]):
                below, upto = (sum(t(v) for v in values) / len(values) for t in (lambda v: v < q, lambda v: v <= q))
                assert below - sketches.RANK_ERROR <= p <= upto + sketches.RANK_ERROR
    assert merged["t"]["quantiles"] is None and merged["nothing"]["distinct"] == 0
    assert sketches.merge(parts.limit(0)).collect() == []


@pytest.mark.parametrize("bits", [dedup.FINGERPRINT_BITS, 1, 64])
def test_fingerprints_drop_the_same_rows(spark, bits):
    rng = random.Random(9)
    rows = [(i, rng.randrange(400), rng.choice(["a", None, "b"]), rng.choice([0.0, -0.0, 1.5, float("nan"), None])) for i in range(1_500)]
    frame = spark.createDataFrame(rows, "_rid long, k long, t string, x double").repartition(5)
    staged = Staging(spark).write(frame, "rows")
    expected = sorted(map(repr, (tuple(r) for r in dedup.drop_exact_duplicates(staged).select("_rid", "k", "t").collect())))
    got = dedup.drop_exact_duplicates_by_fingerprint(staged, bits)
    assert got.columns == staged.columns
    assert sorted(map(repr, (tuple(r) for r in got.select("_rid", "k", "t").collect()))) == expected
    counted = dedup.duplicate_count_by_fingerprint(staged, bits).first()
    assert tuple(counted) == tuple(profile.duplicate_count(staged).first()) == (1_500, 1_500 - len(expected))
    empty = staged.limit(0)
    assert dedup.drop_exact_duplicates_by_fingerprint(empty, bits).collect() == []
    assert tuple(dedup.duplicate_count_by_fingerprint(empty, bits).first()) == (0, 0)


def test_unique_rows_stay_where_they_are(spark):
    frame = Staging(spark).write(spark.range(5_000).selectExpr("CASE WHEN id < 10 THEN 0 ELSE id END AS k", "repeat('x', 100) AS t"), "rows")
    sure, suspects = dedup._by_fingerprint(frame, dedup.FINGERPRINT_BITS)
    assert suspects.count() == 10 and sure.count() == 4_990
