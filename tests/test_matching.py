"""Exact and fuzzy deduplication, similarity join, dictionary lookup — against brute force."""

import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rinsework import Staging
from rinsework.functions import similarity
from rinsework.functions.rules import CITIES
from rinsework.functions.subsequence import Texts
from rinsework.operators import dedup, dictionary, fuzzy, lookup, pairing


def form_of(s):
    s = "".join(ch for ch in s.strip() if not 128 <= ord(ch) < 256).lower()
    return " ".join(sorted(re.sub(r"[\W_]+", " ", s).split()))


def indel(a, b):
    if not a and not b:
        return 100
    line = [0] * (len(a) + 1)
    for ch in b:
        new = [0]
        for i, x in enumerate(a):
            new.append(max(line[i] + (x == ch), line[i + 1], new[-1]))
        line = new
    return round(200 * line[-1] / (len(a) + len(b)))


def levenshtein(a, b):
    if not a and not b:
        return 100
    line = list(range(len(a) + 1))
    for j, ch in enumerate(b, 1):
        new = [j]
        for i, x in enumerate(a):
            new.append(min(line[i] + (x != ch), line[i + 1] + 1, new[-1] + 1))
        line = new
    return round(100 * (len(a) + len(b) - line[-1]) / (len(a) + len(b)))


SCORES = {"indel": indel, "levenshtein": levenshtein}


def names(seed, n=250):
    """Names with typos, case and order variants, short and empty ones; a third of the rows are one name and
    a third of the distinct names share a long prefix."""
    rng = random.Random(seed)
    first = ["anna", "rahul", "john", "mary ann", "li", "o'brien", "josé", "peter"]
    last = ["sharma", "smith", "cooper", "garcia", "wu", "berg"]
    made = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.33:
            s = "Rahul Sharma"
        elif kind < 0.55:
            s = f"customer#{rng.randrange(400):09d}"
        else:
            s = f"{rng.choice(first)} {rng.choice(last)}{rng.choice(['', ' jr', '99'])}"
            for _ in range(rng.choice([0, 1, 1, 2])):
                k = rng.randrange(len(s))
                s = s[:k] + rng.choice(["", "e", " ", s[k].upper()]) + s[k + 1:]
        if rng.random() < 0.05:
            s = s.upper()
        if rng.random() < 0.05:
            s = f" {s}"
        made.append(rng.choice([s] * 20 + ["---", "ab", None, s[:3]]))
    return made


@pytest.fixture(params=[(500, 4_000), (12, 40)], ids=["whole", "split"])
def limits(request, monkeypatch):
    """Once with roomy limits; once with limits so low that blocks split and batches grow."""
    block, batch = request.param
    monkeypatch.setattr(fuzzy, "BLOCK_LIMIT", block)
    monkeypatch.setattr(fuzzy, "SPLIT_LIMIT", 2 * block)
    monkeypatch.setattr(fuzzy, "FIRST_BATCH", batch)


@pytest.mark.parametrize("method", ["indel", "levenshtein"])
def test_pairs_and_deduplication_equal_brute_force(spark, limits, method):
    values = names(len(method))
    frame = spark.createDataFrame(list(enumerate(values)), "id long, v string").repartition(5)
    long_enough = {v: form_of(v) for v in values if v is not None and len(v.strip()) >= 3}
    similar = {
        tuple(sorted(p)): SCORES[method](*p) for p in itertools.combinations(sorted(set(long_enough.values())), 2)
    }
    found = fuzzy.similar_pairs(frame, "v", "id", method).collect()
    assert len(found) == len({tuple(sorted((r.form_a, r.form_b))) for r in found})
    assert {tuple(sorted((r.form_a, r.form_b))): r.score for r in found} == {
        p: s for p, s in similar.items() if s >= 85
    }

    def alike(a, b):
        return a == b or similar[tuple(sorted((a, b)))] >= 85

    expected = sum(
        a.strip().lower() != b.strip().lower() and alike(fa, fb)
        for (a, fa), (b, fb) in itertools.combinations(long_enough.items(), 2)
    )
    assert fuzzy.fuzzy_pair_count(frame, "v", "id", method) == expected

    kept, stay = [], []
    for i, v in enumerate(values):
        form = long_enough.get(v)
        if form is None:
            stay.append(i)
        elif not any(alike(form, k) for k in kept):
            kept.append(form)
            stay.append(i)
    result = fuzzy.fuzzy_dedup(frame, "v", "id", method)
    assert sorted(r.id for r in result.select("id").collect()) == stay


def test_result_does_not_depend_on_partitioning(spark):
    frame = spark.createDataFrame(list(enumerate(names(3, 120))), "id long, v string")
    results = [
        sorted(r.id for r in fuzzy.fuzzy_dedup(frame.repartition(n), "v", "id").select("id").collect())
        for n in (1, 9)
    ]
    assert results[0] == results[1]


def test_pair_count_of_a_column(spark):
    values = ["Rahul Sharma", "Alice Cooper", "Rahul Shrma", "Alice Copr"]
    frame = spark.createDataFrame(list(enumerate(values)), "id long, v string")
    assert fuzzy.fuzzy_pair_count(frame, "v", "id") == 2


def test_cells_are_compared_without_a_join(spark):
    frame = spark.createDataFrame(list(enumerate(names(5, 60))), "id long, v string")
    matcher = fuzzy.Matcher(frame, "v", "id")
    plan = pairing.meet(matcher.index, "count", True, fuzzy._SLACK)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("size", [1500])
def test_dense_columns_are_counted_without_listing_pairs(spark, monkeypatch, size):
    """Serial numbers: nearly a million similar pairs, several slices of one block."""
    monkeypatch.setattr(fuzzy, "BLOCK_LIMIT", 300)
    values = [f"Customer#{i:09d}" for i in range(size)]
    frame = spark.createDataFrame(list(enumerate(values)), "id long, v string")
    forms = [form_of(v) for v in values]
    i, j = np.triu_indices(size, 1)
    near = np.rint(200 * Texts(forms).common(i, j) / 36) >= 85
    matcher = fuzzy.Matcher(frame, "v", "id")
    start = time.monotonic()
    assert matcher.pair_count() == near.sum() > 400_000
    assert time.monotonic() - start < 30
    kept, similar = [], set(zip(i[near].tolist(), j[near].tolist()))
    for n in range(size):
        if not any((k, n) in similar for k in kept):
            kept.append(n)
    assert sorted(r.node for r in matcher.kept().collect()) == kept


def test_approximate_pairs_miss_few(spark):
    values = [v for v in names(21, 500) if v and not v.startswith("customer")]
    frame = spark.createDataFrame(list(enumerate(values)), "id long, v string")
    exact = {tuple(sorted((r.form_a, r.form_b))): r.score for r in fuzzy.similar_pairs(frame, "v").collect()}
    found = fuzzy.approx_similar_pairs(frame, "v").collect()
    pairs = {tuple(sorted((r.form_a, r.form_b))): r.score for r in found}
    assert len(pairs) == len(found) and pairs.items() <= exact.items()
    assert len(pairs) >= 0.9 * len(exact) > 20


def test_cells_come_whole():
    cells = ["a"] * 3 + ["b"] + ["c"] * 9 + ["d"] * 2
    for size in (1, 2, 3, 5, 20):
        batches = [pa.RecordBatch.from_pydict({"cell": cells[k : k + size]}) for k in range(0, len(cells), size)]
        parts = [t["cell"].to_pylist() for t in pairing._whole_cells(iter([pa.RecordBatch.from_pydict({"cell": cells[:0]}), *batches]))]
        assert sum(parts, []) == cells
        assert all(not set(x) & set(y) for x, y in itertools.combinations(parts, 2))


def test_common_subsequences_of_long_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdé\U0001f600", k=rng.choice((0, 1, 5, 40, 63, 64, 65, 128, 129, 200)))) for _ in range(60)]
    pairs = [(a, b) for a in range(60) for b in range(0, 60, 7)]
    left, right = map(np.array, zip(*pairs))
    found = Texts(texts).common(left, right)
    for (a, b), n in zip(pairs, found):
        total = len(texts[a]) + len(texts[b])
        assert indel(texts[a], texts[b]) == (round(200 * n / total) if total else 100)


def test_greedy_rounds_equal_a_loop(spark):
    rng = random.Random(11)
    edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)})
    nodes = spark.createDataFrame([(i,) for i in range(60)], "node long")
    frame = spark.createDataFrame(edges, "a long, b long")
    expected = set()
    for node in range(60):
        if not any((a, node) in edges for a in expected):
            expected.add(node)
    kept = fuzzy._decide(nodes, frame, Staging(spark))
    assert {r.node for r in kept.collect()} == expected


def test_exact_deduplication_keeps_the_first_row(spark):
    rows = [(1, "a", None), (2, "a", None), (3, "b", 1.0), (0, "b", 1.0), (5, None, None)]
    frame = spark.createDataFrame(rows, "_rid long, k string, x double")
    result = {tuple(r) for r in dedup.drop_exact_duplicates(frame).collect()}
    assert result == {(1, "a", None), (0, "b", 1.0), (5, None, None)}
    bare = dedup.drop_exact_duplicates(frame.drop("_rid"))
    assert bare.columns == ["k", "x"] and bare.count() == 3


def test_common_lengths_of_many_pairs():
    rng = random.Random(1)
    pairs = [["".join(rng.choices("abc", k=rng.randrange(9))) for _ in range(2)] for _ in range(300)]
    left, right = zip(*pairs)
    scores = [round(r) for r in similarity.ratios(left, right)]
    assert scores == [indel(a, b) for a, b in pairs]


def test_weighted_scores():
    def best(text):
        scores = similarity.weighted_scores(text, CITIES)
        return CITIES[scores.argmax()], round(scores.max())

    assert best("Mumbia")[0] == "Mumbai" and best("Punne")[0] == "Pune"
    assert best("mumbai") == ("Mumbai", 83)
    assert best("MUMBAI")[1] < 80 and best("Springfield")[1] < 80
    assert best("York New") == ("New York", 95)  # word order costs five per cent
    cut = similarity.weighted_scores("Mumbia", CITIES, 80)
    assert cut.max() == similarity.weighted_scores("Mumbia", CITIES).max()


def test_nearest_names_by_index_equal_all_pairs(spark):
    rng = random.Random(8)
    words = ["new", "York", "port", "San", "el", "Santa", "a", "ville", "Rio", "de", "la", "Bad"]
    names_ = sorted({" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(120)} | set(CITIES))
    names_ = [n for n in names_ if len(n) >= lookup.SHORTEST]
    texts = ["M", "Mu", "Mum", "a", "aa", "a a", "x", "", " ", "York  New", "New\tYork", "note 100953", "mumbai", "MUMBAI", "zz Mumbai zz zz zz zz"]
    for _ in range(700):
        t = " ".join(rng.sample(rng.choice(names_).split(" ") + [""] * rng.randint(0, 2), k=1)) if rng.random() < 0.3 else rng.choice(names_)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(t) + 1)
            t = t[:k] + rng.choice(["", "e", " ", "aa", "x"]) + t[k + rng.randint(0, 1):]
        texts.append(t)
    frame = spark.createDataFrame([(t,) for t in [*texts, None, texts[0]]], "city string")
    for cutoff in (80, 82, 90):
        given = spark.createDataFrame([*zip(names_, range(len(names_))), (None, 5), (names_[3], 900)], "name string, rank int")
        found = {r["value"]: (r["match"], r["score"]) for r in dictionary.nearest_names(frame, "city", given, cutoff).collect()}
        stripped = {t.strip() for t in texts}
        assert set(found) == stripped
        for t in stripped:
            scores = similarity.weighted_scores(t, names_) if t else np.zeros(1)
            top = int(scores.argmax())
            expected = (names_[top], scores[top]) if scores[top] >= cutoff else (None, None)
            assert found[t][0] == expected[0] and (expected[1] is None or abs(found[t][1] - expected[1]) < 1e-9), (t, found[t], expected)
    with pytest.raises(ValueError):
        dictionary.nearest_names(frame, "city", given, 70)
    assert dictionary.nearest_names(frame, "city", given.limit(0), 80).where("match IS NOT NULL").collect() == []
    long = spark.createDataFrame([("Mumbai " * 20_000,), ("Mumbay",)], "city string")
    assert {len(r["value"]): r["match"] for r in dictionary.nearest_names(long, "city").collect()} == {139_999: None, 6: "Mumbai"}


def test_city_correction(spark):
    cells = ["Mumbia", "Punne", " Mumbai ", "Atlantis", None, "", "delhi"]
    frame = spark.createDataFrame(list(enumerate(cells)), "i long, city string")
    for limit in (100_000, 0):  # broadcast, and the way beyond it
        dictionary.BROADCAST_ROWS, old = limit, dictionary.BROADCAST_ROWS
        fixed = dictionary.correct_names(frame, "city", Staging(spark), changed_flag="changed").orderBy("i")
        rows = fixed.collect()
        dictionary.BROADCAST_ROWS = old
        assert [r.city for r in rows] == ["Mumbai", "Pune", "Mumbai", "Atlantis", None, "", "Delhi"]
        assert [r.changed for r in rows] == [True, True, False, False, False, False, True]


def test_nearest_by_levenshtein_prefers_the_earlier_name(spark):
    frame = spark.createDataFrame([("Mysor",), ("Mysore",), ("zzz",)], "city string")
    found = {r["value"]: (r["match"], r["score"]) for r in dictionary.nearest_names(
        frame, "city", names=["Mysoru", "Mysore"], method="levenshtein").collect()}
    assert found == {"Mysor": ("Mysoru", 91), "Mysore": ("Mysore", 100), "zzz": (None, None)}
