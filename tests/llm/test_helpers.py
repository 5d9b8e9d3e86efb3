import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rinsework.llm import lines, words
from rinsework.llm.graph import components
from rinsework.llm.running import digits_for, running_total, shuffle_key


def _brute_components(edges):
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {n: c for n, c in label.items() if n != c}


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(2, 1), (1, 2), (2, 1)],
    [(i, i + 1) for i in range(40)],  # a chain
    [(i, 100) for i in range(30)],  # a star whose centre is the largest
    np.random.default_rng(3).integers(0, 120, (90, 2)).tolist(),
])
def test_components(spark, staging, edges):
    frame = spark.createDataFrame([tuple(map(int, e)) for e in edges], "a long, b long")
    got = {r["node"]: r["component"] for r in components(frame, staging).collect()}
    assert got == _brute_components(edges)


def test_components_ignore_nulls(spark, staging):
    frame = spark.createDataFrame([(1, None), (None, None), (5, 4)], "a long, b long")
    assert [tuple(r) for r in components(frame, staging).collect()] == [(5, 4)]


def test_running_total_of_a_hot_group_and_a_null_group(spark, staging):
    r = np.random.default_rng(1)
    rows = [(i, None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}", int(r.integers(0, 9))) for i in range(400)]
    rows.append(rows[0])
    df = staging.write(spark.createDataFrame(rows, "id long, g string, v long").withColumn("o", shuffle_key("id")), "rows")
    got = running_total(df, "g", "o", "v", "upto", 2, "id").collect()
    assert len(got) == len(rows)
    for g in {x[1] for x in rows}:
        total = 0
        for x in sorted((x for x in got if x["g"] == g), key=lambda x: (x["o"], x["id"], x["upto"])):
            total += x["v"]
            assert x["upto"] == total


def test_digits_grow_with_the_rows():
    assert digits_for(0) == digits_for(1_000_000) == 2 and digits_for(10**12) == 7


def test_words_and_shingles():
    texts = pa.array(["a b\tc\n d  e f", None, "", "  ", "x", "a b c d e"])
    hashes, counts = words.word_hashes(texts)
    assert counts.tolist() == [6, 0, 0, 0, 1, 5]
    assert len(set(hashes.tolist())) == 7
    values, owner = words.shingles(texts)
    assert owner.tolist() == [0, 0, 4, 5]
    assert values[0] == values[3] and len(set(values.tolist())) == 3


def test_multisets_count_repeats():
    row, shingle, count = words.multisets(pa.array(["a " * 12, "b"]))
    assert row.tolist() == [0, 1] and count.tolist() == [8, 1]


def test_slices_cover_all_rows():
    assert list(words.slices(np.array([5, 5, 99, 1, 1]), 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(words.slices(np.array([], dtype=int))) == []


def test_shuffle_key_tells_null_from_nothing_else(spark):
    keys = spark.createDataFrame([(None,), (1,), (11,)], "x long").select(shuffle_key("x").alias("k")).collect()
    assert len({k["k"] for k in keys}) == 3
    assert spark.range(1).select(F.length(shuffle_key("id"))).first()[0] == 32


def test_parsing_lines_is_compiled(documents, largest_method):
    """op2_line_dedup: the loop over lines stays small enough for the JVM to compile it."""
    parsed = lines.parse(documents((1, "a plain line of eight words or more here\nshort 12"), (2, None)))
    assert largest_method(parsed) <= 8000
    found = {r["line"]: r for r in parsed.collect()}
    assert (len(found[0]["runs"]), found[0]["constants"]) == (10, [2, 1, 2, 2, 2])
    assert (len(found[1]["runs"]), found[1]["constants"]) == (2, [1])
