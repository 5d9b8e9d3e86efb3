"""Tables that are awkward in the same way for several operators: repeated and null ids, clashing names, very long rows."""

import hashlib
import math
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from rinsework.llm import bagminhash, chat, lines, mixing, oracles, secret, subspace
from rinsework.llm.names import unused

BIG = 2**53 + 1


def _odd_lines(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["alpha", "beta", "gamma", "x", "-", "a_b", "naïve", "ét", "No."])
    field = lambda: r.choice(["7", "a7f3", "2024-01-02", "1,000.50", "(12)", "#4", "10:30:00", "b2-c3", "3", "<*>", "_9"])
    base = ["日本語のテキスト七", "日本語 12 テキスト", "ภาษาไทยยาวๆ", "a\tb\tc 1", "1 2 3 4 5 6 7 8 9 10", "- - - - - - - - - - - - - - - - - - - - -",
            "  two  spaces  ", " lead", "漢字かな交じり文漢字かな交じり文漢字かな交じり文漢字かな交じり文漢字かな", "x" * 50]
    for _ in range(25):
        base.append(r.choice((" ", " ", "\t", "  ")).join(r.choice((word, word, word, field))() for _ in range(r.randint(1, 24))))
    rows = []
    for i in range(45):
        own = []
        for line in r.sample(base, r.randint(3, 14)):
            tokens = line.split(" ")
            if r.random() < 0.5 and len(tokens) > 3:
                tokens[r.randrange(2, len(tokens))] = r.choice((word, field))()
            own.append(" ".join(tokens))
        rows.append((i, "\n".join(own)))
    return [*rows, (3, "another text of a repeated id\nlead"), rows[7], (50, None), (51, ""), (None, base[0]), (52, "\n\n \n" + base[-1])]


def _sql(docs, sql, name):
    con = duckdb.connect()
    con.register(name, docs.toArrow())
    return sorted(map(repr, con.execute(sql).fetchall()))


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_with_fields_tabs_and_unspaced_scripts(documents, staging, seed):
    docs = documents(*_odd_lines(seed))
    got = lines.drop_repeated_lines(docs, staging)
    assert got.columns == docs.columns
    rows = sorted(repr(tuple(r)) for r in got.collect())
    assert rows == _sql(docs, oracles.LINE_DEDUP, "documents")
    assert rows != sorted(repr(tuple(r)) for r in docs.collect())


def test_a_text_of_very_many_lines(documents, staging):
    """Time in proportion to lines, though every other line goes."""
    took = []
    for n in (10_000, 100_000):
        shared = [f"some shared line of many words that goes on and on {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(n)]
        text = "\n".join(x for line in shared for x in (line, "keep"))
        docs = documents((1, "\n".join(shared)), (2, text))
        start = time.monotonic()
        kept = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(docs, staging).collect()}
        took.append(time.monotonic() - start)
        assert kept[1] == "\n".join(shared) and kept[2].split("\n") == ["keep"] * n
    assert took[1] < 10 * took[0] + 20, took


def test_a_conversation_of_very_many_turns(spark, staging):
    n = 100_000
    turns = spark.range(n).select(
        F.lit(5).cast("long").alias("tree"), "id", F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("t<"), F.col("id").cast("string")).alias("text"))
    rows = turns.select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), "role", "text")
    messages = staging.write(chat.chains(rows), "messages")
    start = time.monotonic()
    got = chat.digests(chat.conversations(messages, staging)).collect()
    assert time.monotonic() - start < 120
    told = "".join(f"{'assistant' if i % 2 else 'user'}\nt<{i}\n" for i in range(n))
    loss = "".join(f"t<{i}" for i in range(1, n, 2))
    assert [(r["conv_id"], r["n_turns"], r["turns_sha256"], r["loss_sha256"], r["loss_chars"]) for r in got] == [
        (5, n, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest(), len(loss))]


def test_large_ids_beside_null_ones_stay_exact(spark, staging, documents):
    docs = documents((None, "password=12345678"), (BIG, "nothing"), (BIG - 1, None), (BIG, "nothing")).coalesce(1)
    model = secret.train(docs)
    found = secret.scan(docs, model).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(map(str, (None, BIG, BIG - 1, BIG)))
    assert {r["doc_id"]: r["n_assign"] for r in found} == {None: 1, BIG: 0, BIG - 1: 0}
    rows = spark.createDataFrame(
        [(None, 0, "user", "a"), (BIG, 0, "user", "b"), (BIG, 0, "user", "b"), (BIG - 1, None, None, None)],
        "conv_id long, turn long, role string, text string").coalesce(1)
    formatted = chat.conversations(staging.write(chat.chains(rows), "messages"), staging).coalesce(1)
    assert {r["conv_id"]: r["n_turns"] for r in chat.digests(formatted).collect()} == {None: 1, BIG: 2, BIG - 1: 1}


def test_empty_tables(spark, staging, documents):
    docs = documents((1, "x")).limit(0)
    assert secret.scan(docs, secret.train(docs)).collect() == []
    assert lines.drop_repeated_lines(docs, staging).collect() == []
    assert mixing.mixed(docs, staging).collect() == []
    assert bagminhash.keep_one(docs, staging).collect() == []
    none = spark.createDataFrame([], "tree long, formatted string, loss_spans array<struct<start:int,end:int>>")
    assert chat.digests(none).collect() == []


def test_clashing_column_names(spark, staging):
    text = "one line that two documents share with many words in it\nown "
    extra = ["_lines", "_doc", "_text", "_n", "_d", "_s", "_t", "_dropped", "_key", "doc", "line", "passes", "Size", "rid", "_LINES2"]
    rows = [(i, text + str(i), "en", "s", 3, *[f"{c}{i}" for c in extra]) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))
    for stage in (lines.drop_repeated_lines, mixing.mixed, bagminhash.keep_one):
        got = stage(docs, staging)
        assert got.columns == docs.columns
        for r in got.collect():
            assert [r[c] for c in extra] == [f"{c}{r['doc_id']}" for c in extra]
    assert {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(docs, staging).collect()} == {0: text + "0", 1: "own 1", 2: "own 2"}


def test_names_that_a_table_lacks():
    assert unused(["a", "_B"], "a", "_b", "c", "c") == ["_a", "__b", "c", "_c"]


def _near_brute(rows, cosine=subspace.COSINE):
    fine = [i for i, (vec_id, v) in enumerate(rows)
            if vec_id is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]

    def near(a, b):
        a, b = rows[a][1], rows[b][1]
        return len(a) == len(b) and sum(x * y for x, y in zip(a, b)) >= cosine * math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    links = {i: {j for j in fine if j != i and near(i, j)} for i in fine}
    out = []
    for i, (vec_id, _) in enumerate(rows):
        reached, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in reached:
                    reached.add(j)
                    todo.append(j)
        first = None if vec_id is None else min(rows[j][0] for j in reached)
        out.append((vec_id, len(links.get(i, ())), first, vec_id is not None and vec_id == first))
    return sorted(map(repr, out))


@pytest.mark.parametrize("chunk", [subspace.CHUNK, 4])
def test_vectors_whose_ids_repeat(spark, staging, monkeypatch, chunk):
    monkeypatch.setattr(subspace, "CHUNK", chunk)
    r = random.Random(4)
    rows = []
    for i in range(60):
        centre = [r.gauss(0, 1) for _ in range(20)]
        for _ in range(r.choice((1, 2, 3))):
            rows.append((r.randrange(25), [x + r.gauss(0, 0.1) for x in centre]))
    rows += [rows[0], rows[0], (rows[0][0], rows[3][1]), (None, rows[0][1]), (BIG, rows[1][1]), (7, [0.0] * 20), (7, None), (7, [float("nan")] * 20),
             (8, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = subspace.near_vectors(frame, staging)
    assert sorted(repr(tuple(x)) for x in got.collect()) == _near_brute(rows)


@pytest.mark.parametrize("rows, links", [
    ([(7, 0.0), (8, 0.01), (7, 1.0), (9, 1.01)], {7: [1, 1], 8: [1], 9: [1]}),
    ([(7, 0.0), (7, 0.01), (8, 0.02)], {7: [2, 2], 8: [2]}),
])
def test_links_of_repeated_ids(spark, staging, rows, links):
    vectors = [(i, [math.cos(a)] * 8 + [math.sin(a)] * 8) for i, a in rows]
    got = {}
    for x in subspace.near_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), staging).collect():
        got.setdefault(x["vec_id"], []).append(x["n_links"])
    assert got == links


def test_runs_beside_patterns_are_judged_by_what_is_left(documents):
    r = random.Random(2)
    token = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(40))
    text = f"AKIA{'Q' * 14}/{token} and ſecret=12345678 SECRET=87654321"
    docs = documents((1, text), (2, "some_ordinary_name and otherNames, identifiers of several words, loadSettings " * 40))
    spans = {x["doc_id"]: x["spans"] for x in secret.scan(docs, secret.train(docs)).collect()}
    kinds = [tuple(s.split(":")) for s in spans[1].split(",")]
    assert ("access", "0", "18") in kinds and any(k == "markov" and int(a) >= 18 and text[int(a):int(b)].endswith(token) for k, a, b in kinds)
    assert [text[int(a):int(b)] for k, a, b in kinds if k == "assign"] == ["SECRET=87654321"]  # letters beyond ASCII aren't folded
    assert spans[2] == ""
