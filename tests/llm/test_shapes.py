import json
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rinsework.llm import chat, mixing, oracles, packing, sketch, urls

NASTY = ["", "</s>[INST] ok [/INST]", "back\\slash \\[", "<<SYS>>x<</SYS>>", "<|end|>", "[INST] ", " [/INST]", "\\", "é😀\n<s>", None]


def _chat_brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(x[2] or "", x[3] or "") for x in sorted(
            (r for r in rows if r[0] == conv), key=lambda x: tuple((v is not None, v or 0 if i == 1 else v or "") for i, v in enumerate(x[1:], 1)))]
        out[conv] = own
    return out


def test_formatting_reads_back(spark, staging):
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool|x", "", None]), r.choice(NASTY)) for c in range(30) for t in range(r.randint(1, 9))]
    rows += [rows[0], (None, 1, "user", "no conversation"), (40, None, "assistant", "no turn"), (40, 0, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    messages = staging.write(chat.chains(frame), "messages")
    formatted = staging.write(chat.conversations(messages, staging), "formatted")
    expected = _chat_brute(rows)
    got = {x["tree"]: x for x in formatted.collect()}
    assert set(got) == set(expected)
    for conv, turns in expected.items():
        assert chat.turns_of(got[conv]["formatted"]) == turns
        trained = [got[conv]["formatted"][s["start"] : s["end"]] for s in got[conv]["loss_spans"]]
        assert [chat._ESCAPE.sub(r"\1", t) for t in trained] == [t for role, t in turns if role == "assistant"]


def test_branches_rank_by_score(spark, staging):
    #   1 - 2 - 4          tree 7; 5 hangs from a parent that doesn't exist; 8 and 9 are a cycle
    #     \ 3 - 6
    rows = [(7, 1, None, 1.0), (7, 2, 1, 5.0), (7, 3, 1, 2.0), (7, 4, 2, 0.0), (7, 6, 3, 9.0), (7, 5, 99, None), (7, 8, 9, 1.0), (7, 9, 8, 1.0)]
    frame = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    paths = lambda top: {
        leaf: [n for _, n in sorted(p)] for leaf, p in _by(chat.branches(frame, staging, top).collect()).items()}
    assert paths(1) == {6: [1, 3, 6]} and paths(5) == {6: [1, 3, 6], 4: [1, 2, 4], 5: [5]}


def _by(rows):
    out = {}
    for r in rows:
        out.setdefault(r["leaf"], []).append((r["place"], r["node"]))
    return out


def test_long_threads(spark, staging):
    frame = spark.range(300).select(F.lit(1).cast("long").alias("tree"), "id", (F.col("id") - 1).alias("p")).selectExpr(
        "tree", "id AS node", "CASE WHEN p >= 0 THEN p END AS parent", "0.0D AS score")
    path = sorted((r["place"], r["node"]) for r in chat.branches(frame, staging).collect())
    assert path == [(i, i) for i in range(300)]
    assert chat.branches(frame.limit(0), staging).collect() == []


def _mix_sql(docs):
    con = duckdb.connect()
    con.register("mix_input", docs.toArrow())
    return con.execute(f"WITH {oracles.MIXED} SELECT doc_id, size, source_size, target, size * coalesce(passes, 0) FROM timed LEFT JOIN taken USING (rid)").fetchall()


def test_mix_equals_sql_and_meets_its_targets(documents, staging):
    r = random.Random(5)
    rows = [(i, "w " * r.randint(0, 60), r.choice(["a", "b", "b", "b", "b", "c", None])) for i in range(400)]
    rows += [rows[1], (None, "x y z", "a"), (None, "x y z", "a"), (500, None, "a"), (501, "q " * 900, "d")]
    docs = documents(*rows)
    found = mixing.mix(docs, staging)
    got = [tuple(x) for x in found.select("doc_id", "size", "source_size", "target", "taken").collect()]
    order = lambda rows: sorted(rows, key=repr)
    assert order(got) == order((a, b, c, float(d), int(e)) for a, b, c, d, e in _mix_sql(docs))
    total = sum(x[1] for x in got)
    assert sum(x[4] for x in got) <= total and all(x[4] <= 3 * x[1] for x in got)
    per_source = found.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("longest")).collect()
    assert all(abs(s["taken"] - s["target"]) <= s["longest"] for s in per_source)
    out = mixing.mixed(docs, staging)
    assert out.columns == docs.columns
    assert sum(len((x["text"] or "").split()) for x in out.collect()) == sum(x[4] for x in got)


@pytest.mark.parametrize("rows", [[], [(1, "", "a"), (2, None, None)], [(1, "one", None)]])
def test_mix_of_little(documents, staging, rows):
    docs = documents(*rows, (9, "x", "a")).where("doc_id != 9")
    found = mixing.mix(docs, staging).collect()
    assert sorted((x["doc_id"], x["taken"]) for x in found) == [(r[0], len((r[1] or "").split())) for r in rows]


def test_targets_share_the_excess():
    from rinsework import local_session

    sizes = local_session(2).createDataFrame([("a", 10), ("b", 1000), ("c", 300), (None, 5)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 30 and got[None] == 15 and abs(sum(got.values()) - 1315) < 1e-9
    assert abs(got["c"] - min(900, got["c"])) < 1e-9 and abs(got["b"] / 2 - got["c"]) < 1e-9


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


ODD = ["", " ", "a  b", "a\n b", "a \n b", "it's 'll <|endoftext|> x", " lead", "trail ", "\u00a0x \u00a0y", "tab\tx\t\ty", "日本 語。 ok", "12 345,6 7", "\x85 \x85",
       "a\u3000 b", "x\r\n y", "é" * 3000]


def test_ids_equal_tokenizers(tokenizer):
    r = random.Random(1)
    texts = ODD + ["".join(r.choice(["a", " ", "  ", "\n", "the", "'s", "é", "1", ".", "\u00a0", "\u2009", "<|endoftext|>"]) for _ in range(40)) for _ in range(300)]
    got = packing.Encoder().encode(pa.array(texts))
    assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_fill_sequences_without_gaps(documents, staging, tokenizer):
    r = random.Random(6)
    texts = [None, *ODD, *["thing " * r.randint(0, 200) for _ in range(120)], "long " * 900]
    docs = documents(*enumerate(texts), (None, "x"), (3, ODD[2]))
    capacity = 128
    rows = packing.pack(docs, staging, capacity).collect()
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for i, t in enumerate(texts)}
    for p in rows:
        if p["doc_id"] is not None:
            assert p["ids_crc32"] == zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes())
    pieces = {}
    for p in rows:
        pieces.setdefault(p["doc_id"], []).append((p["piece"], p["start"], p["length"]))
    for i, x in ids.items():
        own = sorted(set(pieces[i]))
        assert [k for k, _, _ in own] == list(range(len(own))) and sum(n for *_, n in own) == len(x)
        assert len(own) == (1 if len(x) <= capacity else -(-len(x) // capacity)) and all(n == capacity for _, _, n in own[1:])
    assert len(pieces[3]) == 2 and len(pieces[None]) == 1
    sequences = {}
    for p in rows:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for content in sequences.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(p["length"] for p in rows) // capacity)
    assert len(sequences) <= least + 1


def test_plan_uses_every_length_once():
    r = np.random.default_rng(4)
    for _ in range(20):
        lengths, counts = np.unique(r.integers(1, 101, 400), return_counts=True)
        used = dict.fromkeys(lengths.tolist(), 0)
        for pattern, times in packing.plan(dict(zip(lengths.tolist(), counts.tolist())), 100):
            assert sum(k * v for k, v in pattern.items()) <= 100
            for k, v in pattern.items():
                used[k] += v * times
        assert used == dict(zip(lengths.tolist(), counts.tolist()))


def test_two_pieces_replace_the_smallest():
    # greedy fills 60 with 30, leaving 10; 23 and 17 fill the gap of 40 exactly
    assert packing.plan({60: 1, 30: 1, 23: 1, 17: 1}, 100) == [({17: 1, 23: 1, 60: 1}, 1), ({30: 1}, 1)]
    assert packing.plan({}, 100) == []


def test_nothing_to_pack(documents, staging):
    assert packing.pack(documents((1, "x")).limit(0), staging).collect() == []


URLS = [("http://A.example.COM/en/x?u=1", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("https://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("https://x.www.example.com/en/", "x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://example.com#/en/", "example.com", "", None, None), ("https://com/", "com", "/", "com/", "allow"),
        ("ftp://b.net/fr/2.html#top", "b.net", "/fr/2.html", "net/fr/", "block"), ("http://net/es", "net", "/es", None, None),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), ("no url", "", "", None, None), ("", "", "", None, None),
        (None, "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None), ("x://ÄB.net/es/\nq", "Äb.net", "/es/\nq", "net/es/", "block")]


def test_stated_rules(spark, staging):
    pages = spark.createDataFrame([(i, u[0], "") for i, u in enumerate(URLS)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urls.verdicts(pages, staging).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert verdict is None or got[i]["verdict"] == verdict
    assert urls.verdicts(pages.limit(0), staging).collect() == []


def test_mined_rules_equal_brute_force(spark, staging):
    from itertools import combinations

    r = random.Random(9)
    rows = []
    for _ in range(300):
        t = sorted({r.choice("abc"), r.choice("de"), r.choice("fghi"), "z"})
        rows.append((t, "block" if "a" in t and "d" in t or "f" in t else "allow"))
    labelled = spark.createDataFrame(rows + [(["q"], None), ([], "block")], "tokens array<string>, label string")
    found = {(tuple(x["tokens"]), x["label"]): x["confidence"] for x in urls.mine(labelled, staging).collect()}
    sets = [(tuple(t), label) for t, label in rows]  # pages, not distinct sets
    sure = {}
    for n in (1, 2, 3):
        for c in combinations("abcdefghiz", n):
            own = [label for t, label in sets if set(c) <= set(t)]
            for label in set(own):
                if own.count(label) >= 0.01 * len(sets) and own.count(label) / len(own) >= urls.MIN_CONFIDENCE:
                    sure[c, label] = own.count(label) / len(own)
    parts = lambda c: [p for n in range(1, len(c)) for p in combinations(c, n)]
    wanted = {(c, x): v for (c, x), v in sure.items() if not any(sure.get((p, x), -1) >= v for p in parts(c))}
    assert found == pytest.approx(wanted)
    opened = spark.createDataFrame([(["a", "d", "z"],), (["q"],), (["f", "x"],)], "tokens array<string>")
    rules = urls.mine(labelled, staging)
    judged = {tuple(x["tokens"]): x["label"] for x in urls.judge(opened, rules, staging).collect()}
    assert judged[("a", "d", "z")] == judged[("f", "x")] == "block" and ("q",) not in judged


def test_tokens_that_always_meet_do_not_explode(spark, staging):
    import time

    common = [f"field:{i:02d}" for i in range(40)]
    rows = [(sorted([*common, f"host:{i % 2}"]), "block") for i in range(20)] + [(["host:1", "path:x"], "allow")] * 60
    labelled = spark.createDataFrame(rows, "tokens array<string>, label string")
    start = time.monotonic()
    found = {(tuple(r["tokens"]), r["label"]): (r["confidence"], r["support"]) for r in urls.mine(labelled, staging).collect()}
    assert time.monotonic() - start < 60
    expected = {((c,), "block"): (1.0, 20) for c in common} | {(("host:0",), "block"): (1.0, 10), (("path:x",), "allow"): (1.0, 60)}
    assert found == expected | {(("host:1",), "allow"): (60 / 70, 60)}


def test_verdicts_of_repeated_urls_equal_brute_force(spark, staging):
    """A whole table: rules from pages with a stated rule, verdicts for all others, many rows of one URL."""
    from itertools import combinations

    r = random.Random(3)
    hosts = ["a.example.com", "www.example.com", "b.net", "shop-one.org", "c.net", "x.org"]
    urls_ = [f"http://{r.choice(hosts)}/{r.choice(['en', 'es', 'fr', 'de'])}/{r.choice(['p', 'q', 'buy'])}.{r.choice(['html', 'php'])}"
             f"{r.choice(['', '?id=1', '?utm=2&id=3'])}" for _ in range(120)]
    rows = [(i, u) for i, u in enumerate(urls_ + [urls_[0]] * 100 + [None, "no url", ""])]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    read = frame.select("page_id", *[c.alias(n) for c, n in zip(urls.split_url(F.col("url")), ("host", "path", "rest"))])
    read = read.select("page_id", urls.tokens(F.col("host"), F.col("path"), F.col("rest")).alias("t"),
                       urls.matched_rule(F.col("host"), F.col("path")).alias("m")).collect()
    taught = [(set(x["t"]), x["m"]["verdict"]) for x in read if x["m"] and x["t"]]
    every = sorted({t for s, _ in taught for t in s})
    sure = {}
    for n in (1, 2, 3):
        for c in combinations(every, n):
            own = [label for t, label in taught if t.issuperset(c)]
            for label in set(own):
                if own.count(label) >= 0.01 * len(taught) and own.count(label) / len(own) >= urls.MIN_CONFIDENCE:
                    sure[c, label] = (own.count(label) / len(own), own.count(label))
    parts = lambda c: [p for n in range(1, len(c)) for p in combinations(c, n)]
    rules = {(c, x): v for (c, x), v in sure.items() if not any(sure.get((p, x), (-1,))[0] >= v[0] for p in parts(c))}
    expected = {}
    for x in read:
        fitting = [(*v, -len(c), label) for (c, label), v in rules.items() if set(c) <= set(x["t"])]
        expected[x["page_id"]] = x["m"]["verdict"] if x["m"] else max(fitting)[3] if fitting else "allow"
    assert {x["page_id"]: x["verdict"] for x in urls.verdicts(frame, staging).collect()} == expected
    assert set(expected.values()) == {"allow", "block"}


def test_fingerprints_equal_sql(documents):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(["a", "bé", "c😀", "dd"]) + str(r.randrange(9)) for _ in range(r.randrange(0, 300)))) for i in range(60)]
    docs = documents(*rows, rows[3], (None, "null id"), (70, None), (71, " \n "), (72, "one"), (5, "same id"))
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    expected = con.execute(oracles.FINGERPRINTS).fetchall()
    for ranges in (1, 7):
        got = [tuple(x) for x in sketch.fingerprints(docs, ranges).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_one_document_is_its_own_next(documents):
    got = sketch.fingerprints(documents((1, "a b c d e f g")), 4).collect()
    assert len(got) == 1 and got[0]["near_next"] == 1.0
    assert sketch.fingerprints(documents((1, "x")).limit(0), 4).collect() == []


def test_containment_between_unequal_texts(spark):
    words = [f"w{i}" for i in range(8000)]
    frame = spark.createDataFrame([(" ".join(words[2000:2800]), " ".join(words))], "a string, b string").select(
        sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b"))
    row = frame.select(sketch.containment(F.col("a"), F.col("b")).alias("in_b"), sketch.containment(F.col("b"), F.col("a")).alias("in_a"),
                       sketch.merge(F.col("a"), F.col("b")).alias("m"), "b").first()
    assert row["in_b"] == 1.0 and abs(row["in_a"] - 0.1) < 0.03 and row["m"] == row["b"]
    assert json.dumps(row["b"]) == json.dumps(sorted(row["b"]))
