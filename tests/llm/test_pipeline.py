from collections import Counter

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from check import TABLES, _rows
from rinsework.llm import oracles
from rinsework.llm.oracles import ORACLES

FOLDER, SCALE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SCALE}/{t}.parquet'")
    frame = contract.queries()[name](spark, SCALE)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    assert _rows(frame.columns, frame.collect()) == _rows(names, cursor.fetchall())


def test_operators_and_the_pipeline_are_registered():
    known = contract.queries()
    assert [n for n in range(1, 14) if sum(k.startswith(f"op{n}_") for k in known) != 1] == [] and "pipeline" in known


def _shingles(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def _similarity(a, b):
    union = sum((a | b).values())
    return 1.0 if not union else sum((a & b).values()) / union


def _classes(rows, link):
    label = {i: i for i, _ in rows}
    pairs = [(i, j) for i, a in rows for j, b in rows if i < j and link(a, b)]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return label


def _sql(docs, sql, name):
    con = duckdb.connect()
    con.register(name, docs.toArrow())
    return sorted(map(repr, con.execute(sql).fetchall()))


def test_every_stage_equals_its_plain_version(spark, staging):
    """Each stage, on all that the one before it kept, against brute force or SQL."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "minhash_near_dedup", "source_mixing", "best_fit_packing"]

    def run(name, given):
        out = staging.write(stages[name](spark, given, FOLDER), name)
        assert name == "best_fit_packing" or out.columns == columns
        return out

    scores = {r["doc_id"]: r["score"] for r in contract.queries()["op1_toxicity"](spark, FOLDER).collect()}
    clean = run("toxicity", docs)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, x in scores.items() if x < 0.3}

    lined = run("line_dedup", clean)
    assert sorted(repr(tuple(r)) for r in lined.select(columns).collect()) == _sql(
        clean, oracles.LINE_DEDUP, "documents")

    kept = run("minhash_near_dedup", lined)
    bags = [(r["doc_id"], _shingles(r["text"])) for r in lined.collect()]
    classes = _classes(bags, lambda a, b: _similarity(a, b) >= 0.8)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(classes.values()))

    mixed = run("source_mixing", kept)
    wanted = f"WITH {oracles.MIXED} SELECT doc_id, passes FROM timed JOIN taken USING (rid)"
    counted = sorted(repr((r["doc_id"], r["count"])) for r in mixed.groupBy("doc_id").count().collect())
    assert counted == _sql(kept, wanted, "mix_input")

    packed = run("best_fit_packing", mixed).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {r["doc_id"]: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in kept.collect()}
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    for doc_id, n in copies.items():
        assert sum(p["length"] for p in packed if p["doc_id"] == doc_id) == n * tokens[doc_id]
    sequences = {}
    for p in packed:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for content in sequences.values():
        content.sort()
        assert [o for o, _ in content] == [sum(n for _, n in content[:i]) for i in range(len(content))]
        assert sum(n for _, n in content) <= 2048

    order = sorted(set(packed[0].asDict()) - {"sequence_id", "offset"})
    again = corpus_pipeline.run(spark, FOLDER).select(order).collect()
    assert sorted(repr(tuple(r)) for r in again) == sorted(repr(tuple(p[c] for c in order)) for p in packed)
