import random

import numpy as np
import pyarrow as pa
import pytest

from rinsework.llm import lines, secret, toxicity


def _toxic_corpus(n=500, seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "the", "ou", "er", "ti", "sh"]) for _ in range(r.randint(1, 4)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(r.choice((8, 40, 150)))]
        bad = r.random() < 0.3
        if bad:
            for _ in range(max(1, len(w) // 25)):
                w[r.randrange(len(w))] = r.choice(["vexed", "grobbo"]) + r.choice(["", "an", "er", "ous", "tish"])
        rows.append((i, " ".join(w), bad))
    return rows


def test_toxicity_is_learned_from_rows_that_are_not_held_out(spark, documents):
    rows = _toxic_corpus()
    docs = documents(*[(i, t) for i, t, _ in rows], (None, "x"), (9001, None), (9002, ""), (9003, "grobboous " * 20_000))
    labels = spark.createDataFrame([(i, 1, int(bad)) for i, _, bad in rows] + [(None, 1, 1), (3, 1, None)],
                                   "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(found) == len(rows) + 4 and all(0 <= r["score"] <= 1 for r in found.values())
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in found.values())
    unseen = [(found[i]["predicted"], bad) for i, _, bad in rows if found[i]["held_out"]]
    assert len(unseen) > 90 and sum(p == b for p, b in unseen) / len(unseen) >= 0.95
    assert found[9001]["score"] == found[9002]["score"] == 0 and found[9003]["predicted"] == 1


def test_toxicity_without_examples(documents, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents((1, "a"), (2, None))
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {0.0}


def test_gradients_equal_differences():
    net = toxicity.Network.fresh(1)
    r = np.random.default_rng(0)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items() if k not in ("word", "gram")}
    x = np.vstack([r.normal(size=(9, 2 * toxicity.WIDTH)), np.zeros((1, 2 * toxicity.WIDTH))])
    at = np.vstack([r.integers(0, 9, (6, 4)), [[9, 9, 9, 2]]])
    slope, trace = r.normal(size=4), {}
    net.logits(x, at, trace)
    dense, d_x = net.gradients(slope, trace)
    for name, grad in dense.items():
        place = tuple(r.integers(0, s) for s in net.weights[name].shape)
        old = net.weights[name][place]
        values = []
        for d in (1e-3, -1e-3):
            net.weights[name][place] = old + d
            values.append(float(slope @ net.logits(x, at)))
        net.weights[name][place] = old
        assert abs((values[0] - values[1]) / 2e-3 - grad[place]) < 2e-3
    assert d_x.shape == (9, 2 * toxicity.WIDTH)


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 55, 56, 57, 400):
        begin, owner = toxicity._starts(np.array([n]))
        covered = {w for b in begin for w in range(b, min(b + toxicity.WINDOW, n))}
        assert covered == set(range(n)) and set(owner) == {0}


def test_a_text_scores_as_its_highest_window():
    net = toxicity.train([["a b c"], ["bad day"]] * 4, np.array([0, 1] * 4), steps=30)
    text = " ".join(random.Random(1).choice(["a", "b", "bad", "day"]) for _ in range(200))
    w = text.split()
    begin, _ = toxicity._starts(np.array([200]))
    each = toxicity.score_texts(net, pa.array([" ".join(w[b : b + toxicity.WINDOW]) for b in begin]))
    assert np.isclose(toxicity.score_texts(net, pa.array([text]))[0], each.max(), atol=1e-5)


def test_keep_clean_keeps_columns_and_clean_rows(documents):
    net = toxicity.train([["a b c d"], ["vile b c d"]] * 6, np.array([0, 1] * 6), steps=60)
    docs = documents((1, "a b c d"), (2, "vile b c d"), (3, None), (None, "a b"))
    kept = toxicity.keep_clean(docs, net)
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.collect()} == {1, 3, None}


def _lines_of(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_recurring_lines_go_from_all_but_the_first_document(documents, staging):
    notice = "all rights to this text are kept by the people who wrote it"
    passage = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    docs = documents(
        (3, f"{notice}\nthird own line\n\n{passage}"), (1, f"first own line\n{notice}"), (2, f"{passage}\n{notice}\nyes"),
        (4, None), (5, ""), (6, f"{notice}\n{notice}"), (7, "yes"), (None, notice), (8, "only once here and nowhere else at all, twice\n" * 2),
    )
    out = lines.drop_repeated_lines(docs, staging)
    assert out.columns == docs.columns
    got = _lines_of(out)
    assert got[1] == f"first own line\n{notice}" and got[2] == f"{passage}\nyes" and got[3] == "third own line\n"
    assert got[4] is None and got[5] == "" and got[6] == "" and got[7] == "yes" and got[None] == notice
    assert got[8].count("only once") == 2  # repeats within one document are none of this operator's business
    sizes = {r["doc_id"]: r["n_chars"] for r in out.collect()}
    assert sizes[3] == len("third own line\n") and sizes[4] is None


def test_variable_fields(documents, staging):
    docs = documents(
        *[(i, f"page {i} of {i * 7} was printed for you on day {i}\nbody {chr(97 + i) * 6} text") for i in range(1, 5)],
        *[(i, f"dear reader {chr(97 + i) * 5} please do not copy any of this without asking us first") for i in range(10, 14)],
    )
    got = _lines_of(lines.drop_repeated_lines(docs, staging))
    assert got[1].startswith("page 1") and got[2] == "body cccccc text" and got[10] and got[11] == got[13] == ""


def test_short_lines_need_more_documents(documents, staging):
    few = _lines_of(lines.drop_repeated_lines(documents(*[(i, f"so it is\nown{chr(97 + i)}") for i in range(6)]), staging))
    many = _lines_of(lines.drop_repeated_lines(documents(*[(i, f"so it is\nown{chr(97 + i)}") for i in range(7)]), staging))
    assert few[5] == "so it is\nownf" and many[0].startswith("so it is") and many[5] == "ownf"


def _letters(i):
    return f"{chr(97 + i // 26)}{chr(97 + i % 26)}"


def test_variable_fields_are_no_constants(documents, staging):
    numbers = [(i, " ".join(str(i * 1000 + k) for k in range(10))) for i in range(1, 4)]  # ten numbers, three documents
    single = [(i, str(i * 37)) for i in range(10, 40)]  # one number, thirty documents
    padded = [(i, f"{i}        {i * 3}            -{i * 5}.5  ${i},000  ({i}%)") for i in range(50, 80)]
    docs = documents(*numbers, *single, *padded)
    assert _lines_of(lines.drop_repeated_lines(docs, staging)) == _lines_of(docs)


def test_lines_without_spaces_keep_what_they_say(documents, staging):
    def chinese(i):
        return "".join(chr(0x4E00 + (i * 97 + k * 31) % 2000) for k in range(30))

    own = [(i, f"{_letters(i)}name\t{i}\t{_letters(i * 5)}place\t{i * 3}") for i in range(25)]
    own += [(i, f"{chinese(i)}{i}{chinese(i + 7)}") for i in range(100, 125)]
    own += [(i, f"{_letters(i - 200)}=call({_letters(i - 195)},{i});") for i in range(200, 225)]
    docs = documents(*own)
    assert _lines_of(lines.drop_repeated_lines(docs, staging)) == _lines_of(docs)


def test_recurring_lines_without_spaces_go(documents, staging):
    tabbed = "\t".join(f"{_letters(i)}column" for i in range(12))
    notice = "".join(chr(0x4E00 + k * 31) for k in range(30))
    docs = documents(*[(i, f"{tabbed}\t{i}\n{notice}{i}{notice}\nown {_letters(i)}") for i in range(3)])
    got = _lines_of(lines.drop_repeated_lines(docs, staging))
    assert got[0].startswith(tabbed) and notice in got[0] and got[1] == "own ab" and got[2] == "own ac"


def test_lines_of_an_empty_table_and_long_tokens(documents, staging):
    docs = documents((1, "x" * 200_000 + " 7"), (2, "a " * 50_000))
    assert lines.drop_repeated_lines(docs.limit(0), staging).collect() == []
    assert _lines_of(lines.drop_repeated_lines(docs, staging)) == _lines_of(docs)


HEX = "0123456789abcdef" * 2


@pytest.mark.parametrize("text, spans", [
    ("", ""), ("password: short", ""), ('Token = "abcdefgh1"', "assign:0:18"), ("API_KEY=12345678", "assign:0:16"),
    ("apikey:'12345678'", "assign:0:16"), ("password:=x12345678", "assign:0:19"), ("AKIA123456789012", "access:0:16"), ("AKIA12345678901", ""),
    (f"x{HEX}g{HEX[:31]}", "hex:1:33"), (f"é😀 secret={HEX}", "assign:3:42,hex:10:42"),
    ("secret: short secret=longenough", "assign:14:31"),
])
def test_base_spans(text, spans):
    assert secret.joined(secret.base_spans(text)) == spans


def test_base_spans_equal_the_plain_patterns():
    import re

    r = random.Random(8)
    bits = ["token", "SECRET", " = ", ":", '"', "'", "AKIA", "ABC123DEF456", "deadbeef", "0f" * 9, "=", "\n", "zz", ".", "apikey", "é"]
    plain = (("assign", secret.ASSIGN, lambda m: len(m[2]) >= 8), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
             ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32))
    for _ in range(500):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 25)))
        found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(plain) for m in p.finditer(text) if ok(m))
        assert secret.base_spans(text) == [(a, plain[k][0], b) for a, k, b in found]


ORDINARY = """documentation describes international organisations, constitutional frameworks and thousands of things between;
somebody quickly packed seven judges vexing expensive liquor boxes; another jackdaw loves my quartz sphinx; warehouse_id,
total_price, updated_at, customer_name, getUserName, parseHeader, windows, buffers, kernels, joyful zebras, quizzical foxes"""


def test_models_add_random_strings_and_leave_words(documents):
    r = random.Random(3)
    key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    docs = documents((1, f"use {key} now"), (2, "theinternationalisationofthings and theconstitutionaldocumentation"), (3, None),
                     (4, f"token={key}"), (5, f"{ORDINARY} {ORDINARY.title()} " * 20), (None, "x"))
    found = {r["doc_id"]: r for r in secret.scan(docs, secret.train(docs)).collect()}
    assert found[1]["spans"] == "markov:4:44" and found[2]["spans"] == found[3]["spans"] == ""
    assert found[4]["spans"] == "assign:0:46" and found[4]["n_assign"] == 1 and len(found) == 6
    assert found[1]["base_sha256"] == found[3]["base_sha256"]
