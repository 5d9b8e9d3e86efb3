import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as contract
from rinsework import Staging
from rinsework.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def _near(words):
    """Near words through shared keys: a word with one letter open, or one letter out."""
    holes, cut = {}, {}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((i, w[:i], w[i + 1 :]), set()).add(w)
            cut.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    out = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            out[w] |= holes[(i, w[:i], w[i + 1 :])]
        for longer in cut.get(w, ()):
            out[w].add(longer)
            out[longer].add(w)
        out[w].discard(w)
    return out


def _brute(rows):
    n = _words(rows)
    near = _near(n)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def _rows(frame):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in frame.collect())


def _corpus(seed, size=220):
    r = random.Random(seed)
    letters = "abetéèÉ×"
    base = ["".join(r.choice(letters) for _ in range(r.randint(4, 8))) for _ in range(60)] + ["q" * 5, "q" * 6, "q" * 400, "q" * 399 + "z"]
    rows = []
    for i in range(size):
        picked = [r.choice(base[: r.choice((4, 20, len(base)))]) for _ in range(30)]
        for k in range(0, 30, 4):
            w = list(picked[k])
            w[r.randrange(len(w))] = r.choice(letters)
            picked[k] = "".join(w)
        picked[0] = picked[0].upper()
        rows.append((i, r.choice((" ", ", ", "1", "\n")).join(picked)))
    chain = [("aaaab", 90), ("aaabb", 40), ("aabbb", 15), ("abbbb", 6), ("abbbbx", 3), ("bbbbb", 12)]
    rows += [(1000 + i, w) for w, k in chain for i in range(k)]
    return rows + [(None, "Tabet tabet taBet"), (7, None), (8, ""), (9, "ßßßßß " * 3), rows[0], rows[0]]


@pytest.mark.parametrize("chunk", [spelling.CHUNK, 40])
def test_variants_equal_brute_force(documents, staging, chunk):
    rows = _corpus(5, 150)
    got = spelling.variants(documents(*rows), staging, chunk)
    expected = _brute(rows)
    assert len(expected) > 70 and any(r[1] != r[2] and r[1] for r in expected)
    assert _rows(got) == expected


def test_nothing_to_group(documents, staging):
    docs = documents((1, "short words"), (2, None))
    assert spelling.variants(docs, staging).collect() == []
    assert spelling.variants(docs.limit(0), staging).collect() == []


def test_clashing_columns(spark, staging):
    rows = [(i, "badly badly badly baddly", 1, "x", 2) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word int, n string, run int")
    assert _rows(spelling.variants(docs, staging)) == _brute([r[:2] for r in rows])


def test_chains_end_at_their_roots(spark, staging):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)], "word string, form string")
    assert {r["root"] for r in spelling.roots(chain, staging).collect()} == {"w37"}
    assert spelling.roots(chain.limit(0), staging).collect() == []


def test_one_apart():
    code = lambda *words: np.array([list(w.encode()) for w in words], dtype=np.uint8)
    assert spelling.one_apart(code("abcd", "abcd", "abcd"), code("abxd", "abcd", "badc")).tolist() == [True, False, False]
    assert spelling.one_apart(code("abcd", "aaaa", "abcd"), code("abcxd", "aaaaa", "xabdc")).tolist() == [True, True, False]


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert _rows(contract.queries()["op12_spelling_variants"](spark, folder)) == _brute(rows)


class _Plans(Staging):
    """Keeps the plan of every table it writes."""

    def __init__(self, spark):
        super().__init__(spark)
        self.plans = []

    def write(self, df, name):
        self.plans.append(df._jdf.queryExecution().executedPlan().toString())
        return super().write(df, name)


def test_tables_of_words_are_never_broadcast(spark, documents):
    """Small files hold many words: a broadcast of them takes the driver's memory."""
    staging = _Plans(spark)
    found = spelling.variants(documents((1, "chair chairs chair chairs chair chair chair chairs chair")), staging)
    assert _rows(found) == [("chair", None, "chair", 6, 1, None), ("chairs", "chair", "chair", 3, 1, 6)]
    plans = [*staging.plans, found._jdf.queryExecution().executedPlan().toString()]
    staging.discard()
    assert sum("SortMergeJoin" in p for p in plans) >= 4
    assert not any("BroadcastHashJoin" in p for p in plans)
