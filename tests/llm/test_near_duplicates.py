import random
from collections import Counter

import numpy as np
import pytest

from rinsework.llm import bagminhash, subspace


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


def _corpus(seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    rows, doc_id = [], 0
    for group in range(25):
        base = [word() for _ in range(r.choice((30, 80, 150)))]
        for _ in range(r.choice((1, 2, 2, 12))):
            copy = list(base)
            for _ in range(r.choice((0, 1, 1, 3))):  # some near, some not near enough
                copy[r.randrange(len(copy))] = word()
            rows.append((doc_id, " ".join(copy)))
            doc_id += 1
    rows += [(doc_id, None), (doc_id + 1, ""), (doc_id + 2, " \n"), (doc_id + 3, "one two"), (doc_id + 4, "one two"),
             (doc_id + 5, "hi " * 3000), (doc_id + 6, "hi " * 3100), (doc_id + 7, "hi " * 1000)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def corpus():
    return _corpus()


def test_classes_equal_brute_force(documents, staging, corpus, monkeypatch):
    monkeypatch.setattr(bagminhash, "CHUNK_DOCS", 3)  # families of several chunks
    rows = [(i, _shingles(t)) for i, t in corpus]
    expected = _classes(rows, lambda a, b: _similarity(a, b) >= 0.8)
    found = bagminhash.near_duplicates(documents(*corpus, (None, "lost"), corpus[0]), staging).collect()
    assert len(found) == len(corpus) + 2
    assert {r["doc_id"]: r["class_id"] for r in found if r["doc_id"] is not None} == expected
    assert [r["class_id"] for r in found if r["doc_id"] is None] == [None]


def test_keep_one(documents, staging, corpus):
    kept = bagminhash.keep_one(documents(*corpus, corpus[0], (None, "lost")), staging)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = [(i, _shingles(t)) for i, t in corpus]
    expected = sorted(set(_classes(rows, lambda a, b: _similarity(a, b) >= 0.8).values()))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == expected
    assert kept.where("doc_id IS NULL").count() == 1


def _prose(seed, n=60):
    r = random.Random(seed)
    return ["".join(r.choice("klmnopqrst") for _ in range(5)) for _ in range(n)]


def _edited(base, at=30):
    return " ".join([*base[:at], "edited", *base[at + 1 :]])


def test_ids_that_repeat_with_different_texts(documents, staging):
    a, b, c, d = (_prose(s) for s in range(4))
    # 20 stands for two texts, and each has a near copy; 40 has a text of its own beside a near copy of 30's
    rows = [(20, " ".join(a)), (20, " ".join(b)), (21, _edited(a)), (22, _edited(b)), (30, " ".join(c)),
            (40, _edited(c)), (40, " ".join(d)), (41, " ".join(d)), (41, " ".join(d))]
    found = bagminhash.near_duplicates(documents(*rows), staging).collect()
    assert len(found) == len(rows)
    assert {(r["doc_id"], r["class_id"]) for r in found} == {(20, 20), (21, 20), (22, 20), (30, 30), (40, 30), (41, 30)}
    kept = bagminhash.keep_one(documents(*rows), staging).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([rows[0], rows[1], rows[4], rows[6]])


def test_no_text_of_a_repeated_id_vanishes(documents, staging):
    a, b = " ".join(_prose(5)), " ".join(_prose(6))
    rows = [(1, a), (5, a), (5, b), (9, b)]
    found = bagminhash.near_duplicates(documents(*rows), staging).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in found) == [(1, 1), (5, 1), (5, 1), (9, 1)]
    kept = bagminhash.keep_one(documents(*rows), staging).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, a), (5, b)]


def test_empty_table(documents, staging):
    assert bagminhash.near_duplicates(documents((1, "x")).limit(0), staging).collect() == []


def test_signatures_are_unbiased():
    r = np.random.default_rng(2)
    rows, shingles, counts, truth = [], [], [], []
    for pair in range(60):  # weights from one to thousands, partly shared
        keys = r.integers(0, 2**63, 40).astype(np.uint64)
        a = r.choice([0, 1, 1, 2, 3, 7, 100, 3000], 40)
        b = np.where(r.random(40) < 0.6, a, r.choice([0, 1, 2, 5, 64, 1000], 40))
        truth.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
        for row, w in ((2 * pair, a), (2 * pair + 1, b)):
            rows.append(np.full((w > 0).sum(), row)), shingles.append(keys[w > 0]), counts.append(w[w > 0])
    signed = bagminhash.signatures(np.concatenate(rows), np.concatenate(shingles), np.concatenate(counts), 120, 512)
    found = (signed[0::2] == signed[1::2]).mean(axis=1)
    assert abs((found - truth).mean()) < 0.01 and np.abs(found - truth).max() < 0.12


def test_signature_does_not_depend_on_the_batch():
    keys = np.arange(1, 30, dtype=np.uint64)
    one = bagminhash.signatures(np.zeros(29, int), keys, np.arange(1, 30), 1, 64)
    two = bagminhash.signatures(np.repeat([0, 1], 29), np.tile(keys, 2), np.tile(np.arange(1, 30), 2), 2, 64)
    assert (one[0] == two).all()


VECTORS = "vec_id long, embedding array<float>, label int"


def _vectors(dims=20, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(30):
        base = r.normal(size=dims)
        for _ in range(int(r.choice([1, 2, 6]))):
            near = (base + r.normal(size=dims) * r.choice([0, 0.1, 0.25, 0.33])) * r.choice([1, 1, 1e-3, 50])
            rows.append([float(np.float32(x)) for x in near])
    rows += [rows[0]] * 5 + [[0.0] * dims, None, [float("nan")] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1),
                             [float("inf")] + [1.0] * (dims - 1), [], rows[0][:7], [1e30] * dims, [1e-30] * dims]
    return list(enumerate(rows))


@pytest.mark.parametrize("chunk", [12_000, 5])
def test_vectors_equal_brute_force(spark, staging, monkeypatch, chunk):
    monkeypatch.setattr(subspace, "CHUNK", chunk)
    rows = _vectors()

    def fine(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def unit(v):
        v = np.array(v) / max(map(abs, v))
        return v / np.linalg.norm(v)

    def link(a, b):
        return fine(a) and fine(b) and len(a) == len(b) and float(unit(a) @ unit(b)) >= 0.95

    label = _classes(rows, link)
    links = {i: sum(link(a, b) for j, b in rows if j != i) for i, a in rows}
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows] + [(None, rows[0][1], 0)], VECTORS)
    found = subspace.near_vectors(frame, staging, block=4).collect()
    assert len(found) == len(rows) + 1
    for r in found:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, False)
        else:
            i = r["vec_id"]
            assert (r["n_links"], r["component_id"], r["kept"]) == (links[i], label[i], label[i] == i)


def test_no_vectors(spark, staging):
    assert subspace.near_vectors(spark.createDataFrame([], VECTORS), staging).collect() == []
