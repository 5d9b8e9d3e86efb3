import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from rinsework.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def _brute(rows, parts=codes.PARTS, entries=codes.ENTRIES, rounds=codes.ROUNDS):
    """The contract in plain Python, over rows of one vector length."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = len(kept[0][1])
    cut = [slice(dims * k // parts, dims * (k + 1) // parts) for k in range(parts)]
    books = [[r[1][c] for r in kept[:entries]] for c in cut]

    def find(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for k, c in enumerate(cut):
            groups = defaultdict(list)
            for r in kept:
                groups[find(r[1][c], books[k])[1]].append(r[1][c])
            books[k] = [[sum(x) // len(groups[e]) for x in zip(*groups[e])] if e in groups else entry
                        for e, entry in enumerate(books[k])]
    found = [[find(r[1][c], book) for c, book in zip(cut, books)] for r in kept]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = defaultdict(int)
    for r, error in zip(kept, errors):
        by_label[r[2]] += error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(repr((r[0], "".join(f"{e:02x}" for _, e in f), error, by_label[r[2]], sha)) for r, f, error in zip(kept, found, errors))


def _rows(frame):
    return sorted(repr(tuple(r)) for r in frame.collect())


def _vectors(n, dims, seed):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(9)]
    rows = []
    for i in range(n):
        v = [float(np.float32(x + r.gauss(0, 0.2))) for x in r.choice(centres)]
        rows.append((i, v, r.choice([0, 1, 1, None])))
    return rows


def test_codes_equal_brute_force(spark, staging):
    rows = _vectors(330, 8, 1)
    rows += [(400, None, 1)]
    rows += [(402, [1.0] * 7 + [None], 0), (403, [math.nan] + [0.0] * 7, 0), (404, [math.inf] + [0.0] * 7, 2)]
    rows += [rows[5], (7, [9.5, -9.5] * 4, 3), (None, [0.25] * 8, None), (None, [-0.0004] * 8, 1)]  # repeated and null ids
    random.Random(3).shuffle(rows)
    got = codes.compress(spark.createDataFrame(rows, SCHEMA), staging)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert _rows(got) == _brute(rows)


@pytest.mark.parametrize("dims", [1, 4, 6])
def test_few_vectors_and_uneven_parts(spark, staging, dims):
    rows = [(i, [i / 7] * dims, None) for i in range(5)] + [(9, [1 / 7] * dims, 4)]
    assert _rows(codes.compress(spark.createDataFrame(rows, SCHEMA), staging)) == _brute(rows)


def test_empty_table_and_clashing_columns(spark, staging):
    rows = [(1, [0.5, 0.25, 1.0, -1.0], 3, "x", 1, "n"), (2, [0.5, 0.25, 1.0, -1.0], 3, "y", 2, "m")]
    frame = spark.createDataFrame(rows, SCHEMA + ", code string, error int, same string")
    assert codes.compress(frame.limit(0), staging).collect() == []
    assert _rows(codes.compress(frame, staging)) == _brute([r[:3] for r in rows])
    nothing = spark.createDataFrame([(1, None, 1), (2, [None], 1)], SCHEMA)
    assert codes.compress(nothing, staging).collect() == []


def test_lengths_have_codebooks_of_their_own(spark, staging):
    short, long = _vectors(20, 4, 5), [(i + 50, v, 7) for i, v, _ in _vectors(20, 8, 6)]
    rows = [(i, v, 6) for i, v, _ in short] + long + [(99, [], 8)]
    got = _rows(codes.compress(spark.createDataFrame(rows, SCHEMA), staging))
    assert got == sorted(_brute([r for r in rows if len(r[1]) == 4]) + _brute(long) + _brute([rows[-1]]))


def test_distances_are_exact_at_the_limit():
    values = np.array([[codes.LIMIT, -codes.LIMIT], [0, 1], [5, 5]])
    book = np.array([[-codes.LIMIT, codes.LIMIT], [0, 1]])
    best, error = codes.nearest(values, book)
    assert best.tolist() == [1, 1, 1] and error.tolist() == [codes.LIMIT**2 + (codes.LIMIT + 1) ** 2, 0, 41]
    known, places = codes.dictionary(values[:, 0])
    assert known[places].tolist() == values[:, 0].tolist() and len(known) == 3


def test_decoded_vectors_are_near(spark, staging):
    rows = _vectors(300, 8, 7)
    kept = codes.integers(spark.createDataFrame(rows, SCHEMA), staging)
    books = codes.fit(kept, 8)
    back = codes.decode(codes.encode(kept, books, 8), books).collect()
    given = {i: v for i, v, _ in rows}
    for r in back:
        scaled = [math.floor(1024 * x) for x in given[r["vec_id"]]]
        assert sum((a - round(1024 * b)) ** 2 for a, b in zip(scaled, r["approximate"])) == r["error"]
