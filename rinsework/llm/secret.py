"""Secrets in texts: stated patterns, and random-looking strings found by character Markov models.

Two first-order models over the same alphabet, one of random strings and one of ordinary identifiers, are compared by
their log-likelihood ratio. They are trained from samples labelled by the corpus: values that the patterns match are
random strings; identifiers outside of matches that are shorter than a secret are ordinary. Random strings in the
usual alphabets, drawn with a fixed seed, join the first class, so that a corpus without a single match still has both.
Transitions are counted over all texts.

A string of at least ``MIN_LENGTH`` characters, less what the patterns' spans cover, is a secret if its ratio exceeds ``PER_CHAR``
for each character and ``TOTAL`` in all.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")
MIN_LENGTH = 20
PER_CHAR, TOTAL = 0.5, 12.0
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
# the same patterns for a pass that only says which texts to look at
_ANY_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
_IDENTIFIER = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{6,{MIN_LENGTH - 1}}}(?![A-Za-z0-9+/_=-])")
_LONG = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_N = len(_ALPHABET)
_CODE = np.full(128, -1, dtype=np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(_N)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of the patterns' matches, by start and then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def _flagged(texts: pa.Array) -> np.ndarray:
    """Which texts may hold a match of a pattern."""
    masks = [pc.match_substring_regex(texts, p) for p in (_ANY_ASSIGN, ACCESS.pattern, HEX.pattern)]
    return pc.or_(pc.or_(masks[0], masks[1]), masks[2]).to_numpy(zero_copy_only=False)


def _transitions(strings: list[str]) -> np.ndarray:
    """Counts of (character before, character), the beginning of a string as its own state."""
    points = np.frombuffer(("\n".join(["", *strings, ""])).encode("ascii"), dtype=np.uint8)
    code = np.where(points == 10, _N, _CODE[points])
    pair = code[:-1] * (_N + 1) + code[1:]
    return np.bincount(pair[code[1:] < _N], minlength=(_N + 1) ** 2)[: (_N + 1) ** 2]


def _drawn(seed: int = 11, each: int = 400) -> list[str]:
    r = np.random.default_rng(seed)
    alphabets = ("0123456789abcdef", "0123456789ABCDEF", _ALPHABET[:62], _ALPHABET[:64], _ALPHABET[26:62])
    return ["".join(r.choice(list(a), 32)) for a in alphabets for _ in range(each)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros((2, (_N + 1) ** 2), dtype=np.int64)
    for batch in batches:
        texts = batch.column(0)
        flagged = _flagged(texts)
        ordinary: list[str] = []
        random: list[str] = []
        for text, look in zip(texts.to_pylist(), flagged):
            spans = base_spans(text) if look else []
            if not spans:
                ordinary += _IDENTIFIER.findall(text)
                continue
            random += [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= 8] + ACCESS.findall(text) + HEX.findall(text)
            at = 0
            for a, _, b in sorted(spans):
                if a > at:
                    ordinary += _IDENTIFIER.findall(text[at:a])
                at = max(at, b)
            ordinary += _IDENTIFIER.findall(text[at:])
            if len(ordinary) > 500_000:
                totals[1] += _transitions(ordinary)
                ordinary = []
        totals[0] += _transitions([re.sub(r"[^A-Za-z0-9+/_=-]", "", s) for s in random])
        totals[1] += _transitions(ordinary)
    kind, pair = np.nonzero(totals)
    yield pa.RecordBatch.from_pydict({
        "kind": pa.array(kind, pa.int32()), "pair": pa.array(pair, pa.int32()), "n": pa.array(totals[kind, pair], pa.int64())})


def train(docs: DataFrame) -> np.ndarray:
    """The log-likelihood ratio of every transition, random strings over ordinary identifiers, from all texts."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    counted = texts.mapInArrow(_count, "kind int, pair int, n long").groupBy("kind", "pair").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, (_N + 1) ** 2))
    for row in counted.collect():  # at most twice the square of the alphabet
        counts[row["kind"], row["pair"]] = row["n"]
    counts[0] += _transitions(_drawn())
    pairs = counts.reshape(2, _N + 1, _N + 1)[:, :, :_N]
    single = pairs.sum(axis=1, keepdims=True) + 0.5
    smooth = pairs + 5 * single / single.sum(axis=2, keepdims=True)  # rare states lean on single characters
    logs = np.log(smooth / smooth.sum(axis=2, keepdims=True))
    return logs[0] - logs[1]


def ratio(strings: list[str], model: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio of each string."""
    out = []
    for s in strings:
        code = _CODE[np.frombuffer(s.encode("ascii"), dtype=np.uint8)]
        out.append(model[np.concatenate([[_N], code[:-1]]), code].sum())
    return np.array(out)


def _outside(a: int, b: int, base: list[tuple[int, str, int]], first: int) -> tuple[list[tuple[int, int]], int]:
    """The parts of a range that no span of ``base``, sorted by start, covers; spans before ``first`` end before the range."""
    while first < len(base) and base[first][2] <= a:
        first += 1
    parts, at = [], first
    while at < len(base) and base[at][0] < b:
        parts.append((a, base[at][0]))
        a = max(a, base[at][2])
        at += 1
    return [(x, y) for x, y in [*parts, (a, b)] if y - x >= MIN_LENGTH], first


def all_spans(text: str, model: np.ndarray, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The patterns' spans and those that the models add outside them, by start and then kind as listed.

    A run of characters that a pattern's span touches is judged by what the span leaves of it.
    """
    found, first = [], 0
    for m in _LONG.finditer(text):
        parts, first = _outside(m.start(), m.end(), base, first)
        found += parts
    if not found:
        return base
    scores = ratio([text[a:b] for a, b in found], model)
    added = [(a, KINDS[3], b) for (a, b), x in zip(found, scores) if x > max(TOTAL, PER_CHAR * (b - a))]
    return sorted(base + added, key=lambda s: (s[0], KINDS.index(s[1])))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def scan(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """Spans of secrets of every row of ``docs (doc_id, text)``, in code points, end exclusive; a null text is empty.

    Ids may be null or repeat and stay exact; every row is scanned by itself; an empty table gives an empty result; other
    columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            look = _flagged(texts)
            long = pc.match_substring_regex(texts, _LONG.pattern).to_numpy(zero_copy_only=False)
            rows = []
            for text, has, may in zip(texts.to_pylist(), look, long):
                base = base_spans(text) if has else []
                kinds = [k for _, k, _ in base]
                spans = all_spans(text, model, base) if may else base
                rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return named.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
