"""Quality of whole texts, learned from trusted good texts and unlabelled web text.

Positive-unlabelled learning: with ``p`` the share of good texts in the corpus, the risk of a classifier is ``p`` times its loss
on good texts, plus its loss on bad ones. Bad texts are never shown; their part of the risk is the loss of calling unlabelled
texts bad, less ``p`` times the loss of calling good texts bad. That estimate is unbiased, but a flexible model can push it
below zero; the non-negative risk counts it as zero at least, and a step that finds it negative goes back up.

The class prior ``p`` is estimated before: a first network tells trusted texts from unlabelled ones, and all documents are
scored by it. Good texts reach any score at least as often in the corpus as ``p`` times their share among trusted texts, so ``p``
is at most the ratio of the two shares, and the smallest ratio over all scores, less what chance may do, comes closest.

A text enters as ``SHAPE`` measures of its characters, words and lines, and as hashed frequencies of its character n-grams.
Every character and word of a text counts, however long it is. The network (one hidden layer) is trained in numpy.

Plan: one pass reads the texts and writes their measures, half a kilobyte a document. Training collects a bounded sample of
those; the corpus' histogram and the scores are further passes over the measures alone, which are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinsework.session import Staging

from . import words

#: Trusted positives, and unlabelled rows, that training may use at most from each half of the ids.
SAMPLE = 2_000
THRESHOLD = 0.5
#: Buckets of character n-grams, their length, and units of the hidden layer.
BUCKETS, GRAM, HIDDEN = 256, 3, 16
#: The measures of a text besides its n-grams.
SHAPE = (
    "letters", "capitals", "digits", "spaces", "signs", "other", "log characters", "log words", "log word length", "distinct words",
    "words repeated at once", "commonest word", "distinct lines", "words a line", "words without letters", "words in capitals",
    "words ending in signs", "repeated signs",
)
_STEPS, _BATCH, _RATE, _DECAY, _SEED = 600, 512, 0.01, 1e-2, 13
#: Ranges of scores in which the shares are counted, and deviations that chance is allowed.
_BINS, _DEVIATIONS = 1_000, 1.0
_KINDS = 6


def _kinds() -> np.ndarray:
    """The kind of every code point below 2^16: letter, capital, digit, space, sign, other."""
    kinds = np.full(1 << 16, 5, dtype=np.uint8)
    for c in range(1 << 16):
        x = chr(c)
        kinds[c] = 1 if x.isupper() else 0 if x.isalpha() else 2 if x.isdigit() else 3 if x.isspace() else 4 if c < 0x3000 else 5
    return kinds


_KIND = _kinds()


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts (those beyond 2^16 as the last one), and the text of each."""
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.minimum(points, (1 << 16) - 1), np.repeat(np.arange(len(texts)), np.asarray(pc.utf8_length(texts)))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text, how many distinct values it has and how often it has the commonest."""
    if not len(value):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    first = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (v[1:] != v[:-1])))
    runs = np.diff(np.append(first, len(o)))
    most = np.zeros(n)
    np.maximum.at(most, o[first], runs)
    return np.bincount(o[first], minlength=n).astype(float), most


def measures(texts: pa.Array) -> np.ndarray:
    """One row for each text (none null): the shape, then the n-grams' frequencies scaled to length one."""
    n = len(texts)
    points, owner = _codes(texts)
    chars = np.bincount(owner, minlength=n)
    kind = _KIND[points]
    kinds = np.bincount(owner * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS)
    twice = (points[1:] == points[:-1]) & (kind[1:] == 4) & (owner[1:] == owner[:-1])

    flat, counts = words.split_words(texts)
    whose = np.repeat(np.arange(n), counts)
    coded = flat.dictionary_encode()
    known, code = coded.dictionary, coded.indices.to_numpy()
    kept, most = _distinct(whose, code, n)
    again = (code[1:] == code[:-1]) & (whose[1:] == whose[:-1])
    plain = np.asarray(pc.utf8_length(known)).astype(float)
    flags = [
        pc.invert(pc.match_substring_regex(known, r"\p{L}")),
        pc.and_(pc.match_substring_regex(known, r"\p{Lu}\p{Lu}"), pc.invert(pc.match_substring_regex(known, r"\p{Ll}"))),
        pc.match_substring_regex(known, r"[^\p{L}\p{N}][^\p{L}\p{N}]$"),
    ]
    of_words = [np.bincount(whose, weights=np.asarray(f).astype(float)[code], minlength=n) for f in flags] if len(code) else [np.zeros(n)] * 3
    length = np.bincount(whose, weights=plain[code], minlength=n) if len(code) else np.zeros(n)

    lines = pc.split_pattern(texts, "\n")
    line_of = np.repeat(np.arange(n), np.asarray(pc.list_value_length(lines)))
    every = pc.utf8_trim_whitespace(lines.flatten())
    filled = np.asarray(pc.not_equal(every, ""))
    line_code = every.dictionary_encode().indices.to_numpy()
    distinct_lines = _distinct(line_of[filled], line_code[filled], n)[0]
    line_count = np.bincount(line_of[filled], minlength=n)

    shape = [_share(kinds[:, k], chars) for k in range(_KINDS)]
    shape += [np.log1p(chars), np.log1p(counts), np.log1p(_share(length, counts)), _share(kept, counts),
              _share(np.bincount(whose[1:][again], minlength=n), counts), _share(most, counts), _share(distinct_lines, line_count),
              np.log1p(_share(counts, line_count)), *[_share(f, counts) for f in of_words],
              _share(np.bincount(owner[1:][twice], minlength=n), chars)]
    return np.concatenate([np.stack(shape, axis=1), _grams(points, owner, n)], axis=1).astype(np.float32)


def _grams(points: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    size = len(points) - GRAM + 1
    if size < 1:
        return np.zeros((n, BUCKETS))
    total = np.zeros(size, dtype=np.uint64)
    for k in range(GRAM):
        total = total * np.uint64(0x9E3779B97F4A7C15) + points[k : k + size]
    inside = owner[:size] == owner[GRAM - 1 :]
    bucket = (total[inside] >> np.uint64(40)) % np.uint64(BUCKETS)
    found = np.bincount(owner[:size][inside] * BUCKETS + bucket.astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    return found / np.maximum(np.sqrt((found.astype(float) ** 2).sum(axis=1, keepdims=True)), 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Network:
    """Measures to a score between 0 and 1."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def fresh(cls, sample: np.ndarray, seed: int = _SEED) -> Network:
        r, width = np.random.default_rng(seed), sample.shape[1]
        weights = {"in": r.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), "shift": np.zeros(HIDDEN),
                   "out": r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "bias": np.zeros(1)}
        return cls(weights, sample.mean(axis=0), sample.std(axis=0) + 1e-3)

    def inputs(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows.astype(np.float64) - self.mean) / self.scale, -6, 6)

    def logits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(x @ self.weights["in"] + self.weights["shift"])
        return hidden @ self.weights["out"] + self.weights["bias"][0], hidden

    def score(self, rows: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(self.inputs(rows))[0])

    def gradients(self, x: np.ndarray, hidden: np.ndarray, slope: np.ndarray) -> dict[str, np.ndarray]:
        inner = slope[:, None] * self.weights["out"] * (1 - hidden**2)
        return {"in": x.T @ inner, "shift": inner.sum(axis=0), "out": hidden.T @ slope, "bias": slope.sum(keepdims=True)}


def risk(good: np.ndarray, open_: np.ndarray, prior: float, bounded: bool) -> tuple[float, float, tuple[np.ndarray, np.ndarray]]:
    """The two parts of the risk for logits of trusted and unlabelled texts, and the slopes of a step's objective.

    The loss of a logit ``z`` for the bad class is logistic, ``log(1 + exp(z))``, or ``bounded``, ``sigmoid(z)``; that of the good
    class is the same of ``-z``. While the bad class' part is negative, the step follows its reverse alone.
    """
    up, free = _sigmoid(good), _sigmoid(open_)
    n, m = len(good), len(open_)
    if bounded:
        loss_good, loss_bad, loss_open = 1 - up, up, free
        d_good, d_bad, d_open = up * (up - 1) / n, up * (1 - up) / n, free * (1 - free) / m
    else:
        loss_good, loss_bad, loss_open = np.logaddexp(0, -good), np.logaddexp(0, good), np.logaddexp(0, open_)
        d_good, d_bad, d_open = (up - 1) / n, up / n, free / m
    positive, negative = prior * loss_good.mean(), loss_open.mean() - prior * loss_bad.mean()
    if negative < 0:
        return positive, negative, (prior * d_bad, -d_open)
    return positive, negative, (prior * (d_good - d_bad), d_open)


def train(good: np.ndarray, open_: np.ndarray, prior: float | None, steps: int = _STEPS, seed: int = _SEED) -> Network:
    """Fit a network to the measures of trusted and unlabelled texts under the non-negative risk of class prior ``prior``.

    The first third of the steps takes the logistic loss, which pulls back whole groups of texts that begin on the wrong side; the
    bounded one then gives no weight to what can't be told. Without a prior the network learns to tell trusted from unlabelled texts.
    """
    net, r = Network.fresh(np.concatenate([good, open_]), seed), np.random.default_rng(seed)
    a, b = net.inputs(good), net.inputs(open_)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    for step in range(1, steps + 1):
        x = a[r.integers(len(a), size=_BATCH)], b[r.integers(len(b), size=_BATCH)]
        (good_z, good_h), (open_z, open_h) = net.logits(x[0]), net.logits(x[1])
        if prior is None:
            slopes = (_sigmoid(good_z) - 1) / _BATCH, _sigmoid(open_z) / _BATCH
        else:
            slopes = risk(good_z, open_z, prior, bounded=3 * step > steps)[2]
        parts = [net.gradients(v, h, s) for v, h, s in zip(x, (good_h, open_h), slopes)]
        rate = _RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, w in net.weights.items():
            g, (m, v) = parts[0][k] + parts[1][k] + _DECAY * w, moments[k]
            m[...] = 0.9 * m + 0.1 * g
            v[...] = 0.99 * v + 0.01 * g**2
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def prior_of(trusted: np.ndarray, every: np.ndarray) -> float:
    """The estimated share of good texts, from how many trusted texts and how many documents have each range of scores.

    Shares are taken over all scores from the top down; a share that few texts make up is uncertain, and the deviations that chance
    allows are added to the corpus' and taken from the trusted texts' share, so that the smallest ratio isn't one of luck.
    """
    n, m = trusted.sum(), every.sum()
    if not n or not m:
        return 1.0
    top, whole = np.cumsum(trusted[::-1]) / n, np.cumsum(every[::-1]) / m
    chance = _DEVIATIONS * (np.sqrt(top * (1 - top) / n) + np.sqrt(whole * (1 - whole) / m)) + 1 / n
    use = top > 2 * chance
    best = np.argmin((whole[use] + chance[use]) / (top[use] - chance[use]))
    return float(np.clip(whole[use][best] / top[use][best], 0.01, 1.0))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from training: CRC-32 of the id's text leaves 1 modulo 3. False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trusted(labels: DataFrame) -> DataFrame:
    """``(doc_id)`` of the documents whose label of quality 1 may be learned; an id with a good and a bad label isn't one."""
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out())
    good = good.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("worst"))
    return good.where("worst = 1").select("doc_id")


def measured(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, m)`` for every row of ``docs (doc_id, text)``: the measures as half-precision numbers. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(pc.utf8_length(batch.column(2)))
            for lo, hi in words.slices(lengths, 1_000_000):
                found = measures(batch.column(2).slice(lo, hi - lo)).astype(np.float16)
                rows = pa.array([row.tobytes() for row in found], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), rows], names=["doc_id", "held_out", "m"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return named.mapInArrow(run, "doc_id long, held_out boolean, m binary")


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.float16).reshape(len(rows), -1).astype(np.float32)


def _key() -> Column:
    return F.xxhash64("doc_id", "m")


def _fold() -> Column:
    """Which of two halves a row belongs to, by a hash of its id."""
    return F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(2)).cast("int")


def _samples(rows: DataFrame, good: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """The measures of ``SAMPLE`` rows for each (kind, half), kind 1 being trusted rows and 0 any; those of smallest hash.

    Held-out rows take no part; repeated rows of one id count once. Only ids and hashes are shuffled, and of the measures those picked.
    """
    known = rows.where("NOT held_out").select("doc_id", _fold().alias("fold"), _key().alias("key"))
    kinds = known.select(F.lit(0).alias("kind"), "fold", "key").union(known.join(good, "doc_id").select(F.lit(1).alias("kind"), "fold", "key"))
    place = F.row_number().over(Window.partitionBy("kind", "fold").orderBy("key"))
    picked = kinds.distinct().withColumn("place", place).where(F.col("place") <= SAMPLE).select("kind", "fold", F.col("key").alias("_key"))
    # at most 4 * SAMPLE rows of three numbers are broadcast
    found = rows.select(_key().alias("key"), "m").join(F.broadcast(picked), F.col("key") == F.col("_key"))
    table = found.groupBy("kind", "fold", "key").agg(F.first("m").alias("m")).toArrow().sort_by([(c, "ascending") for c in ("kind", "fold", "key")])
    kind, fold = table["kind"].to_numpy(), table["fold"].to_numpy()
    parts = {(k, f): np.flatnonzero((kind == k) & (fold == f)) for k in (0, 1) for f in (0, 1)}
    return {at: _matrix(table["m"].take(pa.array(which))) if len(which) else np.zeros((0, len(SHAPE) + BUCKETS), dtype=np.float32)
            for at, which in parts.items()}


def _placed(nets: list[Network]):
    """The range of scores of each row, scored by the network that the other half trained."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, rows = batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch.column(2))
            scores = np.where(fold == 0, nets[1].score(rows), nets[0].score(rows))
            place = np.minimum((scores * _BINS).astype(np.int32), _BINS - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place, pa.int32())], names=["doc_id", "place"])

    return run


def fit(rows: DataFrame, good: DataFrame) -> tuple[Network | None, float]:
    """A network for ``rows (doc_id, held_out, m)`` with the trusted ids ``good (doc_id)``, and the class prior.

    Learns from at most ``SAMPLE`` trusted rows of either half of the ids, and as many others, which may be good or bad; both exclude
    rows held out, and are picked by a hash, so reruns agree. The prior is taken over all rows, each scored by a network
    that never saw it. Without trusted rows there is no network; without enough of them to estimate a prior it is 1.
    """
    sample = _samples(rows, good)
    known, open_ = (np.concatenate([sample[kind, 0], sample[kind, 1]]) for kind in (1, 0))
    if not len(known):
        return None, 0.0
    if not all(map(len, sample.values())):
        return train(known, open_, 1.0), 1.0
    apart = [train(sample[1, fold], sample[0, fold], None) for fold in (0, 1)]
    placed = rows.select("doc_id", _fold().alias("fold"), "m").mapInArrow(_placed(apart), "doc_id long, place int")
    marked = placed.join(good.withColumn("trusted", F.lit(1)), "doc_id", "left")
    shares = np.zeros((2, _BINS))
    for row in marked.groupBy("place").agg(F.count("*").alias("n"), F.count("trusted").alias("good")).collect():  # a row for each range
        shares[:, row["place"]] = row["good"], row["n"]
    prior = prior_of(*shares)
    return train(known, open_, prior), prior


def score(rows: DataFrame, net: Network | None) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``rows (doc_id, held_out, m)``; all score 0 without a network."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows) if net is None else net.score(_matrix(batch.column(2))).round(9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=["doc_id", "held_out", "score"])

    scored = rows.select("doc_id", "held_out", "m").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, staging: Staging) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs (doc_id, text)``, learned from ``labels (doc_id, quality)``.

    Only texts and labels of quality 1 outside the held-out rows are learned from; other columns aren't read. Null texts are
    empty and scored like empty ones; equal texts score equally, whatever their ids; rows of one id are scored each by its own
    text. An empty table gives an empty result; without trusted texts every score is 0.
    """
    rows = staging.write(measured(docs), "measures")
    return score(rows, fit(rows, staging.write(trusted(labels), "trusted"))[0])
