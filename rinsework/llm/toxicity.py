"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as a hashed word embedding beside the scaled sum of its hashed character n-grams (ends marked). Windows
of ``WINDOW`` words, each beginning ``STRIDE`` words after the one before and the last one ending with the text, cover
every text; a window's logit comes from attention over the states of both directions, and a text's score is that of
its most toxic window. Training sees labels of texts only: the loss goes through each text's currently highest window.
One number of every embedding starts at the row's standardised excess of toxic training texts.

Training takes a bounded sample: ``SAMPLE`` labelled rows of either class, and ``SAMPLE_WINDOWS`` windows spread over
each of those texts. Scoring reads every word of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words

WINDOW, STRIDE = 32, 24
#: Labelled rows of either class, and windows of each, that training may use.
SAMPLE, SAMPLE_WINDOWS = 2_500, 16
#: Rows of the two hashed embeddings, their width, and the states of one direction.
TABLE, WIDTH, STATE = 1 << 17, 8, 8
#: Characters in an n-gram.
GRAM = 4
THRESHOLD = 0.3
_STEPS, _BATCH, _SEED = 240, 60, 7
_EDGES = ".,;:!?\"'()[]{}<>*#%&$|_-…«»“”‘’"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    y = np.exp(np.minimum(-x, 80))
    y += 1
    return np.reciprocal(y, out=y)


def _tanh(x: np.ndarray) -> np.ndarray:
    y = _sigmoid(2 * x)
    y *= 2
    y -= 1
    return y


def _ngrams(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all character n-grams, and the word each belongs to."""
    points = np.frombuffer(("".join(f"^{w}$" for w in vocabulary)).encode("utf-32-le"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(vocabulary)), [len(w) + 2 for w in vocabulary])
    if len(points) < GRAM:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    total = np.zeros(len(points) - GRAM + 1, dtype=np.uint64)
    for k in range(GRAM):
        total = total * np.uint64(0x100000001B3) + points[k : len(points) - GRAM + 1 + k]
    inside = np.flatnonzero(owner[: len(total)] == owner[GRAM - 1 :])
    return (words.mix(total[inside]) % np.uint64(TABLE)).astype(np.int64), owner[inside]


@dataclass
class Lexicon:
    """The distinct words of some texts with their table rows; position ``size`` stands for no word."""

    size: int
    word_row: np.ndarray
    gram_row: np.ndarray
    gram_word: np.ndarray
    gram_scale: np.ndarray

    @classmethod
    def of(cls, vocabulary: list[str]) -> Lexicon:
        import xxhash

        plain = [w.strip(_EDGES) or w for w in vocabulary]
        word_row = np.array([xxhash.xxh3_64_intdigest(w) % TABLE for w in plain], dtype=np.int64)
        gram_row, gram_word = _ngrams(plain)
        counts = np.bincount(gram_word, minlength=len(plain))
        scale = (1 / np.sqrt(np.maximum(counts, 1))).astype(np.float32)
        return cls(len(plain), word_row, gram_row, gram_word, scale)


@dataclass
class Network:
    """The parameters, and the forward and backward pass."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None

    @classmethod
    def fresh(cls, seed: int = _SEED) -> Network:
        r = np.random.default_rng(seed)
        w = {
            "word": np.zeros((TABLE, WIDTH)), "gram": np.zeros((TABLE, WIDTH)),
            "attend": r.normal(0, 0.3, (2 * STATE, STATE)), "query": r.normal(0, 0.5, STATE),
            "out": r.normal(0, 0.5, 2 * STATE), "bias": np.array([-0.5]),
        }
        for side in "fb":
            w[f"in_{side}"] = r.normal(0, 0.4, (2 * WIDTH, 3 * STATE))
            w[f"loop_{side}"] = r.normal(0, 0.3, (STATE, 3 * STATE))
            w[f"shift_{side}"] = np.zeros(3 * STATE)
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def inputs(self, lexicon: Lexicon, known: np.ndarray | None = None) -> np.ndarray:
        """A row for each word, and a zero row for no word. ``known``: which words show their own embedding."""
        x = np.zeros((lexicon.size + 1, 2 * WIDTH), dtype=np.float32)
        own = self.weights["word"][lexicon.word_row]
        x[:-1, :WIDTH] = own if known is None else own * known[:, None]
        if len(lexicon.gram_row):
            starts = np.flatnonzero(np.diff(lexicon.gram_word, prepend=-1))
            sums = np.add.reduceat(self.weights["gram"].take(lexicon.gram_row, axis=0), starts, axis=0)
            x[lexicon.gram_word[starts], WIDTH:] = sums
            x[:-1, WIDTH:] *= lexicon.gram_scale[:, None]
        return x

    def _direction(self, side: str, projected: np.ndarray, at: np.ndarray, filled: np.ndarray | None, keep: list | None):
        """The states of one direction: time, state, window. Arrays are state by window, which numpy walks in line."""
        loop = np.ascontiguousarray(self.weights[f"loop_{side}"].T)
        length, n = at.shape
        h = np.zeros((STATE, n), dtype=np.float32)
        states = np.empty((length, STATE, n), dtype=np.float32)
        for t in range(length) if side == "f" else range(length - 1, -1, -1):
            x, own = np.ascontiguousarray(projected.take(at[t], axis=0).T), loop @ h
            gates = _sigmoid(x[: 2 * STATE] + own[: 2 * STATE])
            reset, stay = gates[:STATE], gates[STATE:]
            new = _tanh(x[2 * STATE :] + reset * own[2 * STATE :])
            after = new + stay * (h - new)
            if filled is not None:
                after = np.where(filled[t], after, h)
            if keep is not None:
                keep.append((t, h, reset, stay, new, own, filled[t]))
            h = states[t] = after
        return states

    def logits(self, x: np.ndarray, at: np.ndarray, trace: dict | None = None, full: bool = False) -> np.ndarray:
        """One logit for each window. ``at``: positions in ``x`` by time and window, its last row for no word.

        ``full`` says that every window has ``WINDOW`` words.
        """
        w = self.weights
        filled = None if full else at < len(x) - 1
        kept: dict[str, list] = {"f": [], "b": []}
        sides = [
            self._direction(s, x @ w[f"in_{s}"] + w[f"shift_{s}"], at, filled, kept[s] if trace is not None else None)
            for s in "fb"
        ]
        both = np.concatenate(sides, axis=1)  # time, state, window
        hidden = _tanh(np.matmul(w["attend"].T, both))
        energy = np.einsum("tsn,s->tn", hidden, w["query"])
        if filled is not None:
            energy = np.where(filled, energy, np.float32(-30))
        energy = np.exp(energy - energy.max(axis=0))
        share = energy / energy.sum(axis=0)
        pooled = np.einsum("tn,tsn->sn", share, both)
        if trace is not None:
            trace |= {"kept": kept, "both": both, "hidden": hidden, "share": share, "pooled": pooled, "x": x, "at": at}
        return w["out"] @ pooled + w["bias"][0]

    def gradients(self, slope: np.ndarray, trace: dict) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the dense weights, and of the word inputs."""
        w, both, share, hidden = self.weights, trace["both"], trace["share"], trace["hidden"]
        x, at = trace["x"], trace["at"]
        g = {"out": trace["pooled"] @ slope, "bias": slope.sum(keepdims=True)}
        d_pooled = w["out"][:, None] * slope
        d_share = np.einsum("sn,tsn->tn", d_pooled, both)
        d_energy = share * (d_share - (share * d_share).sum(axis=0))
        g["query"] = np.einsum("tn,tsn->s", d_energy, hidden)
        d_hidden = d_energy[:, None, :] * w["query"][:, None] * (1 - hidden**2)
        g["attend"] = np.einsum("tsn,tkn->sk", both, d_hidden)
        d_both = share[:, None, :] * d_pooled + np.matmul(w["attend"], d_hidden)
        d_x = np.zeros_like(x)
        for side, cut in (("f", slice(0, STATE)), ("b", slice(STATE, None))):
            loop, d_loop = w[f"loop_{side}"], np.zeros_like(w[f"loop_{side}"])
            d_in = np.zeros((len(at), 3 * STATE, at.shape[1]), dtype=np.float32)
            d_h = np.zeros_like(both[0][cut])
            for t, h, reset, stay, new, own, mask in reversed(trace["kept"][side]):
                d = d_h + d_both[t][cut]
                live = d * mask
                d_new = live * (1 - stay) * (1 - new**2)
                d_stay = live * (h - new) * stay * (1 - stay)
                d_reset = d_new * own[2 * STATE :] * reset * (1 - reset)
                d_own = np.concatenate([d_reset, d_stay, d_new * reset])
                d_in[t] = np.concatenate([d_reset, d_stay, d_new])
                d_loop += h @ d_own.T
                d_h = d * ~mask + live * stay + loop @ d_own
            flat = d_in.transpose(0, 2, 1).reshape(-1, 3 * STATE)
            g[f"loop_{side}"], g[f"shift_{side}"] = d_loop, flat.sum(axis=0)
            g[f"in_{side}"] = x[at.ravel()].T @ flat
            np.add.at(d_x, at.ravel(), flat @ w[f"in_{side}"].T)
        return g, d_x[:-1]


def _starts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first word of every window, and the text it belongs to; a text without words has one, which is empty."""
    windows = np.maximum(1, np.ceil((counts - WINDOW) / STRIDE).astype(np.int64) + 1)
    owner = np.repeat(np.arange(len(counts)), windows)
    place = (np.arange(len(owner)) - (np.cumsum(windows) - windows)[owner]) * STRIDE
    return np.minimum(place, np.maximum(counts[owner] - WINDOW, 0)), owner


def train(windows: list[list[str]], toxic: np.ndarray, steps: int = _STEPS, seed: int = _SEED) -> Network:
    """Fit a network to texts given as windows (words joined by spaces) and their labels.

    Without examples of both classes there is nothing to tell apart: every text then scores the share of toxic labels.
    """
    toxic = np.asarray(toxic, dtype=bool)
    if toxic.all() or not toxic.any():
        return Network(constant=float(toxic.mean()) if len(toxic) else 0.0)
    net, r = Network.fresh(seed), np.random.default_rng(seed)
    split = [[w.split(" ")[:WINDOW] for w in doc] for doc in windows]
    vocabulary = sorted({w for doc in split for win in doc for w in win})
    place = {w: i for i, w in enumerate(vocabulary)}
    lexicon = Lexicon.of(vocabulary)
    nothing = lexicon.size
    at = [np.array([[place[w] for w in win] + [nothing] * (WINDOW - len(win)) for win in doc]).T for doc in split]
    order = np.argsort(lexicon.gram_word, kind="stable")
    gram_at = np.concatenate([[0], np.cumsum(np.bincount(lexicon.gram_word, minlength=nothing))])
    gram_rows = lexicon.gram_row[order]
    seen = [np.unique(a[a < nothing]) for a in at]
    grams = [np.unique(np.concatenate([gram_rows[gram_at[i] : gram_at[i + 1]] for i in x] or [seen[0][:0]])) for x in seen]
    net.weights["word"][:, 0] = _excess([np.unique(lexicon.word_row[x]) for x in seen], toxic)
    net.weights["gram"][:, 0] = _excess(grams, toxic)
    classes = [np.flatnonzero(toxic), np.flatnonzero(~toxic)]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    for step in range(1, steps + 1):
        chosen = np.concatenate([r.choice(classes[0], _BATCH // 3), r.choice(classes[1], _BATCH - _BATCH // 3)])
        stacked = np.concatenate([at[i] for i in chosen], axis=1)
        used, local = np.unique(stacked, return_inverse=True)
        local = local.reshape(stacked.shape)
        real = used[used < nothing]
        if len(real) == len(used):
            used = np.append(used, nothing)
        spans = [gram_rows[gram_at[i] : gram_at[i + 1]] for i in real]
        sizes = np.array([len(s) for s in spans])
        small = Lexicon(len(real), lexicon.word_row[real], np.concatenate(spans), np.repeat(np.arange(len(real)), sizes),
                        lexicon.gram_scale[real])
        known = (r.random(len(real)) > 0.3).astype(np.float32)  # hidden words must be told by their characters
        x = net.inputs(small, known)
        logits = net.logits(x, local)
        begins = np.cumsum([0] + [at[i].shape[1] for i in chosen[:-1]])
        best = np.array([b + np.argmax(logits[b : b + at[i].shape[1]]) for b, i in zip(begins, chosen)])
        trace: dict = {}
        slope = _sigmoid(net.logits(x, local[:, best], trace)) - toxic[chosen]
        dense, d_x = net.gradients((slope / len(chosen)).astype(np.float32), trace)
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in dense.items():
            _adam(net.weights[k], moments[k], slice(None), g, rate, step)
        touched = np.flatnonzero(np.abs(d_x).sum(axis=1) > 0)
        for k, rows, grads in (
            ("word", small.word_row[touched], d_x[touched, :WIDTH] * known[touched, None]),
            ("gram", np.concatenate([spans[i] for i in touched] or [np.zeros(0, int)]),
             np.repeat(d_x[touched, WIDTH:] * small.gram_scale[touched, None], sizes[touched], axis=0)),
        ):
            unique, back = np.unique(rows, return_inverse=True)
            total = np.zeros((len(unique), WIDTH), dtype=np.float32)
            np.add.at(total, back, grads)
            _adam(net.weights[k], moments[k], unique, total, 0.2 * rate, step)
    return net


def _excess(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """For every table row, how far its toxic texts exceed what chance gives, in deviations, clipped and scaled."""
    hits = [np.bincount(np.concatenate([r for r, t in zip(rows, toxic) if t == c]), minlength=TABLE) for c in (True, False)]
    expected = (hits[0] + hits[1]) * toxic.mean()
    return np.clip((hits[0] - expected) / np.sqrt(expected + 1), -4, 4) / 4


def _adam(weight, moment, rows, grad, rate: float, step: int) -> None:
    m, v = moment
    m[rows] = 0.9 * m[rows] + 0.1 * grad
    v[rows] = 0.99 * v[rows] + 0.01 * grad**2
    weight[rows] -= rate * (m[rows] / (1 - 0.9**step)) / (np.sqrt(v[rows] / (1 - 0.99**step)) + 1e-6)


def _lowered(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return words.split_words(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")))


def score_texts(net: Network, texts: pa.Array) -> np.ndarray:
    """The score of every text, from all its overlapping windows. Texts without words have nothing toxic: 0."""
    if net.constant is not None:
        return np.full(len(texts), net.constant)
    flat, counts = _lowered(texts)
    coded = flat.dictionary_encode()
    lexicon = Lexicon.of(coded.dictionary.to_pylist())
    x = net.inputs(lexicon)
    codes = coded.indices.to_numpy()
    begin, owner = _starts(counts)
    offset = (np.cumsum(counts) - counts)[owner]
    logits = np.empty(len(begin), dtype=np.float32)
    whole = counts[owner] >= WINDOW
    for full in (True, False):
        windows = np.flatnonzero(whole == full)
        for i in range(0, len(windows), 4096):
            w = windows[i : i + 4096]
            place = begin[w] + np.arange(WINDOW)[:, None]
            if full:
                at = codes[place + offset[w]]
            else:
                inside = place < counts[owner[w]]
                at = np.full(place.shape, lexicon.size)
                at[inside] = codes[(place + offset[w])[inside]]
            logits[w] = net.logits(x, at, full=full)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    return np.where(counts > 0, _sigmoid(np.maximum.reduceat(logits, first).astype(np.float64)), 0.0)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from training: CRC-32 of the id's text leaves 2 modulo 4. False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _spread_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for toxic, text in zip(batch["toxic"], batch["text"]):
            flat, counts = _lowered(pa.array([text]))
            begin = _starts(counts)[0]
            picked = np.unique(np.linspace(0, len(begin) - 1, SAMPLE_WINDOWS).astype(int))
            found = [" ".join(flat.slice(begin[i], WINDOW).to_pylist()) for i in picked]
            out.append((int(toxic), found))
        yield pd.DataFrame(out, columns=["toxic", "windows"])


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """Train on at most ``SAMPLE`` rows of either class of ``labels (doc_id, toxic)`` that aren't held out.

    Rows are picked by a hash of their id, so reruns agree. Null labels and ids are ignored; where an id has several
    labels, toxic wins. Only the labelled texts' words are inputs.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = known.where("toxic = 1").orderBy(*order).limit(SAMPLE).union(
        known.where("toxic = 0").orderBy(*order).limit(SAMPLE))
    picked = picked.select(F.col("doc_id").alias("_id"), "toxic")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # at most 2 * SAMPLE rows of two numbers are broadcast
    sample = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("doc_id", "toxic", "text")
    rows = sample.select("toxic", "text", "doc_id").mapInPandas(_spread_windows, "toxic int, windows array<string>")
    collected = sorted((r.toxic, list(r.windows)) for r in rows.collect())
    return train([r[1] for r in collected], np.array([r[0] for r in collected]))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs (doc_id, text)``; a null text is empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(pc.utf8_length(batch.column(2)))
            for lo, hi in words.slices(lengths):
                scores = score_texts(net, batch.column(2).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(scores)],
                    schema=schema)

    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    scored = named.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` without the rows whose text scores ``THRESHOLD`` or more; all columns and other rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            lengths = np.asarray(pc.fill_null(pc.utf8_length(texts), 0))
            keep = [score_texts(net, texts.slice(lo, hi - lo)) < THRESHOLD
                    for lo, hi in words.slices(lengths)]
            yield batch.filter(pa.array(np.concatenate(keep or [np.zeros(0, bool)])))

    return docs.mapInArrow(run, docs.schema)
