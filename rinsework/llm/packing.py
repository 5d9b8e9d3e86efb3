"""Best-fit packing of tokenised documents into sequences of fixed length, by best-two-fit.

Only longer documents are cut: the first piece takes what is left over, all further pieces are full. A sequence's content
is decided by lengths alone, and there are no more distinct lengths than the capacity. So the plan is made from the
histogram of piece lengths, a table of at most ``capacity`` rows: a sequence is filled greedily with the longest pieces
that fit, then its smallest piece is replaced by two unpacked pieces if they fill the expanded gap more tightly; the
pattern found is used as often as the counts allow. Pieces then find their sequence from their rank among pieces
of the same length, so packing takes one pass over the texts and no grouping by sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinsework.session import Staging

from . import words
from .running import digits_for, running_total, shuffle_key

CAPACITY = 2048
END = 0
_SPECIAL = "<|endoftext|>"
#: Encoded words that a task remembers; beyond that it starts over.
_REMEMBERED = 400_000


class Encoder:
    """Token ids of whole texts, the same that ``tokenizers`` gives for the vocabulary's JSON file.

    Words repeat, so every distinct word of a batch is encoded once: a single space before a visible character always
    begins a new pre-token. Texts where that doesn't hold (white space after a space) are encoded whole, and texts that
    spell the special token go through ``tokenizers`` itself, which knows it.
    """

    def __init__(self, json_file: str | None = None, ranks_file: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        self.json_file = json_file or public_tokenizers.path("byte_bpe_50k.json")
        with open(ranks_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = None
        self.known: dict[str, np.ndarray] = {}

    def _word(self, word: str) -> np.ndarray:
        ids = self.known.get(word)
        if ids is None:
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            ids = self.known[word] = np.array(self.fast.encode_ordinary(word), dtype=np.uint32)
        return ids

    def _whole(self, text: str) -> np.ndarray:
        if _SPECIAL not in text:
            return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.json_file)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        odd = pc.or_(pc.match_substring_regex(texts, r" [\s\v\x{85}\p{Z}]"), pc.match_substring(texts, _SPECIAL))
        odd = odd.to_numpy(zero_copy_only=False)
        out: list[np.ndarray | None] = [None] * len(texts)
        for i in np.flatnonzero(odd):
            out[i] = self._whole(texts[int(i)].as_py())
        plain = np.flatnonzero(~odd)
        if not len(plain):
            return out
        parts = pc.split_pattern(texts.take(pa.array(plain)), " ")
        counts = np.asarray(pc.list_value_length(parts))
        coded = parts.flatten().dictionary_encode()
        codes, distinct = coded.indices.to_numpy().copy(), coded.dictionary.to_pylist()
        begins = np.cumsum(counts) - counts
        firsts = [distinct[c] for c in codes[begins]]  # no space before these
        codes[begins] = len(distinct) + np.arange(len(plain))
        ids = [self._word(" " + w) for w in distinct] + [self._word(w) for w in firsts]
        sizes = np.array([len(x) for x in ids])
        flat, starts = np.concatenate(ids), np.cumsum(sizes) - sizes
        lengths = sizes[codes]
        ends = np.cumsum(lengths)
        tokens = flat[np.repeat(starts[codes] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        for i, x in zip(plain, np.split(tokens, ends[begins + counts - 1][:-1])):
            out[i] = x
        return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, json_file: str | None = None, ranks_file: str | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` for every row of ``docs (doc_id, text)``; a null text is empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(json_file, ranks_file)
        for batch in batches:
            lengths = np.asarray(pc.utf8_length(batch.column(1)))
            for lo, hi in words.slices(lengths):
                rows: list[tuple] = []
                for doc, ids in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), encoder.encode(batch.column(1).slice(lo, hi - lo))):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    cuts = list(range(len(ids) % capacity or capacity, len(ids) + 1, capacity)) if len(ids) > capacity else [len(ids)]
                    for k, (a, b) in enumerate(zip([0, *cuts[:-1]], cuts)):
                        rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return named.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (length → times in a sequence) and how many sequences follow each, for a histogram of lengths."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    out = []
    while left.any():
        first = int(np.flatnonzero(left)[-1])
        bin_, gap = [first], capacity - first
        left[first] -= 1
        while gap:
            fitting = np.flatnonzero(left[: gap + 1])
            if not len(fitting):
                break
            bin_.append(int(fitting[-1]))
            left[fitting[-1]] -= 1
            gap -= int(fitting[-1])
        while gap and len(bin_) > 1:
            smallest = bin_[-1]  # lengths were added in descending order
            two = _best_two(left, gap + smallest)
            if two is None or sum(two) <= smallest:
                break
            gap += smallest - sum(two)
            left[smallest] += 1
            bin_[-1:] = two
            bin_.sort(reverse=True)
            for x in two:
                left[x] -= 1
        lengths, times = np.unique(bin_, return_counts=True)
        more = int((left[lengths] // times).min())
        left[lengths] -= times * more
        out.append((dict(zip(lengths.tolist(), times.tolist())), 1 + more))
    return out


def _best_two(left: np.ndarray, room: int) -> list[int] | None:
    """The two unpacked lengths of largest sum within ``room``, the longer first."""
    here = np.flatnonzero(left[:room])
    if not len(here):
        return None
    top = np.minimum(here, room - here)
    at = np.searchsorted(here, top, side="right") - 1  # the longest partner that isn't longer
    single = (at >= 0) & (here[at] == here) & (left[here] < 2)
    at = at - single
    good = at >= 0
    if not good.any():
        return None
    sums = np.where(good, here + here[at], -1)
    best = int(sums.argmax())
    return [int(here[best]), int(here[at[best]])]


def pack(docs: DataFrame, staging: Staging, capacity: int = CAPACITY, json_file: str | None = None,
         ranks_file: str | None = None) -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``start`` counts the document's ids before the piece, ``offset`` the ids before it in its sequence. A null or empty
    text is the single end token. Every row is packed, also repeated ones and those with a null id.
    """
    found = staging.write(pieces(docs, capacity, json_file, ranks_file).withColumns(
        {"order": shuffle_key("doc_id", "piece", "ids_crc32"), "one": F.lit(1).cast("long")}), "pieces")
    # at most `capacity` rows, whatever the number of documents
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, used, sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern, times in plan(histogram, capacity):
        offset = 0
        for length, each in sorted(pattern.items(), reverse=True):
            rows.append((length, used[length], used[length] + each * times, sequence, each, offset))
            used[length] += each * times
            offset += each * length
        sequence += times
    spark = docs.sparkSession
    places = spark.createDataFrame(rows, "_length long, lo long, hi long, first long, each long, at long")
    ranked = running_total(found, "length", "order", "one", "rank", digits_for(sum(histogram.values())), "doc_id", "piece")
    ranked = ranked.withColumn("rank", F.col("rank") - 1)
    # the plan's size is bounded by the capacity: every pattern uses up at least one length, but for a remainder
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + (nth % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
