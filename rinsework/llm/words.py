"""Words and five-word shingles of many texts at once, as 64-bit hashes in flat numpy arrays.

A word is a run of characters other than ASCII white space. Texts of one to four words have one shingle, all their
words; texts without words have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words in a shingle.
SHINGLE = 5
#: Characters of text worked on at once, so that memory stays small whatever the size of a batch.
SLICE_CHARS = 4_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(lengths: np.ndarray, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` characters each, one row at least."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in one array, and the number of words of each text. Null texts have none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    flat = lists.flatten()
    filled = pc.not_equal(flat, "")
    owner = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists)))
    counts = np.bincount(owner[filled.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return flat.filter(filled), counts


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the number of words of each text."""
    words, counts = split_words(texts)
    coded = words.dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    return (known[coded.indices.to_numpy()] if len(words) else known), counts


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every shingle in order, and the row of the text that each belongs to."""
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    starts = ends - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    total = np.zeros(len(hashes), dtype=np.uint64)
    place = np.arange(len(hashes)) - starts[owner]
    for k in range(SHINGLE):  # words beyond the text's end add nothing: only short texts keep such a shingle
        inside = np.arange(len(hashes)) + k < ends[owner]
        shifted = np.zeros_like(hashes)
        shifted[: len(hashes) - k] = hashes[k:]
        total += np.where(inside, mix(shifted + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)), np.uint64(0))
    keep = place <= np.maximum(counts[owner] - SHINGLE, 0)
    return mix(total[keep]), owner[keep]


def multisets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, shingle, count)`` of every distinct shingle of every text, by row and shingle."""
    values, owner = shingles(texts)
    if not len(values):
        return owner, values, np.zeros(0, dtype=np.int64)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), dtype=bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return owner[at], values[at], np.diff(np.append(at, len(values)))
