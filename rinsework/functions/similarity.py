"""String similarity: the processed form, the token-sort score and the weighted score.

Two scores exist for pairs of processed strings, both on a 0-100 scale and rounded to integers:

* ``indel``       ``100 * (1 - d / (len(a) + len(b)))`` with d = insertions + deletions; computed on
  Arrow batches, many pairs at once.
* ``levenshtein`` the same ratio with the Levenshtein distance; a plain Spark expression.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .subsequence import common_lengths
from .text import strip

METHODS = ("indel", "levenshtein")
_CELLS_PER_BLOCK = 4_000_000
_MATCH = T.StructType([T.StructField("match", T.StringType()), T.StructField("score", T.DoubleType())])


def processed(c: Column) -> Column:
    """Lower case, Latin-1 accents dropped, everything but letters and digits blanked, tokens sorted."""
    plain = F.regexp_replace(strip(c), r"[\x{80}-\x{FF}]", "")
    words = F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}]+", " ")
    return F.array_join(F.array_sort(F.split(F.trim(words), " ")), " ")


def levenshtein_score(a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100)).otherwise(
        F.bround(100.0 * (total - F.levenshtein(a, b)) / total, 0).cast("int")
    )


def ratios(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Unrounded indel ratio of each pair; two empty strings are equal."""
    total = np.array([len(x) + len(y) for x, y in zip(left, right)], dtype=float)
    common = common_lengths(left, right)
    return np.where(total == 0, 100.0, 200.0 * common / np.maximum(total, 1))


@pandas_udf(T.IntegerType())
def _indel_score(a: pd.Series, b: pd.Series) -> pd.Series:
    left, right = a.tolist(), b.tolist()
    longest = max(map(len, left), default=1) + 1
    block = max(1, _CELLS_PER_BLOCK // longest)
    parts = [
        np.rint(ratios(left[i : i + block], right[i : i + block]))
        for i in range(0, len(left), block)
    ]
    return pd.Series(np.concatenate(parts) if parts else [], dtype="int32")


# a filter on the score must not make Spark evaluate it a second time
indel_score = _indel_score.asNondeterministic()


# --- weighted score against a short list of names ------------------------------------------------

_SAME = ("", "")  # a pair that scores 100


def _sorted_words(words) -> str:
    return " ".join(sorted(words))


def _stretches(a: str, b: str) -> list[tuple[str, str]]:
    """The shorter text paired with every stretch of the longer one, cut off at both ends."""
    short, long = sorted((a, b), key=len)
    n = len(short)
    return [(short, s) for s in {long[max(0, i) : i + n] for i in range(1 - n, len(long))}]


def _word_pairs(a: str, b: str) -> list[tuple[str, str]]:
    """Sorted words against sorted words, and shared words against shared-plus-own words."""
    one, two = set(a.split()), set(b.split())
    shared, only_one, only_two = one & two, one - two, two - one
    if shared and not (only_one and only_two):
        return [_SAME]
    base = _sorted_words(shared)
    with_one = " ".join(filter(None, (base, _sorted_words(only_one))))
    with_two = " ".join(filter(None, (base, _sorted_words(only_two))))
    pairs = [(_sorted_words(a.split()), _sorted_words(b.split())), (with_one, with_two)]
    return pairs + [(base, with_one), (base, with_two)] if shared else pairs


def _comparisons(a: str, b: str, cutoff: float) -> list[tuple[float, str, str]]:
    """(weight, left, right) of every comparison that can still reach the cut-off."""
    spread = max(len(a), len(b)) / min(len(a), len(b))
    weighted = [(1.0, [(a, b)])]
    if spread < 1.5:
        weighted.append((0.95, _word_pairs(a, b)))
    else:
        scale = 0.9 if spread <= 8 else 0.6
        same_word = set(a.split()) & set(b.split())
        words = [_SAME] if same_word else _stretches(
            _sorted_words(a.split()), _sorted_words(b.split())
        )
        weighted += [(scale, _stretches(a, b)), (0.95 * scale, words)]
    return [
        (weight, x, y)
        for weight, pairs in weighted
        for x, y in pairs
        if not (x or y) or 200.0 * weight * min(len(x), len(y)) / (len(x) + len(y)) >= cutoff
    ]


def weighted_scores(text: str, names: Sequence[str], cutoff: float = 0.0) -> np.ndarray:
    """Case-sensitive score of a text against each name; scores below the cut-off may come out as 0.

    The plain ratio, or 0.95 of the word ratio; for lengths that differ by half or more, 0.9 (0.6
    beyond eightfold) of the best-stretch ratio instead of the word ratio.
    """
    return _weighted_batch([text], names, cutoff)[0]


def _letters(texts: Sequence[str]) -> np.ndarray:
    """How often each of 256 character classes occurs in each text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32) % 256
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(owner * 256 + points, minlength=256 * len(texts)).reshape(-1, 256)


def _promising(texts: Sequence[str], names: Sequence[str], cutoff: float) -> np.ndarray:
    """Which pairs share enough characters for any comparison to reach the cut-off.

    Texts that share a word are always compared. Otherwise every comparison is between pieces of the two texts, or of
    their distinct words: what the sides have in common is among the characters that both texts have, and the shorter
    side of the whole comparison is at least as long as the shorter text's distinct words.
    """
    own, wanted = _letters(texts), _letters(names)
    used = wanted.any(axis=0)  # other characters are in no name
    own, wanted = np.minimum(own[:, used], 30_000).astype(np.int16), np.minimum(wanted[:, used], 30_000).astype(np.int16)
    common = np.minimum(own[:, None, :], wanted[None, :, :]).sum(axis=2, dtype=np.int64)
    words = [[set(t.split()) for t in side] for side in (texts, names)]
    sizes, lengths = (
        np.array([min(len(t), len(_sorted_words(w))) for t, w in zip(side, sets)]) for side, sets in zip((texts, names), words)
    )
    # ratio 2c / (x + y), where c is at most what they share and no side is shorter than c
    near = 200.0 * common >= cutoff * (common + np.minimum(sizes[:, None], lengths[None, :]))
    holders: dict[str, list[int]] = {}
    for j, known in enumerate(words[1]):
        for word in known:
            holders.setdefault(word, []).append(j)
    for i, known in enumerate(words[0]):
        for word in known & holders.keys():
            near[i, holders[word]] = True
    return near


def _weighted_batch(texts: Sequence[str], names: Sequence[str], cutoff: float) -> np.ndarray:
    best = np.zeros((len(texts), len(names)))
    pairs = np.argwhere(_promising(texts, names, cutoff)) if texts and names else []
    todo = [(i, j, *c) for i, j in pairs if texts[i] for c in _comparisons(texts[i], names[j], cutoff)]
    if todo:
        text, name, weight, left, right = zip(*todo)
        np.maximum.at(best, (list(text), list(name)), np.array(weight) * ratios(left, right))
    return best


def weighted_of_pairs(texts: Sequence[str], names: Sequence[str], cutoff: float) -> np.ndarray:
    """The weighted score of each text and the name beside it; scores below the cut-off may come out as 0."""
    best = np.zeros(len(texts))
    todo = [(i, *c) for i, (t, n) in enumerate(zip(texts, names)) if t and n for c in _comparisons(t, n, cutoff)]
    if todo:
        pair, weight, left, right = zip(*todo)
        np.maximum.at(best, list(pair), np.array(weight) * ratios(left, right))
    return best


def weighted_score(cutoff: float):
    """Arrow UDF: (text, name) -> their weighted score; scores below the cut-off may come out as 0."""
    @pandas_udf(T.DoubleType())
    def score(texts: pd.Series, names: pd.Series) -> pd.Series:
        left, right = texts.tolist(), names.tolist()
        parts = [weighted_of_pairs(left[i : i + 2_000], right[i : i + 2_000], cutoff) for i in range(0, len(left), 2_000)]
        return pd.Series(np.concatenate(parts) if parts else [], dtype=float)

    return score.asNondeterministic()  # a filter on the score must not make Spark evaluate it a second time


def nearest_weighted(names: Sequence[str], cutoff: float):
    """Arrow UDF: text -> struct(match, score) of the best name at or above ``cutoff``, else NULLs.

    The list of names travels inside the function, so it must be a short, fixed list.
    """
    names = tuple(names)

    @pandas_udf(_MATCH)
    def nearest(texts: pd.Series) -> pd.DataFrame:
        given = texts.tolist()
        found = {t: (t, 100.0) for t in names} | {None: (None, None)}
        unknown = [t for t in dict.fromkeys(given) if t not in found]
        for i in range(0, len(unknown), 200):
            part = unknown[i : i + 200]
            for t, scores in zip(part, _weighted_batch(part, names, cutoff)):
                top = int(scores.argmax())
                found[t] = (names[top], float(scores[top])) if scores[top] >= cutoff else (None, None)
        return pd.DataFrame([found[t] for t in given], columns=["match", "score"])

    return nearest


def nearest_levenshtein(c: Column, names: Sequence[str]) -> Column:
    """struct(score, match) of the best name by Levenshtein score; ties go to the earlier name."""
    ranked = F.transform(
        F.array(*map(F.lit, names)),
        lambda name, at: F.struct(
            levenshtein_score(c, name).alias("score"), (-at).alias("order"), name.alias("match")
        ),
    )
    return F.array_max(ranked)


__all__ = [
    "METHODS", "common_lengths", "indel_score", "levenshtein_score",
    "nearest_levenshtein", "nearest_weighted", "processed", "ratios", "weighted_of_pairs", "weighted_score", "weighted_scores",
]
