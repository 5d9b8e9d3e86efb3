"""Spelling variants of a corpus' words, found with a trie over letter counts.

A word is arranged by the counts of its letters: level by level, a trie branches by how often the word holds the next
letter group. One inserted, deleted or replaced letter adds at most one to one count and takes at most one from another,
so a depth-first search that may spend one surplus and one deficit reaches every word at distance one; the words of
the leaves it reaches are compared letter by letter.

Plan: occurrences are counted natively and aggregated before the shuffle. The trie is dealt over tasks by its top: a word's
length and its first ``TOP`` counts. Each word is indexed in its own shard, and also asks those shards of its own length that
come later, and those of the next length, which the budgets can reach, so each pair of shards meets once. A shard of more than
``CHUNK`` letters is cut into chunks by count; each chunk of asking words meets each chunk of indexed ones in a task of
bounded size. A word has at most so many near words as its length and the alphabet allow, so pairs grow with the words.
Tables of words are merged, never broadcast: their files are small for the rows they hold, and a broadcast passes the driver.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinsework.session import Staging

MIN_CHARS, MIN_COUNT = 5, 3
#: One run in so many loses a letter, chosen by CRC-32.
DROP_EVERY = 97
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letter groups in the order of the trie's levels: frequent letters, then the others, then the accented ones in eighths.
LETTERS = "etaoinshrdlucmfwygpbvkxqjz"
_ACCENTED = 8
_GROUP = np.array([LETTERS.index(chr(c)) if chr(c) in LETTERS else len(LETTERS) + c % _ACCENTED for c in range(256)])
_GROUPS = len(LETTERS) + _ACCENTED
#: Levels of the trie that deal words to shards; letters of a chunk; asking words that search at once.
TOP, CHUNK, _TILE = 3, 400_000, 2_048


def altered(doc_id: Column, run: Column) -> Column:
    """The lower-cased run, without one letter where its CRC-32 beside the id is a multiple of ``DROP_EVERY``."""
    low = F.translate(run, _UPPER, _LOWER)
    mark = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), low).cast("binary"))
    at = (mark % F.length(low)).cast("int")
    return F.when(mark % DROP_EVERY == 0, F.concat(F.substring(low, F.lit(1), at), F.substring(low, at + 2, F.length(low)))).otherwise(low)


def words(docs: DataFrame) -> DataFrame:
    """``(word, n)``: the distinct words of ``docs (doc_id, text)`` with ``MIN_CHARS`` letters and ``MIN_COUNT`` occurrences."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    found = runs.select(altered(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= MIN_CHARS)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def _route(counts: list[Column], length: Column) -> Column:
    """The shards a word takes part in: ``(size, top, home)``, ``top`` being the first counts of the trie's path."""
    def shard(size: Column, moved: dict[int, int], home: bool) -> Column:
        top = F.array(*[c + moved.get(k, 0) for k, c in enumerate(counts)])
        return F.struct(size.alias("size"), top.alias("top"), F.lit(home).alias("home"))

    later = [{k: 1} for k in range(TOP)]  # one more here, one less further down
    later += [{a: 1, b: -1} for a, b in combinations(range(TOP), 2)]  # the first change decides the order
    longer = [{}, *[{k: 1} for k in range(TOP)]]
    return F.array(shard(length, {}, True), *[shard(length, m, False) for m in later], *[shard(length + 1, m, False) for m in longer])


class Trie:
    """Words of one length, given as rows of letter codes, in a trie over their counts."""

    def __init__(self, letters: np.ndarray):
        counts = letter_counts(letters)
        self.order = np.lexsort(counts.T[::-1])
        rows = counts[self.order]
        split = np.logical_or.accumulate(rows[1:] != rows[:-1], axis=1)
        node = np.zeros((len(rows), _GROUPS + 1), dtype=np.int64)  # of each word, on each level
        node[1:, 1:] = np.cumsum(split, axis=0)
        self.base = int(rows.max(initial=0)) + 3
        self.keys = []
        for k in range(_GROUPS):
            first = np.flatnonzero(np.diff(node[:, k + 1], prepend=-1))
            self.keys.append(node[first, k] * self.base + rows[first, k] + 1)
        self.leaf = np.append(np.flatnonzero(np.diff(node[:, -1], prepend=-1)), len(rows))

    def search(self, asked: np.ndarray, deficit: bool) -> tuple[np.ndarray, np.ndarray]:
        """``(row of asked, word)`` of all words in the leaves that one surplus, and one deficit if allowed, can reach."""
        who, at = np.arange(len(asked)), np.zeros(len(asked), dtype=np.int64)
        more = np.ones(len(asked), dtype=bool)
        less = np.full(len(asked), deficit)
        for k, keys in enumerate(self.keys):
            count = asked[who, k]
            nexts = []
            for step, able in ((0, None), (1, more), (-1, less)):
                own = slice(None) if able is None else np.flatnonzero(able)
                key = at[own] * self.base + np.minimum(count[own] + step, self.base - 3) + 1
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = (keys[place] == key) & (count[own] + step <= self.base - 3)
                nexts.append((who[own][hit], place[hit], more[own][hit] & (step != 1), less[own][hit] & (step != -1)))
            who, at, more, less = (np.concatenate(x) for x in zip(*nexts))
        sizes = np.diff(self.leaf)[at]
        first = np.repeat(self.leaf[at] - np.cumsum(sizes) + sizes, sizes)
        return np.repeat(who, sizes), self.order[first + np.arange(len(first))]


def letter_counts(letters: np.ndarray) -> np.ndarray:
    """How often each word holds each letter group."""
    n, length = letters.shape
    cells = np.repeat(np.arange(n) * _GROUPS, length) + _GROUP[letters.ravel()]
    return np.bincount(cells, minlength=n * _GROUPS).reshape(n, _GROUPS)


def one_apart(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For rows of letters side by side: whether one replacement, or one insertion into the shorter, makes them equal."""
    length = short.shape[1]
    if length == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    front = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= length


def _letters(column: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    picked = column.take(pa.array(rows)).to_pylist()
    return np.frombuffer("".join(picked).encode("latin-1"), dtype=np.uint8).reshape(len(picked), -1)


def _meet(key: tuple, group: pa.Table) -> pa.Table:
    """The near pairs of one chunk of asking words and one of indexed words, from both sides."""
    size = key[0].as_py()
    asks, indexed, home = (group[c].to_numpy(zero_copy_only=False) for c in ("asks", "indexed", "home"))
    length, n = group["length"].to_numpy(), group["n"].to_numpy()
    rows = np.flatnonzero(indexed)
    pairs = []
    if len(rows):
        known = _letters(group["word"], rows)
        trie = Trie(known)
        for same in (True, False):
            asking = np.flatnonzero(asks & (length == size if same else length < size))
            for a in range(0, len(asking), _TILE):
                own = asking[a : a + _TILE]
                letters = _letters(group["word"], own)
                who, what = trie.search(letter_counts(letters), deficit=same)
                if same:  # of two words at home here, only the one of the smaller spelling asks
                    mine, other = letters[who], known[what]
                    at = (mine != other).argmax(axis=1)[:, None]
                    smaller = np.take_along_axis(mine, at, 1)[:, 0] < np.take_along_axis(other, at, 1)[:, 0]
                    fits = ~home[own[who]] | smaller
                    who, what = who[fits], what[fits]
                near = one_apart(letters[who], known[what])
                pairs.append((own[who[near]], rows[what[near]]))
    x = np.concatenate([p[0] for p in pairs] or [np.zeros(0, dtype=np.int64)])
    y = np.concatenate([p[1] for p in pairs] or [np.zeros(0, dtype=np.int64)])
    one, two = np.concatenate([x, y]), np.concatenate([y, x])
    return pa.table({"word": group["word"].take(pa.array(one)), "other": group["word"].take(pa.array(two)),
                     "n": pa.array(n[two], pa.int64())})


def near_words(counted: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(word, other, n)``: every ordered pair of the distinct words ``counted (word, n)`` at distance one; ``n`` is the other's.

    Words hold code points up to U+00FF. ``counted`` is read twice, so callers pass a written table.
    """
    counts = [F.length("word") - F.length(F.replace("word", F.lit(c), F.lit(""))) for c in LETTERS[:TOP]]
    routed = counted.withColumn("length", F.length("word")).withColumn("r", F.explode(_route(counts, F.col("length"))))
    routed = routed.select("word", "n", "length", "r.*").where(F.array_min("top") >= 0)
    place = ["size", "top"]
    sizes = routed.groupBy(*place).agg(F.count("*").alias("all"), F.count_if("home").alias("homes")).where("homes > 0")
    pieces = [F.ceil(F.col(c) * F.col("size") / chunk).cast("int").alias(a) for c, a in (("all", "q"), ("homes", "b"))]
    joined = routed.join(sizes.select(*place, *pieces).hint("merge"), place)
    joined = joined.withColumns({"i": F.pmod(F.xxhash64("word"), F.col("q")).cast("int"),
                                 "j": F.pmod(F.xxhash64(F.lit(1), "word"), F.col("b")).cast("int")})
    cell = "struct({} AS i, {} AS j, {} AS asks, {} AS indexed)"
    cells = F.expr(f"""CASE WHEN home THEN concat(array({cell.format("i", "j", "true", "true")}),
        transform(filter(sequence(0, q - 1), k -> k != i), k -> {cell.format("k", "j", "false", "true")}),
        transform(filter(sequence(0, b - 1), k -> k != j), k -> {cell.format("i", "k", "true", "false")}))
        ELSE transform(sequence(0, b - 1), k -> {cell.format("i", "k", "true", "false")}) END""")
    dealt = joined.select("word", "n", "length", *place, "home", F.explode(cells).alias("c"))
    dealt = dealt.select("size", "top", "c.i", "c.j", "word", "n", "length", "home", "c.asks", "c.indexed")
    return dealt.groupBy("size", "top", "i", "j").applyInArrow(_meet, "word string, other string, n long")


def roots(forms: DataFrame, staging: Staging) -> DataFrame:
    """``(word, root)``: where the chain of ``forms (word, form)`` ends, by pointer doubling. No word is null or repeats.

    Chains must not run in circles. Each round halves what is left of every chain.
    """
    state, left = staging.write(forms.select("word", F.col("form").alias("root")), "chain"), True
    while left:
        further = state.select(F.col("word").alias("at"), F.col("root").alias("next"))
        joined = state.join(further.hint("merge"), state["root"] == further["at"], "left")
        moved = staging.write(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chain")
        left = bool(moved.where("moved").limit(1).count())
        state = moved.select("word", "root")
    return state


def variants(docs: DataFrame, staging: Staging, chunk: int = CHUNK) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``docs (doc_id, text)``.

    Words are maximal runs of ASCII and Latin-1 letters, with A-Z lower-cased, that reach ``MIN_CHARS`` and ``MIN_COUNT``. A word's form is its
    commonest near word (the smallest of equals), if that is at least twice as common; the root is where forms lead to.
    Null texts have no words, a null id counts as an empty one, repeated rows count again, an empty table gives an
    empty result; other columns aren't read.
    """
    counted = staging.write(words(docs), "words")
    pairs = staging.write(near_words(counted, chunk), "near")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), "other")).alias("best"))
    joined = counted.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.m") >= 2 * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.m")).alias("n"))).alias("f"))
    told = staging.write(joined.select("word", "f.form", "n", "n_near", F.col("f.n").alias("form_n")), "forms")
    ends = roots(told.where("form IS NOT NULL").select("word", "form"), staging)
    return told.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
