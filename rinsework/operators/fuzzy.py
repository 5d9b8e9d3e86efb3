"""Similarity self-join and fuzzy deduplication on one text column, without comparing all pairs.

Values are first reduced to *forms* (processed text); copies, case variants and word orders share a form,
so a value that fills a third of the table is one row from here on. Forms are then blocked:

1.  Two forms at or above the cut-off must share a known minimum of bigrams. With bigrams in one global
    order, rarest first, they must share one inside a short prefix of that order (prefix filter), and
    even ``n`` of them when the prefix is ``n - 1`` longer.
2.  A block is one bigram within one length class. A block with too many forms is split by the next shared
    bigram, up to ``MAX_DEPTH`` of them; what is still too big is cut into slices, and every pair of
    slices becomes its own cell. So no cell ever holds more than two slices, whatever the skew.
3.  The tasks that receive the cells (:mod:`.pairing`) compare lengths, accept a pair only in the one cell of its
    smallest shared bigrams, and score it there, many pairs at a time. Counting returns one number for
    each task, deduplication edges only; pairs are listed where they are asked for.

All bounds are necessary conditions, so nothing is lost; the tests compare with brute force.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.ml.feature import HashingTF, MinHashLSH
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.similarity import METHODS, indel_score, levenshtein_score, processed
from ..functions.text import strip
from ..session import Staging
from .pairing import meet
from .profile import col

BLOCK_LIMIT = 2_000  # forms per slice of a block
SPLIT_LIMIT = 5_000  # forms per block before it is split by a further bigram
MAX_DEPTH = 2  # shared bigrams a block may require
TOP_NODES = 1_000_000  # numbers that one task may put in order to find where a batch ends
FIRST_BATCH = 1_000  # forms decided in the first round of fuzzy deduplication
_BUCKETS = 65_536  # rows of the bigram frequency table, whatever the data

# score >= 85 after rounding means distance < 15.5 % of the summed lengths
_SLACK = (100 - rules.FUZZY_SCORE + 0.5) / 100
_CLASS_BASE = 1.367  # just above the largest length ratio of a pair: (1 + slack) / (1 - slack)
_SHARE = {  # least share of the longer length that must survive as common bigrams, plus one
    "indel": (0.5 - 1.5 * _SLACK) * (1 + (1 - _SLACK) / (1 + _SLACK)),
    "levenshtein": 1 - 4 * _SLACK,
}


def _pairs_among(count: str) -> Column:
    return F.shiftright(F.col(count) * (F.col(count) - 1), 1)


# --- forms ---------------------------------------------------------------------------------------


def forms(df: DataFrame, key: str, order_by: str | None = None) -> DataFrame:
    """(form, node, members, same): one row per distinct processed text of the column.

    ``node`` is the smallest ``order_by`` among its rows (a hash of the form without one), ``members``
    the number of distinct raw values, ``same`` the number of pairs of them that differ only in case or
    outer blanks. Texts under three characters never take part.
    """
    order = col(order_by).cast("long") if order_by else F.lit(0).cast("long")
    raw = (
        df.where(col(key).isNotNull())
        .groupBy(col(key).cast("string").alias("raw"))
        .agg(F.min(order).alias("node"))
    )
    per_form = (
        raw.where(F.length(strip(F.col("raw"))) >= rules.FUZZY_MIN_CHARS)
        .select(processed(F.col("raw")).alias("form"), F.lower(strip(F.col("raw"))).alias("low"), "node")
        .groupBy("form", "low")
        .agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
        .groupBy("form")
        .agg(
            F.min("node").alias("node"),
            F.sum("n").alias("members"),
            F.sum(_pairs_among("n")).alias("same"),
        )
    )
    if order_by is None:
        # without an order a form only needs an identity, not a place
        per_form = per_form.withColumn("node", F.monotonically_increasing_id())
    return per_form


# --- blocking ------------------------------------------------------------------------------------


def _bigrams(form: Column) -> Column:
    """All overlapping pairs of characters, in one walk over the text."""
    return F.regexp_extract_all(form, F.lit("(?s)(?=(..))"), F.lit(1))


def _length_class(form: Column) -> Column:
    return F.floor(F.ln(F.length(form)) / math.log(_CLASS_BASE)).cast("int")


def _required(cls: Column, method: str) -> Column:
    """Bigrams any pair of this length class must share, at least one."""
    shortest = F.pow(F.lit(_CLASS_BASE), cls)
    return F.greatest(
        F.lit(1), (F.floor(shortest * _SHARE[method] - 1 - 1e-6) + 1).cast("int")
    )


def build_index(nodes: DataFrame, staging: Staging, method: str = "indel") -> DataFrame:
    """Block membership of every form: (cls, sig, cell_a, cell_b, slice, node, form, members, own_cls, prefix).

    ``nodes`` must be a staged table: it is read more than once.
    """
    kept = ["cls", "node", "form", "members", "own_cls", "need", "prefix", "width"]
    shared = F.split("sig", "[|]").alias("shared")
    level = _first_level(nodes, method)
    if nodes.count() <= BLOCK_LIMIT:  # then no block can be crowded
        whole = F.lit(0).alias
        return staging.write(
            level.select(*kept, "sig", shared, whole("slice"), whole("cell_a"), whole("cell_b")), "index"
        )
    finished = []
    for depth in range(1, MAX_DEPTH + 1):
        level = staging.write(level, f"blocks-{depth}")
        sizes = level.groupBy("cls", "sig").agg(
            F.count(F.lit(1)).alias("n"), F.max("need").alias("most")
        )
        sized = level.join(sizes.where("n > 1").drop("most"), ["cls", "sig"])
        crowded = (F.col("n") > SPLIT_LIMIT) & (F.col("need") > depth)
        if depth == MAX_DEPTH or sizes.where((F.col("n") > SPLIT_LIMIT) & (F.col("most") > depth)).isEmpty():
            finished.append(sized)
            break
        finished.append(sized.where(~crowded))
        # a crowded block splits by the next bigram of the prefix, which is one longer per level
        longer = F.slice("prefix", F.lit(1), F.least(F.size("prefix"), F.col("width") + F.lit(depth)))
        level = (
            sized.where(crowded)
            .select(*kept, "sig", "at", F.posexplode(longer).alias("next", "gram"))
            .where("next > at")
            .select(*kept, F.concat_ws("|", "sig", "gram").alias("sig"), F.col("next").alias("at"))
        )
    members = finished[0]
    for more in finished[1:]:
        members = members.unionByName(more)
    # whatever is still crowded is cut into slices; each pair of slices is a cell of its own
    sliced = members.withColumn("slices", F.ceil(F.col("n") / BLOCK_LIMIT).cast("int")).withColumn(
        "slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    )
    cells = sliced.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    return staging.write(
        cells.select(
            *kept, "sig", shared, "slice", F.least("slice", "other").alias("cell_a"),
            F.greatest("slice", "other").alias("cell_b"),
        ),
        "index",
    )


def _first_level(nodes: DataFrame, method: str) -> DataFrame:
    """Every form once per length class it can pair in and per bigram of its prefix there."""
    known = nodes.where(F.length("form") >= rules.FUZZY_MIN_CHARS).select("node", "form", "members")
    bucket = F.pmod(F.xxhash64("gram"), F.lit(_BUCKETS)).alias("bucket")
    # frequency per hash bucket: a table of fixed size, hence safe to broadcast
    frequency = (
        known.select(F.explode(_bigrams(F.col("form"))).alias("gram"))
        .groupBy(bucket)
        .agg(F.count(F.lit(1)).alias("freq"))
    )
    # one shuffle by node; everything below is grouped by node and stays where it is
    keyed = known.repartition("node")
    grams = keyed.select("node", F.explode(_bigrams(F.col("form"))).alias("gram"))
    # equal bigrams of a form are numbered (text#1, text#2, ...), so that sets count like multisets
    numbered = (
        grams.groupBy("node", "gram")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("node", bucket, F.explode(F.transform(
            F.sequence(F.lit(1), F.col("n")),
            lambda k: F.concat(F.col("gram"), F.lit("#"), k.cast("string")),
        )).alias("gram"))
    )
    # rarest first: texts in the order of their frequency and spelling
    ranked = F.concat(F.lpad(F.hex("freq"), 12, "0"), "gram")
    ordered = (
        numbered.join(F.broadcast(frequency), "bucket")
        .groupBy("node")
        .agg(F.array_sort(F.collect_list(ranked)).alias("grams"))
        .join(keyed, "node")
        .withColumn("own_cls", _length_class(F.col("form")))
    )
    # a pair belongs to the class of its longer form; its shorter one may be one class below
    classed = ordered.withColumn("cls", F.explode(F.array("own_cls", F.col("own_cls") + 1))).withColumn(
        "need", _required(F.col("cls"), method)
    )

    def length(depth: Column) -> Column:
        return F.greatest(F.lit(1), F.size("grams") - F.col("need") + depth)

    deepest = F.least(F.col("need"), F.lit(MAX_DEPTH))
    return classed.select(
        "cls", "node", "form", "members", "own_cls", "need",
        F.slice("grams", F.lit(1), length(deepest)).alias("prefix"),
        F.least(F.size("grams"), length(F.lit(1))).alias("width"),
    ).select(
        "*", F.posexplode(F.slice("prefix", F.lit(1), F.col("width"))).alias("at", "sig")
    )


def _pairs(index: DataFrame, method: str, late: DataFrame | None = None) -> DataFrame:
    """(a, b, form_a, form_b, members_a, members_b, score) of the pairs at or above the cut-off, a < b or b a late one."""
    if method == "indel":
        return meet(index, "pairs", True, _SLACK, late)
    score = levenshtein_score(F.col("form_a"), F.col("form_b"))
    # a filter on the score must not make Spark compare twice
    close = F.expr(f"levenshtein(form_a, form_b, cast(ceil({_SLACK} * (length(form_a) + length(form_b))) as int)) >= 0")
    found = meet(index, "pairs", False, _SLACK, late).where(close)
    return found.withColumn("score", score).where(F.col("score") >= rules.FUZZY_SCORE)


class Matcher:
    """The forms of one column with their index; built once, used for pairs, counts and deduplication."""

    def __init__(
        self, df: DataFrame, key: str, order_by: str | None = None, method: str = "indel",
        staging: Staging | None = None,
    ):
        if method not in METHODS:
            raise ValueError(f"unknown similarity method {method!r}; choose from {METHODS}")
        self.key, self.order_by, self.method = key, order_by, method
        self.staging = staging or Staging(df.sparkSession)
        self.nodes = self.staging.write(forms(df, key, order_by), "forms")

    @cached_property
    def index(self) -> DataFrame:
        return build_index(self.nodes, self.staging, self.method)

    @cached_property
    def is_small(self) -> bool:
        return self.nodes.count() <= FIRST_BATCH

    @cached_property
    def pairs(self) -> DataFrame:
        """(a, b, form_a, form_b, members_a, members_b, score) of all pairs at or above the cut-off, a < b.

        Few forms have a bounded number of pairs, which are kept for reuse; many are only ever streamed.
        """
        found = _pairs(self.index, self.method)
        return self.staging.write(found, "pairs") if self.is_small else found

    def pair_count(self) -> int:
        """Pairs of raw values that differ ignoring case and outer blanks, yet score 85 or more.

        Pairs that share a form are counted by arithmetic; others are counted where they are compared, not listed.
        """
        within = self.nodes.agg(
            F.coalesce(F.sum(_pairs_among("members") - F.col("same")), F.lit(0)).alias("n")
        )
        if self.method == "indel" and not self.is_small:
            products = meet(self.index, "count", True, _SLACK)
        else:
            products = self.pairs.select((F.col("members_a") * F.col("members_b")).alias("n"))
        across = products.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        return int(within.unionByName(across).agg(F.sum("n")).first()[0])

    def kept(self) -> DataFrame:
        """(node) of the forms that survive greedy deduplication in ascending node order."""
        if self.is_small:
            return self.staging.write(_decide(self.nodes.select("node"), self.pairs, self.staging), "kept")
        return kept_forms(self.nodes, self.index, self.staging, self.method)

    def drop_similar(self, df: DataFrame) -> DataFrame:
        """Drop the rows whose key resembles an earlier kept key; ``df`` has the rows the forms came from."""
        if self.order_by is None:
            raise ValueError("deduplication needs a row order")
        kept = self.kept().select(F.col("node").alias("__node"))
        text = strip(col(self.key).cast("string"))
        compared = F.coalesce(F.length(text) >= rules.FUZZY_MIN_CHARS, F.lit(False))
        survivors = df.where(compared).join(
            kept, col(self.order_by).cast("long") == F.col("__node"), "left_semi"
        )
        return survivors.unionByName(df.where(~compared))


# --- similarity self-join ------------------------------------------------------------------------


def similar_pairs(
    df: DataFrame, key: str, order_by: str | None = None, method: str = "indel",
    staging: Staging | None = None,
) -> DataFrame:
    """(form_a, form_b, score, members_a, members_b): every pair of distinct forms at or above the cut-off,
    the form of the smaller node first.

    ``members_*`` says how many raw values a form stands for; copies are counted, never paired up.
    """
    matcher = Matcher(df, key, order_by, method, staging=staging)
    return matcher.pairs.select("form_a", "form_b", "score", "members_a", "members_b")


def approx_similar_pairs(df: DataFrame, key: str, tables: int = 24, seed: int = 7) -> DataFrame:
    """(form_a, form_b, score, members_a, members_b): most of the pairs of :func:`similar_pairs`, found by MinHash.

    Candidates are forms that agree on one of ``tables`` min-hashes of their bigrams; their scores are exact, so no wrong pair is
    returned, and the tests measure how many are missed (fewer than one in ten). It is for columns whose blocks are crowded by
    forms that share rare bigrams yet differ; forms of one character less than a bigram aren't compared.
    """
    nodes = forms(df, key).where(F.length("form") >= 2)
    found = F.array_distinct(_bigrams(F.col("form")))
    # the model takes no empty set, and may hash a form before the filter above
    grams = nodes.select("form", "members", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(""))).alias("grams"))
    vectors = HashingTF(inputCol="grams", outputCol="features", binary=True, numFeatures=1 << 18).transform(grams)
    model = MinHashLSH(inputCol="features", outputCol="hashes", numHashTables=tables, seed=seed).fit(vectors)
    near = model.approxSimilarityJoin(vectors, vectors, 0.8).where("datasetA.form < datasetB.form")
    pairs = near.select(
        F.col("datasetA.form").alias("form_a"), F.col("datasetB.form").alias("form_b"),
        F.col("datasetA.members").alias("members_a"), F.col("datasetB.members").alias("members_b"))
    scored = pairs.withColumn("score", indel_score(F.col("form_a"), F.col("form_b")))
    return scored.where(F.col("score") >= rules.FUZZY_SCORE).select("form_a", "form_b", "score", "members_a", "members_b")


def fuzzy_pair_count(
    df: DataFrame, key: str, order_by: str | None = None, method: str = "indel", staging: Staging | None = None
) -> int:
    """Pairs of distinct values that differ ignoring case and outer blanks, yet score 85 or more."""
    own = Staging(df.sparkSession) if staging is None else None
    count = Matcher(df, key, order_by, method, staging or own).pair_count()
    if own is not None:
        own.discard()
    return count


# --- fuzzy deduplication -------------------------------------------------------------------------


def _decide(nodes: DataFrame, edges: DataFrame, staging: Staging) -> DataFrame:
    """The kept nodes: in ascending order, a node stays unless it has an edge to a kept smaller one."""
    edges = staging.write(edges.select("a", "b"), "edges")
    dropped_parts = []
    while not edges.isEmpty():
        # every node without a smaller undecided neighbour stays; its neighbours go
        waiting = edges.select(F.col("b").alias("node")).distinct()
        kept = edges.select(F.col("a").alias("node")).distinct().join(waiting, "node", "left_anti")
        dropped = staging.write(
            edges.join(kept.select(F.col("node").alias("a")), "a", "left_semi")
            .select(F.col("b").alias("node"))
            .distinct(),
            "dropped",
        )
        dropped_parts.append(dropped)
        decided = kept.unionByName(dropped)
        edges = staging.write(
            edges.join(decided.select(F.col("node").alias("a")), "a", "left_anti").join(
                dropped.select(F.col("node").alias("b")), "b", "left_anti"
            ),
            "edges",
        )
    for dropped in dropped_parts:
        nodes = nodes.join(dropped, "node", "left_anti")
    return nodes


def kept_forms(nodes: DataFrame, index: DataFrame, staging: Staging, method: str) -> DataFrame:
    """The forms that survive greedy deduplication in ascending node order.

    Works through the forms in batches that grow fourfold: decide a batch, then drop every later form that is
    similar to a kept one. Dense clusters shrink to their leaders early and their inner pairs are never
    enumerated; sparse data needs only a logarithmic number of rounds.
    """
    undecided = nodes.select("node")
    remaining = undecided.count()
    size, kept_parts = FIRST_BATCH, []
    while remaining:
        if remaining <= size:
            batch, later = undecided, None
        else:
            if size <= TOP_NODES:  # the exact first so many: every task keeps its smallest, and one number comes back
                first = undecided.orderBy("node").limit(size).agg(F.max("node").alias("limit"))
            else:  # a rank error of at most a tenth of the batch
                accuracy = max(10_000, 10 * remaining // size)
                first = undecided.agg(F.percentile_approx("node", size / remaining, accuracy).alias("limit"))
            limit = first.first()["limit"]
            batch = undecided.where(F.col("node") <= limit)
            later = undecided.where(F.col("node") > limit)
        part = index.join(batch, "node", "left_semi") if later is not None else index.join(
            undecided, "node", "left_semi") if kept_parts else index
        edges = meet(part, "edges", True, _SLACK) if method == "indel" else _pairs(part, method)
        kept = staging.write(_decide(batch, edges, staging), "kept")
        kept_parts.append(kept)
        if later is None:
            break
        early, others = index.join(kept, "node", "left_semi"), index.join(later, "node", "left_semi")
        hits = (meet(early, "late", True, _SLACK, others) if method == "indel" else _pairs(early, method, others)).select(
            F.col("b").alias("node"))
        undecided = staging.write(later.join(hits.distinct(), "node", "left_anti"), "undecided")
        remaining = undecided.count()
        size *= 4
    kept = kept_parts[0]
    for more in kept_parts[1:]:
        kept = kept.unionByName(more)
    return kept


def fuzzy_dedup(
    df: DataFrame, key: str, order_by: str, method: str = "indel", staging: Staging | None = None
) -> DataFrame:
    """Drop rows whose key resembles an earlier kept key (score 85 or more); equal keys count too.

    Rows are taken in ascending ``order_by``, a unique integer column. Rows whose key is missing or shorter
    than three characters always stay. Every row of the table takes part.
    """
    return Matcher(df, key, order_by, method, staging=staging).drop_similar(df)
