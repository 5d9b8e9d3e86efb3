"""URL filters by association rules: FP-growth mines token combinations of labelled URLs.

A URL's tokens are its host's labels, their hyphenated words, its path's segments and file endings (digits generalised)
and the names of its query's fields. Combinations of up to ``MAX_TOKENS`` tokens that imply a label with enough confidence
and support become rules; a rule is dropped if some of its tokens imply the label as surely. Rules match through an
inverted index: each rule stands under its rarest token, so common tokens don't gather rules.

Rules are mined from pages, and a repeated one counts as often as it occurs. Open pages' token sets are judged once each, so a
host or URL that makes up a third of all pages is one row there.
"""

from __future__ import annotations

import json

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinsework.session import Staging

#: (host, path, verdict); the rule of longest host and path wins.
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
MIN_SUPPORT, MIN_CONFIDENCE, MAX_TOKENS = 0.01, 0.8, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LABEL = "label="


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and the rest; empty for a null, or without ``://``."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
    part = [F.coalesce(F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, whole, k)), F.lit("")) for k in (1, 2, 3)]
    return F.translate(part[0], _UPPER, _LOWER), part[1], part[2]


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``; null if none does."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def tokens(host: Column, path: Column, rest: Column) -> Column:
    """The sorted distinct tokens of a URL."""
    def tagged(tag: str, items: Column) -> Column:
        return F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(tag), F.regexp_replace(x, "[0-9]+", "0")))

    labels = F.split(host, "\\.")
    hyphened = F.flatten(F.transform(F.filter(labels, lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, "-")))
    segments = F.split(path, "/")
    endings = F.regexp_extract_all(path, F.lit("\\.([A-Za-z0-9]+)(?:/|$)"), F.lit(1))
    fields = F.regexp_extract_all(rest, F.lit("[?&]([^=&#]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(
        tagged("host:", labels), tagged("word:", hyphened), tagged("path:", segments), tagged("end:", endings), tagged("field:", fields))))


def _classes(pages: DataFrame, min_support: float) -> list[list[str]]:
    """The tokens of at least ``min_support`` of all pages, those that occur on exactly the same pages together.

    So many tokens come to the driver as a page has on average, divided by ``min_support``, at most.
    """
    sets = pages.groupBy("tokens", "label").agg(F.count("*").alias("n"))
    entries = sets.select(F.explode("tokens").alias("token"), "n", *[F.xxhash64(F.lit(k), "tokens", "label").alias(f"h{k}") for k in (1, 2)])
    marks = [F.sum(F.col(f"h{k}").cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]
    seen = entries.groupBy("token").agg(F.sum("n").alias("n"), *marks)
    common = seen.where(F.col("n") >= min_support * pages.count())
    return sorted(sorted(r["t"]) for r in common.groupBy("n", "h1", "h2").agg(F.collect_list("token").alias("t")).collect())


def _product(members: Column) -> Column:
    """All ways to take one token of each list, sorted."""
    def longer(taken: Column, own: Column) -> Column:
        return F.flatten(F.transform(taken, lambda t: F.transform(own, lambda m: F.array_append(t, m))))

    start = F.array(F.array().cast("array<string>"))
    return F.transform(F.aggregate(members, start, longer), lambda t: F.array_sort(t))


def mine(labelled: DataFrame, staging: Staging, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
         max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Rules ``(tokens, label, confidence, support)`` from the rows of ``labelled (tokens, label)``, one for each page.

    Support and confidence count pages, so a repeated URL weighs as often as it occurs. Tokens that occur on exactly the same pages
    are mined as one, since FP-growth would enumerate all their combinations, and each of them gets the rules. Rows without tokens or
    label teach nothing; without rows there are no rules.
    """
    pages = staging.write(labelled.where("label IS NOT NULL AND size(tokens) > 0").select("tokens", "label"), "labelled")
    classes = _classes(pages, min_support)
    if not classes:
        return staging.write(pages.limit(0).selectExpr("tokens", "label", "0.0D AS confidence", "0L AS support"), "rules")
    known = F.from_json(F.lit(json.dumps({t: c[0] for c in classes for t in c})), "map<string,string>")
    members = F.from_json(F.lit(json.dumps({c[0]: c for c in classes})), "map<string,array<string>>")
    shown = F.array_distinct(F.filter(F.transform("tokens", lambda t: F.try_element_at(known, t)), lambda t: t.isNotNull()))
    baskets = pages.select(F.array_append(shown, F.concat(F.lit(_LABEL), "label")).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0).fit(baskets).freqItemsets
    is_label = lambda x: x.startswith(_LABEL)
    plain = sets.select(
        F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("tokens"), F.filter("items", is_label).alias("labels"), "freq")
    plain = staging.write(plain.where(F.size("tokens").between(1, max_tokens)), "itemsets")
    base = plain.where(F.size("labels") == 0).select("tokens", F.col("freq").alias("base"))
    sure = plain.where(F.size("labels") == 1).join(base, "tokens").select(
        "tokens", F.expr(f"substring(labels[0], {len(_LABEL) + 1})").alias("label"), (F.col("freq") / F.col("base")).alias("confidence"),
        F.col("freq").alias("support"))
    sure = staging.write(sure.where(F.col("confidence") >= min_confidence), "sure")
    # a rule that has a token too many: without it, the others are as sure
    smaller = sure.select(F.col("tokens").alias("part"), F.col("label").alias("_l"), F.col("confidence").alias("_c"))
    parts = sure.where(F.size("tokens") > 1).select(
        "tokens", "label", "confidence", F.explode(F.concat(
            F.transform("tokens", lambda t: F.array_remove("tokens", t)), F.transform("tokens", lambda t: F.array(t)))).alias("part"))
    needless = parts.join(smaller, "part").where("label = _l AND _c >= confidence").select("tokens", "label").distinct()
    kept = sure.join(needless, ["tokens", "label"], "left_anti")
    every = kept.select(F.explode(_product(F.transform("tokens", lambda t: F.element_at(members, t)))).alias("tokens"), "label", "confidence", "support")
    return staging.write(every, "rules")


def judge(sets: DataFrame, rules: DataFrame, staging: Staging) -> DataFrame:
    """``(tokens, label)`` of the surest rule for each distinct row of ``sets (tokens)`` that a rule matches.

    The surest rule is the one of highest confidence, then support, then fewest tokens, then first in order.
    """
    entries = sets.select("tokens", F.explode("tokens").alias("token"))
    common = entries.groupBy("token").agg(F.count("*").alias("n"))
    numbered = rules.withColumnRenamed("tokens", "wanted")
    spread = numbered.select("wanted", "label", "confidence", "support", F.explode("wanted").alias("token")).join(common, "token")
    index = spread.groupBy("wanted", "label", "confidence", "support").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    hits = entries.join(index, "token").where(F.size(F.array_except("wanted", "tokens")) == 0)
    order = F.struct("confidence", "support", -F.size("wanted"), F.col("label"))
    return hits.groupBy("tokens").agg(F.max_by("label", order).alias("label"))


def verdicts(pages: DataFrame, staging: Staging, rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages (page_id, url)``.

    URLs that a stated rule fits are the labelled ones; others get the verdict of the surest mined rule, and are allowed
    if none matches, as are nulls and texts that are no URL.
    """
    host, path, rest = split_url(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), rest.alias("rest"))
    rows = rows.withColumns({"found": matched_rule(F.col("host"), F.col("path"), rules),
                             "tokens": tokens(F.col("host"), F.col("path"), F.col("rest"))}).drop("rest")
    rows = staging.write(rows, "urls")
    mined = mine(rows.where("found IS NOT NULL").select("tokens", F.col("found.verdict").alias("label")), staging)
    open_sets = rows.where("found IS NULL AND size(tokens) > 0").select("tokens").distinct()
    judged = judge(staging.write(open_sets, "open"), mined, staging)
    joined = rows.join(judged, "tokens", "left")
    return joined.select("page_id", "host", "path", F.col("found.rule").alias("rule"),
                         F.coalesce("found.verdict", "label", F.lit("allow")).alias("verdict"))
