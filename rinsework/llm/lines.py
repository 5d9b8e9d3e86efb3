"""Line deduplication with a log-template tree, in DataFrame expressions only.

A line is parsed at fixed depth: the number of its tokens, then its ``DEPTH`` leading tokens, lead to a leaf. Tokens end at
spaces and tabs. Words that hold a digit (``7``, ``a7f3``, ``2024-01-02``) are variable fields, generalised to ``<*>`` before
parsing; what else a token holds stays. Below its leaf a line belongs to its own template
and, if it is long enough, to templates that generalise one field: the tokens after the leading ones are cut into
``FIELDS`` runs, and each template leaves one run open. A template recurs if at least two documents hold it and
documents times constant tokens reach ``EVIDENCE``, so that a short line needs more documents than a long one. Variable
fields and the signs around them are no constants, so a line made of nothing else never recurs; in scripts that are written
without spaces two letters count as a token. Every
document but the one of smallest id loses the lines of recurring templates.

Plan: the texts are read twice. The first pass ships one row per line (hashes only) to its leaf; lines alone in their
leaf leave there. Counts are aggregated per template before the shuffle, and a document counts once per template. The
second pass joins each document with the numbers of the lines it loses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinsework.session import Staging

from .names import unused

#: Leading tokens on the way to a leaf; runs of tokens that may vary; tokens a line needs for that.
DEPTH, FIELDS, MIN_FIELD_TOKENS = 2, 4, 8
#: Documents times constant tokens that make a template recurring.
EVIDENCE = 20
VARIABLE = "<*>"
#: Letters of scripts that don't part words by spaces; characters of the other scripts' words, without digits and with them.
_UNSPACED = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}\\p{IsTibetan}"
_PLAIN, _WORD = (f"[\\p{{L}}\\p{{M}}{digits}_&&[^{_UNSPACED}]]" for digits in ("", "0-9"))
_DIGITS = f"{_PLAIN}*+[0-9]{_WORD}*+"
#: Words that hold a digit, and rows of them such as dates, amounts and addresses.
_FIELD = f"(?<!{_WORD}){_DIGITS}(?:[.,:/-]{_DIGITS})*+"


def _hash(*parts: Column) -> list[Column]:
    """128 bits as two longs."""
    return [F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)]


def _masked(line: Column) -> Column:
    """The line with every word that holds a digit generalised, and spaces for tabs."""
    return F.translate(F.regexp_replace(line, _FIELD, VARIABLE), "\t", " ")


def _constants(tokens: Column) -> Column:
    """How many words a run of masked tokens holds besides variable fields and the signs that touch them."""
    marked = F.replace(F.array_join(tokens, " "), F.lit(VARIABLE), F.lit("\x01"))
    rest = F.regexp_replace(marked, "(?<![^\\s\\p{L}\\p{M}])[^\\s\\p{L}\\p{M}\\x01]*+\\x01[^\\s\\p{L}\\p{M}]*+", " ")
    return F.regexp_count(rest, F.lit(f"[{_UNSPACED}]{{1,2}}|[^\\s{_UNSPACED}]+"))


def parse(docs: DataFrame) -> DataFrame:
    """One row for each line that isn't blank: document, line number from 0, leaf, tokens, hashes and constants of its runs.

    The runs are the leading tokens and the fields after them, or the whole line if it is too short for fields. Each
    token is hashed once here; templates are made from the runs' hashes.
    """
    # the text itself stays behind: beside the exploded lines it would be hashed once a line
    texts = docs.where("text IS NOT NULL").select(
        F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_key"), F.split("text", "\n").alias("l"))
    lines = texts.select("doc", "text_key", F.posexplode("l").alias("line", "v")).where("trim(v) != ''")
    # a line without fields, unspaced letters (all beyond U+0E00) and empty tokens has as many constants as tokens; this
    # must stay one cheap scan: script classes are slow
    v = F.col("v")
    plain = ~(v.rlike("[\\x00-\\x1f0-9<\\u0E00-\\x{10FFFF}]") | v.contains("  ") | v.startswith(" ") | v.endswith(" "))
    lines = lines.select("doc", "text_key", "line", "v", plain.alias("plain"))
    lines = lines.withColumn("tokens", F.split(F.when(F.col("plain"), v).otherwise(_masked(v)), " "))
    lines = lines.withColumn("n", F.size("tokens"))
    tokens, n = F.col("tokens"), F.col("n")

    def end(k: int) -> Column:
        return F.lit(DEPTH) + F.floor((n - DEPTH) * k / FIELDS).cast("int")

    fields = [F.slice(tokens, end(k) + 1, end(k + 1) - end(k)) for k in range(FIELDS)]
    # runs are hashed and measured by functions over their array: written out for each run, they make a method beyond the
    # 8,000 bytes that the JVM compiles
    runs = F.when(n >= MIN_FIELD_TOKENS, F.array(F.slice(tokens, 1, DEPTH), *fields)).otherwise(F.array(tokens))
    lines = lines.select("*", runs.alias("parts"))
    constants = F.when(F.col("plain"), F.transform("parts", F.size)).otherwise(F.transform("parts", _constants))
    return lines.select(
        "doc", "text_key", "line", F.xxhash64(n, F.slice(tokens, 1, DEPTH)).alias("leaf"), "n",
        F.flatten(F.transform("parts", lambda run: F.array(*_hash(run)))).alias("runs"), constants.alias("constants"),
    )


def _templates() -> Column:
    """Of a parsed line: hash and constant tokens of its own template and of each one with a field left open."""
    n, runs, constants = F.col("n"), F.col("runs"), F.col("constants")
    total = F.aggregate(constants, F.lit(0), lambda a, b: a + b)
    own = F.struct(F.struct(*[x.alias(c) for x, c in zip(_hash(n, runs), ("h1", "h2"))]).alias("t"), total.alias("constants"))

    def without(k: int) -> Column:
        rest = F.concat(F.slice(runs, 1, 2 + 2 * k), F.slice(runs, 2 * k + 5, 2 * FIELDS))
        key = F.struct(*[x.alias(c) for x, c in zip(_hash(n, F.lit(k), rest), ("h1", "h2"))])
        return F.struct(key.alias("t"), (total - constants[k + 1]).alias("constants"))

    return F.when(n >= MIN_FIELD_TOKENS, F.array(own, *[without(k) for k in range(FIELDS)])).otherwise(F.array(own))


def repeated_lines(docs: DataFrame, staging: Staging) -> DataFrame:
    """``(doc, text_key, lines)``: the numbers of the lines that each document loses; documents that lose none are left out."""
    parsed = parse(docs.where("doc_id IS NOT NULL"))
    crowded = parsed.groupBy("leaf").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo != hi").select("leaf")
    candidates = parsed.join(crowded, "leaf").select("doc", "text_key", "line", _templates().alias("templates"))
    candidates = staging.write(candidates, "candidate-lines")
    # a template counts once for each document
    held = candidates.select("doc", F.explode("templates").alias("x")).select("doc", "x.t", "x.constants").distinct()
    docs_of = held.groupBy("t").agg(
        F.count("*").alias("docs"), F.min("doc").alias("first"), F.max("constants").alias("constants"))
    recurring = docs_of.where((F.col("docs") > 1) & (F.col("docs") * F.col("constants") >= EVIDENCE)).select("t", "first")
    lost = candidates.select("doc", "text_key", "line", F.explode("templates.t").alias("t")).join(recurring, "t")
    lost = lost.where("doc != first")
    return lost.groupBy("doc", "text_key").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def _without(lines: Column, gone: Column) -> Column:
    """``lines`` without those of the numbers ``gone``: both are put in one order, where a number follows the line it takes."""
    marked = F.sort_array(F.concat(
        F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.lit(False).alias("gone"), x.alias("line"))),
        F.transform(gone, lambda i: F.struct(i.alias("at"), F.lit(True).alias("gone"), F.lit("").alias("line")))))

    def kept(whole: Column) -> Column:
        taken = lambda i: F.coalesce(F.get(whole, i + 1)["gone"], F.lit(False))
        return F.transform(F.filter(whole, lambda x, i: ~x["gone"] & ~taken(i)), lambda x: x["line"])

    return F.transform(F.array(marked), kept)[0]


def drop_repeated_lines(docs: DataFrame, staging: Staging) -> DataFrame:
    """``docs`` with the lines of templates that recur across documents taken out of all but the first document.

    The first document is the one of smallest ``doc_id``. Blank lines stay; a document that loses all its lines stays with
    an empty text. Null texts and rows with a null ``doc_id`` stay as they are and count for nothing. Repeated rows of
    one ``doc_id`` are one document, and so are rows of one id with different texts; each loses the lines of its own text. An
    empty table stays empty. ``n_chars``, where it exists, follows the text; other columns stay as they are, whatever their names.
    """
    doc, key, numbers = unused(docs.columns, "_doc", "_text", "_lines")
    lost = repeated_lines(docs, staging).select(F.col("doc").alias(doc), F.col("text_key").alias(key), F.col("lines").alias(numbers))
    joined = docs.join(lost, (docs["doc_id"] == lost[doc]) & (F.xxhash64(docs["text"]) == lost[key]), "left")
    gone = lost[numbers]
    text = F.when(gone.isNull(), docs["text"]).otherwise(F.array_join(_without(F.split(docs["text"], "\n"), gone), "\n"))

    def column(name: str) -> Column:
        if name == "text":
            return text.alias(name)
        if name == "n_chars":
            return F.when(gone.isNotNull(), F.length(text)).otherwise(docs[name]).cast(docs.schema[name].dataType).alias(name)
        return docs[name]

    return joined.select(*[column(c) for c in docs.columns])
