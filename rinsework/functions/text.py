"""Text expressions: trimming, blank test, title case."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# every character a Unicode-aware strip removes
WHITESPACE = (
    " \t\n\r\f\u000b\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``value`` is computed once however often ``use`` names it.

    It also keeps long expressions out of the loop that Spark generates for a whole stage: a method beyond 8,000 bytes is
    never compiled by the JVM, and then everything in that loop is slow.
    """
    return F.transform(F.array(value), use)[0]


def without_whitespace(c: Column) -> Column:
    return F.translate(c, WHITESPACE, "")


def is_blank(c: Column) -> Column:
    """True for NULL and for text without a visible character."""
    return c.isNull() | (strip(c) == "")


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every letter run and lower-case the rest (``O'Brien``, ``Hello-World``).

    ``initcap`` only restarts after a blank, so it is used directly on plain words and per letter
    run on everything else.
    """
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.when(c.rlike(r"^[\p{L} ]*$"), F.initcap(c)).otherwise(
        F.array_join(F.transform(runs, F.initcap), "")
    )


def standardize_text(c: Column, structured: bool) -> Column:
    """Trim; apply title case unless the column holds structured values. NULL stays NULL."""
    return strip(c) if structured else title_case(strip(c))


def composed(c: Column) -> Column:
    """Unicode normal form C: letters and combining marks that one character stands for become that character.

    By the Unicode library that ships with Spark, on the JVM. Texts without a character from U+0300 on are in that form already.
    Spark takes the call for non-deterministic, so it belongs in a projection, not in an aggregate.
    """
    whole = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(False))
    return F.when(c.rlike(r"[\x{300}-\x{10FFFF}]"), whole).otherwise(c)
