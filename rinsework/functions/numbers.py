"""Numeric, boolean and age expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import WHITESPACE, strip

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER = r"^[+-]?\d{1,18}$"


def to_double(c: Column) -> Column:
    """The double a text spells, else NULL. The shape test keeps texts such as ``12d`` out of the cast."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def strip_currency(c: Column) -> Column:
    return F.translate(c, rules.CURRENCY_SYMBOLS + "," + WHITESPACE, "")


def numeric_string(c: Column) -> Column:
    """``₹5,000`` -> 5000.0; NULL when nothing numeric remains."""
    return to_double(strip_currency(c))


def boolean_string(c: Column) -> Column:
    word = F.lower(strip(c))
    return F.when(word.isin(*rules.TRUE_WORDS), F.lit(True)).when(
        word.isin(*rules.FALSE_WORDS), F.lit(False)
    )


def age_in_range(c: Column) -> Column:
    """The value when it is a possible age, else NULL."""
    low, high = rules.AGE_RANGE
    return F.when((c >= low) & (c <= high), c)


def age_out_of_range(c: Column) -> Column:
    low, high = rules.AGE_RANGE
    return F.coalesce((c < low) | (c > high), F.lit(False))
