"""E-mail expressions: syntax check and normal form, without any DNS look-up.

Rules: one ``@``; local part of 1-64 allowed characters without a leading, trailing or doubled dot;
a domain of at least two labels of 1-63 letters, digits and inner hyphens that ends in a letter and
is not a special-use name; at most 254 characters in all. The normal form composes letters and their combining
marks (Unicode form C) and lower-cases the domain.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from .text import composed, is_blank, without_whitespace

_WIDE = r"\x{80}-\x{10FFFF}"
_ATOM = rf"[A-Za-z0-9!#$%&'*+/=?^_`{{|}}~{_WIDE}-]+"
_ALNUM = rf"[A-Za-z0-9{_WIDE}]"
_LABEL = rf"{_ALNUM}([A-Za-z0-9{_WIDE}-]{{0,61}}{_ALNUM})?"
SYNTAX = rf"^{_ATOM}(\.{_ATOM})*@{_LABEL}(\.{_LABEL})+$"
ENDS_IN_LETTER = rf"[A-Za-z{_WIDE}]$"
SPECIAL_USE = r"(?i)[@.](" + "|".join(rules.SPECIAL_USE_DOMAINS) + r")$"


def is_valid_email(compact: Column) -> Column:
    """Whether a whitespace-free text is a deliverable-looking address."""
    return (
        compact.rlike(SYNTAX)
        & compact.rlike(ENDS_IN_LETTER)
        & ~compact.rlike(SPECIAL_USE)
        & (F.instr(compact, "@") <= 65)
        & (F.length(compact) <= 254)
    )


def _normal(compact: Column) -> Column:
    normal = F.concat(
        F.substring_index(compact, "@", 1), F.lit("@"), F.lower(F.substring_index(compact, "@", -1))
    )
    return F.when(is_valid_email(compact), normal)


def with_normal_emails(df: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """Add ``{new column: source column}`` columns with the normal form of valid addresses, else NULL."""
    helpers = {new: f"__compact_{i}" for i, new in enumerate(targets)}
    compact = df.select(
        "*", *[composed(without_whitespace(F.col(f"`{src}`"))).alias(helpers[new]) for new, src in targets.items()]
    )
    return compact.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[_normal(F.col(h)).alias(new) for new, h in helpers.items()],
    )


def email_status(c: Column, normal: Column) -> Column:
    """``valid`` / ``corrected`` / ``invalid`` for a cell and its normal form; NULL for blank cells, which
    the cleaner leaves alone."""
    return (
        F.when(is_blank(c), F.lit(None).cast("string"))
        .when(normal.isNull(), "invalid")
        .when(normal != c, "corrected")
        .otherwise("valid")
    )


def email_audit_class(c: Column) -> Column:
    """``valid`` / ``malformed`` / ``suspicious`` for the audit, which also judges blank texts."""
    compact = without_whitespace(c)
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(is_valid_email(compact), "valid")
        .when(~compact.contains("@") | compact.startswith("@") | compact.endswith("@"), "malformed")
        .otherwise("suspicious")
    )
