"""Date expressions: pre-screen, parsing of many spellings, strict check, standard form.

Parsing never throws and never falls back to Python: a text is matched by shape, rewritten as
``year-month-day``, and one ``try_cast`` decides whether that day exists.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain
from string import ascii_letters, digits

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from .text import is_blank, once, strip

_SCREENED = r"^\d{2,4}[/.-]\d{1,2}[/.-]\d{1,2}$"
_PLAUSIBLE = r"^\d{2,4}[/.-](0?[1-9]|1[0-2])[/.-](0?[1-9]|[12]\d|3[01])$"

# years the engine accepts (rules.FIRST_YEAR to rules.LAST_YEAR) and the two halves of short years
_YEAR = r"(167[89]|16[89]\d|1[7-9]\d\d|2[01]\d\d|22[0-5]\d|226[01])"
_NEW = r"(0\d|[1-5]\d|6[0-8])"
_OLD = r"(69|[7-9]\d)"

# --- fixed values: numeric spellings and their year-month-day form, in order of preference --------
NUMERIC_SHAPES = (
    (rf"^{_YEAR}([-/.])(\d{{1,2}})\2(\d{{1,2}})$", "$1-$3-$4"),
    (rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2{_YEAR}$", "$4-$3-$1"),
    (rf"^(\d{{1,2}})([-/])(\d{{1,2}})\2{_YEAR}$", "$4-$1-$3"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/{_NEW}$", "20$3-$1-$2"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/{_OLD}$", "19$3-$1-$2"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/{_NEW}$", "20$3-$2-$1"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/{_OLD}$", "19$3-$2-$1"),
    (rf"^{_NEW}-(\d{{1,2}})-(\d{{1,2}})$", "20$1-$2-$3"),
    (rf"^{_OLD}-(\d{{1,2}})-(\d{{1,2}})$", "19$1-$2-$3"),
)

# --- fixed values: further spellings that only the extended reading knows --------------------------
COMPACT_SHAPES = (
    (rf"^{_YEAR}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$", "$1-$2-$3"),
    (rf"^{_YEAR}-(0?[1-9]|1[0-2])$", "$1-$2-1"),
)

_MONTH_FIRST = r"^([A-Za-z]+)([ -])(\d{1,2})\2(\d{4})$"
_MONTH_FIRST_SHORT = r"^([A-Za-z]+)([ -])(\d{1,2})\2(\d{2})$"
_WORDED_NEW = rf"^(\d{{1,2}})([ /-])([A-Za-z]+)\2{_NEW}$"
_WORDED_OLD = rf"^(\d{{1,2}})([ /-])([A-Za-z]+)\2{_OLD}$"
_MONTH_ONLY = r"^([A-Za-z]+) (\d{4})$"
_WORDED = rf"^(\d{{1,2}})([ /-])([A-Za-z]+)\2{_YEAR}$"
_WORDED_STRICT = rf"^(\d{{1,2}})( [A-Za-z]+ |-[A-Za-z]{{3}}-|/[A-Za-z]{{3}}/){_YEAR}$"

# what the extended reading drops or rewrites before it looks at the shape
_RELAXATIONS = (
    (r"(?i)[T\s]+\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*([AP]M)?\s*(Z|UTC|GMT|[+-]\d{2}:?\d{2})?$", ""),
    (r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*[.,]?\s+", ""),
    (r"(?i)(\d)(st|nd|rd|th)\b", "$1"),
    (r"(?i)\bsept\b", "Sep"),
    (r"[,\s]+", " "),
)


def passes_prescreen(c: Column) -> Column:
    """False for delimited numbers whose 2nd part cannot be a month or whose 3rd cannot be a day."""
    t = strip(c)
    return ~t.rlike(_SCREENED) | t.rlike(_PLAUSIBLE)


# what every shape needs, whatever is dropped first: two digits of a year, and no other characters than these
_YEAR_DIGITS = r"\d\d"
# (each spelled out: Java looks single characters up in a table, but tries ranges one after the other)
_FOREIGN = rf"[^{ascii_letters}{digits}/.:+, \t\n\x0B\f\r\x{{85}}\x{{2028}}\x{{2029}}-]"
_NUMERIC = r"^[\d/.-]+$"
# every text that one of the worded shapes fits, or that is rewritten into one
_WORDABLE = r"^(\d{1,2}[ /-][A-Za-z]+[ /-]\d{2,4}|[A-Za-z]+[ -]\d{1,2}[ -]\d{2,4}|[A-Za-z]+ \d{4})$"


def _tidy(t: Column, extended: bool) -> Column:
    """A stripped text as the shapes expect it; NULL where none can fit, which spares the others' work."""
    tidy = t
    for pattern, replacement in _RELAXATIONS if extended else ((r"\s+", " "),):
        tidy = F.regexp_replace(tidy, pattern, replacement)
    # of the rewrites only that of the month can change what a text reads that has a worded shape already
    sept, sep = _RELAXATIONS[3]
    tidy = F.when(t.rlike(_WORDABLE), F.regexp_replace(t, sept, sep) if extended else t).otherwise(tidy)
    worded = F.when(~t.rlike(_FOREIGN), tidy)
    return F.when(t.rlike(_YEAR_DIGITS), F.when(t.rlike(r"^[\d/.-]*$"), t).otherwise(worded))


def _day_first(t: Column, extended: bool) -> Column:
    """A tidy text of a worded date with its day in front; NULL where no worded shape can fit."""
    day_first = F.regexp_replace(t, _MONTH_FIRST, "$3$2$1$2$4")
    if extended:
        day_first = F.regexp_replace(day_first, _MONTH_ONLY, "1 $1 $2")
        day_first = F.regexp_replace(day_first, _MONTH_FIRST_SHORT, "$3$2$1$2$4")
        day_first = F.regexp_replace(day_first, _WORDED_NEW, "$1$2$3$2" + "20$4")
        day_first = F.regexp_replace(day_first, _WORDED_OLD, "$1$2$3$2" + "19$4")
    return F.when(t.rlike(_WORDED), t).when(t.rlike(_WORDABLE), day_first)


def _worded_date(day_first: Column, extended: bool) -> Column:
    numbers = {}
    for i, name in enumerate(rules.MONTHS, 1):
        numbers |= {name: f"-{i:02d}-", name[:3]: f"-{i:02d}-"}
    months = F.create_map(*map(F.lit, chain.from_iterable(numbers.items())))

    def made(parts: Column) -> Column:
        month = F.try_element_at(months, F.lower(parts[1]))
        return F.concat(parts[2], month, parts[0]).try_cast("date")

    return F.when(day_first.rlike(_WORDED if extended else _WORDED_STRICT), once(F.split(day_first, "[ /-]"), made))


def _from_tidy(t: Column, day_first: Column, extended: bool) -> Column:
    def read(shape: str, form: str) -> Column:
        return F.regexp_replace(t, shape, form).try_cast("date")

    def first_of(*shapes: tuple[str, str]) -> Column:
        return F.coalesce(*[F.when(t.rlike(shape), read(shape, form)) for shape, form in shapes])

    # no text has shapes of two of these groups
    year_first, day_first_shape, month_first, *short = NUMERIC_SHAPES
    numeric = F.when(t.rlike(year_first[0]), read(*year_first)).when(
        t.rlike(day_first_shape[0]), F.coalesce(read(*day_first_shape), first_of(month_first))).when(
        t.rlike(r"^\d{1,2}/\d{1,2}/\d\d$"), first_of(*short[:4])).otherwise(
        first_of(*short[4:], *(COMPACT_SHAPES if extended else ())))
    return F.when(day_first.isNotNull(), _worded_date(day_first, extended)).when(
        t.rlike(_NUMERIC) & (~t.rlike(_SCREENED) | t.rlike(_PLAUSIBLE)), numeric
    )


def parse_date(c: Column, extended: bool = True) -> Column:
    """The date a text spells, else NULL.

    Day-first spellings win over month-first ones where both fit. ``extended`` adds ordinals, commas,
    weekday names, ``15 Jan 25``, ``20250115``, ``Jan 2025`` and ``2025-01`` (first of the month), and a time of
    day, which is dropped; :func:`seconds_of_day` reads it.
    """
    def parsed(tidy: Column) -> Column:
        return once(_day_first(tidy, extended), lambda day_first: _from_tidy(tidy, day_first, extended))

    return once(strip(c), lambda bare: once(_tidy(bare, extended), parsed))


_CLOCK = r"(?i)[T\s](\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*([AP]M)?\s*(?:Z|UTC|GMT|([+-])(\d{2}):?(\d{2}))?$"


def seconds_of_day(c: Column) -> Column:
    """The seconds after midnight that the end of a text spells, less its offset from UTC; 0 without a clock time.

    NULL for a time that doesn't exist, such as 25:00 or 13:00 PM.
    """
    t = strip(c)
    hour, minute, second, ahead_h, ahead_m = (
        F.coalesce(F.regexp_extract(t, _CLOCK, k).try_cast("int"), F.lit(0)) for k in (1, 2, 3, 6, 7)
    )
    half, sign = F.upper(F.regexp_extract(t, _CLOCK, 4)), F.regexp_extract(t, _CLOCK, 5)
    fits = (minute < 60) & (second < 60) & F.when(half == "", hour < 24).otherwise(hour.between(1, 12))
    full_hour = F.when(half == "", hour).otherwise(hour % 12 + F.when(half == "PM", 12).otherwise(0))
    ahead = (ahead_h * 3600 + ahead_m * 60) * F.when(sign == "-", -1).otherwise(1)
    clock = F.when(fits, full_hour * 3600 + minute * 60 + second - ahead)
    return F.when(t.rlike(_CLOCK), clock).otherwise(0)


def with_parsed_dates(
    df: DataFrame, targets: Mapping[str, str], extended: bool = True
) -> DataFrame:
    """Add ``{new column: source column}`` date columns."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*kept, *[parse_date(F.col(f"`{src}`"), extended).alias(new) for new, src in targets.items()])


def is_strict_date(c: Column) -> Column:
    """True for a text that already is an existing ``YYYY-MM-DD`` day."""
    return F.coalesce(
        c.rlike(rules.STRICT_DATE) & c.rlike(f"^{_YEAR}") & c.try_cast("date").isNotNull(),
        F.lit(False),
    )


def date_status(c: Column, parsed: Column) -> Column:
    """``converted`` / ``rejected``; NULL for blank cells."""
    return (
        F.when(is_blank(c), F.lit(None).cast("string"))
        .when(parsed.isNotNull(), "converted")
        .otherwise("rejected")
    )


def standard_date(c: Column, parsed: Column, mode: str) -> Column:
    """The cell after standardising: ``nullify`` empties what cannot be parsed, ``standardize`` trims it,
    ``keep`` changes nothing."""
    if mode == "keep":
        return c
    bad = F.lit(None).cast("string") if mode == "nullify" else strip(c)
    return (
        F.when(is_blank(c), c)
        .when(parsed.isNotNull(), parsed.cast("string"))
        .otherwise(bad)
    )
