"""Phone expressions: E.164 form from numbering plans and the table of calling codes.

Numbers of the listed plans are checked against the shape of their national numbers. Other international numbers
need an assigned calling code and a length that E.164 allows. All of it is one ``CASE`` expression, so cleaning a
phone column is a projection — no join, no Python. Callers extend the plans by passing their own rules, or bring a table of
plans, which is looked up by the longest calling code that a number begins with, however many plans it holds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from .rules import PhoneRule
from .text import is_blank, strip

#: Calling codes of a table of plans that may be broadcast.
PLAN_ROWS = 100_000
_EXTENSION = r"(?i)[\s,;]*(extension|extn|ext|x|#)[\s.:=]*\d{1,7}$"
_LEAD_IN = r"^[^+\d(]+"
_DIALABLE = r"^\+?[\d\s().~/-]+$"


def _digits(c: Column) -> Column:
    """Digits with an optional leading ``+``; NULL when the text holds anything else."""
    core = F.regexp_replace(F.regexp_replace(strip(c), _EXTENSION, ""), _LEAD_IN, "")
    return F.when(core.rlike(_DIALABLE), F.regexp_replace(core, r"[^+\d]", ""))


def _known_number(plans: Sequence[PhoneRule]) -> str:
    return r"^\+(" + "|".join(p.calling_code + p.national for p in plans) + ")$"


_ASSIGNED = "|".join([*rules.SHORT_CODES, *[f"{zone}[{last}]" for zone, last in rules.CODE_ZONES.items()]])


def _assigned(dialled: Column, unless: str = "") -> Column:
    """Whether an international number has an assigned calling code and a possible length."""
    shape = rf"^\+{unless}({_ASSIGNED})\d{{{rules.NATIONAL_DIGITS},}}$"
    return dialled.rlike(shape) & (F.length(dialled) <= rules.E164_DIGITS + 1)


def _elsewhere(dialled: Column, plans: Sequence[PhoneRule]) -> Column:
    """Whether an international number has an assigned calling code without a plan, and a possible length."""
    planned = "|".join(p.calling_code for p in plans)
    return _assigned(dialled, f"(?!({planned}))")


def _from_dialled(dialled: Column, plans: Sequence[PhoneRule], home: PhoneRule) -> Column:
    known = _known_number(plans)
    abroad = F.when(dialled.rlike(known), dialled)
    by_trunk: dict[str, list[str]] = {}
    for p in plans:
        by_trunk.setdefault(p.trunk, []).append(p.calling_code)
    for trunk, codes in by_trunk.items():
        if trunk:
            bare = F.regexp_replace(dialled, rf"^\+({'|'.join(codes)}){trunk}", "+$1")
            abroad = abroad.when(bare.rlike(known), bare)
    abroad = abroad.when(_elsewhere(dialled, plans), dialled)
    national = f"^({home.trunk})?({home.national})$"
    return (
        F.when(dialled.startswith("+"), abroad)
        .when(dialled.rlike(national), F.regexp_replace(dialled, national, f"+{home.calling_code}$2"))
        .when(dialled.rlike(f"^{home.calling_code}{home.national}$"), F.concat(F.lit("+"), dialled))
    )


def with_e164_by_table(df: DataFrame, targets: Mapping[str, str], plans: DataFrame, home: str) -> DataFrame:
    """What :func:`with_e164` adds, with the plans of a table ``(country, calling_code, national, trunk)``; ``home`` is a country of it.

    A number belongs to the plans of the longest listed calling code that it begins with, of which one must fit. The table is joined as a broadcast once it was counted and found to have at most ``PLAN_ROWS`` codes.
    Null codes and shapes are ignored; a table without ``home`` raises ``ValueError``.
    """
    known = plans.where("calling_code IS NOT NULL AND national IS NOT NULL").select(
        "country", F.col("calling_code").cast("string").alias("code"), F.concat(F.lit("("), "national", F.lit(")")).alias("national"),
        F.coalesce("trunk", F.lit("")).alias("trunk"))
    own = known.where(F.col("country") == home).first()
    if own is None:
        raise ValueError(f"no plan of {home!r}")
    codes = known.groupBy(F.col("code").alias("__code")).agg(F.array_sort(F.collect_list(F.struct("national", "trunk"))).alias("__plans"))
    codes = F.broadcast(codes) if codes.count() <= PLAN_ROWS else codes
    lengths = sorted(r["n"] for r in known.select(F.length("code").alias("n")).distinct().collect())
    national = f"^({own['trunk']})?({own['national']})$"
    out = df
    for new, source in targets.items():
        wide = out.withColumn("__dialled", _dialled(F.col(f"`{source}`")))
        wide = wide.withColumn("__rest", F.expr("substring(__dialled, 2)"))
        # the longest listed code is the last of these that meets a row of the table
        listed = codes.select("__code", F.col("__plans"))
        for n in lengths:
            at = listed.toDF(f"__code{n}", f"__plans{n}")
            wide = wide.join(at, F.when(F.col("__dialled").startswith("+"), F.substring("__rest", 1, n)) == F.col(f"__code{n}"), "left")
        code = F.coalesce(*[F.col(f"__code{n}") for n in reversed(lengths)])
        shapes = F.coalesce(*[F.col(f"__plans{n}") for n in reversed(lengths)])
        wide = wide.withColumns({"__found": code, "__shapes": shapes})
        rest = F.expr("substring(__rest, length(__found) + 1)")

        def bare(p: Column) -> Column:
            trunk = p["trunk"]
            return F.when(F.regexp_like(rest, F.concat(F.lit("^"), p["national"], F.lit("$"))), rest).when(
                (trunk != "") & F.regexp_like(rest, F.concat(F.lit("^"), trunk, p["national"], F.lit("$"))),
                F.regexp_replace(rest, F.concat(F.lit("^"), trunk), F.lit("")))

        fitting = F.filter(F.transform("__shapes", bare), lambda x: x.isNotNull())
        number = F.concat(F.lit("+"), F.col("__found"), F.get(fitting, F.lit(0)))
        abroad = F.when(F.col("__found").isNotNull(), number).when(_assigned(F.col("__dialled")), F.col("__dialled"))
        dialled = F.col("__dialled")
        value = (
            F.when(dialled.startswith("+"), abroad)
            .when(dialled.rlike(national), F.regexp_replace(dialled, national, f"+{own['code']}$2"))
            .when(dialled.rlike(f"^{own['code']}{own['national']}$"), F.concat(F.lit("+"), dialled))
        )
        out = wide.select(*[F.col(f"`{c}`") for c in out.columns], value.alias(new))
    return out


def _dialled(c: Column) -> Column:
    return F.regexp_replace(_digits(c), r"^00", "+")


def with_e164(
    df: DataFrame,
    targets: Mapping[str, str],
    plans: Sequence[PhoneRule] = rules.PHONE_RULES,
    default_country: str = rules.DEFAULT_COUNTRY,
) -> DataFrame:
    """Add ``{new column: source column}`` E.164 columns, NULL for what is no valid number.

    The digits of a cell are extracted once, in a projection of their own.
    """
    home = next(p for p in plans if p.country == default_country)
    helpers = {new: f"__dialled_{i}" for i, new in enumerate(targets)}
    dialled = df.select(
        "*", *[_dialled(F.col(f"`{src}`")).alias(helpers[new]) for new, src in targets.items()]
    )
    return dialled.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[_from_dialled(F.col(h), plans, home).alias(new) for new, h in helpers.items()],
    )


def is_unlisted(c: Column) -> Column:
    """Whether a cell is an international number whose calling code isn't assigned to anybody."""
    dialled = _dialled(c)
    number = rf"^\+[1-9]\d{{7,{rules.E164_DIGITS - 1}}}$"
    return F.coalesce(dialled.rlike(number) & ~dialled.rlike(rf"^\+({_ASSIGNED})"), F.lit(False))


def phone_status(c: Column, number: Column) -> Column:
    """``valid`` / ``corrected`` / ``unknown`` / ``invalid`` for a cell and its E.164 form; NULL for blank cells.

    ``unknown`` numbers have a calling code that isn't assigned; nothing says that they're wrong.
    """
    return (
        F.when(is_blank(c), F.lit(None).cast("string"))
        .when(number.isNull() & is_unlisted(c), "unknown")
        .when(number.isNull(), "invalid")
        .when(number != strip(c), "corrected")
        .otherwise("valid")
    )
