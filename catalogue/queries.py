"""Every operator as a named query over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinsework import Staging, diagnose, optimize
from rinsework.functions import dates, numbers, rules, text
from rinsework.operators import columns, dedup, dictionary, fuzzy, impute, outliers, profile, report
from rinsework.operators import scoring, semantics, sketches, verify
from rinsework.operators.profile import ROW_ID
from rinsework.operators.quantiles import exact_quantiles
from rinsework.sources import infer_types, output_name, preview, read_csv, write_csv, write_json

from .dirty import EMAIL_IN_TEXT, PHONE_IN_TEXT, table, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Rows of a task whose memory grows with the distinct values in them.
TASK_ROWS = 500_000


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _customer(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "dirty_customer")


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "dirty_orders")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "dirty_events")


def _pick(frame: DataFrame, *names: str) -> DataFrame:
    return frame.select(*names)


# --- sources -------------------------------------------------------------------------------------


@query
def inferred_types(spark, folder):
    """All cells as text, then typed by their values."""
    raw = _customer(spark, folder)
    as_text = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
    typed = infer_types(as_text)
    picked = typed.select("c_custkey", "age", "balance", "email")
    return picked.withColumn("types", F.lit(",".join(f"{c}:{t}" for c, t in picked.dtypes)))


@query
def preview_rows(spark, folder):
    return preview(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"),
                   10, "o_orderkey")


# --- profile -------------------------------------------------------------------------------------


@query
def base_stats(spark, folder):
    stats = profile.base_stats(table(spark, folder, "lineitem"))
    return stats.select("rows", "cols", F.array_join("columns", ",").alias("columns"))


@query
def column_profile(spark, folder):
    frame = profile.column_profile(_events(spark, folder))
    return frame.drop("mode", "skewness")


@query
def skewness_profile(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    stats = profile.collect_stats(
        lineitem.select(*profile.numeric_columns(lineitem)), frequencies=False, quantiles=False
    )
    return spark.createDataFrame(
        [(s.name, round(s.skewness, 2), impute.recommend(s, s.kind)) for s in stats.columns.values()],
        "column string, skewness double, recommended string",
    )


@query
def mode_profile(spark, folder):
    customer = table(spark, folder, "customer").select("c_name", "c_mktsegment")
    part = table(spark, folder, "part").select("p_name", "p_brand", "p_type")
    return profile.modes(customer, customer.columns).unionByName(profile.modes(part, part.columns))


@query
def exact_quantile(spark, folder):
    wanted = {"l_extendedprice": (0.01, 0.25, 0.5, 0.75, 0.99), "l_quantity": (0.1, 0.9)}
    found = exact_quantiles(table(spark, folder, "lineitem"), wanted)
    rows = [(c, p, round(v, 4)) for c, values in found.items() for p, v in values.items()]
    return spark.createDataFrame(rows, "column string, probability double, quantile double")


@query
def null_density(spark, folder):
    return profile.null_density(_customer(spark, folder))


@query
def blank_cells(spark, folder):
    return profile.blank_counts(_customer(spark, folder), ["name", "email", "phone", "city"])


@query
def duplicate_audit(spark, folder):
    return profile.duplicate_count(_orders(spark, folder))


@query
def exact_dedup(spark, folder):
    return dedup.drop_exact_duplicates(_orders(spark, folder))


@query
def exact_dedup_fingerprint(spark, folder):
    staging = Staging(spark)
    return dedup.drop_exact_duplicates_by_fingerprint(staging.write(_orders(spark, folder), "orders"))


@query
def duplicate_audit_fingerprint(spark, folder):
    staging = Staging(spark)
    return dedup.duplicate_count_by_fingerprint(staging.write(_orders(spark, folder), "orders"))


@query
def mode_heavy(spark, folder):
    """Modes of columns with few and with many distinct values, by bucket counts and an exact second pass."""
    lines, staging = table(spark, folder, "lineitem"), Staging(spark)
    wanted = ["l_partkey", "l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag"]
    return profile.heavy_modes(lines, wanted, staging)


@query
def profile_merged(spark, folder):
    """Profiles of every ship month of lineitem, stored and merged, beside whether distinct counts and medians keep their bounds."""
    lines, staging = table(spark, folder, "lineitem"), Staging(spark)
    wanted = ["l_orderkey", "l_extendedprice", "l_discount", "l_returnflag"]
    parts = staging.write(sketches.sketch(lines, wanted, F.date_trunc("month", "l_shipdate")), "months")
    found = sketches.read(sketches.merge(parts), (0.5,))
    # each task collapses the copies of its own rows before the shuffle, in a map that grows with them
    bounded = table(spark, folder, "lineitem", rows=TASK_ROWS)
    exact = bounded.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v"), (
        F.lit(None) if c == "l_returnflag" else F.col(c)).cast("double").alias("x")) for c in wanted])))
    near = exact.join(F.broadcast(found.select("column", F.get("quantiles", F.lit(0)).alias("median"))), "column").groupBy("column").agg(
        F.countDistinct("v").alias("exact"), F.avg((F.col("x") < F.col("median")).cast("double")).alias("below"),
        F.avg((F.col("x") <= F.col("median")).cast("double")).alias("upto"))
    bound = 4 * sketches.DISTINCT_ERROR
    return found.join(near, "column").select(
        "column", "rows", "nulls", "low", "high", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
        (F.abs(F.col("distinct") - F.col("exact")) <= bound * F.col("exact") + 1).alias("distinct_near"),
        ((F.col("below") <= 0.5 + sketches.RANK_ERROR) & (F.col("upto") >= 0.5 - sketches.RANK_ERROR)).alias("median_near"))


# --- outliers ------------------------------------------------------------------------------------


def _rounded_audit(frame: DataFrame) -> DataFrame:
    return frame.select("column", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "outliers")


@query
def iqr_outlier_audit(spark, folder):
    return _rounded_audit(outliers.outlier_audit(table(spark, folder, "lineitem"))).unionByName(
        _rounded_audit(outliers.outlier_audit(_events(spark, folder)))
    )


def _treated(spark, folder, treatment):
    events = _events(spark, folder).select("event_id", "value")
    bounds = outliers.iqr_bounds(events, ["value"])
    return outliers.treat_outliers(events, bounds, treatment).select(
        "event_id", F.round("value", 4).alias("value")
    )


@query
def outlier_clip(spark, folder):
    return _treated(spark, folder, "clip")


@query
def outlier_median(spark, folder):
    return _treated(spark, folder, "median_replace")


@query
def outlier_remove(spark, folder):
    return _treated(spark, folder, "remove_row")


# --- missing values ------------------------------------------------------------------------------


def _imputed(spark, folder, column, strategy):
    events = _events(spark, folder).select("event_id", column)
    return impute.impute(events, {column: strategy})[0]


@query
def impute_mean(spark, folder):
    return _imputed(spark, folder, "value", "Mean")


@query
def impute_median(spark, folder):
    return _imputed(spark, folder, "value", "Median")


@query
def impute_auto(spark, folder):
    return _imputed(spark, folder, "value", "Auto")


@query
def impute_mode(spark, folder):
    return _imputed(spark, folder, "event_type", "Mode")


@query
def impute_mode_numbers(spark, folder):
    frame = view(spark, folder, "tied_numbers")
    return impute.impute(frame, {"user_id": "Mode", "big": "Mode", "tied": "Mode"})[0]


@query
def impute_custom(spark, folder):
    return _imputed(spark, folder, "value", "Custom:99.0")


@query
def impute_skip(spark, folder):
    return _imputed(spark, folder, "value", "Skip")


# --- cell cleaners -------------------------------------------------------------------------------


@query
def numeric_string_clean(spark, folder):
    return _orders(spark, folder).select(
        "o_orderkey", numbers.numeric_string(F.col("revenue")).alias("revenue")
    )


@query
def boolean_clean(spark, folder):
    return _orders(spark, folder).select(
        "o_orderkey", numbers.boolean_string(F.col("active")).alias("active")
    )


@query
def type_gates(spark, folder):
    """Columns are converted where enough cells convert: revenue passes, active does, priority stays."""
    converted, types = columns.convert_types(
        _orders(spark, folder), {"revenue": "currency", "active": "boolean", "priority": "numeric_string"}
    )
    return converted.select(
        "o_orderkey", "revenue", "active", "priority",
        F.lit(",".join(f"{c}:{t}" for c, t in types.items())).alias("converted"),
    )


@query
def date_prescreen(spark, folder):
    return _orders(spark, folder).select(
        "o_orderkey", "order_date", dates.passes_prescreen(F.col("order_date")).alias("passes")
    )


def _dated(spark, folder, mode):
    frame = _orders(spark, folder).select("o_orderkey", "order_date")
    return columns.standardize_dates(
        frame, {"order_date": mode}, {"order_date": "status"}, extended=False
    )


@query
def date_standardize(spark, folder):
    return _dated(spark, folder, "standardize")


@query
def date_nullify(spark, folder):
    return _dated(spark, folder, "nullify")


@query
def date_audit(spark, folder):
    status = _dated(spark, folder, "nullify").groupBy().agg(
        F.count("status").alias("detected"),
        F.count_if(F.col("status") == "converted").alias("converted"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
    )
    return status


@query
def date_extended(spark, folder):
    """The free-text reading, one spelling after the other."""
    spelled = view(spark, folder, "spelled_dates").select("o_orderkey", "spelled")
    return columns.standardize_dates(spelled, {"spelled": "nullify"})


@query
def date_timestamp(spark, folder):
    """The same spellings as points in time."""
    spelled = view(spark, folder, "spelled_dates").select("o_orderkey", "spelled")
    return columns.standardize_dates(spelled, {"spelled": "nullify"}, as_type="timestamp")


@query
def date_strict(spark, folder):
    return _orders(spark, folder).select(
        "o_orderkey", dates.is_strict_date(text.strip(F.col("order_date"))).alias("strict")
    )


@query
def email_audit(spark, folder):
    return report.email_audit(_customer(spark, folder), "email")


def _mailed(spark, folder, mode):
    frame = _customer(spark, folder).select("c_custkey", "email")
    return columns.clean_emails(frame, "email", mode, "status")


@query
def email_flag(spark, folder):
    return _mailed(spark, folder, "flag")


@query
def email_nullify(spark, folder):
    return _mailed(spark, folder, "nullify")


@query
def email_remove(spark, folder):
    return _mailed(spark, folder, "remove")


@query
def email_counts(spark, folder):
    status = F.col("status")
    return _mailed(spark, folder, "flag").agg(
        F.count(status).alias("found"),
        *[F.count_if(status == s).alias(s) for s in ("valid", "corrected", "invalid")],
    )


def _mentions(spark, folder, pattern, name):
    """Every match in every document, with its place."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    return table(spark, folder, "documents").select("doc_id", F.posexplode(found).alias("place", name))


_COMBINED = (
    "CASE c_custkey % 3 WHEN 0 THEN concat('Jose\u0301', c_custkey, '@Mu\u0308nchen.de') "
    "WHEN 1 THEN concat('Jos\u00e9', c_custkey, '@m\u00fcnchen.de') ELSE 'a\u0323\u0307@x' END"
)


@query
def document_emails(spark, folder):
    return columns.clean_emails(_mentions(spark, folder, EMAIL_IN_TEXT, "email"), "email", "nullify", "status")


@query
def phone_e164(spark, folder):
    frame = _customer(spark, folder).select("c_custkey", "phone")
    return columns.clean_phones(frame, "phone", "status")


@query
def phone_plan_table(spark, folder):
    """As ``phone_e164``, with the plans looked up in a table by their longest calling code."""
    plans = spark.createDataFrame([vars(p) for p in rules.PHONE_RULES])
    return columns.clean_phones(_customer(spark, folder).select("c_custkey", "phone"), "phone", "status", plans=plans)


@query
def phone_foreign_table(spark, folder):
    """As ``phone_foreign``, with a table of plans."""
    plans = spark.createDataFrame([vars(p) for p in rules.PHONE_RULES])
    return columns.clean_phones(view(spark, folder, "foreign_phones"), "phone", "status", plans=plans)


@query
def email_composed(spark, folder):
    """Addresses spelt with combining marks and with single characters."""
    spelt = table(spark, folder, "customer").selectExpr("c_custkey", _COMBINED + " AS email")
    return columns.clean_emails(spelt, "email", "nullify", "status")


@query
def phone_keep_invalid(spark, folder):
    frame = _customer(spark, folder).select("c_custkey", "phone")
    return columns.clean_phones(frame, "phone", "status", keep_invalid=True)


@query
def document_phones(spark, folder):
    return columns.clean_phones(_mentions(spark, folder, PHONE_IN_TEXT, "phone"), "phone", "status")


@query
def phone_foreign(spark, folder):
    return columns.clean_phones(view(spark, folder, "foreign_phones"), "phone", "status")


@query
def age_rule(spark, folder):
    frame = _customer(spark, folder).select("c_custkey", "age")
    return columns.clean_ages(frame, ["age"], {"age": "emptied"})


@query
def title_case(spark, folder):
    return columns.standardize_text(
        _customer(spark, folder).select("c_custkey", "name", "segment", "email"),
        {"name": "name", "segment": "text", "email": "email"},
    )


@query
def dropped_columns(spark, folder):
    return columns.drop_columns(_customer(spark, folder), ["city", "phone", "email", "no_such_column"])


# --- semantic types ------------------------------------------------------------------------------


def _rates(spark, folder):
    orders = semantics.semantic_rates(_orders(spark, folder), ["order_date", "revenue", "active", "priority"])
    customer = semantics.semantic_rates(_customer(spark, folder), ["email", "phone"])
    return orders.unionByName(customer)


@query
def semantic_rates(spark, folder):
    return _rates(spark, folder).select(
        "column", "sampled", "decided",
        *[F.round(f"{r}_rate", 6).alias(f"{r}_rate")
          for r in ("boolean", "email", "date_hint", "date", "number", "symbol", "phone")],
    )


@query
def semantic_types(spark, folder):
    found = {}
    for name in ("dirty_customer", "dirty_orders", "hidden_types"):
        found |= semantics.detect_semantics(view(spark, folder, name))
    return spark.createDataFrame(list(found.items()), "column string, semantic string")


# --- fuzzy matching ------------------------------------------------------------------------------


def _pairs(spark, folder, method):
    names = view(spark, folder, "part_names")
    pairs = fuzzy.similar_pairs(names, "part_name", "p_partkey", method)
    return pairs.select(
        F.least("form_a", "form_b").alias("form_a"), F.greatest("form_a", "form_b").alias("form_b"), "score"
    )


@query
def fuzzy_pairs(spark, folder):
    return _pairs(spark, folder, "indel")


@query
def fuzzy_pairs_lev(spark, folder):
    return _pairs(spark, folder, "levenshtein")


@query
def fuzzy_pair_total(spark, folder):
    total = fuzzy.fuzzy_pair_count(
        view(spark, folder, "part_names"), "part_name", "p_partkey", "levenshtein"
    )
    return spark.createDataFrame([(total,)], "fuzzy_duplicate_count long")


@query
def fuzzy_dedup(spark, folder):
    return fuzzy.fuzzy_dedup(view(spark, folder, "part_names"), "part_name", "p_partkey")


@query
def fuzzy_dedup_lev(spark, folder):
    return fuzzy.fuzzy_dedup(view(spark, folder, "part_names"), "part_name", "p_partkey", "levenshtein")


@query
def nearest_dictionary_lev(spark, folder):
    nearest = dictionary.nearest_names(_customer(spark, folder), "city", method="levenshtein")
    return nearest.select("value", "match", "score")


@query
def nearest_dictionary(spark, folder):
    nearest = dictionary.nearest_names(_customer(spark, folder), "city")
    return nearest.select("value", "match", F.round("score", 4).alias("score"))


@query
def city_normalize(spark, folder):
    frame = _customer(spark, folder).select("c_custkey", "city")
    return dictionary.correct_names(frame, "city", Staging(spark), changed_flag="changed")


@query
def city_normalize_lev(spark, folder):
    frame = _customer(spark, folder).select("c_custkey", "city")
    return dictionary.correct_names(
        frame, "city", Staging(spark), method="levenshtein", changed_flag="changed"
    )


# --- scores, verification, reports, whole runs ---------------------------------------------------


@query
def quality_score(spark, folder):
    audit = diagnose(_customer(spark, folder), fuzzy=False).audit_frame()
    return scoring.score_frame(audit).select(
        "rows", "null_density", "duplicate_count", "outlier_count", "total_email_issues", "quality_score"
    )


@query
def quality_improvement(spark, folder):
    """Scores before and after rows without an address or a balance leave, and the improvement in per cent."""
    customers = _customer(spark, folder)
    before, after = (diagnose(df, fuzzy=False).quality_score for df in (customers, customers.where("email IS NOT NULL AND balance IS NOT NULL")))
    return spark.createDataFrame(
        [(before, after, scoring.improvement_percent(before, after))], "quality_before long, quality_after long, improvement_pct double")


@query
def age_warning(spark, folder):
    """Status of a numeric age column in the column report."""
    ages = _customer(spark, folder).select("c_custkey", F.expr("try_cast(age AS double)").alias("age"))
    report = diagnose(ages.where("age IS NULL OR age < 200"), fuzzy=False).columns()
    return report.where("column = 'age'").select("column", "semantic", "status")


@query
def email_examples(spark, folder):
    """The first invalid addresses that the column report shows."""
    report = diagnose(view(spark, folder, "dirty_customer", in_order=True).withColumnRenamed("c_custkey", ROW_ID), fuzzy=False).columns()
    found = report.where("column = 'email'").select("column", F.posexplode("invalid_email_examples").alias("nth", "example"))
    return found.withColumn("nth", F.col("nth") + 1)


@query
def health_score(spark, folder):
    audit = diagnose(_customer(spark, folder).drop("c_custkey"), fuzzy_method="levenshtein").audit_frame()
    return scoring.score_frame(audit).select("fuzzy_duplicate_count", "fuzzy_key_col", "health_score")


_STEERING = {"email": "email", "phone": "phone", "city": "city", "age": "integer"}


def _cleaned_customer(spark, folder):
    frame = columns.clean_emails(_customer(spark, folder), "email", "nullify")
    frame = columns.clean_ages(columns.clean_phones(frame, "phone"), ["age"])
    return frame.select("c_custkey", "email", "phone", "age", "balance")


@query
def post_clean_verify(spark, folder):
    checked = verify.post_clean_verify(_cleaned_customer(spark, folder), _STEERING)
    return checked.frame(spark)


@query
def pre_clean_verify(spark, folder):
    orders = _orders(spark, folder).select("o_orderkey", "order_date", "priority")
    return verify.post_clean_verify(orders, {"order_date": "date"}).frame(spark)


@query
def remaining_contacts(spark, folder):
    return _cleaned_customer(spark, folder).agg(
        F.count("email").alias("emails_remaining"), F.count("phone").alias("phones_remaining")
    )


@query
def diagnose_columns(spark, folder):
    found = diagnose(_events(spark, folder).drop("props"), fuzzy=False)
    return found.columns().select(
        "column", "semantic", "label", "null_count", "sparsity", "unique_count", "skewness", "mean",
        "median", "min", "max", "std", "mode", "status", "recommended",
    )


@query
def audit_report(spark, folder):
    """The audit of a table with its near-duplicate count."""
    names = view(spark, folder, "part_names")
    return diagnose(names).audit_frame().select(
        "rows", "null_count", "duplicate_count", "fuzzy_key_col", "fuzzy_duplicate_count", "outlier_count"
    )


@query
def report_json(spark, folder):
    """The column report as JSON, read again."""
    staging = Staging(spark)
    found = diagnose_columns(spark, folder)
    write_json(found, f"{staging.folder}/report")
    return spark.read.schema(found.schema).json(f"{staging.folder}/report")


@query
def csv_optimize(spark, folder):
    """Delimited text in, cleaned, delimited text out, read again."""
    staging = Staging(spark)
    write_csv(view(spark, folder, "dirty_orders", in_order=True), f"{staging.folder}/orders.csv")
    rows = read_csv(spark, f"{staging.folder}/orders.csv")
    result = optimize(rows, {"active": "Skip", "revenue": "Mean"}, fuzzy_dedup=False, fuzzy_audit=False)
    write_csv(result.df, f"{staging.folder}/{output_name('orders.csv')}")
    result.discard()
    back = read_csv(spark, f"{staging.folder}/{output_name('orders.csv')}", row_id=False)
    return back.withColumn("revenue", F.round("revenue", 4))


@query
def csv_records(spark, folder):
    """Documents written as delimited text, line breaks and quotes included, and put together from lines in parallel."""
    staging = Staging(spark)
    target = f"{staging.folder}/documents.csv"
    texts = table(spark, folder, "documents").select("doc_id", "text", "lang")
    plain = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    texts.write.options(**plain).csv(target)
    rows = read_csv(spark, target, infer=False, row_id=False, staging=staging)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"), "lang")


def _optimized_orders(spark, folder, **more):
    rows = view(spark, folder, "dirty_orders", in_order=True)
    return optimize(rows, {"active": "Skip", "revenue": "Mean"} | more, fuzzy_dedup=False, fuzzy_audit=False)


@query
def optimize_orders(spark, folder):
    """Types, deduplication, dates, missing values, text, outliers and the last deduplication."""
    return _optimized_orders(spark, folder).df.withColumn("revenue", F.round("revenue", 4))


@query
def optimize_orders_metrics(spark, folder):
    return _optimized_orders(spark, folder).metrics_frame()


@query
def optimize_orders_replaced(spark, folder):
    return _optimized_orders(spark, folder, outlier_revenue="median_replace").df.withColumn("revenue", F.round("revenue", 4))


@query
def optimize_orders_replaced_metrics(spark, folder):
    return _optimized_orders(spark, folder, outlier_revenue="median_replace").metrics_frame()


@query
def optimize_orders_removed(spark, folder):
    return _optimized_orders(spark, folder, outlier_revenue="remove_row").df.withColumn("revenue", F.round("revenue", 4))


@query
def optimize_orders_removed_metrics(spark, folder):
    return _optimized_orders(spark, folder, outlier_revenue="remove_row").metrics_frame()


def _optimized_customer(spark, folder, mode):
    """All steps on all column types, by the scores that SQL knows too."""
    return optimize(
        view(spark, folder, "dirty_customer", in_order=True), {"email_mode_email": mode}, order_by="c_custkey",
        fuzzy_method="levenshtein", city_method="levenshtein",
    )


@query
def optimize_customer(spark, folder):
    """All steps on all column types, fuzzy deduplication included."""
    cleaned = _optimized_customer(spark, folder, "nullify").df
    return cleaned.withColumns({"age": F.round("age", 4), "balance": F.round("balance", 4)})


@query
def optimize_customer_report(spark, folder):
    return _optimized_customer(spark, folder, "remove").summary()[0]


@query
def optimize_customer_metrics(spark, folder):
    return _optimized_customer(spark, folder, "remove").metrics_frame()


@query
def optimize_customer_columns(spark, folder):
    result = optimize(
        _customer(spark, folder), {"city": "Drop", "balance": "Median", "outlier_balance": "remove_row"},
        order_by="c_custkey", fuzzy_dedup=False, fuzzy_audit=False,
    )
    return result.summary()[1]
