"""The queries again as DuckDB SQL, written independently of the Spark expressions."""

from __future__ import annotations

from rinsework.functions.rules import CITIES
from rinsework.operators.report import METRICS

from .dirty import EMAIL_IN_TEXT, PHONE_IN_TEXT, with_views

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str, *views: str) -> None:
    ORACLES[name] = with_views(sql, *views) if views else sql


# --- sources -------------------------------------------------------------------------------------

oracle(
    "inferred_types",
    "SELECT c_custkey, cast(age AS double) AS age, balance, nullif(email, '') AS email, "
    "'c_custkey:bigint,age:double,balance:double,email:string' AS types FROM dirty_customer",
    "dirty_customer",
)
oracle("preview_rows", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10")

# --- profile -------------------------------------------------------------------------------------

_LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
}
oracle(
    "base_stats",
    "SELECT count(*) AS rows, cast(11 AS bigint) AS cols, 'l_orderkey,l_partkey,l_suppkey,l_linenumber,"
    "l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate' AS columns FROM lineitem",
)


def _profile(column: str, numeric: bool) -> str:
    x = f"cast({column} AS double)"
    stats = (
        f"round(avg({x}), 4) AS mean, round(quantile_cont({x}, 0.5), 4) AS median, round(min({x}), 4) AS min, "
        f"round(max({x}), 4) AS max, round(stddev_samp({x}), 4) AS std"
        if numeric
        else "cast(NULL AS double) AS mean, cast(NULL AS double) AS median, cast(NULL AS double) AS min, "
        "cast(NULL AS double) AS max, cast(NULL AS double) AS std"
    )
    return (
        f"SELECT '{column}' AS \"column\", count(*) - count({column}) AS null_count, "
        f"round((count(*) - count({column})) * 100.0 / count(*), 2) AS sparsity, "
        f"count(DISTINCT {column}) AS unique_count, {stats} FROM dirty_events"
    )


_EVENT_COLUMNS = {"event_id": True, "user_id": True, "event_type": False, "value": True, "props": False}
oracle(
    "column_profile",
    " UNION ALL ".join(_profile(c, n) for c, n in _EVENT_COLUMNS.items()),
    "dirty_events",
)


def _skewness(column: str, source: str) -> str:
    return (
        f"(SELECT avg(pow(x - m, 3)) / pow(any_value(s), 3) FROM (SELECT cast({column} AS double) AS x, "
        f"avg({column}) OVER () AS m, stddev_pop({column}) OVER () AS s FROM {source}) WHERE x IS NOT NULL)"
    )


oracle(
    "skewness_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(sk, 2) AS skewness, "
        "CASE WHEN abs(round(sk, 2)) > 1 THEN 'Median' ELSE 'Mean' END AS recommended "
        f"FROM (SELECT {_skewness(c, 'lineitem')} AS sk)"
        for c in _LINEITEM
    ),
)


def _mode(column: str, source: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", (SELECT count(DISTINCT {column}) FROM {source}) AS unique_count, "
        f"(SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY 1 "
        "ORDER BY count(*) DESC, 1 LIMIT 1) AS mode"
    )


oracle(
    "mode_profile",
    " UNION ALL ".join(
        _mode(c, t)
        for t, cs in (("customer", ("c_name", "c_mktsegment")), ("part", ("p_name", "p_brand", "p_type")))
        for c in cs
    ),
)
oracle(
    "exact_quantile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", cast({p} AS double) AS probability, "
        f"round(quantile_cont({c}, {p}), 4) AS quantile FROM lineitem"
        for c, ps in (("l_extendedprice", (0.01, 0.25, 0.5, 0.75, 0.99)), ("l_quantity", (0.1, 0.9)))
        for p in ps
    ),
)
_CUSTOMER_COLUMNS = ("c_custkey", "name", "email", "phone", "age", "city", "balance", "segment")
_NULLS = " + ".join(f"count(*) - count({c})" for c in _CUSTOMER_COLUMNS)
oracle(
    "null_density",
    f"SELECT cast({_NULLS} AS bigint) AS null_count, "
    f"round(({_NULLS}) * 100.0 / (count(*) * 8), 2) AS null_density FROM dirty_customer",
    "dirty_customer",
)
oracle(
    "blank_cells",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, "
        f"count(*) FILTER ({c} IS NULL OR trim({c}) = '') AS blanks, "
        f"count(*) FILTER (trim({c}) <> '') AS filled FROM dirty_customer"
        for c in ("name", "email", "phone", "city")
    ),
    "dirty_customer",
)
oracle(
    "duplicate_audit",
    "SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) "
    "AS duplicate_count FROM dirty_orders",
    "dirty_orders",
)
oracle("exact_dedup", "SELECT DISTINCT * FROM dirty_orders", "dirty_orders")
ORACLES["exact_dedup_fingerprint"] = ORACLES["exact_dedup"]
ORACLES["duplicate_audit_fingerprint"] = ORACLES["duplicate_audit"]


def _heavy(column: str, shown: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", {shown} AS mode, n FROM (SELECT {column}, count(*) AS n FROM lineitem "
        f"WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1)"
    )


oracle("mode_heavy", " UNION ALL ".join(
    f"SELECT * FROM ({_heavy(c, f'CAST({c} AS VARCHAR)')})"
    for c in ("l_partkey", "l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag")))


def _merged(column: str, number: bool) -> str:
    x = f"CAST({column} AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
    return (
        f"SELECT '{column}' AS \"column\", count(*) AS rows, count(*) - count({column}) AS nulls, min({x}) AS low, max({x}) AS high, "
        f"round(avg({x}), 4) AS mean, round(stddev_samp({x}), 4) AS std, true AS distinct_near, "
        f"{'true' if number else 'CAST(NULL AS BOOLEAN)'} AS median_near FROM lineitem"
    )


oracle("profile_merged", " UNION ALL ".join(
    _merged(c, c != "l_returnflag") for c in ("l_orderkey", "l_extendedprice", "l_discount", "l_returnflag")))

# --- outliers ------------------------------------------------------------------------------------


def _bounds(column: str, source: str) -> str:
    return (
        "SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high, med FROM (SELECT "
        f"quantile_cont(cast({column} AS double), 0.25) AS q1, quantile_cont(cast({column} AS double), 0.5) AS med, "
        f"quantile_cont(cast({column} AS double), 0.75) AS q3 FROM {source})"
    )


def _outlier_row(column: str, source: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", round(low, 6) AS low, round(high, 6) AS high, "
        f"(SELECT count(*) FROM {source} WHERE {column} < low OR {column} > high) AS outliers "
        f"FROM ({_bounds(column, source)})"
    )


oracle(
    "iqr_outlier_audit",
    " UNION ALL ".join(
        [_outlier_row(c, "lineitem") for c in _LINEITEM]
        + [_outlier_row(c, "dirty_events") for c in ("event_id", "user_id", "value")]
    ),
    "dirty_events",
)
_EVENT_BOUNDS = f"({_bounds('value', 'dirty_events')}) b"
oracle(
    "outlier_clip",
    "SELECT event_id, round(CASE WHEN value < low THEN low WHEN value > high THEN high ELSE value END, 4) AS value "
    f"FROM dirty_events, {_EVENT_BOUNDS}",
    "dirty_events",
)
oracle(
    "outlier_median",
    "SELECT event_id, round(CASE WHEN value < low OR value > high THEN med ELSE value END, 4) AS value "
    f"FROM dirty_events, {_EVENT_BOUNDS}",
    "dirty_events",
)
oracle(
    "outlier_remove",
    f"SELECT event_id, round(value, 4) AS value FROM dirty_events, {_EVENT_BOUNDS} "
    "WHERE value IS NULL OR NOT (value < low OR value > high)",
    "dirty_events",
)

# --- missing values ------------------------------------------------------------------------------


def _fill(fill: str, column: str = "value") -> str:
    return f"SELECT event_id, coalesce({column}, {fill}) AS {column} FROM dirty_events"


_MEDIAN = "(SELECT round(quantile_cont(value, 0.5), 4) FROM dirty_events)"
oracle("impute_mean", _fill("(SELECT round(avg(value), 4) FROM dirty_events)"), "dirty_events")
oracle("impute_median", _fill(_MEDIAN), "dirty_events")
oracle(
    "impute_auto",
    _fill(
        f"(SELECT CASE WHEN abs(round({_skewness('value', 'dirty_events')}, 2)) > 1 THEN {_MEDIAN} "
        "ELSE (SELECT round(avg(value), 4) FROM dirty_events) END)"
    ),
    "dirty_events",
)
oracle(
    "impute_mode",
    _fill(
        "(SELECT event_type FROM dirty_events WHERE event_type IS NOT NULL GROUP BY 1 "
        "ORDER BY count(*) DESC, 1 LIMIT 1)",
        "event_type",
    ),
    "dirty_events",
)
oracle("impute_custom", _fill("99.0"), "dirty_events")
oracle("impute_skip", "SELECT event_id, value FROM dirty_events", "dirty_events")

# --- cell cleaners -------------------------------------------------------------------------------

_BARE = "regexp_replace(revenue, '[₹$€£¥,\\s]', '', 'g')"
_REVENUE = f"CASE WHEN regexp_full_match({_BARE}, '[+-]?[0-9]+([.][0-9]+)?') THEN cast({_BARE} AS double) END"
_ACTIVE = (
    "CASE WHEN lower(trim(active)) IN ('true', 'yes', 't', 'y', '1') THEN true "
    "WHEN lower(trim(active)) IN ('false', 'no', 'f', 'n', '0') THEN false END"
)
oracle("numeric_string_clean", f"SELECT o_orderkey, {_REVENUE} AS revenue FROM dirty_orders", "dirty_orders")
oracle("boolean_clean", f"SELECT o_orderkey, {_ACTIVE} AS active FROM dirty_orders", "dirty_orders")
oracle(
    "type_gates",
    f"SELECT o_orderkey, {_REVENUE} AS revenue, {_ACTIVE} AS active, priority, "
    "(SELECT CASE WHEN count(r) * 2 >= count(*) THEN 'revenue:double' END || "
    "CASE WHEN count(a) >= 0.8 * count(*) THEN ',active:boolean' END "
    f"FROM (SELECT {_REVENUE} AS r, {_ACTIVE} AS a FROM dirty_orders)) AS converted FROM dirty_orders",
    "dirty_orders",
)
_SCREEN = r"[0-9]{2,4}[/.-]([0-9]{1,2})[/.-]([0-9]{1,2})"


def _passes(c: str) -> str:
    return (
        f"(NOT regexp_full_match(trim({c}), '{_SCREEN}') OR ("
        f"cast(regexp_extract(trim({c}), '^{_SCREEN}$', 1) AS int) BETWEEN 1 AND 12 AND "
        f"cast(regexp_extract(trim({c}), '^{_SCREEN}$', 2) AS int) BETWEEN 1 AND 31))"
    )


oracle(
    "date_prescreen",
    "SELECT o_orderkey, order_date, CASE WHEN order_date IS NOT NULL THEN "
    f"CASE WHEN regexp_full_match(trim(order_date), '{_SCREEN}') THEN {_passes('order_date')} ELSE true END END "
    "AS passes FROM dirty_orders",
    "dirty_orders",
)

# --- fixed values: date formats in the order they are tried, each with the shape it needs ---------
_FORMATS = (
    ("%Y-%m-%d", "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"),
    ("%d-%m-%Y", "[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}"),
    ("%m-%d-%Y", "[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}"),
    ("%Y/%m/%d", "[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}"),
    ("%d/%m/%Y", "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"),
    ("%m/%d/%Y", "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"),
    ("%d.%m.%Y", "[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}"),
    ("%Y.%m.%d", "[0-9]{4}[.][0-9]{1,2}[.][0-9]{1,2}"),
    ("%d %b %Y", "[0-9]{1,2} [A-Za-z]{3} [0-9]{4}"),
    ("%d %B %Y", "[0-9]{1,2} [A-Za-z]+ [0-9]{4}"),
    ("%b %d %Y", "[A-Za-z]{3} [0-9]{1,2} [0-9]{4}"),
    ("%B %d %Y", "[A-Za-z]+ [0-9]{1,2} [0-9]{4}"),
    ("%d-%b-%Y", "[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}"),
    ("%b-%d-%Y", "[A-Za-z]{3}-[0-9]{1,2}-[0-9]{4}"),
    ("%d/%b/%Y", "[0-9]{1,2}/[A-Za-z]{3}/[0-9]{4}"),
    ("%m/%d/%y", "[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}"),
    ("%d/%m/%y", "[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}"),
    ("%y-%m-%d", "[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}"),
)


def _parsed(c: str) -> str:
    tries = ", ".join(
        f"CASE WHEN regexp_full_match(trim({c}), '{shape}') THEN try_strptime(trim({c}), '{fmt}') END"
        for fmt, shape in _FORMATS
    )
    return f"CASE WHEN {_passes(c)} THEN coalesce({tries}) END"


def _dated(bad: str) -> str:
    return (
        "SELECT o_orderkey, CASE WHEN order_date IS NULL OR trim(order_date) = '' THEN order_date "
        f"WHEN p IS NOT NULL THEN strftime(p, '%Y-%m-%d') ELSE {bad} END AS order_date, "
        "CASE WHEN order_date IS NULL OR trim(order_date) = '' THEN NULL "
        "WHEN p IS NOT NULL THEN 'converted' ELSE 'rejected' END AS status "
        f"FROM (SELECT o_orderkey, order_date, {_parsed('order_date')} AS p FROM dirty_orders)"
    )


oracle("date_standardize", _dated("trim(order_date)"), "dirty_orders")
oracle("date_nullify", _dated("NULL"), "dirty_orders")
oracle(
    "date_audit",
    "SELECT count(status) AS detected, count(*) FILTER (status = 'converted') AS converted, "
    f"count(*) FILTER (status = 'rejected') AS rejected FROM ({_dated('NULL')})",
    "dirty_orders",
)
oracle(
    "date_strict",
    "SELECT o_orderkey, coalesce(regexp_full_match(trim(order_date), '[0-9]{4}-[0-9]{2}-[0-9]{2}') "
    "AND try_strptime(trim(order_date), '%Y-%m-%d') IS NOT NULL, false) AS strict FROM dirty_orders",
    "dirty_orders",
)

_ATOM = "[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+"
_LABEL = "[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?"
_COMPACT = "regexp_replace(email, '\\s', '', 'g')"
_MAIL_OK = (
    f"(regexp_full_match({_COMPACT}, '{_ATOM}([.]{_ATOM})*@{_LABEL}([.]{_LABEL})*[.]([A-Za-z0-9-]*[A-Za-z])') "
    f"AND NOT regexp_matches(lower({_COMPACT}), '[@.](arpa|invalid|local|localhost|onion|test)$') "
    f"AND length(split_part({_COMPACT}, '@', 1)) <= 64 AND length({_COMPACT}) <= 254)"
)
_MAIL_NORMAL = (
    f"CASE WHEN {_MAIL_OK} THEN split_part({_COMPACT}, '@', 1) || '@' || lower(split_part({_COMPACT}, '@', 2)) END"
)
oracle(
    "email_audit",
    "SELECT count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok AND mal) AS malformed, "
    "count(*) FILTER (NOT ok AND NOT mal) AS suspicious, count(*) FILTER (NOT ok) AS invalid FROM ("
    f"SELECT {_MAIL_OK} AS ok, (instr({_COMPACT}, '@') = 0 OR starts_with({_COMPACT}, '@') "
    f"OR ends_with({_COMPACT}, '@')) AS mal FROM dirty_customer WHERE email IS NOT NULL)",
    "dirty_customer",
)


def _mailed(key: str, source: str) -> str:
    return (
        f"SELECT {key}, email, normal, CASE WHEN email IS NULL OR trim(email) = '' THEN NULL "
        "WHEN normal IS NULL THEN 'invalid' WHEN normal <> email THEN 'corrected' ELSE 'valid' END AS status "
        f"FROM (SELECT {key}, email, {_MAIL_NORMAL} AS normal FROM {source})"
    )


_KEPT_MAIL = "CASE WHEN status IN ('valid', 'corrected') THEN normal ELSE email END"
_NULLED_MAIL = "CASE WHEN status IS NULL THEN email ELSE normal END"
_CUSTOMER_MAIL = _mailed("c_custkey", "dirty_customer")
oracle(
    "email_flag", f"SELECT c_custkey, {_KEPT_MAIL} AS email, status FROM ({_CUSTOMER_MAIL})", "dirty_customer"
)
oracle(
    "email_nullify",
    f"SELECT c_custkey, {_NULLED_MAIL} AS email, status FROM ({_CUSTOMER_MAIL})",
    "dirty_customer",
)
oracle(
    "email_remove",
    f"SELECT c_custkey, {_KEPT_MAIL} AS email, status FROM ({_CUSTOMER_MAIL}) "
    "WHERE status IS NULL OR status <> 'invalid'",
    "dirty_customer",
)
oracle(
    "email_counts",
    "SELECT count(status) AS found, count(*) FILTER (status = 'valid') AS valid, "
    "count(*) FILTER (status = 'corrected') AS corrected, count(*) FILTER (status = 'invalid') AS invalid "
    f"FROM ({_CUSTOMER_MAIL})",
    "dirty_customer",
)


def _mentions(pattern: str, name: str) -> str:
    return (
        f"WITH found AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m FROM documents), mentions AS "
        f"(SELECT doc_id, cast(i - 1 AS int) AS place, m[i] AS {name} FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found)) "
    )


oracle(
    "document_emails",
    _mentions(EMAIL_IN_TEXT, "email")
    + f"SELECT doc_id, place, {_NULLED_MAIL} AS email, status FROM ({_mailed('doc_id, place', 'mentions')})",
)

# --- fixed values: the numbering plans, national numbers by calling code -------------------------
_PLANS = {
    "91": "[1-9][0-9]{9}", "1": "[2-9][0-9]{2}[2-9][0-9]{6}", "44": "[1-9][0-9]{8,9}",
    "61": "[1-478][0-9]{8}", "49": "[1-9][0-9]{5,10}", "33": "[1-9][0-9]{8}", "65": "[3689][0-9]{7}",
    "971": "[2-9][0-9]{7,8}", "81": "[1-9][0-9]{8,9}", "86": "1[3-9][0-9]{9}",
}
_ABROAD = " ".join(
    f"WHEN regexp_full_match(d, '[+]{cc}{national}') THEN d "
    f"WHEN '{cc}' <> '65' AND regexp_full_match(d, '[+]{cc}{'1' if cc == '1' else '0'}{national}') "
    f"THEN '+{cc}' || substr(d, {len(cc) + 3})"
    for cc, national in _PLANS.items()
)

# --- fixed values: assigned calling codes that have no plan above ---------------------------------
_ELSEWHERE = (
    "7|20|27|30|31|32|34|36|39|40|41|43|45|46|47|48|51|52|53|54|55|56|57|58|60|62|63|64|66|82|84|90|92|93|94|95|98|"
    "21[12368]|22[0-9]|23[0-9]|24[0-9]|25[0-8]|26[0-9]|29[01789]|35[0-9]|37[0-9]|38[01235679]|42[013]|50[0-9]|59[0-9]|"
    "67[02-9]|68[0-35-9]|69[0-2]|80[08]|85[02356]|87[08]|88[0-368]|96[0-8]|97[02-79]|99[2-68]"
)
_LISTED = f"(1|33|44|49|61|65|81|86|91|971|{_ELSEWHERE})"


def _phoned(key: str, source: str) -> str:
    digits = "regexp_replace(regexp_replace(phone, '[^0-9+]', '', 'g'), '^00', '+')"
    return (
        f"SELECT {key}, CASE WHEN phone IS NULL OR trim(phone) = '' OR unknown THEN phone ELSE e END AS phone, "
        "CASE WHEN phone IS NULL OR trim(phone) = '' THEN NULL WHEN unknown THEN 'unknown' WHEN e IS NULL THEN 'invalid' "
        "WHEN e <> trim(phone) THEN 'corrected' ELSE 'valid' END AS status, phone AS original FROM ("
        f"SELECT {key}, phone, regexp_full_match(d, '[+][1-9][0-9]{{7,14}}') AND NOT regexp_matches(d, '^[+]{_LISTED}') AS unknown, CASE {_ABROAD} "
        f"WHEN regexp_full_match(d, '[+]({_ELSEWHERE})[0-9]{{4,}}') AND length(d) <= 16 THEN d WHEN regexp_full_match(d, '0?[1-9][0-9]{{9}}') "
        "THEN '+91' || right(d, 10) WHEN regexp_full_match(d, '91[1-9][0-9]{9}') THEN '+' || d END AS e "
        f"FROM (SELECT {key}, phone, {digits} AS d FROM {source}))"
    )


_CUSTOMER_PHONE = _phoned("c_custkey", "dirty_customer")
oracle("phone_e164", f"SELECT c_custkey, phone, status FROM ({_CUSTOMER_PHONE})", "dirty_customer")
ORACLES["phone_plan_table"] = ORACLES["phone_e164"]
oracle(
    "email_composed",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN nfc_normalize(spelt) || c_custkey || '@münchen.de' END AS email, CASE c_custkey % 3 "
    "WHEN 0 THEN 'corrected' WHEN 1 THEN 'valid' ELSE 'invalid' END AS status FROM (SELECT c_custkey, 'Jose' || chr(769) AS spelt FROM customer)",
)
oracle(
    "phone_keep_invalid",
    "SELECT c_custkey, CASE WHEN status = 'invalid' THEN original ELSE phone END AS phone, status "
    f"FROM ({_CUSTOMER_PHONE})",
    "dirty_customer",
)
oracle(
    "document_phones",
    _mentions(PHONE_IN_TEXT, "phone") + f"SELECT doc_id, place, phone, status FROM ({_phoned('doc_id, place', 'mentions')})",
)
oracle("phone_foreign", f"SELECT c_custkey, phone, status FROM ({_phoned('c_custkey', 'foreign_phones')})", "foreign_phones")
oracle(
    "age_rule",
    "SELECT c_custkey, CASE WHEN age BETWEEN 0 AND 120 THEN age END AS age, "
    "coalesce(age < 0 OR age > 120, false) AS emptied FROM dirty_customer",
    "dirty_customer",
)


def _title(c: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(trim({c}), '[A-Za-z]+|[^A-Za-z]+'), "
        "lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '')"
    )


oracle(
    "title_case",
    f"SELECT c_custkey, CASE WHEN name IS NOT NULL THEN {_title('name')} END AS name, "
    f"{_title('segment')} AS segment, trim(email) AS email FROM dirty_customer",
    "dirty_customer",
)
oracle("dropped_columns", "SELECT c_custkey, name, age, balance, segment FROM dirty_customer", "dirty_customer")

# --- semantic types ------------------------------------------------------------------------------


def _rates(column: str, source: str) -> str:
    bare = "regexp_replace(v, '[₹$€£¥,\\s]', '', 'g')"

    words = "'true','yes','t','y','1','false','no','f','n','0'"
    hint = "[0-9]{2,4}[-/.][0-9]{1,2}|[A-Za-z]{3,9}\\s+[0-9]{1,2}|[0-9]{1,2}\\s+[A-Za-z]{3,9}"
    tests = {
        "boolean": f"lower(v) IN ({words})",
        "email": "contains(v, '@')",
        "date_hint": f"regexp_matches(v, '{hint}')",
        "date": f"({_parsed('v')}) IS NOT NULL",
        "number": f"regexp_full_match({bare}, '-?[0-9]+([.][0-9]+)?')",
        "symbol": "regexp_matches(v, '[₹$€£¥]')",
        "phone": "regexp_full_match(v, '[+() 0-9.-]{7,20}')",
    }
    rates = ", ".join(f"avg(CASE WHEN {t} THEN 1.0 ELSE 0.0 END) AS {name}_rate" for name, t in tests.items())
    return (
        f"SELECT '{column}' AS \"column\", count(*) AS sampled, {rates} "
        f"FROM (SELECT trim({column}) AS v FROM {source} WHERE {column} IS NOT NULL)"
    )


_ALL_RATES = " UNION ALL ".join(
    [_rates(c, "dirty_orders") for c in ("order_date", "revenue", "active", "priority")]
    + [_rates(c, "dirty_customer") for c in ("email", "phone")]
)
oracle(
    "semantic_rates",
    'SELECT "column", sampled, CASE WHEN boolean_rate = 1 THEN \'boolean\' WHEN email_rate > 0.5 THEN \'email\' '
    "WHEN date_hint_rate > 0.5 AND date_rate > 0.65 THEN 'date' "
    "WHEN number_rate > 0.7 AND symbol_rate > 0.3 THEN 'currency' WHEN number_rate > 0.7 THEN 'numeric_string' "
    "WHEN phone_rate > 0.6 THEN 'phone' END AS decided, round(boolean_rate, 6) AS boolean_rate, "
    "round(email_rate, 6) AS email_rate, round(date_hint_rate, 6) AS date_hint_rate, "
    "round(date_rate, 6) AS date_rate, round(number_rate, 6) AS number_rate, "
    f"round(symbol_rate, 6) AS symbol_rate, round(phone_rate, 6) AS phone_rate FROM ({_ALL_RATES})",
    "dirty_orders", "dirty_customer",
)

# --- fuzzy matching ------------------------------------------------------------------------------


def _form(c: str) -> str:
    return (
        f"array_to_string(list_sort(string_split(trim(regexp_replace(lower(trim({c})), '[^a-z0-9]+', ' ', 'g')), "
        "' ')), ' ')"
    )


_PART_FORMS = (
    f"SELECT {_form('part_name')} AS form, min(p_partkey) AS node FROM part_names "
    "WHERE length(trim(part_name)) >= 3 GROUP BY 1"
)


def _lev(a: str, b: str) -> str:
    return f"(100.0 * (length({a}) + length({b}) - levenshtein({a}, {b})) / (length({a}) + length({b})))"


_LEV_PAIRS = (
    f"SELECT a.form AS form_a, b.form AS form_b, cast(round_even({_lev('a.form', 'b.form')}, 0) AS int) AS score "
    "FROM forms a JOIN forms b ON a.form < b.form "
    f"WHERE {_lev('a.form', 'b.form')} > 84.5"
)
oracle("fuzzy_pairs_lev", f"SELECT * FROM (WITH forms AS ({_PART_FORMS}) {_LEV_PAIRS})", "part_names")

# longest common subsequence, one character of the left form per recursion step, all pairs at once
_INDEL_PAIRS = """
SELECT form_a, form_b, cast(round_even(200.0 * best / (length(form_a) + length(form_b)), 0) AS int) AS score
FROM (
  WITH RECURSIVE pairs AS MATERIALIZED (
    SELECT a.form AS form_a, b.form AS form_b, string_split(b.form, '') AS chars
    FROM forms a JOIN forms b ON a.form < b.form
    WHERE levenshtein(a.form, b.form) < 0.155 * (length(a.form) + length(b.form))
  ),
  steps AS (
    SELECT form_a, form_b, chars, 0 AS i, list_transform(range(0, length(form_b) + 1), lambda x: 0) AS line
    FROM pairs
    UNION ALL
    SELECT form_a, form_b, chars, i + 1, list_concat([0], list_transform(range(1, length(form_b) + 1),
      lambda j: list_max(list_transform(range(1, j + 1),
        lambda k: greatest(line[k + 1], line[k] + CASE WHEN chars[k] = substr(form_a, i + 1, 1) THEN 1 ELSE 0 END)))))
    FROM steps WHERE i < length(form_a)
  )
  SELECT form_a, form_b, line[-1] AS best FROM steps WHERE i = length(form_a)
)
WHERE 200.0 * best / (length(form_a) + length(form_b)) > 84.5
"""
oracle("fuzzy_pairs", f"SELECT * FROM (WITH forms AS ({_PART_FORMS}) {_INDEL_PAIRS})", "part_names")


def _pair_count(column: str, source: str, pairs: str) -> str:
    """Pairs of distinct raw values, differing ignoring case, whose forms are equal or a scored pair."""
    return (
        f"SELECT cast(count(*) AS bigint) AS fuzzy_duplicate_count FROM (WITH raws AS (SELECT DISTINCT {column} AS raw, "
        f"lower(trim({column})) AS low, {_form(column)} AS form FROM {source} "
        f"WHERE {column} IS NOT NULL AND length(trim({column})) >= 3), "
        f"forms AS (SELECT DISTINCT form FROM raws), scored AS ({pairs}) "
        "SELECT 1 FROM raws x JOIN raws y ON x.raw < y.raw AND x.low <> y.low AND x.form = y.form "
        "UNION ALL SELECT 1 FROM scored s JOIN raws x ON x.form = s.form_a JOIN raws y ON y.form = s.form_b)"
    )


oracle("fuzzy_pair_total", _pair_count("part_name", "part_names", _LEV_PAIRS), "part_names")


def _kept_nodes(forms: str, pairs: str) -> str:
    """Forms in order of first appearance; a form stays unless it pairs with a kept earlier one."""
    return f"""
  WITH RECURSIVE forms AS MATERIALIZED ({forms}),
  scored AS MATERIALIZED ({pairs}),
  ranked AS MATERIALIZED (SELECT form, node, row_number() OVER (ORDER BY node) AS i FROM forms),
  rivals AS MATERIALIZED (
    SELECT r.i, r.node, coalesce(list(DISTINCT o.i) FILTER (o.i < r.i), []) AS earlier
    FROM ranked r LEFT JOIN scored s ON r.form IN (s.form_a, s.form_b)
    LEFT JOIN ranked o ON o.form = CASE WHEN s.form_a = r.form THEN s.form_b ELSE s.form_a END
    GROUP BY r.i, r.node
  ),
  walk AS (
    SELECT cast(0 AS bigint) AS i, cast([] AS bigint[]) AS kept
    UNION ALL
    SELECT v.i, CASE WHEN list_has_any(w.kept, v.earlier) THEN w.kept ELSE list_append(w.kept, v.i) END
    FROM walk w JOIN rivals v ON v.i = w.i + 1
  )
  SELECT r.node FROM ranked r JOIN (SELECT unnest(kept) AS i FROM walk WHERE i = (SELECT max(i) FROM ranked)) k
    ON k.i = r.i
"""


def _greedy(pairs: str) -> str:
    return (
        "SELECT p.p_partkey, p.part_name, p.p_brand FROM part_names p WHERE length(trim(p.part_name)) < 3 UNION ALL "
        f"SELECT p.p_partkey, p.part_name, p.p_brand FROM part_names p JOIN ({_kept_nodes(_PART_FORMS, pairs)}) firsts "
        "ON firsts.node = p.p_partkey"
    )


oracle("fuzzy_dedup_lev", _greedy(_LEV_PAIRS), "part_names")
oracle("fuzzy_dedup", _greedy(_INDEL_PAIRS), "part_names")

_CITY_LIST = "[" + ", ".join(f"'{c}'" for c in CITIES) + "]"
_NEAREST = (
    "SELECT value, CASE WHEN score >= 80 THEN match END AS match, CASE WHEN score >= 80 THEN score END AS score FROM ("
    "SELECT value, match, score, row_number() OVER (PARTITION BY value ORDER BY score DESC, pos) AS rn FROM ("
    f"SELECT value, match, pos, cast(round_even({_lev('value', 'match')}, 0) AS int) AS score "
    "FROM (SELECT DISTINCT trim(city) AS value FROM dirty_customer WHERE city IS NOT NULL), "
    f"(SELECT unnest({_CITY_LIST}) AS match, unnest(range(1, {len(CITIES) + 1})) AS pos))) WHERE rn = 1"
)
oracle("nearest_dictionary_lev", _NEAREST, "dirty_customer")
oracle(
    "city_normalize_lev",
    "SELECT c_custkey, coalesce(n.match, trim(city)) AS city, coalesce(n.match <> trim(city), false) AS changed "
    f"FROM dirty_customer LEFT JOIN ({_NEAREST}) n ON n.value = trim(city)",
    "dirty_customer",
)

# the weighted score: every comparison of a value with a city as a row (weight, a, b), scored by bit vectors
_SPLIT = "list_filter(string_split({}, ' '), lambda w: w <> '')"


def _sorted_words(words: str) -> str:
    return f"array_to_string(list_sort({words}), ' ')"


def _stretches(a: str, b: str, weight: str, where: str) -> str:
    return f"""
  SELECT value, match, pos, {weight} AS weight, short AS a, substr(long, greatest(i, 0) + 1, i + length(short) - greatest(i, 0)) AS b
  FROM (SELECT *, CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END AS short, CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END AS long
        FROM met WHERE {where}) m, unnest(range(1 - length(short), length(long))) t(i)"""


_NEAREST_WEIGHTED = f"""
WITH met AS (
  SELECT *, spread_of <= 8 AS close, {_sorted_words('wv')} AS sv, {_sorted_words('wc')} AS sc, list_distinct(list_intersect(wv, wc)) AS shared,
    list_distinct(list_filter(wv, lambda w: NOT list_contains(wc, w))) AS only_v, list_distinct(list_filter(wc, lambda w: NOT list_contains(wv, w))) AS only_c
  FROM (
    SELECT value, match, pos, {_SPLIT.format('value')} AS wv, {_SPLIT.format('match')} AS wc,
      greatest(length(value), length(match)) / least(length(value), length(match)) AS spread_of
    FROM (SELECT DISTINCT trim(city) AS value FROM dirty_customer WHERE trim(city) <> ''),
      (SELECT unnest({_CITY_LIST}) AS match, unnest(range(1, {len(CITIES) + 1})) AS pos))),
sets AS (
  SELECT *, {_sorted_words('shared')} AS base, trim({_sorted_words('shared')} || ' ' || {_sorted_words('only_v')}) AS with_v,
    trim({_sorted_words('shared')} || ' ' || {_sorted_words('only_c')}) AS with_c, len(shared) > 0 AND (len(only_v) = 0 OR len(only_c) = 0) AS within
  FROM met WHERE spread_of < 1.5),
compared AS (
  SELECT value, match, pos, 1.0::DOUBLE AS weight, value AS a, match AS b FROM met
  UNION ALL SELECT value, match, pos, 0.95, '', '' FROM sets WHERE within
  UNION ALL SELECT value, match, pos, 0.95, sv, sc FROM sets WHERE NOT within
  UNION ALL SELECT value, match, pos, 0.95, with_v, with_c FROM sets WHERE NOT within
  UNION ALL SELECT value, match, pos, 0.95, base, with_v FROM sets WHERE NOT within AND len(shared) > 0
  UNION ALL SELECT value, match, pos, 0.95, base, with_c FROM sets WHERE NOT within AND len(shared) > 0
  UNION ALL SELECT value, match, pos, 0.95 * CASE WHEN close THEN 0.9 ELSE 0.6 END, '', '' FROM met WHERE spread_of >= 1.5 AND len(shared) > 0
  UNION ALL {_stretches('value', 'match', 'CASE WHEN close THEN 0.9 ELSE 0.6 END', 'spread_of >= 1.5')}
  UNION ALL {_stretches('sv', 'sc', '0.95 * CASE WHEN close THEN 0.9 ELSE 0.6 END', 'spread_of >= 1.5 AND len(shared) = 0')}),
masked AS (
  SELECT *, list_transform(CASE WHEN b = '' THEN [] ELSE string_split(b, '') END, lambda x: CAST(list_sum(list_transform(range(1, length(a) + 1),
    lambda i: CASE WHEN a[i] = x THEN 1::BIGINT << (i - 1) ELSE 0 END)) AS BIGINT)) AS masks, (1::BIGINT << length(a)) - 1 AS whole
  FROM (SELECT DISTINCT a, b FROM compared)),
ratios AS (
  SELECT a, b, CASE WHEN a = '' AND b = '' THEN 100.0 WHEN a = '' OR b = '' THEN 0.0 ELSE 200.0 * (length(a) - bit_count(
    list_reduce(masks, lambda v, m: ((v + (v & m)) | (v & xor(m, whole))) & whole, whole))) / (length(a) + length(b)) END AS ratio
  FROM masked),
scored AS (SELECT value, match, pos, max(weight * ratio) AS score FROM compared JOIN ratios USING (a, b) GROUP BY value, match, pos),
best AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY round(score, 9) DESC, pos) AS rn FROM scored)
SELECT value, CASE WHEN score >= 80 THEN match END AS match, CASE WHEN score >= 80 THEN round(score, 4) END AS score FROM best WHERE rn = 1
"""
oracle("nearest_dictionary", f"SELECT * FROM ({_NEAREST_WEIGHTED})", "dirty_customer")
oracle(
    "city_normalize",
    "SELECT c_custkey, coalesce(n.match, trim(city)) AS city, coalesce(n.match <> trim(city), false) AS changed "
    f"FROM dirty_customer LEFT JOIN ({_NEAREST_WEIGHTED}) n ON n.value = trim(city)",
    "dirty_customer",
)

# --- scores, verification, reports, whole runs ---------------------------------------------------


def _outliers(source: str, *columns: str) -> str:
    return " + ".join(
        f"(SELECT count(*) FROM {source}, ({_bounds(c, source)}) WHERE high > low AND ({c} < low OR {c} > high))"
        for c in columns
    )


_EMAIL_ISSUES = f"(SELECT count(*) FROM dirty_customer WHERE email IS NOT NULL AND NOT {_MAIL_OK})"
_CUSTOMER_AUDIT = (
    f"SELECT (SELECT count(*) FROM dirty_customer) AS rows, (SELECT round(({_NULLS}) * 100.0 / (count(*) * 8), 2) "
    "FROM dirty_customer) AS null_density, cast(0 AS bigint) AS duplicate_count, "
    f"cast({_outliers('dirty_customer', 'c_custkey', 'age', 'balance')} AS bigint) AS outlier_count, "
    f"{_EMAIL_ISSUES} AS total_email_issues"
)
_QUALITY = (
    "cast(greatest(0, trunc(100.0 - least(20, null_density * 1.5) - least(15, duplicate_count * 100.0 / rows) "
    "- 0 - least(10, total_email_issues * 30.0 / rows) - 0 - least(15, outlier_count * 5.0 / rows) - least(15, 2 * 4))) AS bigint)"
)
oracle("quality_score", f"SELECT *, {_QUALITY} AS quality_score FROM ({_CUSTOMER_AUDIT})", "dirty_customer")
_FULLER = "(SELECT * FROM dirty_customer WHERE email IS NOT NULL AND balance IS NOT NULL) fuller"
oracle(
    "quality_improvement",
    "SELECT quality_before, quality_after, round((quality_after - quality_before) / greatest(quality_before, 1) * 100, 1) AS improvement_pct "
    f"FROM (SELECT {_QUALITY} AS quality_before FROM ({_CUSTOMER_AUDIT})), "
    f"(SELECT {_QUALITY} AS quality_after FROM ({_CUSTOMER_AUDIT.replace('FROM dirty_customer', 'FROM ' + _FULLER)}))",
    "dirty_customer",
)
_AGES = "(SELECT try_cast(age AS double) AS age FROM dirty_customer WHERE try_cast(age AS double) IS NULL OR try_cast(age AS double) < 200)"
oracle(
    "age_warning",
    f"SELECT 'age' AS \"column\", 'float' AS semantic, CASE WHEN (count(*) - count(age)) * 100.0 / count(*) > 50 THEN 'Critical (High Sparsity)' "
    f"WHEN abs(round(skewness(age), 2)) > 1 THEN 'Warning (High Skew)' WHEN count(*) FILTER (age < 0 OR age > 120) > 0 "
    f"THEN 'Warning (' || count(*) FILTER (age < 0 OR age > 120) || ' out-of-range ages)' ELSE 'Clean' END AS status FROM {_AGES}",
    "dirty_customer",
)
oracle(
    "email_examples",
    "SELECT 'email' AS \"column\", cast(nth AS int) AS nth, example FROM (SELECT email AS example, row_number() OVER (ORDER BY c_custkey) AS nth "
    f"FROM dirty_customer WHERE email IS NOT NULL AND NOT {_MAIL_OK}) WHERE nth <= 3",
    "dirty_customer",
)
_NO_KEY = [c for c in _CUSTOMER_COLUMNS if c != "c_custkey"]
_NO_KEY_NULLS = " + ".join(f"count(*) - count({c})" for c in _NO_KEY)
oracle(
    "health_score",
    "SELECT fuzzy_duplicate_count, 'name' AS fuzzy_key_col, cast(greatest(0, trunc(100.0 - least(30, density * 2) "
    "- least(20, dups * 100.0 / n) - least(15, outs * 5.0 / n) - least(10, fuzzy_duplicate_count * 2) "
    "- least(10, issues * 20.0 / n))) AS bigint) AS health_score FROM (SELECT "
    f"({_pair_count('name', 'dirty_customer', _LEV_PAIRS)}) AS fuzzy_duplicate_count, "
    "(SELECT count(*) FROM dirty_customer) AS n, "
    f"(SELECT round(({_NO_KEY_NULLS}) * 100.0 / (count(*) * 7), 2) FROM dirty_customer) AS density, "
    f"(SELECT count(*) FROM dirty_customer) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(_NO_KEY)} "
    f"FROM dirty_customer)) AS dups, {_outliers('dirty_customer', 'age', 'balance')} AS outs, {_EMAIL_ISSUES} AS issues)",
    "dirty_customer",
)
_CLEANED = (
    f"SELECT c_custkey, {_NULLED_MAIL} AS email, p.phone, CASE WHEN c.age BETWEEN 0 AND 120 THEN c.age END AS age, "
    f"c.balance FROM ({_CUSTOMER_MAIL}) m JOIN (SELECT c_custkey, phone FROM ({_CUSTOMER_PHONE})) p USING (c_custkey) "
    "JOIN (SELECT c_custkey, age, balance FROM dirty_customer) c USING (c_custkey)"
)
_VERDICT = (
    "invalid_emails_remaining = 0 AND invalid_dates_remaining = 0 AND invalid_phones_remaining = 0 "
    "AND duplicates_remaining = 0"
)


def _verified(inner: str) -> str:
    return (
        f"SELECT *, {_VERDICT} AS all_clear, CASE WHEN {_VERDICT} THEN 'PASS' ELSE 'PASS WITH WARNINGS' END "
        f"AS export_status FROM ({inner})"
    )


_CLEANED_NULLS = " + ".join(f"count(*) - count({c})" for c in ("c_custkey", "email", "phone", "age", "balance"))
oracle(
    "post_clean_verify",
    _verified(
        f"WITH cleaned AS MATERIALIZED ({_CLEANED}) SELECT "
        "(SELECT count(*) FROM cleaned WHERE trim(email) = '') AS invalid_emails_remaining, "
        "cast(0 AS bigint) AS invalid_dates_remaining, "
        "(SELECT count(*) FROM cleaned WHERE trim(phone) = '') AS invalid_phones_remaining, "
        f"cast({_outliers('cleaned', 'c_custkey', 'age', 'balance')} AS bigint) AS outliers_remaining, "
        "(SELECT count(*) FROM cleaned) - (SELECT count(*) FROM (SELECT DISTINCT * FROM cleaned)) "
        f"AS duplicates_remaining, (SELECT cast({_CLEANED_NULLS} AS bigint) FROM cleaned) AS nulls_remaining"
    ),
    "dirty_customer",
)
oracle(
    "pre_clean_verify",
    _verified(
        "WITH t AS (SELECT o_orderkey, order_date, priority FROM dirty_orders) SELECT "
        "cast(0 AS bigint) AS invalid_emails_remaining, (SELECT count(*) FROM t WHERE order_date IS NOT NULL AND NOT "
        "(regexp_full_match(trim(order_date), '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND "
        "try_strptime(trim(order_date), '%Y-%m-%d') IS NOT NULL)) AS invalid_dates_remaining, "
        "cast(0 AS bigint) AS invalid_phones_remaining, "
        f"cast({_outliers('t', 'o_orderkey')} AS bigint) AS outliers_remaining, "
        "(SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicates_remaining, "
        "(SELECT count(*) FROM t WHERE order_date IS NULL) AS nulls_remaining"
    ),
    "dirty_orders",
)
oracle(
    "remaining_contacts",
    f"SELECT count(email) AS emails_remaining, count(phone) AS phones_remaining FROM ({_CLEANED})",
    "dirty_customer",
)


def _diagnosed(column: str, kind: str) -> str:
    n = f"(count(*) - count({column}))"
    sparsity = f"round({n} * 100.0 / count(*), 2)"
    head = (
        f"SELECT '{column}' AS \"column\", '{kind}' AS semantic, '{kind.capitalize()}' AS label, {n} AS null_count, "
        f"{sparsity} AS sparsity, count(DISTINCT {column}) AS unique_count, "
    )
    if kind == "text":
        nothing = ", ".join(f"cast(NULL AS double) AS {s}" for s in ("skewness", "mean", "median", "min", "max", "std"))
        mode = (
            f"(SELECT {column} FROM dirty_events WHERE {column} IS NOT NULL GROUP BY 1 "
            "ORDER BY count(*) DESC, 1 LIMIT 1)"
        )
        return head + f"{nothing}, {mode} AS mode, 'Clean' AS status, 'Mode' AS recommended FROM dirty_events"
    x = f"cast({column} AS double)"
    skew = f"round({_skewness(column, 'dirty_events')}, 2)"
    return head + (
        f"{skew} AS skewness, round(avg({x}), 4) AS mean, round(quantile_cont({x}, 0.5), 4) AS median, "
        f"round(min({x}), 4) AS min, round(max({x}), 4) AS max, round(stddev_samp({x}), 4) AS std, "
        f"cast(NULL AS varchar) AS mode, CASE WHEN abs({skew}) > 1 THEN 'Warning (High Skew)' ELSE 'Clean' END AS status, "
        f"CASE WHEN abs({skew}) > 1 THEN 'Median' ELSE 'Mean' END AS recommended FROM dirty_events"
    )


oracle(
    "diagnose_columns",
    " UNION ALL ".join(
        _diagnosed(c, k)
        for c, k in (("event_id", "integer"), ("user_id", "integer"), ("event_type", "text"), ("value", "float"))
    ),
    "dirty_events",
)
oracle(
    "audit_report",
    "SELECT (SELECT count(*) FROM part_names) AS rows, cast(0 AS bigint) AS null_count, "
    "cast(0 AS bigint) AS duplicate_count, 'part_name' AS fuzzy_key_col, "
    f"({_pair_count('part_name', 'part_names', _INDEL_PAIRS)}) AS fuzzy_duplicate_count, "
    f"cast({_outliers('part_names', 'p_partkey')} AS bigint) AS outlier_count",
    "part_names",
)

# the cleaning run on orders, step by step: types and deduplication, dates, mean fill, text, clipping,
# last deduplication
_RUN = f"""
WITH typed AS MATERIALIZED (
  SELECT DISTINCT o_orderkey, order_date, {_REVENUE} AS revenue, active, priority FROM dirty_orders
),
dated AS MATERIALIZED (
  SELECT o_orderkey, CASE WHEN order_date IS NULL OR trim(order_date) = '' THEN order_date
    ELSE strftime({_parsed('order_date')}, '%Y-%m-%d') END AS order_date, revenue, active, priority FROM typed
),
filled AS MATERIALIZED (
  SELECT o_orderkey, trim(order_date) AS order_date,
    coalesce(revenue, (SELECT round(avg(revenue), 4) FROM dated)) AS revenue,
    CASE WHEN active IS NOT NULL THEN {_title('active')} END AS active, {_title('priority')} AS priority FROM dated
),
clipped AS (
  SELECT o_orderkey, order_date,
    CASE WHEN revenue < low THEN low WHEN revenue > high THEN high ELSE revenue END AS revenue, active, priority
  FROM filled, ({_bounds('revenue', 'filled')})
)
SELECT DISTINCT o_orderkey, order_date, round(revenue, 4) AS revenue, active, priority FROM clipped
"""
oracle("optimize_orders", f"SELECT * FROM ({_RUN})", "dirty_orders")
# empty cells of delimited text are missing
oracle("csv_optimize", f"SELECT * REPLACE (nullif(order_date, '') AS order_date) FROM ({_RUN})", "dirty_orders")
ORACLES["report_json"] = ORACLES["diagnose_columns"]
_DATES = f"SELECT order_date IS NOT NULL AND trim(order_date) <> '' AS found, {_parsed('order_date')} AS p FROM typed"
_METRICS = {
    "rows_before": "(SELECT count(*) FROM dirty_orders)",
    "rows_after": f"(SELECT count(*) FROM ({_RUN}))",
    "nulls_filled": "(SELECT count(*) FROM dated WHERE revenue IS NULL)",
    "duplicates_dropped": f"(SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM ({_RUN}))",
    "types_converted": "1",
    "dates_detected": f"(SELECT count(*) FROM ({_DATES}) WHERE found)",
    "dates_standardized": f"(SELECT count(*) FROM ({_DATES}) WHERE found AND p IS NOT NULL)",
    "dates_rejected": f"(SELECT count(*) FROM ({_DATES}) WHERE found AND p IS NULL)",
    "outliers_clipped": _outliers("filled", "o_orderkey", "revenue"),
} | dict.fromkeys(
    (
        "fuzzy_duplicates_dropped", "emails_flagged", "emails_nullified", "emails_rows_removed", "phones_corrected",
        "phones_flagged_invalid", "cities_normalized", "outliers_replaced", "outlier_rows_removed", "ages_nullified",
        "emails_found", "emails_valid", "emails_invalid", "emails_corrected", "emails_removed", "emails_remaining",
        "phones_found", "phones_valid", "phones_invalid", "phones_remaining",
    ),
    "0",
)
oracle(
    "optimize_orders_metrics",
    "SELECT * FROM (" + _RUN[: _RUN.rindex("SELECT DISTINCT")]
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, cast({v} AS bigint) AS value" for m, v in _METRICS.items())
    + ")",
    "dirty_orders",
)

# the same run with outliers replaced by the median, or their rows removed
_MORE_RUNS = {
    "optimize_orders_replaced": "CASE WHEN revenue < low OR revenue > high THEN med ELSE revenue END AS revenue, active, priority "
                                f"FROM filled, ({_bounds('revenue', 'filled')})",
    "optimize_orders_removed": f"revenue, active, priority FROM filled, ({_bounds('revenue', 'filled')}) WHERE revenue BETWEEN low AND high",
}
_BEYOND = _outliers("filled", "revenue")
for _name, _last in _MORE_RUNS.items():
    _head = _RUN[: _RUN.index("clipped AS (")] + f"clipped AS (SELECT o_orderkey, order_date, {_last}) "
    _tail = "SELECT DISTINCT o_orderkey, order_date, round(revenue, 4) AS revenue, active, priority FROM clipped"
    oracle(_name, f"SELECT * FROM ({_head} {_tail})", "dirty_orders")
    _after = f"(SELECT count(*) FROM ({_tail}))"
    _treated = "outliers_replaced" if _name.endswith("replaced") else "outlier_rows_removed"
    _gone = "0" if _name.endswith("replaced") else _BEYOND
    _changed = _METRICS | {
        "rows_after": _after, _treated: _BEYOND, "outliers_clipped": _outliers("filled", "o_orderkey"),
        "duplicates_dropped": f"(SELECT count(*) FROM dirty_orders) - {_after} - ({_gone})",
    }
    oracle(
        f"{_name}_metrics",
        f"SELECT * FROM ({_head} " + " UNION ALL ".join(
            f"SELECT '{m}' AS metric, cast({v} AS bigint) AS value" for m, v in _changed.items()) + ")",
        "dirty_orders",
    )

# the cleaning run on customers: near-duplicate names, addresses, numbers, cities, ages, fills, text and clipping; with
# mode "remove", rows of invalid addresses leave after the counting
_NAME_FORMS = f"SELECT {_form('name')} AS form, min(c_custkey) AS node FROM dirty_customer WHERE length(trim(name)) >= 3 GROUP BY 1"


def _commonest(column: str) -> str:
    return f"(SELECT {column} FROM cells WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _typical(column: str) -> str:
    return (
        f"(SELECT round(CASE WHEN abs(round({_skewness(column, 'cells')}, 2)) > 1 THEN quantile_cont(cast({column} AS double), 0.5) "
        f"ELSE avg({column}) END, 4) FROM cells)"
    )


def _customer_run(mode: str) -> str:
    stays = "true" if mode == "nullify" else "mail IS DISTINCT FROM 'invalid'"
    clips = ", ".join(
        f"CASE WHEN {c} < {c}_b.low THEN {c}_b.low WHEN {c} > {c}_b.high THEN {c}_b.high ELSE {c} END AS {c}" for c in ("c_custkey", "age", "balance"))
    return f"""
kept AS MATERIALIZED (
  SELECT * FROM dirty_customer WHERE name IS NULL OR length(trim(name)) < 3
    OR c_custkey IN (SELECT node FROM ({_kept_nodes(_NAME_FORMS, _LEV_PAIRS)}))
),
judged AS MATERIALIZED (
  SELECT k.c_custkey, k.name, m.mail_text AS email, m.mail, p.phone, p.call, k.age AS old_age, CASE WHEN k.age BETWEEN 0 AND 120 THEN k.age END AS age,
    coalesce(n.match, trim(k.city)) AS city, coalesce(n.match <> trim(k.city), false) AS moved, k.balance, k.segment
  FROM kept k
  JOIN (SELECT c_custkey, status AS mail, {_NULLED_MAIL} AS mail_text FROM ({_mailed('c_custkey', 'kept')})) m USING (c_custkey)
  JOIN (SELECT c_custkey, phone, status AS call FROM ({_phoned('c_custkey', 'kept')})) p USING (c_custkey)
  LEFT JOIN ({_NEAREST}) n ON n.value = trim(k.city)
),
cells AS MATERIALIZED (SELECT * FROM judged WHERE {stays}),
filled AS MATERIALIZED (
  SELECT c_custkey, coalesce(name, {_commonest('name')}) AS name, email, phone, coalesce(cast(age AS double), {_typical('age')}) AS age,
    coalesce(city, {_commonest('city')}) AS city, coalesce(balance, {_typical('balance')}) AS balance, segment FROM cells
),
final AS MATERIALIZED (
  SELECT DISTINCT {_title('name')} AS name, trim(email) AS email, trim(phone) AS phone, {clips},
    {_title('city')} AS city, {_title('segment')} AS segment
  FROM filled, ({_bounds('c_custkey', 'filled')}) c_custkey_b, ({_bounds('age', 'filled')}) age_b, ({_bounds('balance', 'filled')}) balance_b
)"""


oracle(
    "optimize_customer",
    "SELECT * FROM (WITH " + _customer_run("nullify").lstrip() + " SELECT c_custkey, name, email, phone, round(age, 4) AS age, city, "
    "round(balance, 4) AS balance, segment FROM final)",
    "dirty_customer",
)
_REPORTED = {
    "rows_before": "SELECT count(*) FROM dirty_customer",
    "rows_after": "SELECT count(*) FROM final",
    "nulls_filled": "SELECT " + " + ".join(f"count(*) - count({c})" for c in ("name", "age", "city", "balance")) + " FROM cells",
    "duplicates_dropped": "SELECT 0",
    "fuzzy_duplicates_dropped": "SELECT (SELECT count(*) FROM dirty_customer) - (SELECT count(*) FROM kept)",
    "types_converted": "SELECT 0", "dates_detected": "SELECT 0", "dates_standardized": "SELECT 0", "dates_rejected": "SELECT 0",
    "emails_flagged": "SELECT 0",
    "emails_nullified": "SELECT 0",
    "emails_rows_removed": "SELECT count(*) FROM judged WHERE mail = 'invalid'",
    "phones_corrected": "SELECT count(*) FROM cells WHERE call = 'corrected'",
    "phones_flagged_invalid": "SELECT count(*) FROM cells WHERE call = 'invalid'",
    "cities_normalized": "SELECT count(*) FROM cells WHERE moved",
    "outliers_clipped": f"SELECT {_outliers('filled', 'c_custkey', 'age', 'balance')}",
    "outliers_replaced": "SELECT 0", "outlier_rows_removed": "SELECT 0",
}
_ALSO = {
    "ages_nullified": "SELECT count(*) FROM cells WHERE old_age IS NOT NULL AND age IS NULL",
    "emails_found": "SELECT count(mail) FROM judged",
    "emails_valid": "SELECT count(*) FROM judged WHERE mail = 'valid'",
    "emails_invalid": "SELECT count(*) FROM judged WHERE mail = 'invalid'",
    "emails_corrected": "SELECT count(*) FROM judged WHERE mail = 'corrected'",
    "emails_removed": "SELECT count(*) FROM judged WHERE mail = 'invalid'",
    "emails_remaining": "SELECT count(email) FROM final",
    "phones_found": "SELECT count(call) FROM cells",
    "phones_valid": "SELECT count(*) FROM cells WHERE call = 'valid'",
    "phones_invalid": "SELECT count(*) FROM cells WHERE call = 'invalid'",
    "phones_remaining": "SELECT count(phone) FROM final",
}
oracle(
    "optimize_customer_report",
    "SELECT * FROM (WITH " + _customer_run("remove").lstrip() + " " + " UNION ALL ".join(
        f"SELECT cast({i} AS int) AS seq, '{METRICS[m]}' AS metric, cast(({v}) AS varchar) AS value"
        for i, (m, v) in enumerate(_REPORTED.items(), 1)) + ")",
    "dirty_customer",
)
oracle(
    "optimize_customer_metrics",
    "SELECT * FROM (WITH " + _customer_run("remove").lstrip() + " " + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, cast(({v}) AS bigint) AS value" for m, v in (_REPORTED | _ALSO).items()) + ")",
    "dirty_customer",
)

# the run without cities and near-duplicates, outliers of the balance removed with their rows; what its summary says
_COLUMNS_RUN = f"""
kept AS MATERIALIZED (SELECT * FROM dirty_customer),
cells AS MATERIALIZED (
  SELECT k.c_custkey, k.name, m.mail_text AS email, p.phone, CASE WHEN k.age BETWEEN 0 AND 120 THEN k.age END AS age, k.balance, k.segment
  FROM kept k
  JOIN (SELECT c_custkey, {_KEPT_MAIL} AS mail_text FROM ({_mailed('c_custkey', 'kept')})) m USING (c_custkey)
  JOIN (SELECT c_custkey, phone FROM ({_phoned('c_custkey', 'kept')})) p USING (c_custkey)
),
filled AS MATERIALIZED (
  SELECT c_custkey, coalesce(name, {_commonest('name')}) AS name, email, phone, coalesce(cast(age AS double), {_typical('age')}) AS age,
    coalesce(balance, (SELECT round(quantile_cont(balance, 0.5), 4) FROM cells)) AS balance, segment FROM cells
),
final AS MATERIALIZED (
  SELECT DISTINCT c_custkey, {_title('name')} AS name, trim(email) AS email, trim(phone) AS phone, age, balance, {_title('segment')} AS segment
  FROM filled, ({_bounds('balance', 'filled')}) b WHERE balance BETWEEN b.low AND b.high
)"""


def _summed_up(column: str, label: str, numeric: bool) -> str:
    status = "'Clean'"
    if numeric:
        status = f"CASE WHEN abs(round({_skewness(column, 'final')}, 2)) > 1 THEN 'Warning (High Skew)' ELSE 'Clean' END"
    elif column == "email":
        bad = f"count(*) FILTER (email IS NOT NULL AND NOT {_MAIL_OK})"
        status = f"CASE WHEN {bad} > 0 THEN 'Warning (' || {bad} || ' invalid emails)' ELSE 'Clean' END"
    missing = f"count(*) - count({column})"
    return (
        f"SELECT '{column}' AS column_name, {label} AS semantic_type, ({missing}) || ' (' || "
        f"cast(round(({missing}) * 100.0 / count(*), 2) AS double) || '%)' AS nulls, {status} AS status FROM final"
    )


oracle(
    "optimize_customer_columns",
    "SELECT * FROM (WITH " + _COLUMNS_RUN.lstrip() + " " + " UNION ALL ".join(_summed_up(*c) for c in (
        ("c_custkey", "'Integer'", True), ("name", "'Name'", False), ("email", "'Email'", False), ("phone", "'Phone'", False),
        # whole ages stay whole if their fill is
        ("age", f"CASE WHEN {_typical('age')} % 1 = 0 THEN 'Integer' ELSE 'Float' END", True),
        ("balance", "'Float'", True), ("segment", "'Text'", False),
    )) + ")",
    "dirty_customer",
)

# the columns whose names settle nothing; exact names stand for the resemblance that the engine looks for
_UNSETTLED = (
    ("revenue", "dirty_orders"), ("active", "dirty_orders"), ("priority", "dirty_orders"), ("segment", "dirty_customer"),
    ("settled", "hidden_types"), ("early", "hidden_types"), ("seat", "hidden_types"), ("spot", "hidden_types"),
)
_BY_VALUE = " UNION ALL ".join(_rates(c, t) for c, t in _UNSETTLED)
_KNOWN_CITIES = ", ".join(f"'{c}'" for c in CITIES)
_TOWNS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg(CASE WHEN trim({c}) IN ({_KNOWN_CITIES}) THEN 1.0 ELSE 0.0 END) AS city_rate "
    f"FROM {t} WHERE {c} IS NOT NULL" for c, t in _UNSETTLED
)
_SETTLED = {
    "c_custkey": "integer", "name": "name", "email": "email", "phone": "phone", "age": "integer", "city": "city",
    "balance": "float", "o_orderkey": "integer", "order_date": "date",
}
oracle(
    "semantic_types",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS semantic" for c, t in _SETTLED.items())
    + " UNION ALL SELECT \"column\", CASE WHEN boolean_rate = 1 THEN 'boolean' WHEN email_rate > 0.5 THEN 'email' "
    "WHEN date_hint_rate > 0.5 AND date_rate > 0.65 THEN 'date' WHEN number_rate > 0.7 AND symbol_rate > 0.3 "
    "THEN 'currency' WHEN number_rate > 0.7 THEN 'numeric_string' WHEN phone_rate > 0.6 THEN 'phone' "
    "WHEN city_rate > 0.5 THEN 'city' ELSE 'text' END "
    f"AS semantic FROM ({_BY_VALUE}) JOIN ({_TOWNS}) USING (\"column\")",
    "dirty_orders", "dirty_customer", "hidden_types",
)
oracle(
    "impute_mode_numbers",
    "SELECT event_id, " + ", ".join(
        f"coalesce({c}, (SELECT {c} FROM tied_numbers WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS {c}"
        for c in ("user_id", "big", "tied")
    ) + " FROM tied_numbers",
    "tied_numbers",
)
_SPELLED_DAY = "CASE WHEN o_orderkey % 12 IN (7, 11) THEN date_trunc('month', o_orderdate) ELSE date_trunc('day', o_orderdate) END"
oracle("date_extended", f"SELECT o_orderkey, strftime({_SPELLED_DAY}, '%Y-%m-%d') AS spelled FROM orders")
oracle(
    "date_timestamp",
    f"SELECT o_orderkey, CAST({_SPELLED_DAY} AS TIMESTAMP) + to_seconds(CASE o_orderkey % 12 WHEN 3 THEN 51900 WHEN 8 THEN 83109 "
    "WHEN 9 THEN 48600 WHEN 10 THEN 900 - 7200 ELSE 0 END) AS spelled FROM orders",
)
ORACLES["phone_foreign_table"] = ORACLES["phone_foreign"]
oracle("csv_records", "SELECT doc_id, length(nullif(text, '')) AS n_chars, md5(nullif(text, '')) AS text_md5, nullif(lang, '') AS lang FROM documents")
