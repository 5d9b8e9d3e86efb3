"""Dirty views of the clean test tables, derived by arithmetic on their keys.

Every view is one SELECT in a dialect that both Spark and DuckDB read, so query and oracle start from the
same cells. All rows of the base table take part.
"""

from __future__ import annotations

import os
from math import ceil

from pyspark.sql import DataFrame, SparkSession


FIRST_NAMES = (
    "Rahul,Priya,Amit,Sunita,Vikram,Anita,Deepak,Kavita,Sanjay,Meera,Arjun,Pooja,Nikhil,Asha,Rohan,Divya,"
    "John,Mary,Peter,Susan,Michael,Laura,David,Emma,Robert,Grace,Thomas,Helen,Walter,Ingrid,Carlos,Lucia,"
    "Hiroshi,Yuki,Chen,Li,Ahmed,Fatima,Olga,Sven"
)
LAST_NAMES = (
    "Sharma,Verma,Gupta,Nair,Reddy,Iyer,Kapoor,Chatterjee,Deshpande,Bhattacharya,Smith,Johnson,Williams,"
    "Anderson,Thompson,Garcia,Martinez,Robinson,Clarke,Wright,Fernandez,Rodriguez,Kowalski,Novak,Schneider,"
    "Fischer,Weber,Lindqvist,Johansson,Nakamura,Yamamoto,Takahashi,Zhang,Wang,Okafor,Mensah,Haddad,Rahman,"
    "O'Brien,O'Connor,Van-Dyke,Saint-Clair,MacDonald,McCarthy,Papadopoulos,Ivanov,Petrova,Costa,Silva,Moreau"
).replace("'", "''")
CITY_SPELLINGS = (
    "Mumbai,Mumbia,mumbai,Punne,Pune,Delhi,Dehli,Bangalore,Bangalor,Chennai,Chenai,Kolkata,Hyderabd,"
    "New York,New Yrok,Los Angelos,Chicago,Londn,London,Paris,Berlin,Tokio,Sydny,Singapore,Springfield,XYZ"
)
MONTHS = "Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec"


def _pick(words: str, index: str) -> str:
    return f"split_part('{words}', ',', cast({index} as int) + 1)"


def _pad(number: str, width: int) -> str:
    return f"lpad(cast({number} as string), {width}, '0')"


_NAME = f"{_pick(FIRST_NAMES, 'c_custkey % 40')} || ' ' || {_pick(LAST_NAMES, 'floor(c_custkey / 3.0) % 50')}"

DIRTY_CUSTOMER = f"""
SELECT c_custkey,
  CASE WHEN c_custkey % 31 = 0 THEN NULL
       WHEN c_custkey % 9 = 0 THEN substr(full_name, 1, cast(2 + c_custkey % 5 as int))
            || substr(full_name, cast(4 + c_custkey % 5 as int))
       WHEN c_custkey % 7 = 0 THEN upper(full_name)
       WHEN c_custkey % 6 = 0 THEN '  ' || full_name || ' '
       WHEN c_custkey % 10 = 3 THEN lower(full_name)
       ELSE full_name END AS name,
  CASE WHEN c_custkey % 13 = 0 THEN NULL
       WHEN c_custkey % 11 = 0 THEN 'user' || cast(c_custkey as string) || '@'
       WHEN c_custkey % 7 = 0 THEN '@x.com'
       WHEN c_custkey % 17 = 0 THEN 'bob' || cast(c_custkey as string) || '@wilson'
       WHEN c_custkey % 19 = 0 THEN ''
       WHEN c_custkey % 23 = 0 THEN 'a..b' || cast(c_custkey as string) || '@mail.org'
       WHEN c_custkey % 5 = 0 THEN 'User ' || cast(c_custkey as string) || '@Mail.EXAMPLE.com'
       ELSE 'user' || cast(c_custkey as string) || '@mail.example.com' END AS email,
  CASE WHEN c_custkey % 29 = 0 THEN NULL
       WHEN c_custkey % 27 = 0 THEN ' '
       WHEN c_custkey % 3 = 0 THEN '+91 (987) 654-' || {_pad('c_custkey % 10000', 4)}
       WHEN c_custkey % 4 = 1 THEN cast(123 + c_custkey % 100 as string)
       WHEN c_custkey % 5 = 0 THEN '0' || cast(9100000000 + c_custkey as string)
       WHEN c_custkey % 7 = 0 THEN '+1-202-555-' || {_pad('c_custkey % 10000', 4)}
       WHEN c_custkey % 8 = 0 THEN '+44 (0)20 7946 ' || {_pad('c_custkey % 10000', 4)}
       WHEN c_custkey % 11 = 0 THEN '+91' || cast(9200000000 + c_custkey as string)
       ELSE cast(9300000000 + c_custkey as string) END AS phone,
  CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE cast(c_custkey % 150 - 5 as bigint) END AS age,
  CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE {_pick(CITY_SPELLINGS, 'c_custkey % 26')} END AS city,
  CASE WHEN c_custkey % 43 = 0 THEN NULL ELSE c_acctbal END AS balance,
  c_mktsegment AS segment
FROM (SELECT *, {_NAME} AS full_name FROM customer) named
"""

_Y, _M, _D = (f"cast({part}(o_orderdate) as string)" for part in ("year", "month", "day"))
_MM, _DD = _pad("month(o_orderdate)", 2), _pad("day(o_orderdate)", 2)
_MON = _pick(MONTHS, "month(o_orderdate) - 1")
_WHOLE = "cast(floor(o_totalprice) as bigint)"
_THOUSANDS = f"cast(cast(floor(o_totalprice / 1000.0) as bigint) as string) || ',' || {_pad(_WHOLE + ' % 1000', 3)}"

_DIRTY_ORDERS_ONCE = f"""
SELECT o_orderkey,
  CASE cast(o_orderkey % 14 as int)
       WHEN 0 THEN {_Y} || '-' || {_MM} || '-' || {_DD}
       WHEN 1 THEN {_DD} || '/' || {_MM} || '/' || {_Y}
       WHEN 2 THEN {_MM} || '-' || {_DD} || '-' || {_Y}
       WHEN 3 THEN {_Y} || '/' || {_M} || '/' || {_D}
       WHEN 4 THEN {_MON} || ' ' || {_D} || ' ' || {_Y}
       WHEN 5 THEN {_DD} || '-' || {_MON} || '-' || {_Y}
       WHEN 6 THEN {_DD} || '.' || {_MM} || '.' || {_Y}
       WHEN 7 THEN {_M} || '/' || {_D} || '/' || substr({_Y}, 3, 2)
       WHEN 8 THEN ' ' || {_D} || ' ' || {_MON} || ' ' || {_Y} || ' '
       WHEN 9 THEN 'not-a-date'
       WHEN 10 THEN {_Y} || '/13/' || {_DD}
       WHEN 11 THEN ''
       WHEN 12 THEN substr({_Y}, 3, 2) || '-' || {_MM} || '-' || {_DD}
       ELSE CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE {_Y} || '-02-30' END END AS order_date,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL
       WHEN o_orderkey % 19 = 0 THEN 'pending'
       WHEN o_orderkey % 23 = 0 THEN '12d'
       WHEN o_orderkey % 4 = 0 THEN '₹' || {_THOUSANDS}
       WHEN o_orderkey % 4 = 1 THEN '$ ' || {_THOUSANDS} || '.50'
       WHEN o_orderkey % 4 = 2 THEN cast({_WHOLE} as string)
       ELSE '€-' || cast({_WHOLE} % 1000 as string) || '.25' END AS revenue,
  CASE WHEN o_orderkey % 47 = 0 THEN NULL
       ELSE {_pick("yes,No,T,0,TRUE, n ,1,maybe", "o_orderkey % 8")} END AS active,
  o_orderpriority AS priority
FROM orders
"""

DIRTY_ORDERS = f"""
SELECT * FROM ({_DIRTY_ORDERS_ONCE}) once
UNION ALL
SELECT * FROM ({_DIRTY_ORDERS_ONCE}) again WHERE o_orderkey % 50 = 0
"""

DIRTY_EVENTS = """
SELECT event_id, user_id,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value,
  props
FROM events
"""

PART_NAMES = """
SELECT p_partkey,
  CASE WHEN p_partkey % 9 = 0 THEN substr(p_name, 1, cast(1 + p_partkey % 7 as int))
            || substr(p_name, cast(3 + p_partkey % 7 as int))
       WHEN p_partkey % 11 = 0 THEN upper(p_name)
       WHEN p_partkey % 13 = 0 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)
       WHEN p_partkey % 15 = 0 THEN p_name || 's'
       ELSE p_name END AS part_name,
  p_brand
FROM part
"""

# the addresses and numbers that documents mention
EMAIL_IN_TEXT = "[A-Za-z0-9._]+@[A-Za-z0-9.-]+"
PHONE_IN_TEXT = "[+][0-9][0-9 ()-]{7,17}[0-9]"

# text columns whose first hundred values say something else than all of them
HIDDEN_TYPES = """
SELECT o_orderkey,
  CASE WHEN o_orderkey % 5 = 0 THEN 'yes' WHEN o_orderkey % 5 = 1 THEN ' F ' WHEN o_orderkey % 5 = 2 THEN NULL ELSE '0' END AS settled,
  CASE WHEN o_orderkey < 400 THEN 'yes' ELSE 'note ' || cast(o_orderkey as string) END AS early,
  CASE WHEN o_orderkey < 400 THEN 'nowhere at all' WHEN o_orderkey % 7 = 0 THEN 'zzzzqq' WHEN o_orderkey % 2 = 0 THEN 'Mumbai'
    ELSE ' Los Angeles' END AS seat,
  CASE WHEN o_orderkey < 400 THEN 'Pune' ELSE 'qxqxqx' || cast(o_orderkey % 3 as string) END AS spot
FROM orders
"""

# numbers from many plans, a calling code that nobody has, and numbers too short or too long
FOREIGN_PHONES = """
SELECT c_custkey,
  split_part('+39 06 ,+55 11 9,+27 82 ,+34 91,+7 495 1,+31 20 ,+353 1 9,+46 8 1,+82 2 1,+90 212 ,+52 55 ,+48 22 ,+380 44 ,'
    || '+852 2,+966 11 ,0039 06 ,+999 12,+210 55,+34 1,+39 123 456 789 0123 ', ',', cast(c_custkey % 20 + 1 as int))
  || CASE WHEN c_custkey % 20 = 18 THEN '' ELSE lpad(cast(c_custkey % 1000000 as string), 7, '0') END AS phone
FROM customer
"""

# the spellings that the free-text reading adds
SPELLED_DATES = """
SELECT o_orderkey, o_orderdate,
  CASE cast(o_orderkey % 12 as int)
    WHEN 0 THEN mon || ' ' || d || ', ' || y WHEN 1 THEN d || 'th ' || mon || ' ' || y WHEN 2 THEN 'Mon, ' || mon || ' ' || d || ' ' || y
    WHEN 3 THEN y || '-' || mm || '-' || dd || ' 14:25' WHEN 4 THEN d || ' ' || mon || ' ' || substr(y, 3, 2)
    WHEN 5 THEN mon || ' ' || d || ', ' || substr(y, 3, 2) WHEN 6 THEN y || mm || dd WHEN 7 THEN y || '-' || mm
    WHEN 8 THEN y || '-' || mm || '-' || dd || 'T23:05:09Z' WHEN 9 THEN dd || '-' || mon || '-' || y || ' 01:30 pm'
    WHEN 10 THEN y || '-' || mm || '-' || dd || ' 00:15:00+02:00' ELSE mon || ' ' || y END AS spelled
FROM (SELECT o_orderkey, o_orderdate, cast(year(o_orderdate) as string) AS y, lpad(cast(month(o_orderdate) as string), 2, '0') AS mm,
  lpad(cast(day(o_orderdate) as string), 2, '0') AS dd, cast(day(o_orderdate) as string) AS d,
  split_part('Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec', ',', cast(month(o_orderdate) as int)) AS mon FROM orders) parts
"""

# numeric columns for modes: big integers, and a tie that text order would decide otherwise
TIED_NUMBERS = """
SELECT event_id,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END AS user_id,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 9007199254740995 ELSE 9007199254740993 END AS big,
  CASE WHEN event_id >= 200 THEN NULL WHEN event_id % 2 = 0 THEN 10 ELSE 9 END AS tied
FROM events
"""

VIEWS = {
    "dirty_customer": DIRTY_CUSTOMER,
    "dirty_orders": DIRTY_ORDERS,
    "dirty_events": DIRTY_EVENTS,
    "part_names": PART_NAMES,
    "hidden_types": HIDDEN_TYPES,
    "foreign_phones": FOREIGN_PHONES,
    "spelled_dates": SPELLED_DATES,
    "tied_numbers": TIED_NUMBERS,
}
_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
)


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows of a few files, dealt to all cores, because a file of one row group is read by one task.

    ``rows`` bounds the rows of a task, for steps whose memory grows with them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = cores if len(df.inputFiles()) < cores else 0
    if rows is not None:
        tasks = max(tasks, ceil(df.count() / rows))
    return df.repartition(tasks) if tasks else df


def table(spark: SparkSession, folder: str, name: str, rows: int | None = None) -> DataFrame:
    return spread(spark.read.parquet(os.path.join(folder, f"{name}.parquet")), rows)


def view(spark: SparkSession, folder: str, name: str, in_order: bool = False) -> DataFrame:
    """A dirty view as a DataFrame; ``in_order`` keeps the rows in file order."""
    for base in _TABLES:
        if f"FROM {base}" in VIEWS[name]:
            spark.read.parquet(os.path.join(folder, f"{base}.parquet")).createOrReplaceTempView(base)
    rows = spark.sql(VIEWS[name])
    return rows if in_order else spread(rows)


def with_views(sql: str, *names: str) -> str:
    """The oracle query with the dirty views it reads as common table expressions."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {ctes} {sql}"
