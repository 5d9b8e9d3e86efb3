"""The driver's contract, and a few queries beside their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from catalogue.dirty import table
from check import TABLES, _rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_entry(spark):
    assert contract.entry(spark).count() == 5


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", [
    "column_profile", "mode_profile", "exact_dedup", "iqr_outlier_audit", "impute_auto", "type_gates",
    "date_nullify", "email_flag", "phone_e164", "title_case", "semantic_rates", "fuzzy_pairs", "fuzzy_dedup_lev",
    "city_normalize_lev", "quality_score", "nearest_dictionary", "city_normalize", "quality_improvement", "age_warning",
    "email_examples", "exact_dedup_fingerprint", "duplicate_audit_fingerprint", "mode_heavy", "profile_merged",
    "phone_plan_table", "email_composed", "csv_records",
])
def test_query_equals_sql(spark, sql, name):
    frame = contract.queries()[name](spark, FOLDER)
    cursor = sql.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    assert _rows(frame.columns, frame.collect()) == _rows(names, cursor.fetchall())


def test_rows_of_a_task_are_bounded(spark, tmp_path):
    """More rows make more tasks, not larger ones, where a task's memory follows its rows."""
    for rows, tasks in ((4, 4), (41, 9)):
        spark.range(rows).coalesce(1).write.parquet(f"{tmp_path}/{rows}/t.parquet")
        dealt = table(spark, f"{tmp_path}/{rows}", "t", rows=5)
        assert dealt.rdd.getNumPartitions() == tasks
        assert sorted(r["id"] for r in dealt.collect()) == list(range(rows))
