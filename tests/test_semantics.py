"""Semantic types by name and by value."""

import pytest
from pyspark.sql import functions as F

from rinsework.operators import semantics

COLUMNS = {
    "mails": (["john@example.com", "jane@test.org", "bob@domain.io", "x"], "email"),
    "days": (["2024-01-01", "Feb 15 2024", "2023-12-31", "x"], "date"),
    "flags": (["True", "False", "true", "0"], "boolean"),
    "grouped": (["1,200", "15,000", "3,500", "999"], "numeric_string"),
    "money": (["₹5,000", "₹12,000", "$3,500", "999"], "currency"),
    "fruit": (["apple", "banana", "orange", "grape"], "text"),
    "towns": (["Pune", "Mumbai", "Delhi", "Bangalore"], "city"),
    "lines": (["(555) 010-9999", "+91 98765-43210", "(020) 7946-0958", "555-0101-22"], "phone"),
    "nothing": ([None, None, None, None], "unknown"),
    # by name, whatever the values
    "Customer E-Mail": (["a", "b", "c", "d"], "email"),
    "mobile": (["a", "b", "c", "d"], "phone"),
    "birth_city": (["a", "b", "c", "d"], "date"),
    "Bin_Location": (["a", "b", "c", "d"], "city"),
    "Lead_ID": (["a", "b", "c", "d"], "id"),
    "id_card": (["a", "b", "c", "d"], "id"),
    "age": (["a", "b", "c", "d"], "age"),
    "first_name": (["a", "b", "c", "d"], "name"),
    "street": (["a", "b", "c", "d"], "address"),
}


@pytest.fixture(scope="module")
def table(spark):
    rows = list(zip(range(4), *[values for values, _ in COLUMNS.values()]))
    fields = ", ".join(f"`{c}` string" for c in COLUMNS)
    return spark.createDataFrame(rows, f"_rid long, {fields}")


def test_detection(table):
    assert semantics.detect_semantics(table) == {c: t for c, (_, t) in COLUMNS.items()}


def test_overrides_and_physical_types(spark):
    frame = spark.sql("SELECT 1 AS age, 1.5D AS city, true AS email, current_date() AS name, 'a' AS x, array(1) AS y")
    found = semantics.detect_semantics(frame, overrides={"x": "id"})
    assert found == {"age": "integer", "city": "float", "email": "boolean", "name": "date", "x": "id", "y": "text"}


def test_sparse_columns(spark):
    frame = spark.range(5000).select(
        F.col("id").alias("_rid"),
        F.when(F.col("id") >= 4990, F.concat(F.lit("u"), F.col("id"), F.lit("@x.com"))).alias("v"),
    )
    assert semantics.detect_semantics(frame) == {"v": "email"}


def test_all_values_count_wherever_they_stand(spark):
    frame = spark.range(400).select(
        F.col("id").alias("_rid"), F.when(F.col("id") < 100, "yes").otherwise("a@b.com").alias("v"),
        F.when(F.col("id") < 100, "yes").otherwise(F.concat(F.lit("free text "), F.col("id"))).alias("w"),
        F.when(F.col("id") < 100, "nothing").otherwise("Mumbia").alias("x"),
    ).repartition(3)
    assert semantics.detect_semantics(frame) == {"v": "email", "w": "text", "x": "city"}
    rates = semantics.semantic_rates(frame, ["v"]).first()
    assert (rates["sampled"], rates["email_rate"], rates["decided"]) == (400, 0.75, "email")


def test_long_texts_are_no_cities(spark):
    frame = spark.range(10).select(F.concat(F.lit("Pune "), F.repeat(F.lit("word "), 4000)).alias("v"))
    assert semantics.city_rates(frame, ["v"]).first()["city_rate"] == 0.0


def test_copies_are_judged_once(spark):
    """Copies are counted before dates are read; long texts are judged without travelling."""
    long = "note " * 40
    cells = ["2024-01-01"] * 5 + [" 2024-01-01 "] + ["12"] * 2 + [long] * 2
    frame = spark.createDataFrame([(c, "x@y.z") for c in cells], "v string, w string")
    rates = semantics.semantic_rates(frame, ["v", "w"])
    found = {r["column"]: r for r in rates.collect()}
    v = found["v"]
    assert (v["sampled"], v["date_rate"], v["number_rate"], v["phone_rate"], v["decided"]) == (10, 0.6, 0.2, 0.6, None)
    assert (found["w"]["sampled"], found["w"]["email_rate"], found["w"]["decided"]) == (10, 1.0, "email")
    plan = rates._jdf.queryExecution().optimizedPlan().toString()
    counted = [line for line in plan.splitlines() if "Aggregate [column" in line and "value" in line]
    assert counted and plan.index("rlike" if "rlike" in plan else "RLIKE") < plan.index(counted[0])


def test_only_texts_that_may_be_dates_are_rewritten(spark):
    """A text without two digits, or with a character that no date has, is no date; it is not rewritten first."""
    from rinsework.functions import dates

    cells = ["1-URGENT", "$ 2024", "a@b.c 2024", "Jan 5", "15th Jan, 2025", "Mon, Jan 5 2024 14:25", "2024-01-05\u0085 12:30", None]
    frame = spark.createDataFrame([(c,) for c in cells], "v string").withColumn("t", dates._tidy(F.col("v"), True))
    assert [r["t"] for r in frame.collect()] == [None, None, None, None, "15 Jan 2025", "Jan 5 2024", "2024-01-05\u0085", None]
    read = dates.with_parsed_dates(frame, {"d": "v"}).collect()
    assert [str(r["d"]) for r in read] == ["None"] * 4 + ["2025-01-15", "2024-01-05", "None", "None"]


def test_date_parsing_is_compiled(spark, largest_method):
    """optimize_orders: the loop that reads dates stays small enough for the JVM to compile it, whatever the number of columns."""
    from rinsework.operators import columns

    cells = ["2024-02-30", "13/01/2024", "01/13/2024", "1/13/24", "24-01-13", "20240113", "2024-01", "Jan 13 2024", "Sept 5 2024", "x"]
    frame = spark.createDataFrame([(c, c) for c in cells], "a string, b string")
    read = columns.standardize_dates(frame, {"a": "nullify", "b": "nullify"}, {"a": "s", "b": "t"})
    assert largest_method(read) <= 8000
    wanted = [None, *["2024-01-13"] * 5, "2024-01-01", "2024-01-13", "2024-09-05", None]
    assert [(r["a"], r["b"], r["s"]) for r in read.collect()] == [(w, w, "converted" if w else "rejected") for w in wanted]
