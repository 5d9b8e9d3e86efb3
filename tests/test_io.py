"""Sources, sinks and streaming use."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from rinsework import Staging
from rinsework.sources import (
    infer_types, output_name, preview, read_csv, read_table, write_csv, write_json, write_parquet,
)
from rinsework.sources.delimited import spans_lines
from rinsework.sources.records import read_records
from rinsework.streaming import clean_cells, drop_duplicates_within

LEADS = """Lead_ID,Name,Score,Count,Active,Joined,Big
L001,  John Doe,85.5,1,True,2023-01-15,12345678901234567890
L002,"Smith, Jane",NaN,2,False,02/10/2022,1
L003,"Bob ""B"" W",N/A,3,true,,2
L004,,-1e3,4,False,not-a-date,3
"""


@pytest.fixture()
def leads(tmp_path):
    path = tmp_path / "leads.CSV"
    path.write_text(LEADS)
    return str(path)


def test_csv_is_typed_by_its_values(spark, leads):
    frame = read_table(spark, leads)
    assert dict(frame.dtypes) == {
        "Lead_ID": "string", "Name": "string", "Score": "double", "Count": "bigint", "Active": "boolean",
        "Joined": "string", "Big": "string", "_rid": "bigint"}
    rows = preview(frame).collect()
    assert [r["Name"] for r in rows] == ["  John Doe", "Smith, Jane", 'Bob "B" W', None]
    assert [r["Score"] for r in rows] == [85.5, None, None, -1000.0]
    assert "_rid" not in rows[0]


def test_quoted_line_breaks_are_noticed(spark, tmp_path, leads):
    path = tmp_path / "notes.csv"
    path.write_text('id,note\n1,"two\nlines"\n2,"a ""quoted"" word"\n')
    assert spans_lines(spark, str(path)) and not spans_lines(spark, leads)
    assert [r["note"] for r in read_csv(spark, str(path)).collect()] == ["two\nlines", 'a "quoted" word']


@pytest.mark.parametrize("line, spans", [
    ('1,5" nail', False), ('1,"5"" nail"', False), ('1,a "quoted" word', False), ('"a, b",x', False), ('"","",""', False),
    ('1,"open', True), ('"open', True), ('1,"a""', True), ('1,"closed","open, still', True), ("", False),
])
def test_only_an_open_field_spans_lines(spark, tmp_path, line, spans):
    path = tmp_path / "one.csv"
    path.write_text(f"id,note\n{line}\n")
    assert spans_lines(spark, str(path)) == spans


def test_integers_with_missing_cells_become_doubles(spark):
    frame = spark.createDataFrame([("1", "", "x"), ("2", "7", "NULL"), ("3", "nan", "1")], "a string, b string, c string")
    assert dict(infer_types(frame).dtypes) == {"a": "bigint", "b": "double", "c": "string"}


def test_round_trips(spark, tmp_path, leads):
    frame = read_csv(spark, leads)
    write_csv(frame, str(tmp_path / "out"))
    back = read_csv(spark, str(tmp_path / "out"))
    assert sorted(map(str, back.drop("_rid").collect())) == sorted(map(str, frame.drop("_rid").collect()))
    write_parquet(frame, str(tmp_path / "t.parquet"))
    assert read_table(spark, str(tmp_path / "t.parquet")).dtypes == frame.drop("_rid").dtypes
    write_json(frame.select("Count"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 4


def test_names_and_workbooks(spark):
    assert output_name("/data/leads.csv") == "/data/optimized_leads.csv"
    with pytest.raises(ValueError):
        read_table(spark, "/data/book.XLSX")


def test_cell_cleaners_on_a_stream(spark, tmp_path):
    rows = [(" ann LEE ", "A@B.Com", "9876543210", 200, "Jan 5 2024"), ("bob", "bad@", "12", 30, "never")]
    schema = "name string, email string, phone string, age long, day string"
    batch = spark.createDataFrame(rows, schema)
    batch.write.parquet(str(tmp_path / "in"))
    kinds = {"name": "name", "email": "email", "phone": "phone", "age": "age", "day": "date"}
    stream = clean_cells(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), kinds,
                         email_modes={"email": "nullify"})
    started = stream.writeStream.format("memory").queryName("cleaned").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "checkpoint")).start()
    started.processAllAvailable()
    started.stop()
    expected = [("Ann Lee", "A@b.com", "+919876543210", None, "2024-01-05"), ("Bob", None, None, 30, None)]
    assert sorted(map(tuple, spark.table("cleaned").collect())) == expected


def test_repeats_on_a_stream(spark, tmp_path):
    """Repeats within the watermark go, repeats long after it are new rows, rows behind it are dropped."""
    schema = "t timestamp, k string, v long"
    batches = [
        [("2024-01-01 00:00:00", "a", 1), ("2024-01-01 00:00:10", "a", 1), ("2024-01-01 00:00:20", None, 2), ("2024-01-01 00:00:25", None, 2)],
        [("2024-01-01 00:00:50", "a", 1), ("2024-01-01 00:05:00", "b", 1)],
        [("2024-01-01 00:05:10", "a", 1), ("2024-01-01 00:00:01", "c", 1), ("2024-01-01 00:05:20", "b", 1)],
    ]
    rows = spark.createDataFrame([], schema)
    (tmp_path / "in").mkdir()
    stream = drop_duplicates_within(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "t", "1 minute", ["k", "v"])
    query = None
    for batch in batches:
        part = spark.createDataFrame(batch, "t string, k string, v long").withColumn("t", F.to_timestamp("t")).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
        if query is None:
            query = stream.writeStream.format("memory").queryName("unrepeated").outputMode("append").option(
                "checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
    query.stop()
    found = sorted((str(r["t"]), r["k"]) for r in spark.table("unrepeated").collect())
    assert [k for _, k in found] == ["a", None, "b", "a"]
    whole = spark.createDataFrame(sum(batches, []), "t string, k string, v long")
    assert drop_duplicates_within(whole, "t", "1 minute").count() == 4 and rows.schema == part.schema


@pytest.mark.parametrize("size", ["300", "37", "1000000"])
def test_records_with_line_breaks_are_read_in_parallel(spark, tmp_path, size):
    """Quoted breaks, doubled quotes, separators in quotes, inch marks: as a plain parser reads them, however files are split."""
    rng = random.Random(int(size))
    cells = ["plain", "with, comma", "two\nlines", 'q "x" q', '5" pipe', 'a\n"b"\n,c', "", "\n\n", '"', '",\n"', "many\n\n\nbreaks " * 9]
    expected = []
    for f in range(3):
        rows = [[str(f * 1000 + i), rng.choice(cells), rng.choice(["x", "y\nz", ""])] for i in range(50 if f else 0)]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([["id", "a text", "t"], *rows])
        (tmp_path / f"f{f}.csv").write_text(out.getvalue().replace('"5"" pipe"', '5" pipe'))  # a quote inside of an unquoted field
        expected += rows
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        found = read_csv(spark, str(tmp_path), infer=False, staging=Staging(spark))
        got = [tuple(r) for r in found.orderBy("_rid").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found.columns == ["id", "a text", "t", "_rid"]
    assert got == [(*[c or None for c in row], i) for i, row in enumerate(expected)]


def test_records_of_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k;v\n1;"open\nto the\nend')
    rows = read_records(spark, str(tmp_path / "a.csv"), Staging(spark), ";").collect()
    assert [r["k"] for r in rows] == ["1"]
    (tmp_path / "b.csv").write_text("k,v\n")
    assert read_records(spark, str(tmp_path / "b.csv"), Staging(spark)).collect() == []
    (tmp_path / "c.csv").write_text("")
    with pytest.raises(ValueError):
        read_records(spark, str(tmp_path / "c.csv"), Staging(spark))
