"""Whole runs: diagnosis, cleaning, scores, verification, reports."""

import pytest

from rinsework import Overrides, diagnose, optimize
from rinsework.operators.scoring import Audit, improvement_percent, score_frame
from rinsework.operators.verify import post_clean_verify


def rows(df, *names):
    return [tuple(r) if len(r) > 1 else r[0] for r in df.select(*names).collect()]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [
            ("  John Doe", "good@valid.com", "+91 (123) 456-7890", "Mumbia", 25, "Jan 1 2025", "₹1,000", "yes", 10.0),
            ("Bob Wilson", "abc@", "123", "Punne", 150, "01/15/2024", "$2,500", "No", 11.0),
            ("  John Doe", "good@valid.com", "+91 (123) 456-7890", "Mumbia", 25, "Jan 1 2025", "₹1,000", "yes", 10.0),
            ("alice o'brien", None, "9876543210", "Delhi", None, "not-a-date", "bad", "t", 12.0),
            ("Alice O'Brein", "Also@GOOD.org", None, "London", 31, None, "4000", "0", 9000.0),
            ("Zoe", "z@valid.org", " ", None, 40, "2024-03-10", "3,000", "n", None),
        ],
        "name string, email string, phone string, city string, age long, signup_date string, "
        "revenue string, active string, score double",
    )


@pytest.fixture(scope="module")
def flagged(people):
    return optimize(people)


@pytest.fixture(scope="module")
def strict(people):
    return optimize(
        people,
        {"email_mode_email": "remove", "date_mode_signup_date": "standardize", "score": "Custom:99.0",
         "strategy_active": "Skip", "city": "Drop", "outlier_score": "remove_row"},
        fuzzy_dedup=False, fuzzy_audit=False,
    )


def test_diagnosis(flagged):
    before = flagged.before
    assert before.semantics == {
        "name": "name", "email": "email", "phone": "phone", "city": "city", "age": "integer",
        "signup_date": "date", "revenue": "currency", "active": "boolean", "score": "float"}
    audit = before.audit
    assert (audit.rows, audit.cols, audit.duplicate_count, audit.null_count) == (6, 9, 1, 6)
    assert (audit.fuzzy_key_col, audit.fuzzy_duplicate_count) == ("name", 1)
    assert (audit.total_email_issues, audit.numeric_str_cols, audit.city_cols) == (1, ["revenue"], ["city"])
    report = {r["column"]: r for r in before.columns().collect()}
    assert report["email"]["status"] == "Warning (1 invalid emails)"
    assert report["email"]["invalid_email_examples"] == ["abc@"]
    assert report["age"]["recommended"] == "Median" and report["age"]["status"] == "Warning (High Skew)"
    assert report["phone"]["recommended"] == "Skip" and report["name"]["recommended"] == "Mode"
    assert (report["name"]["label"], report["name"]["badge"]) == ("Name", "sem-text")


def test_default_run(flagged):
    table = {r["name"]: r for r in flagged.df.collect()}
    assert set(table) == {"John Doe", "Bob Wilson", "Alice O'Brien", "Zoe"}
    assert table["Bob Wilson"]["email"] == "abc@"  # flagged, not removed
    assert table["John Doe"]["phone"] == "+911234567890" and table["Bob Wilson"]["phone"] is None
    assert (table["John Doe"]["city"], table["Bob Wilson"]["city"]) == ("Mumbai", "Pune")
    assert table["Zoe"]["city"] == "Delhi"  # the most frequent, smallest on ties
    assert table["John Doe"]["signup_date"] == "2025-01-01" and table["Alice O'Brien"]["signup_date"] is None
    assert dict(flagged.df.dtypes)["revenue"] == "double" and dict(flagged.df.dtypes)["active"] == "boolean"
    assert table["John Doe"]["revenue"] == 1000.0
    assert all(r["age"] is not None and 0 <= r["age"] <= 120 for r in table.values())
    assert "_rid" not in flagged.df.columns


def test_metrics_of_the_default_run(flagged):
    m = flagged.metrics
    assert (m["rows_before"], m["rows_after"], m["duplicates_dropped"], m["fuzzy_duplicates_dropped"]) == (6, 4, 1, 1)
    assert m["rows_before"] == m["rows_after"] + m["duplicates_dropped"] + m["fuzzy_duplicates_dropped"]
    assert (m["emails_found"], m["emails_valid"], m["emails_invalid"], m["emails_flagged"]) == (3, 2, 1, 1)
    assert (m["phones_found"], m["phones_corrected"], m["phones_invalid"], m["phones_remaining"]) == (3, 2, 1, 3)
    assert (m["dates_detected"], m["dates_standardized"], m["dates_rejected"]) == (4, 3, 1)
    assert (m["types_converted"], m["cities_normalized"], m["ages_nullified"]) == (2, 2, 1)
    assert len(m) == 29
    log = " ".join(flagged.steps)
    assert "fuzzy duplicate" in log and "boolean" in log and "Mean" in log


def test_quality_improves(flagged):
    assert flagged.quality_after > flagged.quality_before
    assert flagged.after.health_score >= flagged.before.health_score
    assert flagged.quality_improvement_pct == improvement_percent(flagged.quality_before, flagged.quality_after)


def test_verification_warns_about_flagged_emails(flagged):
    v = flagged.verification
    assert (v.invalid_emails_remaining, v.invalid_dates_remaining, v.duplicates_remaining) == (1, 0, 0)
    assert v.invalid_phones_remaining == 1  # the blank cell, which cleaning leaves alone, is title-cased to ''
    assert not v.all_clear and v.export_status == "PASS WITH WARNINGS"


def test_overrides_are_followed(strict):
    table = strict.df.collect()
    assert "city" not in strict.df.columns
    assert all(r["email"] != "abc@" for r in table) and strict.metrics["emails_rows_removed"] == 1
    assert "not-a-date" in [r["signup_date"] for r in table]
    assert strict.metrics["outlier_rows_removed"] >= 1 and 9000.0 not in [r["score"] for r in table]
    assert strict.metrics["fuzzy_duplicates_dropped"] == 0
    assert any("Dropped column 'city'" in s for s in strict.steps)
    assert any("custom value '99.0'" in s for s in strict.steps)
    assert strict.verification.invalid_dates_remaining == 1


def test_reports(flagged, spark):
    named, columns = flagged.summary()
    assert named.count() == 18 and named.orderBy("seq").first().asDict() == {
        "seq": 1, "metric": "Original Row Count", "value": "6"}
    assert rows(columns, "column_name")[0] == "name" and columns.columns[1:] == ["semantic_type", "nulls", "status"]
    assert flagged.metrics_frame().count() == 29
    assert flagged.steps_frame().count() == len(flagged.steps)
    assert flagged.verification.frame(spark).first()["export_status"] == "PASS WITH WARNINGS"


def test_cleaning_twice_changes_nothing(flagged):
    again = optimize(flagged.df, fuzzy_dedup=False, fuzzy_audit=False)
    assert sorted(map(str, again.df.collect())) == sorted(map(str, flagged.df.collect()))
    assert again.metrics["rows_after"] == flagged.metrics["rows_after"]


def test_text_ages_are_coerced(spark):
    frame = spark.createDataFrame(
        [("25", "a1"), ("-5", "b2"), ("old", "c3"), ("130", "d4")], "age string, code string")
    result = optimize(frame, {"age": "Skip"}, fuzzy_dedup=False, fuzzy_audit=False)
    assert sorted((r["age"] for r in result.df.collect()), key=str) == [25.0, None, None, None]
    assert result.metrics["ages_nullified"] == 2
    result.discard()


def test_choices_are_checked(people):
    for bad in ({"email_mode_email": "drop"}, {"date_mode_x": "x"}, {"outlier_score": "cut"}):
        with pytest.raises(ValueError):
            Overrides.parse(bad, people.columns)
    parsed = Overrides.parse({"strategy_name": "Skip", "outlier_score": "clip", "age": "Drop"}, people.columns)
    assert parsed.fill == {"name": "Skip", "age": "Drop"} and parsed.dropped == ["age"]
    with pytest.raises(ValueError):
        Overrides({"score": "Custom:much"}).check_fill({"score": "float"})


def test_scores_as_numbers_and_as_columns(spark):
    audits = [
        Audit(rows=0, cols=0),
        Audit(rows=100, cols=4, null_density=3.3, duplicate_count=7, fuzzy_duplicate_count=3, outlier_count=40,
              phone_cols=["p"], city_cols=["c"], numeric_str_cols=["n"], total_email_issues=20, dates_rejected=9),
        Audit(rows=10, cols=2, null_density=90.0, duplicate_count=9, fuzzy_duplicate_count=99, outlier_count=99,
              phone_cols=list("abcde"), numeric_str_cols=list("abcde"), total_email_issues=99, dates_rejected=99),
    ]
    frames = [score_frame(a.frame(spark)) for a in audits]
    assert [(a.quality, a.health) for a in audits] == [
        (f.first()["quality_score"], f.first()["health_score"]) for f in frames]
    assert (audits[0].quality, audits[0].health) == (100, 100)
    assert audits[1].quality == int(100 - 4.95 - 7 - 4 - 6 - 2.7 - 2 - 8)
    assert audits[1].health == int(100 - 6.6 - 7 - 2 - 6 - 4 - 3)
    assert (audits[2].quality, audits[2].health) == (0, 5)


def test_verification_of_a_clean_table(spark):
    frame = spark.createDataFrame([("a@b.com", "2025-01-01", "+919876543210", 1.0)],
                                  "email string, date string, phone string, x double")
    checked = post_clean_verify(frame, {"email": "email", "date": "date", "phone": "phone"})
    assert checked.all_clear and checked.export_status == "PASS"


def test_sketched_diagnosis_without_fuzzy_count(people):
    found = diagnose(people, fuzzy=False, exact=False)
    assert found.audit.fuzzy_duplicate_count == 0 and found.audit.duplicate_count == 1
