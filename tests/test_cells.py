"""Cell cleaners: dates, e-mails, phones, numbers, booleans, ages, text."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from rinsework.functions import dates, emails, numbers, phones, rules, text
from rinsework.operators import columns, impute


def column(frame, name="v"):
    return [r[name] for r in frame.orderBy("i").select(name).collect()]


EXPLICIT = {
    "2025-01-15": "2025-01-15", "15-01-2025": "2025-01-15", "01-15-2025": "2025-01-15",
    "2025/01/15": "2025-01-15", "15/01/2025": "2025-01-15", "01/15/2024": "2024-01-15",
    "15.01.2025": "2025-01-15", "2025.01.15": "2025-01-15", "15 Jan 2025": "2025-01-15",
    "15 January 2025": "2025-01-15", "Jan 15 2025": "2025-01-15", "January 15 2025": "2025-01-15",
    "15-Jan-2025": "2025-01-15", "Jan-15-2025": "2025-01-15", "15/Jan/2025": "2025-01-15",
    "15/01/25": "2025-01-15", "25-01-15": "2025-01-15", "02/10/2023": "2023-10-02",
    "1/5/70": "1970-01-05", "1/5/68": "2068-01-05", "  2023-12-31 ": "2023-12-31", "2025-1-5": "2025-01-05",
    # impossible segments, days and years
    "01/15/25": None, "2025/13/01": None, "2025-00-01": None, "31/02/2023": None, "not_a_date": None,
    "1600-01-01": None, "2025-02-30": None, "12/2025": None, "jan 32 2025": None,
}
EXTENDED = {
    "1st Jan 2025": "2025-01-01", "January 5, 2025": "2025-01-05", "Mon, Jan 6 2025": "2025-01-06",
    "2024-01-01 08:00": "2024-01-01", "2024-01-01T08:00:00Z": "2024-01-01", "Jan 2025": "2025-01-01",
    "Sept 3 2020": "2020-09-03", "3 sept. 2020": None, "2025/13/01 08:00": None, "yesterday": None,
}


def test_explicit_dates(texts):
    frame = columns.standardize_dates(texts(list(EXPLICIT)), {"v": "nullify"}, extended=False)
    assert column(frame) == list(EXPLICIT.values())


def test_extended_dates_keep_the_explicit_ones(texts):
    cases = EXPLICIT | EXTENDED
    frame = columns.standardize_dates(texts(list(cases)), {"v": "nullify"})
    assert dict(zip(cases, column(frame))) == cases


def test_extended_spellings_need_the_extended_reading(texts):
    frame = columns.standardize_dates(texts(list(EXTENDED)), {"v": "nullify"}, extended=False)
    assert column(frame) == [None] * len(EXTENDED)


def test_date_modes_and_status(texts):
    cells = ["Jan 1 2025", " invalid_date ", "", None, "2025-01-01"]
    status = {"v": "s"}
    kept = columns.standardize_dates(texts(cells), {"v": "standardize"}, status)
    assert column(kept) == ["2025-01-01", "invalid_date", "", None, "2025-01-01"]
    assert column(kept, "s") == ["converted", "rejected", None, None, "converted"]
    assert column(columns.standardize_dates(texts(cells), {"v": "keep"}, status)) == cells
    typed = columns.standardize_dates(texts(cells), {"v": "nullify"}, as_type="date")
    assert dict(typed.dtypes)["v"] == "date"
    with pytest.raises(ValueError):
        columns.standardize_dates(texts(cells), {"v": "guess"})


def test_standardising_dates_twice_changes_nothing(texts):
    once = columns.standardize_dates(texts(list(EXPLICIT | EXTENDED)), {"v": "standardize"})
    assert column(columns.standardize_dates(once, {"v": "standardize"})) == column(once)


def test_strict_dates(texts):
    cells = ["2025-01-15", "2025-13-01", "2025-02-30", "2025-1-5", "15-01-2025", "1500-01-01", None]
    frame = texts(cells).select("i", dates.is_strict_date(F.col("v")).alias("v"))
    assert column(frame) == [True, False, False, False, False, False, False]


MAILS = {  # cell: (normal form, status, audit class)
    "a@b.com": ("a@b.com", "valid", "valid"),
    "Good@VALID.com": ("Good@valid.com", "corrected", "valid"),
    " a b@c.io ": ("ab@c.io", "corrected", "valid"),
    "abc@": (None, "invalid", "malformed"),
    "@gmail.com": (None, "invalid", "malformed"),
    "plain": (None, "invalid", "malformed"),
    "bob@wilson": (None, "invalid", "suspicious"),
    "a..b@c.com": (None, "invalid", "suspicious"),
    ".a@c.com": (None, "invalid", "suspicious"),
    "a@-c.com": (None, "invalid", "suspicious"),
    "a@b@c.com": (None, "invalid", "suspicious"),
    "x@foo.test": (None, "invalid", "suspicious"),
    "a@b.c1": (None, "invalid", "suspicious"),
    "x" * 65 + "@b.com": (None, "invalid", "suspicious"),
    "jörg@exämple.com": ("jörg@exämple.com", "valid", "valid"),
    "": (None, None, "malformed"),
}


def test_emails(texts):
    frame = emails.with_normal_emails(texts(list(MAILS)), {"n": "v"})
    frame = frame.select("i", "n", emails.email_status(F.col("v"), F.col("n")).alias("s"),
                         emails.email_audit_class(F.col("v")).alias("a"))
    assert [tuple(r)[1:] for r in frame.orderBy("i").collect()] == list(MAILS.values())


def test_email_modes(texts):
    cells = ["good@valid.com", "abc@", "", None, "Another@VALID.org"]
    frame = texts(cells)
    assert column(columns.clean_emails(frame, "v", "flag")) == [*cells[:4], "Another@valid.org"]
    assert column(columns.clean_emails(frame, "v", "nullify")) == [
        "good@valid.com", None, "", None, "Another@valid.org"]
    assert column(columns.clean_emails(frame, "v", "remove")) == [
        "good@valid.com", "", None, "Another@valid.org"]
    with pytest.raises(ValueError):
        columns.clean_emails(frame, "v", "delete")


PHONES = {
    "+91 (123) 456-7890": "+911234567890", "123": None, "00000000000": None, "000000000": None,
    "+1-800-555-0100": "+18005550100", "9876543210": "+919876543210", "+91-9999999999": "+919999999999",
    "5551234567": "+915551234567", "+447911123456": "+447911123456", "09876543210": "+919876543210",
    "919876543210": "+919876543210", "+44 (0)20 7946 0958": "+442079460958", "Tel: 98765 43210": "+919876543210",
    "00919876543210": "+919876543210", "98765 43210 ext. 12": "+919876543210", "abc": None, "": "", None: None,
}


def test_phones(texts):
    frame = columns.clean_phones(texts(list(PHONES)), "v", "s")
    assert column(frame) == list(PHONES.values())
    counts = {r["s"]: r["count"] for r in frame.groupBy("s").count().collect()}
    assert counts == {"corrected": 11, "valid": 1, "invalid": 4, None: 2}
    again = columns.clean_phones(frame.drop("s"), "v")
    assert column(again) == column(frame)


def test_phones_may_keep_invalid_numbers(texts):
    frame = columns.clean_phones(texts(["123", "9876543210"]), "v", keep_invalid=True)
    assert column(frame) == ["123", "+919876543210"]


def test_numbers_and_booleans(texts):
    cells = ["₹5,000", "$1,500", "€3,200.50", "-7", "12d", "5f", "1e3", "n/a", "", None, " 1 234 "]
    frame = texts(cells).select("i", numbers.numeric_string(F.col("v")).alias("v"))
    assert column(frame) == [5000.0, 1500.0, 3200.5, -7.0, None, None, 1000.0, None, None, None, 1234.0]
    cells = ["True", "no", " Y ", "0", "t", "maybe", None]
    frame = texts(cells).select("i", numbers.boolean_string(F.col("v")).alias("v"))
    assert column(frame) == [True, False, True, False, True, None, None]


def test_type_gates(spark):
    frame = spark.createDataFrame(
        [("₹1", "yes", "1"), ("x", "no", None), ("2", "t", None), (None, "f", None), (None, "?", "2")],
        "half string, most string, few string",
    )
    converted, types = columns.convert_types(
        frame, {"half": "currency", "most": "boolean", "few": "numeric_string"}
    )
    assert types == {"most": "boolean"}  # 2 of 5 and 2 of 5 numbers are too few, 4 of 5 booleans are enough
    assert converted.schema["half"].dataType.simpleString() == "string"


def test_ages(spark):
    frame = spark.createDataFrame([(0, 25), (1, -5), (2, 130), (3, None), (4, 120)], "i long, v long")
    cleaned = columns.clean_ages(frame, ["v"], {"v": "f"})
    assert column(cleaned) == [25, None, None, None, 120]
    assert column(cleaned, "f") == [False, True, True, False, False]


def test_title_case(texts):
    cells = [" o'brien hello-world ABC ", "x1y2z3 ÉCOLE", "john SMITH", "\tnew\nline ", None, ""]
    frame = texts(cells).select("i", text.standardize_text(F.col("v"), False).alias("v"))
    assert column(frame) == [c and c.strip().title() for c in cells]
    frame = texts(cells).select("i", text.standardize_text(F.col("v"), True).alias("v"))
    assert column(frame) == [c and c.strip() for c in cells]


@pytest.mark.parametrize("cell, number, status", [
    ("+39 06 698 12345", "+390669812345", "corrected"), ("+5511912345678", "+5511912345678", "valid"),
    ("0027 82 123 4567", "+27821234567", "corrected"), ("+7 495 123-45-67", "+74951234567", "corrected"),
    ("+999 1234 5678", "+999 1234 5678", "unknown"), ("+34 12", None, "invalid"), ("+390 12345678901234", None, "invalid"),
    ("+91 12", None, "invalid"), (" ", " ", None), (None, None, None),
])
def test_phones_of_other_plans(texts, cell, number, status):
    row = columns.clean_phones(texts([cell]), "v", "status").first()
    assert (row["v"], row["status"]) == (number, status)


@pytest.mark.parametrize("cell, day, time", [
    ("15 Jan 25", "2025-01-15", "00:00:00"), ("Jan 5, 75", "1975-01-05", "00:00:00"), ("20250115", "2025-01-15", "00:00:00"),
    ("2025-01", "2025-01-01", "00:00:00"), ("2024-03-10 14:25", "2024-03-10", "14:25:00"), ("2024-03-10T23:05:09Z", "2024-03-10", "23:05:09"),
    ("10 Mar 2024 12:30 am", "2024-03-10", "00:30:00"), ("2024-03-10 00:15:00+02:00", "2024-03-10", "22:15:00 the day before"),
    ("2024-03-10 25:00", "2024-03-10", None), ("20251301", None, None), ("15 Foo 25", None, None),
])
def test_further_dates_and_times(texts, cell, day, time):
    frame = texts([cell])
    assert columns.standardize_dates(frame, {"v": "nullify"}).first()["v"] == day
    found = columns.standardize_dates(frame, {"v": "nullify"}, as_type="timestamp").first()["v"]
    if day is None or time is None:
        assert found is None
    elif "before" in time:
        assert str(found) == "2024-03-09 22:15:00"
    else:
        assert str(found) == f"{day} {time}"


def test_mode_of_numbers(spark):
    rows = [(9007199254740993, 9, 9.0), (9007199254740993, 10, 10.0), (9007199254740995, 9, 9.0), (None, 10, 10.0), (None, None, None)]
    frame = spark.createDataFrame(rows, "big long, tied long, real double")
    filled = impute.impute(frame, {"big": "Mode", "tied": "Mode", "real": "Mode"})[0].collect()
    assert tuple(filled[-1]) == (9007199254740993, 9, 9.0)


def test_a_table_of_plans_gives_the_same_numbers(spark):
    rng = random.Random(5)
    cells = ["+91 12345 67890", "+1 1 212 555 1234", "+12125551234", "+9715012345678", "+971 0 50123456", "0091 1234567890", "01234567890", "+999123456789",
             "+4407911123456", "+3530123456", None, "", "ext 5", "1234567890 x12", "+", "+0", "+18", "911234567890"]
    cells += ["+" + rng.choice(["91", "1", "44", "61", "49", "33", "65", "971", "81", "86", "7", "999", "35"]) + rng.choice(["", "0", "1"])
              + "".join(rng.choices("0123456789", k=rng.randint(4, 12))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(cells)), "i long, v string")
    plans = spark.createDataFrame([vars(p) for p in rules.PHONE_RULES] + [{"country": "XX", "calling_code": None, "trunk": None, "national": "1"}],
                                  "country string, calling_code string, trunk string, national string")
    expected = {r["i"]: r["n"] for r in phones.with_e164(frame, {"n": "v"}).collect()}
    found = phones.with_e164_by_table(frame, {"n": "v"}, plans, "IN")
    assert found.columns == ["i", "v", "n"] and {r["i"]: r["n"] for r in found.collect()} == expected
    # a longer code beats a shorter one
    more = spark.createDataFrame([("US", "1", "1", "[2-9][0-9]{9}"), ("BS", "1242", "", "[0-9]{7}"), ("B2", "1242", "", "[0-9]{3}")],
                                 "country string, calling_code string, trunk string, national string")
    numbers_ = spark.createDataFrame([("+12425551234",), ("+1242555",), ("+124255512",), ("+13035551234",)], "v string")
    got = [r["n"] for r in phones.with_e164_by_table(numbers_, {"n": "v"}, more, "US").collect()]
    assert got == ["+12425551234", "+1242555", None, "+13035551234"]
    with pytest.raises(ValueError):
        phones.with_e164_by_table(frame, {"n": "v"}, plans, "ZZ")


def test_composed_texts(spark):
    rng = random.Random(6)
    cells = [None, "", "plain", "\u1112\u1161\u11ab", "\u212b", "a\u0323\u0307", "a\u0307\u0323", "\u0344", "\U0001f600e\u0301"]
    cells += ["".join(rng.choices("aeiouAOn\u0301\u0308\u0323\u00e9\u1e0b", k=6)) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(cells)), "i long, v string").select("i", text.composed(F.col("v")).alias("n"))
    assert {r["i"]: r["n"] for r in frame.collect()} == {i: v if v is None else unicodedata.normalize("NFC", v) for i, v in enumerate(cells)}
    mails = spark.createDataFrame([("jose\u0301@mu\u0308nchen.de",), ("jos\u00e9@m\u00fcnchen.de",)], "email string")
    assert len({r["n"] for r in emails.with_normal_emails(mails, {"n": "email"}).collect()}) == 1
