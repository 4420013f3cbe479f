from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgermill.functions import dates, items, money, text


@pytest.fixture
def each(spark):
    def run(rule, *values):
        rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
        return [r[1] for r in rows.select("i", rule(F.col("v")).alias("out")).orderBy("i").collect()]

    return run


def test_clean_text(each):
    assert each(text.clean_text, None, "  a​b \t\n", "x", "   ") == ["", "ab", "x", ""]


def test_digits(each):
    assert each(text.ascii_digits, "٥٠٠٠", "١٢٣٫٥", "۱٬۲") == ["5000", "123.5", "1,2"]


@pytest.mark.parametrize(
    ("raw", "value", "rule"),
    [
        ("125,000.00", 125000.0, "CURRENCY_OR_FORMAT_NORMALIZED"),
        ("5000 لاير", 5000.0, "CURRENCY_OR_FORMAT_NORMALIZED"),
        ("2000 YER", 2000.0, "CURRENCY_OR_FORMAT_NORMALIZED"),
        ("5000 ر.ي.", 5000.0, "CURRENCY_OR_FORMAT_NORMALIZED"),
        ("خمسة آلاف", 5000.0, "CURRENCY_OR_FORMAT_NORMALIZED"),
        ("٥٠٠٠", 5000.0, "ARABIC_DIGITS_CONVERTED"),
        ("١٢٣٫٥", 123.5, "ARABIC_DIGITS_CONVERTED"),
        ("12.5", 12.5, None),
        ("1e5", 100000.0, None),
        ("1_000", 1000.0, None),
        ("-5", -5.0, None),
        ("inf", float("inf"), None),
        ("???", None, None),
        ("NaN", None, None),
        ("5d", None, None),
        ("1,00", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_money(each, raw, value, rule):
    (parsed,) = each(money.parse_money, raw)
    assert (parsed["value"], parsed["ok"], parsed["rule"]) == (value, value is not None, rule)


def test_currency(each):
    assert each(text.currency_corrected, "لاير يمني", "YER", " yer ", "", None, "USD") == [True, False, False, False, False, True]


def test_phone(each):
    assert each(text.clean_phone, "+967 77 123 4567", "00967771234567", "777-123", None) == ["771234567", "771234567", "777123", ""]


def test_email(each):
    assert each(text.clean_email, "user@@mail..com", "@@", "a@b.c") == ["user@mail.com", "@", "a@b.c"]
    assert each(lambda c: text.email_is_broken(text.clean_email(c)), "user@@mail..com", "@@", "a b@c.d") == [False, True, True]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("2025/01/31", datetime(2025, 1, 31)),
        ("17-01-2025 04:50:00", datetime(2025, 1, 17, 4, 50)),
        ("05-01-2025", datetime(2025, 5, 1)),
        ("2025-01-15T10:00:00+03:00", datetime(2025, 1, 15, 10)),
        ("2025-01-15 10:00:00.123Z", datetime(2025, 1, 15, 10)),
        ("٢٠٢٥-٠١-٠٢", datetime(2025, 1, 2)),
        ("20250115", datetime(2025, 1, 15)),
        ("Jan 5, 2025", datetime(2025, 1, 5)),
        ("5 January 2025 10:30", datetime(2025, 1, 5, 10, 30)),
        ("2025-13-01", datetime(2025, 1, 13)),
        ("2025-02-30", None),
        ("1999-12-31", None),
        ("2101-01-01", None),
        ("2025", None),
        ("not-a-date", None),
        (None, None),
    ],
)
def test_date(each, raw, expected):
    assert each(dates.parse_date, raw) == [expected]


def test_choice(each):
    assert each(text.clean_choice, "  مؤكد  ", "a \t b", None) == ["مؤكد", "a b", ""]


@pytest.mark.parametrize(
    ("raw", "n"),
    [('[{"sku":"A"}]', 1), ("[]", 0), ('[{"sku":"A"},3]', 2), ("not-json", None), ("[] xyz", None), ('{"sku":"A"}', None), ("[{'sku':'A'}]", None), ("", None), (None, None)],
)
def test_parse_items(each, raw, n):
    (found,) = each(lambda c: F.when(items.parse_items(c).isNotNull(), F.size(items.parse_items(c))), raw)
    assert found == n


def test_items_keep_what_can_be_read(spark):
    raw = '[{"sku":"A","qty":"٢","unit_price":"1,000","total":12345678901.50,"note":[1]},{"sku":"B","qty":"?","unit_price":1,"total":1},7,{"sku":"C","qty":-1,"unit_price":1,"total":1}]'
    lines = spark.createDataFrame([(raw,)], "v string").select(items.read_items(items.parse_items(F.col("v"))).alias("lines"))
    row = lines.select(items.kept_items(F.col("lines")).alias("kept"), items.has_negative(F.col("lines")).alias("negative"), items.item_corrections(F.col("lines")).alias("corrections")).first()
    assert [(i["sku"], i["qty"], i["total"]) for i in row["kept"]] == [("A", 2.0, 12345678901.5)]
    assert '"note":[1]' in row["kept"][0]["extra"]
    assert row["negative"]
    assert [(c["field"], c["rule_code"]) for c in row["corrections"]] == [("items[0].qty", "ARABIC_DIGITS_CONVERTED"), ("items[0].unit_price", "CURRENCY_OR_FORMAT_NORMALIZED")]


@pytest.mark.parametrize(("words", "value"), [
    ("ألف", 1000), ("الف", 1000), ("ألفان", 2000), ("الفان", 2000), ("ألفين", 2000), ("الفين", 2000),
    ("ثلاثة آلاف", 3000), ("ثلاثة الاف", 3000), ("أربعة آلاف", 4000), ("اربعة الاف", 4000), ("خمسة آلاف", 5000), ("خمسة الاف", 5000),
    ("ستة آلاف", 6000), ("ستة الاف", 6000), ("سبعة آلاف", 7000), ("سبعة الاف", 7000), ("ثمانية آلاف", 8000), ("ثمانية الاف", 8000),
    ("تسعة آلاف", 9000), ("تسعة الاف", 9000), ("عشرة آلاف", 10000), ("عشرة الاف", 10000),
])
def test_numbers_written_as_words(spark, words, value):
    found = spark.range(1).select(money.parse_money(F.lit(f"  {words} ريال")).alias("m")).first()["m"]
    assert found["value"] == value and found["ok"] and found["rule"] == "CURRENCY_OR_FORMAT_NORMALIZED"
