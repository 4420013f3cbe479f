import pytest
from records import frame, record

from ledgermill.operators.classify import classify


@pytest.fixture
def outcomes(spark):
    def run(*overrides, profile="row"):
        rows = classify(frame(spark, [record(**o) for o in overrides]), profile).orderBy("source_row_number").collect()
        return rows if len(rows) > 1 else rows[0]

    return run


def test_clean_record_is_valid(outcomes):
    row = outcomes({})
    assert row["quality_status"] == "valid" and row["clean"]["order_id"] == "B-204" and not row["corrections"]


def test_foreign_digits_are_corrected(outcomes):
    row = outcomes({"total_amount": "٩٥٠٠", "delivery_cost": "١٥٠٠"})
    assert row["quality_status"] == "corrected" and row["clean"]["total_amount"] == 9500.0


@pytest.mark.parametrize(
    ("overrides", "code"),
    [
        ({"order_id": ""}, "MISSING_ORDER_ID"),
        ({"order_id": None}, "MISSING_ORDER_ID"),
        ({"customer_id": "  "}, "MISSING_CUSTOMER_ID"),
        ({"order_date": "not-a-date"}, "INVALID_IMPOSSIBLE_DATE"),
        ({"items_json": "not-json"}, "CORRUPTED_ITEMS_JSON"),
        ({"items_json": "[]"}, "EMPTY_ITEMS"),
        ({"items_json": '[{"sku":"A"},3]'}, "EMPTY_ITEMS"),
        ({"items_json": '[{"sku":"A","qty":-1,"unit_price":1,"total":1}]'}, "AMBIGUOUS_NEGATIVE_VALUE"),
        ({"customer_email": "@@"}, "EMAIL_UNFIXABLE"),
    ],
)
def test_rejections(outcomes, overrides, code):
    row = outcomes(overrides)
    assert (row["quality_status"], row["error_codes"], row["error_details"], row["clean"]) == ("quarantine", [code], code, None)


def test_first_of_a_repeated_id_stays(outcomes):
    first, second = outcomes({}, {})
    assert first["quality_status"] == "valid" and second["error_codes"] == ["DUPLICATE_ORDER_ID"]


def test_a_quarantined_first_still_counts(outcomes):
    first, second = outcomes({"items_json": "[]"}, {})
    assert first["error_codes"] == ["EMPTY_ITEMS"] and second["error_codes"] == ["DUPLICATE_ORDER_ID"]


def test_several_errors(outcomes):
    row = outcomes({"order_id": "", "customer_id": "", "items_json": "not-json", "total_amount": "???"})
    assert row["error_codes"] == ["MULTIPLE_CONFLICTING_ERRORS"]
    assert row["error_details"] == "MISSING_ORDER_ID; MISSING_CUSTOMER_ID; CORRUPTED_ITEMS_JSON; UNKNOWN_PRICE"


def test_wrong_total_is_recalculated(outcomes):
    row = outcomes({"total_amount": "999999.0"})
    assert row["clean"]["total_amount"] == 9500.0 and [c["rule_code"] for c in row["corrections"]] == ["ORDER_TOTAL_RECALCULATED"]


def test_total_within_the_tolerance_stays(outcomes):
    row = outcomes({"total_amount": "9500.3"})
    assert row["quality_status"] == "valid" and row["clean"]["total_amount"] == 9500.3


def test_missing_delivery_cost_is_zero(outcomes):
    row = outcomes({"delivery_cost": "", "total_amount": "8000"})
    assert row["quality_status"] == "valid" and row["clean"]["delivery_cost"] == 0.0


def test_order_of_corrections(outcomes):
    row = outcomes({
        "order_date": "2025/01/15", "delivery_cost": "١٥٠٠", "total_amount": "5 لاير", "currency": "ريال", "customer_phone": "+967777123456", "customer_email": "user@@example.com",
        "status": "قيد  الانتظار", "payment_amount": "1,000", "items_json": '[{"sku":"A","qty":"١","unit_price":10000,"total":10000}]',
    })
    assert [c["field"] for c in row["corrections"]] == ["order_date", "items[0].qty", "delivery_cost", "total_amount", "currency", "total_amount", "customer_phone", "customer_email", "status", "payment_amount"]


def test_one_outcome_each(outcomes):
    rows = outcomes({}, {"order_id": "", "customer_id": ""}, {"order_id": "B-205", "total_amount": "٩٥٠٠"})
    assert [r["quality_status"] for r in rows] == ["valid", "quarantine", "corrected"]


@pytest.mark.parametrize(
    ("overrides", "row", "bulk"),
    [
        ({"order_date": "17-01-2025"}, "corrected", "INVALID_IMPOSSIBLE_DATE"),
        ({"delivery_cost": ""}, "corrected", "UNKNOWN_PRICE"),
        ({"items_json": '[{"sku":"A","qty":"?","unit_price":1,"total":1}]'}, "EMPTY_ITEMS", "AMBIGUOUS_NEGATIVE_VALUE"),
        ({"total_amount": "9,500"}, "corrected", "valid"),
        ({"delivery_cost": "١٥٠٠٫٠"}, "corrected", "UNKNOWN_PRICE"),
        ({"delivery_cost": "1500 YER"}, "corrected", "UNKNOWN_PRICE"),
        ({"delivery_cost": "ألفان"}, "corrected", "UNKNOWN_PRICE"),
        ({"delivery_cost": "1.5e3"}, "valid", "UNKNOWN_PRICE"),
        ({"currency": "yer"}, "valid", "corrected"),
        ({"order_date": "2025-01-15"}, "corrected", "valid"),
        ({"items_json": '[{"sku":"A"},3]'}, "EMPTY_ITEMS", "CORRUPTED_ITEMS_JSON"),
        ({"items_json": "[] xyz"}, "CORRUPTED_ITEMS_JSON", "EMPTY_ITEMS"),
        ({"items_json": '[{"sku":"A","qty":1,"unit_price":20000000.0,"total":20000000.0}]'}, "corrected", "AMBIGUOUS_NEGATIVE_VALUE"),
        ({"status": "a  b"}, "corrected", "valid"),
    ],
)
def test_profiles_differ(outcomes, overrides, row, bulk):
    for profile, expected in (("row", row), ("bulk", bulk)):
        found = outcomes(overrides, profile=profile)
        assert (found["error_codes"] or [found["quality_status"]]) == [expected], profile


def test_bulk_flags_all_of_a_repeated_id(outcomes):
    assert [r["error_codes"] for r in outcomes({}, {}, profile="bulk")] == [["DUPLICATE_ORDER_ID"]] * 2


def test_unknown_profile(spark):
    with pytest.raises(ValueError, match="profile"):
        classify(frame(spark, [record()]), "other")


def test_rules_are_generated_code(spark):
    """Higher-order functions are interpreted with all that is inside them: they go through the lines of an order, not through the rules, and parse no text."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = classify(frame(spark, [record()]))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "array_join" not in plan and "concat_ws(; " in plan
    assert plan.count("filter(array(") == 1  # the corrections of a line
    assert "transform(w_parsed" in plan and "transform(try_variant_get" not in plan


def test_texts_that_do_not_stay_as_they_are(outcomes):
    ends = ["\xa0", "​", "\t", "\n", "\x1c", "\x85", " ", "　", " "]
    rows = outcomes(*({"order_id": f"B-{n}", "city": f"{e}تعز{e}", "status": f"{e}تم{e}{e}ا{e}", "customer_email": f"{e}a@@b..c{e}", "customer_phone": f"00967{e}711222333"} for n, e in enumerate(ends)))
    for r, e in zip(rows, ends):
        assert (r["clean"]["city"], r["clean"]["customer_email"], r["clean"]["customer_phone"]) == ("تعز", "a@b.c", "711222333")
        assert r["clean"]["status"] == ("تما" if e == "​" else "تم ا")
