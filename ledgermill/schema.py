"""Schemas of the order tables, and the vocabularies of order fields."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of order files, which are given by their producers.
RAW_COLUMNS = (
    "order_id", "order_date", "status", "customer_id", "customer_name", "customer_phone", "customer_email", "city", "district",
    "delivery_type", "delivery_cost", "payment_method", "payment_status", "payment_amount", "currency", "total_amount", "items_json",
)
RAW = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

ITEM = T.StructType([
    T.StructField("sku", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("qty", T.DoubleType()),
    T.StructField("unit_price", T.DoubleType()),
    T.StructField("total", T.DoubleType()),
    T.StructField("extra", T.StringType()),
])
CORRECTION = "struct<field:string,original_value:string,corrected_value:string,rule_code:string>"

#: Columns of a cleaned order, in the order of the validated table.
CLEAN_COLUMNS = (
    "order_id", "order_date", "status", "customer_id", "customer_name", "customer_phone", "customer_email", "city", "district",
    "delivery_type", "delivery_cost", "payment_method", "payment_status", "payment_amount", "currency", "total_amount", "items",
)

CURRENCY = "YER"

# Currency words in the order in which they are taken out (the form with the last dot comes first, so that no
# dot is left behind), and numbers written as words, each in both spellings.
CURRENCY_WORDS = ("لاير يمني", "لاير", "ريال يمني", "ريال", "YER", "yer", "ر.ي.", "ر.ي")
WORD_NUMBERS = {
    "ألف": 1000, "الف": 1000,
    "ألفان": 2000, "الفان": 2000,
    "ألفين": 2000, "الفين": 2000,
    "ثلاثة آلاف": 3000, "ثلاثة الاف": 3000,
    "أربعة آلاف": 4000, "اربعة الاف": 4000,
    "خمسة آلاف": 5000, "خمسة الاف": 5000,
    "ستة آلاف": 6000, "ستة الاف": 6000,
    "سبعة آلاف": 7000, "سبعة الاف": 7000,
    "ثمانية آلاف": 8000, "ثمانية الاف": 8000,
    "تسعة آلاف": 9000, "تسعة الاف": 9000,
    "عشرة آلاف": 10000, "عشرة الاف": 10000,
}
UNKNOWN_MONEY = ("؟؟؟", "???", "null", "None", "NaN")
FOREIGN_DIGITS, ASCII_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٫٬", "01234567890123456789.,"
# Fixed value: the form of an address that is not rejected.
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"

# Codes of rejections and of corrections.
MISSING_ORDER_ID, MISSING_CUSTOMER_ID = "MISSING_ORDER_ID", "MISSING_CUSTOMER_ID"
DUPLICATE_ORDER_ID, INVALID_DATE = "DUPLICATE_ORDER_ID", "INVALID_IMPOSSIBLE_DATE"
CORRUPTED_ITEMS, EMPTY_ITEMS, NEGATIVE_VALUE = "CORRUPTED_ITEMS_JSON", "EMPTY_ITEMS", "AMBIGUOUS_NEGATIVE_VALUE"
UNKNOWN_PRICE, EMAIL_UNFIXABLE, SEVERAL_ERRORS = "UNKNOWN_PRICE", "EMAIL_UNFIXABLE", "MULTIPLE_CONFLICTING_ERRORS"
DIGITS_CONVERTED, MONEY_NORMALIZED = "ARABIC_DIGITS_CONVERTED", "CURRENCY_OR_FORMAT_NORMALIZED"
PHONE_NORMALIZED, EMAIL_REPEATED = "PHONE_FORMAT_NORMALIZED", "EMAIL_REPEATED_SYMBOLS"
DATE_NORMALIZED, CHOICE_NORMALIZED = "DATE_FORMAT_NORMALIZED", "TEXT_FIELD_TRIMMED_NORMALIZED"
TOTAL_RECALCULATED, CURRENCY_UNIFIED = "ORDER_TOTAL_RECALCULATED", "CURRENCY_UNIFIED"
