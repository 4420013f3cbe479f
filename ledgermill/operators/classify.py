"""Records into valid, corrected or quarantined, with every correction and rejection named.

Two profiles share the output: ``row`` holds the full rules and flags repeats of an order_id after the
first; ``bulk`` knows fewer forms of numbers and dates, rejects more, and flags every row of a
repeated order_id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill import schema as S
from ledgermill.functions import bulk, dates, items, money, text
from ledgermill.functions.text import correction
from ledgermill.operators.dedup import flag_repeats

#: Prefix of working columns, which the result does not have.
_W = "w_"
#: Between the codes of error_details.
_BETWEEN = "; "


@dataclass(frozen=True)
class Rules:
    """Names of the working columns: cleaned fields, corrections and rejection codes, both in order."""

    frame: DataFrame
    clean: dict[str, Column]
    corrections: list[tuple[Column, Column]]  # where, and the struct
    listed_corrections: dict[int, Column]  # arrays to put in before a place of corrections
    errors: list[tuple[Column, str]]  # where a rule is broken, and its code


def _row_rules(df: DataFrame) -> Rules:
    steps, rules = _row_columns(id(SparkContext._gateway))
    for step in steps:
        df = df.withColumns(step)
    return Rules(df, *rules)


@lru_cache(maxsize=1)
def _row_columns(gateway: int) -> tuple:
    """The working columns in four steps, and the rules over them: thousands of calls to the driver's JVM, made once for each."""
    c = F.col
    w = lambda name: F.col(_W + name)
    amounts = ("delivery_cost", "total_amount", "payment_amount")
    choices = ("status", "payment_method", "payment_status", "delivery_type")
    # each text is cleaned once, and the items are parsed outside the functions that go through them, which would interpret that
    texts = {_W + f: text.clean_text(c(f)) for f in ("order_id", "customer_id", "customer_name", "city", "district", "order_date", "customer_phone", "customer_email")}
    texts |= {f"{_W}given_{f}": text.clean_text(c(f)) for f in choices} | {_W + "parsed": items.parse_items(c("items_json"))}
    fields = (
        {_W + "date": dates.parse_date(c("order_date")), _W + "lines": items.read_items(w("parsed"))}
        | {_W + f: money.parse_money(c(f)) for f in amounts}
        | {_W + f: text.clean_choice(w(f"given_{f}"), cleaned=True) for f in choices}
        | {_W + "phone": text.clean_phone(c("customer_phone")), _W + "email": text.clean_email(w("customer_email"), cleaned=True)}
    )
    read = {_W + "items": items.kept_items(w("lines")), _W + "negative": items.has_negative(w("lines")), _W + "iso": dates.iso_text(w("date"))}
    corrupted = w("lines").isNull()
    usable = F.coalesce(F.size(w("items")) > 0, F.lit(False)) & ~w("negative")
    summed = {_W + "total": F.when(usable, items.recompute_total(w("items"), w("delivery_cost")["value"], w("total_amount")["value"]))}
    replaced = F.coalesce(w("total")["replaced"], F.lit(False))
    given = w("total_amount")["value"]

    amount = lambda f: (w(f)["rule"].isNotNull(), correction(f, c(f), w(f)["value"], w(f)["rule"]))
    choice = lambda f: (w(f) != w(f"given_{f}"), correction(f, w(f"given_{f}"), w(f), S.CHOICE_NORMALIZED))
    corrections = [
        (w("iso") != w("order_date"), correction("order_date", w("order_date"), w("iso"), S.DATE_NORMALIZED)),
        amount("delivery_cost"),
        amount("total_amount"),
        (text.currency_corrected(c("currency")), correction("currency", c("currency"), F.lit(S.CURRENCY), S.CURRENCY_UNIFIED)),
        (replaced, correction("total_amount", given, w("total")["value"], S.TOTAL_RECALCULATED)),
        (w("phone") != w("customer_phone"), correction("customer_phone", w("customer_phone"), w("phone"), S.PHONE_NORMALIZED)),
        (w("email") != w("customer_email"), correction("customer_email", w("customer_email"), w("email"), S.EMAIL_REPEATED)),
        *(choice(f) for f in choices),
        amount("payment_amount"),
    ]
    no_items = ~corrupted & (F.size(w("items")) == 0) & ~w("negative")
    errors = [
        (w("order_id") == "", S.MISSING_ORDER_ID),
        (w("customer_id") == "", S.MISSING_CUSTOMER_ID),
        (c(_W + "repeats"), S.DUPLICATE_ORDER_ID),
        (w("date").isNull(), S.INVALID_DATE),
        (corrupted, S.CORRUPTED_ITEMS),
        (w("negative"), S.NEGATIVE_VALUE),
        (no_items, S.EMPTY_ITEMS),
        (~usable & given.isNull(), S.UNKNOWN_PRICE),
        ((w("email") != "") & text.email_is_broken(w("email")), S.EMAIL_UNFIXABLE),
    ]
    clean = {
        "order_id": w("order_id"), "order_date": w("date"), "status": w("status"), "customer_id": w("customer_id"), "customer_name": w("customer_name"),
        "customer_phone": w("phone"), "customer_email": w("email"), "city": w("city"), "district": w("district"), "delivery_type": w("delivery_type"),
        "delivery_cost": F.coalesce(w("delivery_cost")["value"], F.lit(0.0)), "payment_method": w("payment_method"), "payment_status": w("payment_status"),
        "payment_amount": w("payment_amount")["value"], "currency": F.lit(S.CURRENCY), "total_amount": F.coalesce(w("total")["value"], given), "items": w("items"),
    }
    return (texts, fields, read, summed), (clean, corrections, {1: items.item_corrections(w("lines"))}, errors)


def _bulk_rules(df: DataFrame) -> Rules:
    c = F.col
    w = lambda name: F.col(_W + name)
    df = df.withColumns(
        {_W + f: bulk.clean_text(c(f)) for f in ("order_id", "customer_id", "customer_name", "status", "city", "district", "delivery_type", "payment_method", "payment_status")}
        | {_W + "phone": bulk.phone(c("customer_phone")), _W + "email": bulk.email(c("customer_email")), _W + "date_text": bulk.date_text(c("order_date"))}
        | {_W + f: bulk.money(c(f)) for f in ("delivery_cost", "payment_amount", "total_amount")}
        | {_W + "items": bulk.items(c("items_json"))}
    )
    df = df.withColumn(_W + "date", F.try_to_timestamp(w("date_text")).cast("timestamp_ntz"))
    corrupted = w("items").isNull()
    empty = ~corrupted & (F.size(w("items")) == 0)
    bad = F.coalesce(F.exists(w("items"), bulk.is_bad_item), F.lit(False))
    countable = ~corrupted & ~empty & ~bad & w("delivery_cost").isNotNull()
    df = df.withColumn(_W + "sum", F.when(countable, items.items_total(w("items")) + w("delivery_cost")))
    df = df.withColumn(_W + "final", F.coalesce(w("sum"), w("total_amount")))
    recomputed = w("sum").isNotNull() & (w("total_amount").isNull() | (F.abs(w("total_amount") - w("sum")) > 0.5))
    corrections = [
        (w("date_text") != bulk.clean_text(c("order_date")), correction("order_date", c("order_date"), w("date_text"), S.DATE_NORMALIZED)),
        (bulk.clean_text(c("currency")) != S.CURRENCY, correction("currency", c("currency"), F.lit(S.CURRENCY), S.CURRENCY_UNIFIED)),
        (w("email") != bulk.clean_text(c("customer_email")), correction("customer_email", c("customer_email"), w("email"), S.EMAIL_REPEATED)),
        (w("phone") != bulk.clean_text(c("customer_phone")), correction("customer_phone", c("customer_phone"), w("phone"), S.PHONE_NORMALIZED)),
        (recomputed, correction("total_amount", c("total_amount"), w("final"), S.TOTAL_RECALCULATED)),
    ]
    in_range = F.coalesce(F.year(w("date")).between(2000, 2100), F.lit(False))
    errors = [
        (w("order_id") == "", S.MISSING_ORDER_ID),
        (w("customer_id") == "", S.MISSING_CUSTOMER_ID),
        (~in_range, S.INVALID_DATE),
        (corrupted, S.CORRUPTED_ITEMS),
        (empty, S.EMPTY_ITEMS),
        (bad, S.NEGATIVE_VALUE),
        (w("delivery_cost").isNull() | w("final").isNull(), S.UNKNOWN_PRICE),
        ((w("email") != "") & ~w("email").rlike(S.EMAIL_PATTERN), S.EMAIL_UNFIXABLE),
        (c(_W + "repeats"), S.DUPLICATE_ORDER_ID),
    ]
    clean = {
        "order_id": w("order_id"), "order_date": w("date"), "status": w("status"), "customer_id": w("customer_id"), "customer_name": w("customer_name"),
        "customer_phone": w("phone"), "customer_email": w("email"), "city": w("city"), "district": w("district"), "delivery_type": w("delivery_type"),
        "delivery_cost": w("delivery_cost"), "payment_method": w("payment_method"), "payment_status": w("payment_status"), "payment_amount": w("payment_amount"),
        "currency": F.lit(S.CURRENCY), "total_amount": w("final"), "items": w("items"),
    }
    return Rules(df, clean, corrections, {}, errors)


_PROFILES = {"row": _row_rules, "bulk": _bulk_rules}


def classify(raw: DataFrame, profile: str = "row", position: str | None = "source_row_number", staged: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """raw (columns of RAW and any others) with quality_status, clean (struct), corrections, error_codes, error_details.

    ``position`` orders the rows of one order_id; without one, no row counts as a repeat. clean is
    null for quarantined rows. The raw columns stay as they were. ``staged``: see flag_repeats.
    """
    if profile not in _PROFILES:
        raise ValueError(f"unknown profile {profile!r}: {', '.join(_PROFILES)}")
    key = text.clean_text if profile == "row" else bulk.clean_text
    raw = raw.withColumns({name: F.lit(None).cast("string") for name in S.RAW_COLUMNS if name not in raw.columns})
    flagged = flag_repeats(raw, F.nullif(key(F.col("order_id")), F.lit("")), position, _W + "repeats", keep_first=profile == "row", staged=staged)
    rules = _PROFILES[profile](flagged)
    listed = rules.listed_corrections.get(1)
    # whatever is named here is generated code: a higher-order function over an array of rules would interpret them all
    found = [F.when(where, F.array(what)).otherwise(F.array().cast(f"array<{S.CORRECTION}>")) for where, what in rules.corrections]
    corrections = F.concat(*found[:1], *([] if listed is None else [listed]), *found[1:])
    details = F.concat_ws(_BETWEEN, *(F.when(where, F.lit(code)) for where, code in rules.errors))
    df = rules.frame.withColumns({_W + "errors": details, _W + "corrections": corrections})
    errors = F.col(_W + "errors")
    rejected = errors != ""
    return df.select(
        *raw.columns,
        F.when(rejected, "quarantine").when(F.size(_W + "corrections") > 0, "corrected").otherwise("valid").alias("quality_status"),
        F.when(~rejected, F.struct(*(v.alias(k) for k, v in rules.clean.items()))).alias("clean"),
        F.col(_W + "corrections").alias("corrections"),
        F.when(errors.contains(_BETWEEN), F.array(F.lit(S.SEVERAL_ERRORS))).when(rejected, F.array(errors)).otherwise(F.array().cast("array<string>")).alias("error_codes"),
        errors.alias("error_details"),
    )


def record_hash(clean: Column, status: Column, corrections: Column) -> Column:
    """SHA-256 of the cleaned record, its status and its corrections, as JSON with nulls kept."""
    return F.sha2(F.to_json(F.struct(clean.alias("clean"), status.alias("quality_status"), corrections.alias("corrections")), {"ignoreNullFields": "false"}), 256)
