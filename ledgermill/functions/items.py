"""Order lines given as a JSON array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermill.functions.money import money_correction, parse_money
from ledgermill.functions.text import clean_text

_AMOUNTS = ("qty", "unit_price", "total")


def parse_items(raw: Column) -> Column:
    """array<variant> of a JSON array, null for anything else: empty text, an object, broken JSON, text after the array."""
    text = clean_text(raw)
    whole = F.when(text.startswith("[") & text.endswith("]"), text)
    return F.try_variant_get(F.try_parse_json(whole), "$", "array<variant>")


def read_items(parsed: Column) -> Column:
    """Per line: its fields, parsed amounts, and whether it is readable and negative."""

    fields = ("place", "sku", "name", *(f"raw_{a}" for a in _AMOUNTS), "extra")

    def line(value: Column, place: Column) -> Column:
        get = lambda name: F.try_variant_get(value, f"$.{name}", "string")
        return F.struct(place.alias("place"), get("sku").alias("sku"), get("name").alias("name"), *(get(a).alias(f"raw_{a}") for a in _AMOUNTS), F.to_json(value).alias("extra"))

    def priced(x: Column) -> Column:
        return F.struct(*(x[f].alias(f) for f in fields), *(parse_money(x[f"raw_{a}"]).alias(a) for a in _AMOUNTS))

    def judged(x: Column) -> Column:
        readable = x["qty"]["ok"] & x["unit_price"]["ok"] & x["total"]["ok"]
        below = (x["qty"]["value"] < 0) | (x["unit_price"]["value"] < 0) | (x["total"]["value"] < 0)
        return F.struct(*(x[f].alias(f) for f in (*fields, *_AMOUNTS)), readable.alias("readable"), (readable & below).alias("negative"))

    # an element that is no object has no fields, so none of its amounts can be read
    return F.transform(F.transform(F.transform(parsed, line), priced), judged)


def kept_items(lines: Column) -> Column:
    """The lines that are readable and not negative, as items."""
    good = F.filter(lines, lambda x: x["readable"] & ~x["negative"])
    return F.transform(good, lambda x: F.struct(x["sku"].alias("sku"), x["name"].alias("name"), *(x[a]["value"].alias(a) for a in _AMOUNTS), x["extra"].alias("extra")))


def has_negative(lines: Column) -> Column:
    return F.coalesce(F.exists(lines, lambda x: x["negative"]), F.lit(False))


def item_corrections(lines: Column) -> Column:
    """Corrections of the amounts of all lines, line by line."""

    def of(x: Column) -> Column:
        names = {a: F.concat(F.lit("items["), x["place"].cast("string"), F.lit(f"].{a}")) for a in _AMOUNTS}
        found = F.array(*(money_correction(names[a], x[f"raw_{a}"], x[a]) for a in _AMOUNTS))
        return F.filter(found, lambda c: c.isNotNull())

    corrected = F.exists(lines, lambda x: F.coalesce(*(x[a]["rule"] for a in _AMOUNTS)).isNotNull())
    return F.coalesce(F.when(corrected, F.flatten(F.transform(lines, of))), F.array())


def items_total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda total, item: total + item["total"])


def recompute_total(items: Column, delivery: Column, given: Column, tolerance: float = 0.5) -> Column:
    """struct<value double, replaced boolean>: the given total, unless it is missing or off by more than the tolerance."""
    expected = F.bround(items_total(items) + F.coalesce(delivery, F.lit(0.0)), 2)
    replaced = given.isNull() | (F.abs(given - expected) > tolerance)
    return F.struct(F.when(replaced, expected).otherwise(given).alias("value"), replaced.alias("replaced"))
