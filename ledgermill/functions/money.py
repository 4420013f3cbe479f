"""Amounts written as text."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermill.functions.text import ascii_digits, clean_text, correction, let, stripped
from ledgermill.schema import CURRENCY_WORDS, DIGITS_CONVERTED, MONEY_NORMALIZED, UNKNOWN_MONEY, WORD_NUMBERS

#: Numbers as float() reads them: digits grouped by single underscores, point, exponent, or a word for no finite number.
_D = r"[0-9]+(?:_[0-9]+)*"
_NUMBER = rf"^[+-]?(?:{_D}\.?(?:{_D})?|\.{_D})(?:[eE][+-]?{_D})?$"
_PLAIN = r"^-?[0-9]{1,300}(?:\.[0-9]{1,300})?$"
_NOT_FINITE = r"(?i)^[+-]?(?:inf|infinity|nan)$"


def _word_table() -> Column:
    return F.from_json(F.lit(json.dumps(WORD_NUMBERS)), "map<string,string>")  # folds to a literal


def parse_money(raw: Column) -> Column:
    """struct<value double, ok boolean, rule string>: rule is null where the text was a plain number or none.

    Digits become ASCII, currency words and, when one stands before three digits, all commas are
    dropped, and the known number words are looked up. A null, empty or unknown amount is not ok.
    """

    def from_text(text: Column) -> Column:
        return let(ascii_digits(text), lambda digits: _from_digits(text, digits))

    def known(value: Column, ok: bool) -> Column:
        return F.struct(value.alias("value"), F.lit(ok).alias("ok"), F.lit(None).cast("string").alias("rule"))

    # most amounts are plain or missing, and need none of the steps
    none, plain = known(F.lit(None).cast("double"), False), known(raw.try_cast("double"), True)
    return F.when(raw.isNull(), none).when(raw.rlike(_PLAIN), plain).otherwise(let(clean_text(raw), from_text))


def _from_digits(text: Column, digits: Column) -> Column:
    bare = reduce(lambda t, word: F.replace(t, F.lit(word), F.lit("")), CURRENCY_WORDS, digits)
    trimmed = stripped(bare)
    no_commas = F.when(trimmed.rlike("[0-9],[0-9]{3}"), F.replace(trimmed, F.lit(","), F.lit(""))).otherwise(trimmed)
    return let(
        F.struct(trimmed.alias("trimmed"), no_commas.alias("number"), (bare != digits).alias("had_word")),
        lambda s: let(F.coalesce(F.try_element_at(_word_table(), s["number"]), s["number"]), lambda number: _result(text, digits, s, number)),
    )


def _result(text: Column, digits: Column, s: Column, number: Column) -> Column:
    readable = number.rlike(_NUMBER) | (number.rlike(_NOT_FINITE) & ~number.isin(*UNKNOWN_MONEY))
    value = F.when(readable, F.replace(number, F.lit("_"), F.lit("")).try_cast("double"))
    digits_changed = digits != text
    changed = digits_changed | s["had_word"] | (s["number"] != s["trimmed"]) | (number != s["number"])
    rule = F.when(value.isNotNull() & changed, F.when(digits_changed, F.lit(DIGITS_CONVERTED)).otherwise(F.lit(MONEY_NORMALIZED)))
    return F.struct(value.alias("value"), value.isNotNull().alias("ok"), rule.alias("rule"))


def money_correction(field: str | Column, raw: Column, parsed: Column) -> Column:
    """The correction of a parsed amount, or null."""
    return F.when(parsed["rule"].isNotNull(), correction(field, raw, parsed["value"], parsed["rule"]))
