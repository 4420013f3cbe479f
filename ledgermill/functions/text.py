"""Text rules as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermill.schema import ASCII_DIGITS, CURRENCY, EMAIL_PATTERN, FOREIGN_DIGITS

#: All white space of Unicode, and the separators of ASCII.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, also inside higher-order functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_text(raw: Column) -> Column:
    """Null as empty, no-break spaces as spaces, zero-width spaces dropped, Unicode white space trimmed."""
    # most texts stay as they are, which their ends and two searches tell
    raw = raw.cast("string")
    ends = ~F.substring(raw, 1, 1).isin(*WHITE_SPACE) & ~F.substring(raw, -1, 1).isin(*WHITE_SPACE)
    return F.when(~raw.contains("\xa0") & ~raw.contains("\u200b") & ends, raw).otherwise(stripped(raw))


def stripped(raw: Column) -> Column:
    """As clean_text, in one pass: for a raw that takes work to make, inside a higher-order function."""
    visible = F.translate(F.coalesce(raw.cast("string"), F.lit("")), " ​", " ")
    return F.btrim(visible, F.lit(WHITE_SPACE))


def ascii_digits(text: Column) -> Column:
    """Arabic and Persian digits and separators in ASCII."""
    return F.translate(text, FOREIGN_DIGITS, ASCII_DIGITS)


def correction(field: str | Column, original: Column, corrected: Column, rule: str | Column) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        as_column(field).alias("field"),
        original.cast("string").alias("original_value"),
        corrected.cast("string").alias("corrected_value"),
        as_column(rule).alias("rule_code"),
    )


def clean_phone(raw: Column) -> Column:
    """Digits without the country prefix 00967 or 967; never rejects."""
    digits = F.regexp_replace(ascii_digits(clean_text(raw)), "[^0-9]", "")
    return F.when(raw.rlike(r"^(?!00967|967)[0-9]+\z"), raw).otherwise(F.regexp_replace(digits, "^(00967|967)", ""))


def clean_email(raw: Column, cleaned: bool = False) -> Column:
    """Repeated at signs and dots collapsed; ``cleaned``: raw is a clean text."""
    text = raw if cleaned else clean_text(raw)
    return F.when(text.contains("@@") | text.contains(".."), F.regexp_replace(F.regexp_replace(text, "@{2,}", "@"), r"\.{2,}", ".")).otherwise(text)


def email_is_broken(cleaned: Column) -> Column:
    return ~cleaned.rlike("(?U)" + EMAIL_PATTERN)


def clean_choice(raw: Column, cleaned: bool = False) -> Column:
    """Runs of white space as one space; words outside the vocabulary pass. ``cleaned``: raw is a clean text."""
    text = raw if cleaned else clean_text(raw)
    return F.when(text.rlike(r"(?U)\s\s|[\s&&[^ ]]"), F.regexp_replace(text, r"(?U)\s+", " ")).otherwise(text)


def currency_corrected(raw: Column) -> Column:
    """Whether a currency was named that is not already CURRENCY, in any case."""
    return F.when(raw == CURRENCY, False).otherwise(~F.upper(clean_text(raw)).isin("", CURRENCY))
