"""Dates written as text.

Month comes before day where both orders are possible. The wall clock is kept and an offset
dropped. A year outside 2000 to 2100 and a text without a full date are invalid.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermill.functions.text import ascii_digits, clean_text, let

_TIME = r"(?:(?:T|\s+)\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d+)?)?\s*(?:Z|[+-]\d{2}:?\d{2})?)?$"
_ISO = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2})?$"
_USUAL = r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2})?\z"
_YEAR_FIRST = r"(?i)^\d{4}-\d{1,2}-\d{1,2}" + _TIME
_YEAR_LAST = r"(?i)^\d{1,2}-\d{1,2}-\d{4}" + _TIME
_COMPACT = r"(?i)^\d{8}" + _TIME
_MONTH_DAY = r"(?i)^[a-z]{3,9}\.?[\s-]+\d{1,2},?[\s-]+\d{4}" + _TIME
_DAY_MONTH = r"(?i)^\d{1,2}[\s-]+[a-z]{3,9}\.?,?[\s-]+\d{4}" + _TIME
#: What follows the last number of a time of day: its fraction and the offset.
_BEHIND_TIME = r"(:\d{1,2})(?:\.\d+)?\s*(?:[zZ]|[+-]\d{2}:?\d{2})?$"
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def date_text(raw: Column) -> Column:
    return F.replace(ascii_digits(clean_text(raw)), F.lit("/"), F.lit("-"))


def _month(text: Column) -> Column:
    """The number of the month that the first letters of a text name, or null."""
    name = F.lower(F.regexp_extract(text, "[A-Za-z]+", 0))
    listed = F.array(*(F.lit(m) for m in _MONTHS))
    return F.nullif(F.array_position(F.transform(listed, lambda m: m.startswith(name)), F.lit(True)), F.lit(0)).cast("int")


def _moment(numbers: Column, year: int | Column, month: int | Column, day: int | Column, time: int = 3) -> Column:
    """The moment of the numbers of a text, by their places (year, month and day may be columns)."""
    number = lambda i: F.get(numbers, F.lit(i)).try_cast("int") if isinstance(i, int) else i
    clock = [F.coalesce(number(time + k), F.lit(0)) for k in range(3)]
    return F.try_make_timestamp_ntz(number(year), number(month), number(day), clock[0], clock[1], clock[2].cast("decimal(8,6)"))


def parse_date(raw: Column) -> Column:
    """timestamp_ntz of a text, null where it is invalid.

    The first form that the text has decides how its numbers, taken apart once, are read.
    """

    def chain(text: Column) -> Column:
        core = F.when(text.contains(":"), F.regexp_replace(text, _BEHIND_TIME, "$1")).otherwise(text)
        read = lambda use: let(F.split(core, "[^0-9]+"), use)
        first = lambda n: F.get(n, F.lit(0))
        part = lambda n, a, length: F.substring(first(n), a, length).try_cast("int")
        found = (
            F.when(text.rlike(_ISO), F.coalesce(text.try_cast("timestamp_ntz"), read(lambda n: _moment(n, 0, 2, 1))))  # the usual form
            .when(text.rlike(_YEAR_FIRST), read(lambda n: F.coalesce(_moment(n, 0, 1, 2), _moment(n, 0, 2, 1))))
            .when(text.rlike(_YEAR_LAST), read(lambda n: F.coalesce(_moment(n, 2, 0, 1), _moment(n, 2, 1, 0))))
            .when(text.rlike(_COMPACT), read(lambda n: _moment(n, part(n, 1, 4), part(n, 5, 2), part(n, 7, 2), 1)))
            .when(text.rlike(_MONTH_DAY), read(lambda n: _moment(n, 2, _month(text), 1)))
            .when(text.rlike(_DAY_MONTH), read(lambda n: _moment(n, 1, _month(text), 0, 2)))
        )
        return let(found, lambda t: F.when(F.year(t).between(2000, 2100), t))

    usual = F.when(raw.rlike(_USUAL), raw.try_cast("timestamp_ntz"))
    return F.when(F.year(usual).between(2000, 2100), usual).otherwise(let(date_text(raw), chain))


def iso_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
