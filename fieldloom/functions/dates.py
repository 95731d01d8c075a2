"""Dates: printed forms, parsing, months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MONTHS
from .text import strip_accents

_NUMERIC = r"(?U)\b([0-3]?\d)\s*[/\-.]\s*([01]?\d)\s*[/\-.]\s*((?:19|20)\d{2})\b"
_TEXTUAL = r"(?iU)\b([0-3]?\d)\s+de\s+([a-záéíóú]+)\s+(?:del?\s+)?((?:19|20)\d{2})\b"


def in_words(day: Column) -> Column:
    """7 de junio de 2022"""
    month = F.get(F.array(*map(F.lit, MONTHS)), F.month(day) - 1)
    return F.concat(F.dayofmonth(day).cast("string"), F.lit(" de "), month, F.lit(" de "), F.year(day).cast("string"))


def in_digits(day: Column, separator: str = "/") -> Column:
    """07/06/2022"""
    return F.date_format(day, f"dd'{separator}'MM'{separator}'yyyy")


def _iso(year: Column, month: Column, day: Column) -> Column:
    """Empty for a day that isn't in the calendar."""
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.coalesce(F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd"), F.lit(""))


def parse_date(x: Column) -> Column:
    """The first numeric date, else the first one in words, as yyyy-MM-dd; empty if there is none or it doesn't exist. An
    impossible numeric date is final."""
    x = F.coalesce(x, F.lit(""))
    numeric = [F.regexp_extract(x, _NUMERIC, k) for k in (1, 2, 3)]
    worded = [F.regexp_extract(x, _TEXTUAL, k) for k in (1, 2, 3)]
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(strip_accents(worded[1])))
    return (
        F.when(numeric[0] != "", _iso(numeric[2], numeric[1], numeric[0]))
        .when((worded[0] != "") & (month > 0), _iso(worded[2], month.cast("string"), worded[0]))
        .otherwise("")
    )


def months_between(start: Column, end: Column) -> Column:
    """Whole calendar months, a clamped month end counting as whole."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return months - F.when((F.dayofmonth(end) < F.dayofmonth(start)) & (end != F.last_day(end)), 1).otherwise(0)
