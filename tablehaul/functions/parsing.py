"""Guarded parsing of text cells: numbers, dates, times, lengths and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablehaul.functions.text import strip

NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
DATE = r"^[0-9]{8}$"
TIME = r"^([01][0-9]|2[0-3])[0-5][0-9][0-5][0-9]$"


def parse_number(col: Column) -> Column:
    """Double or null. The guard keeps out forms such as ``1.5d`` that a bare cast accepts."""
    return F.when(col.rlike(NUMBER), col.try_cast("double"))


def parse_integer(col: Column) -> Column:
    """The number when it has no fraction, else null; compared as doubles, so numbers of any length count."""
    number = parse_number(col)
    return F.when(number == F.rint(number), number)


def parse_date(col: Column) -> Column:
    """Calendar date written as eight digits, else null."""
    return F.when(col.rlike(DATE), F.try_to_timestamp(col, F.lit("yyyyMMdd"))).cast("date")


def parse_time(col: Column) -> Column:
    """Seconds since midnight for a six digit time in range, else null."""
    text = strip(col)
    part = lambda at: F.substring(text, at, 2).cast("int")
    return F.when(text.rlike(TIME), part(1) * 3600 + part(3) * 60 + part(5))


def format_time(seconds: Column) -> Column:
    """Seconds since midnight as six digits."""
    whole = F.floor(seconds).cast("int")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hour = F.floor(whole / 3600).cast("int")
    minute = F.floor((whole % 3600) / 60).cast("int")
    return F.concat(two(hour), two(minute), two(whole % 60))


def format_date(col: Column) -> Column:
    return F.date_format(col, "yyyyMMdd")


def parse_length(col: Column) -> Column:
    """Digits only; leading zeros do not matter. Anything else is null."""
    text = strip(col)
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))


def parse_length_lenient(col: Column) -> Column:
    """Whole part of any number as text; other non-empty text is kept as it is."""
    number = parse_number(col)
    return F.when(number.isNotNull(), number.cast("long").cast("string")).otherwise(
        F.coalesce(strip(col), F.lit(""))
    )


def is_marked(col: Column) -> Column:
    """A single ``X`` in any case."""
    return F.coalesce(F.upper(strip(col)) == "X", F.lit(False))


def is_mandatory(col: Column) -> Column:
    """Text that contains *mandatory*, or is one of x, true, 1."""
    text = F.lower(F.coalesce(col, F.lit("")))
    return text.contains("mandatory") | text.isin("x", "true", "1")


def is_mandatory_strict(col: Column) -> Column:
    """Exactly one of mandatory, true, 1, yes."""
    return F.lower(strip(F.coalesce(col, F.lit("")))).isin("mandatory", "true", "1", "yes")


def parse_decimal_text(col: Column, decimal: str = ",", thousands: str = ".") -> Column:
    """Number written with other separators, as text with a point and no grouping."""
    text = strip(col)
    if thousands:
        text = F.replace(text, F.lit(thousands), F.lit(""))
    if decimal != ".":
        text = F.replace(text, F.lit(decimal), F.lit("."))
    return F.when(text.rlike(NUMBER), text)
