"""Value transforms driven by rule rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.functions import parsing
from tablehaul.functions.text import strip
from tablehaul.operators.project import quoted


@dataclass(frozen=True)
class Settings:
    null_handling: str = "use_placeholder"  # use_placeholder | skip | error
    empty_string_handling: str = "use_placeholder"  # use_placeholder | skip | keep
    case_sensitive_mappings: bool = False
    trim_whitespace: bool = True


@dataclass(frozen=True)
class FieldTransform:
    """``direct`` copies, ``constant`` sets a blank or a value, ``calculated`` evaluates SQL."""

    target: str
    kind: str = "direct"
    placeholder: str = ""
    expression: str | None = None


def fill_value(value: Column, placeholder: str, settings: Settings) -> Column:
    """Placeholder policy for null and for the empty string."""
    filled = value
    if settings.null_handling == "use_placeholder":
        filled = F.coalesce(filled, F.lit(placeholder))
    if settings.empty_string_handling == "use_placeholder":
        filled = F.when(value == "", F.lit(placeholder)).otherwise(filled)
    return filled


def apply_transforms(
    df: DataFrame, transforms: list[FieldTransform], settings: Settings = Settings(), found: Column | None = None
) -> DataFrame:
    """All field transforms in one projection; ``found`` maps lower-case fields to their translated value, if they have one.

    With ``skip`` a row whose field is null or empty stays, and a column ``skipped`` tells it from
    the others; ``error`` adds the label ``FIELD.null`` to the row's error list (created when the
    table has none).
    """
    by_name = {t.target.lower(): t for t in transforms}
    out: dict[str, Column] = {}
    labels, skipped = [], []
    for name in df.columns:
        rule = by_name.get(name.lower())
        if rule is None:
            out[name] = quoted(name)
            continue
        value = quoted(name)
        if settings.trim_whitespace:
            value = strip(value)
        if rule.kind == "constant":
            value = F.lit(rule.placeholder or " ")
        elif rule.kind == "calculated":
            value = F.expr(rule.expression).cast("string")
        else:
            if settings.null_handling == "skip":
                skipped.append(value.isNull())
            if settings.null_handling == "error":
                labels.append(F.when(value.isNull(), F.lit(f"{name.upper()}.null")))
            if settings.empty_string_handling == "skip":
                skipped.append(F.coalesce(value == "", F.lit(False)))
            if found is not None:
                value = F.coalesce(F.try_element_at(found, F.lit(name.lower())), value)
            value = fill_value(value, rule.placeholder, settings)
        out[name] = value
    if skipped:
        out.pop("skipped", None)
        out["skipped"] = reduce(Column.__or__, skipped)
    if labels:
        found = F.array_compact(F.array(*labels))
        before = out.pop("errors", None)
        out["errors"] = found if before is None else F.concat(before, found)
    return df.select(*[value.alias(name) for name, value in out.items()])


def map_by_table(
    df: DataFrame, column: str, table: DataFrame, case_sensitive: bool = False
) -> DataFrame:
    """Translate a column through a table (source_value, target_value) of any length.

    Per source value the target value at the smallest ``position`` counts; in a table without that
    column the smallest target value. Spark picks broadcast or shuffle from the table's real size.
    """
    fold = (lambda c: c) if case_sensitive else F.lower
    lookup = table.groupBy(fold(F.col("source_value")).alias("__key")).agg(
        F.min_by("target_value", "position" if "position" in table.columns else "target_value").alias("__value")
    )
    joined = df.join(lookup, fold(quoted(column)) == F.col("__key"), "left")
    value = F.coalesce("__value", quoted(column))
    return joined.select(*[(value if c == column else quoted(c)).alias(c) for c in df.columns])


def standardize_date(value: Column, *formats: str) -> Column:
    """The first format that fits, written as eight digits; null when none does."""
    parsed = F.coalesce(*[F.try_to_timestamp(strip(value), F.lit(f)) for f in formats])
    return parsing.format_date(parsed)


def standardize_number(value: Column, decimal: str = ",", thousands: str = ".") -> Column:
    return parsing.parse_decimal_text(value, decimal, thousands)


def convert_currency(
    df: DataFrame, amount: str, currency: str, rates: DataFrame, to: str, digits: int = 2, output: str = "converted"
) -> DataFrame:
    """Multiply by the rate of (from, to), in decimals. Without a rate the result is null; no row is dropped."""
    wanted = rates.filter(F.col("to_currency") == to).select(
        F.col("from_currency").alias("__from"), F.col("rate").cast("decimal(18,8)").alias("__rate")
    )
    joined = df.join(wanted, quoted(currency) == F.col("__from"), "left")
    rate = F.when(quoted(currency) == to, F.lit(1).cast("decimal(18,8)")).otherwise(F.col("__rate"))
    value = F.round(quoted(amount).cast("decimal(18,4)") * rate, digits)
    return joined.select(*[quoted(c) for c in df.columns], value.alias(output))


def lookup(df: DataFrame, on: str, table: DataFrame, key: str, value: str, output: str) -> DataFrame:
    """Left lookup of one value; rows without a hit keep null."""
    side = table.select(quoted(key).alias("__key"), quoted(value).alias(output))
    return df.join(side, quoted(on) == F.col("__key"), "left").drop("__key")


def change_log(df: DataFrame, key: str, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Long table (key, field, original, transformed) of the values that changed.

    Both versions come from the same row, so no join is needed.
    """
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("field"), before.cast("string").alias("original"), after.cast("string").alias("transformed"))
            for name, (before, after) in pairs.items()
        ]
    )
    rows = df.select(quoted(key).alias(key), F.inline(entries))
    return rows.filter(~F.col("original").eqNullSafe(F.col("transformed")))
