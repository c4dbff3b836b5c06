"""Classifiers that read a field's name and description."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark an operational field.
OPERATIONAL = "flag status indicator control system process update created modified version lock".split()

# Words that mark a derived field.
DERIVED = "calculated computed derived total sum average balance amount percentage ratio".split()

# Words that mark a target without a source as a constant.
CONSTANT = (
    "flag flg ind indicator control ctrl status state active inactive enabled disabled "
    "lock block freeze hold system process auto manual update modify change create "
    "version audit log track delete archive purge "
    "kennzeichen merkmal schalter sperre blockierung"
).split()

# One-letter names that count as flags.
ONE_LETTER_FLAGS = list("XYZQWERTY")


def _has_any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def _text(name: Column, description: Column) -> Column:
    blank = F.lit("")
    return F.lower(F.concat(F.coalesce(name, blank), F.lit(" "), F.coalesce(description, blank)))


def is_operational(name: Column, description: Column) -> Column:
    return _has_any(_text(name, description), OPERATIONAL)


def is_derived(name: Column, description: Column) -> Column:
    return _has_any(_text(name, description), DERIVED)


def is_constant(name: Column, description: Column) -> Column:
    letter = F.upper(F.coalesce(name, F.lit(""))).isin(ONE_LETTER_FLAGS)
    return _has_any(_text(name, description), CONSTANT) | letter


def type_by_name(name: Column, description: Column) -> Column:
    """Rule type from name, then description: date, decimal, integer, boolean, string."""
    n, d = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(description, F.lit("")))
    return (
        F.when(n.rlike("date|dat|time"), "date")
        .when(n.rlike("amount|amt|value|val"), "decimal")
        .when(n.rlike("count|number|num|id"), "integer")
        .when(d.rlike("boolean|flag|indicator"), "boolean")
        .otherwise("string")
    )


def profile_type(name: Column, rule_type: Column | None = None) -> Column:
    """Logical type used for profiling: the rule's type if known, else by name."""
    n = F.lower(name)
    guess = (
        F.when(n.rlike("decimal|number|num|decimals"), "decimal")
        .when(n.rlike("int|integer"), "int")
        .when(n.contains("date"), "date")
        .when(n.contains("time"), "time")
        .otherwise("string")
    )
    if rule_type is None:
        return guess
    given = F.lower(rule_type)
    return F.when(given.isin("string", "int", "decimal", "date", "time"), given).otherwise(guess)


def profile_type_of(name: str, rule_type: str | None = None) -> str:
    """The same decision for one column name while a plan is being put together."""
    if rule_type and rule_type.lower() in ("string", "int", "decimal", "date", "time"):
        return rule_type.lower()
    lowered = name.lower()
    for words, kind in (
        (("decimal", "num"), "decimal"),
        (("int",), "int"),
        (("date",), "date"),
        (("time",), "time"),
    ):
        if any(w in lowered for w in words):
            return kind
    return "string"


def rule_type(data_type: Column, decimals: Column) -> Column:
    """Rule type from a dictionary's type text."""
    text = F.upper(data_type)
    return (
        F.when(F.coalesce(data_type, F.lit("")) == "", "string")
        .when(text.contains("DATE"), "date")
        .when(text.contains("TIME"), "time")
        .when(text.contains("NUM") | text.contains("DEC") | decimals.isNotNull(), "decimal")
        .otherwise("string")
    )
