"""Projections: cleaned tables, target skeleton, mapping-driven copy, template layout, filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.functions import text


def quoted(name: str) -> Column:
    """Column reference that is safe for names such as ``BANKL(k/*)`` or ``a.b``."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_clean_text(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Every (named) column as stripped text, null as the empty string."""
    chosen = set(columns if columns is not None else df.columns)
    return df.select(
        *[(text.clean(quoted(c)) if c in chosen else quoted(c)).alias(c) for c in df.columns]
    )


@dataclass(frozen=True)
class MappingRow:
    target: str
    source: str | None


def collect_mapping(mapping: DataFrame, target: str = "target_field", source: str = "source_header") -> list[MappingRow]:
    """The mapping table as plan-building metadata: one row per field of one target table."""
    rows = mapping.select(target, source).collect()
    return [MappingRow(r[0], r[1]) for r in rows]


def apply_mapping(
    df: DataFrame, targets: list[str], mapping: Iterable[MappingRow], keep: Iterable[str] = ()
) -> DataFrame:
    """Target-shaped table in one ``select``.

    Every target starts empty; a mapping row copies its source column; a later row for the same
    target wins; a source column that does not exist gives the empty string.
    """
    present = set(df.columns)
    chosen = {m.target.lower(): m.source for m in mapping if m.target and m.source}
    columns = []
    for target in targets:
        source = chosen.get(target.lower())
        value = quoted(source) if source in present else F.lit("")
        columns.append(value.alias(target.lower()))
    return df.select(*[quoted(c) for c in keep], *columns)


def skeleton(df: DataFrame, targets: list[str], keep: Iterable[str] = ()) -> DataFrame:
    """One empty column per target field."""
    return apply_mapping(df, targets, [], keep)


def missing_sources(df: DataFrame, mapping: Iterable[MappingRow]) -> list[str]:
    """Mapped headers that the table does not have."""
    present = set(df.columns)
    return list(dict.fromkeys(m.source for m in mapping if m.source and m.source not in present))


def annotate(name: str, key: bool, required: bool) -> str:
    if key and required:
        return f"{name}(k/*)"
    return f"{name}(*)" if required else name


def base_name(header: str) -> str:
    return header.strip().split("(")[0].split(")")[0].upper()


@dataclass(frozen=True)
class Layout:
    """Output columns as (annotated header, source column or None) and targets left out."""

    columns: list[tuple[str, str | None]]
    ignored: list[str]


def plan_layout(
    targets: list[str], template: list[str] | None, flags: Mapping[str, tuple[bool, bool]]
) -> Layout:
    """Order and names of the output columns.

    With a template its order rules and targets it lacks are ignored; without one the target
    order is used. ``flags`` maps an upper-case name to (key, required).
    """
    known = {t.upper(): t.lower() for t in targets}
    order = [base_name(h) for h in template] if template else list(known)
    order = [o for o in order if o]
    ignored = [t for t in known if template and t not in order]
    columns = [(annotate(n, *flags.get(n, (False, False))), known.get(n)) for n in order]
    return Layout(columns, ignored)


def apply_layout(df: DataFrame, layout: Layout) -> DataFrame:
    return df.select(
        *[(quoted(c) if c else F.lit("")).alias(name) for name, c in layout.columns]
    )


def drop_empty_rows(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Keep rows in which at least one cell is not blank."""
    cells = F.array(*[text.clean(quoted(c)) for c in (columns or df.columns)])
    return df.filter(F.exists(cells, lambda c: c != ""))


def search(df: DataFrame, anywhere: str = "", column: str | None = None, contains: str = "") -> DataFrame:
    """Rows where any cell contains a text, and one named column another; case is ignored."""
    if column is not None and column not in df.columns:
        raise ValueError(f"there is no column {column}")
    if anywhere:
        needle = anywhere.lower()
        hit = F.lit(False)
        for c in df.columns:
            hit = hit | F.coalesce(F.lower(quoted(c).cast("string")).contains(needle), F.lit(False))
        df = df.filter(hit)
    if column is not None and contains:
        df = df.filter(F.lower(quoted(column).cast("string")).contains(contains.lower()))
    return df


LEADING_NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def leading_number(column: str) -> Column:
    """The number that a text begins with, or null."""
    start = F.regexp_extract(quoted(column).cast("string"), LEADING_NUMBER, 1)
    return F.nullif(start, F.lit("")).try_cast("double")


def numeric_first_order(column: str, descending: bool = False) -> list[Column]:
    """Sort keys: texts that begin with a number first, by that number, then the rest as text. A total order."""
    number = leading_number(column)
    if descending:
        return [number.desc_nulls_last(), quoted(column).desc()]
    return [number.asc_nulls_last(), quoted(column).asc()]


def split_by_side(definitions: DataFrame, side: str = "field") -> tuple[DataFrame, DataFrame]:
    """Source rows and target rows of one definitions table."""
    return definitions.filter(F.col(side) == "Source"), definitions.filter(F.col(side) == "Target")
