"""Source and target catalogues: one table for all objects and variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablehaul.functions import classify, parsing, text

# The column names of three generations of catalogue files, newest first.
SOURCE_NAMES = {
    "field_name": ["source_field", "source_field_name", "field_name"],
    "description": ["source_field_description", "field_description", "description"],
    "example": ["source_example", "example"],
    "ordinal": ["source_field_count", "field_count", "ordinal"],
    "dtype": ["source_dtype", "dtype"],
    "nullable": ["source_nullable", "nullable"],
}
TARGET_NAMES = {
    "field_name": ["target_field", "target_field_name", "sap_field", "field_name"],
    "description": ["target_field_description", "field_description", "description"],
    "table": ["target_table", "sap_table", "table"],
    "is_mandatory": ["target_is_mandatory", "mandatory", "is_mandatory"],
    "field_group": ["target_field_group", "field_group"],
    "is_key": ["target_is_key", "key", "is_key"],
    "sheet": ["target_sheet_name", "sheet_name", "sheet"],
    "data_type": ["target_data_type", "data_type"],
    "length": ["target_length", "length"],
    "decimal": ["target_decimal", "decimal"],
    "ordinal": ["target_field_count", "field_count", "ordinal"],
}
MAPPING_NAMES = {
    "target_field": ["target_field", "target_field_name"],
    "source_header": ["source_header"],
    "source_field": ["source_field_name", "source_field"],
    "confidence": ["map_confidence", "confidence"],
    "status": ["map_status", "status"],
    "rationale": ["map_rationale", "rationale"],
}


def harmonize(df: DataFrame, names: dict[str, list[str]], keep: tuple[str, ...] = ("object", "variant")) -> DataFrame:
    """Bring any generation of column names to the current ones; absent columns become null."""
    columns = [F.col(k) for k in keep if k in df.columns]
    for name, variants in names.items():
        found = [F.col(v) for v in variants if v in df.columns]
        columns.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name))
    return df.select(*columns)


def structure_filter(rows: DataFrame, structure: str, field: str, variant: Column) -> DataFrame:
    """Dictionary rows of one structure: ``S_`` plus the variant, with a field name."""
    return rows.filter(
        F.col(structure).startswith("S_")
        & (F.lower(F.substring(structure, 3, 2**31 - 1)) == F.lower(variant))
        & ~text.is_blank(F.col(field))
    )


def with_ordinal(rows: DataFrame, by: list[str], order_by: list[str], name: str = "ordinal") -> DataFrame:
    """1-based number over kept rows of one dictionary.

    For field lists, whose size is a table's column count; ``number_within`` is for larger groups.
    """
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order_by)))


def field_ids(table: Column, field: Column) -> tuple[Column, Column, Column]:
    """Table without its prefix, ``table.field`` and ``structure#field``."""
    internal = F.regexp_replace(table, "^S_", "")
    return internal, F.concat(internal, F.lit("."), field), F.concat(table, F.lit("#"), field)


def validation_rules(targets: DataFrame) -> DataFrame:
    """Validation rules derived from the target catalogue; a key is always required."""
    return targets.select(
        *[c for c in ("object", "variant") if c in targets.columns],
        F.upper("field_name").alias("field"),
        F.col("is_key").alias("key"),
        (F.col("is_mandatory") | F.col("is_key")).alias("required"),
        classify.rule_type(F.col("data_type"), F.col("decimal")).alias("type"),
        F.col("length").cast("int").alias("max_length"),
        (F.col("is_key") & ~F.col("is_mandatory")).alias("key_implies_required"),
    )


def transform_rules(targets: DataFrame) -> DataFrame:
    """One ``direct`` transform per target field with an empty value table and placeholder."""
    upper = F.upper("field_name")
    described = F.when(F.coalesce("description", F.lit("")) != "", F.col("description"))
    pair = "array<struct<source_value:string,target_value:string>>"
    return targets.select(
        *[c for c in ("object", "variant") if c in targets.columns],
        upper.alias("target_field"),
        F.coalesce(described, F.concat(F.lit("Transform data for "), upper)).alias("description"),
        F.lit("direct").alias("transformation_type"),
        F.lit("").alias("placeholder_value"),
        F.array().cast(pair).alias("value_mappings"),
    )


def value_rules(targets: DataFrame) -> DataFrame:
    """How a target gets its value: required, constant, derive or map."""
    name, description = F.col("field_name"), F.col("description")
    rule = (
        F.when(F.col("is_mandatory"), "required")
        .when(classify.is_operational(name, description), "constant")
        .when(classify.is_derived(name, description), "derive")
        .otherwise("map")
    )
    return targets.withColumn("rule", rule).withColumn("value", F.when(rule == "constant", F.lit(" ")))


def quality_rules(targets: DataFrame) -> DataFrame:
    """Long rule list per field: unique key, not null, valid date."""
    kind = classify.type_by_name(F.col("field_name"), F.col("description"))
    entry = lambda t, r, s: F.struct(F.lit(t).alias("rule_type"), F.lit(r).alias("rule"), F.lit(s).alias("severity"))
    rules = F.array_compact(
        F.array(
            F.when(F.col("is_key"), entry("primary_key", "not_null_unique", "error")),
            F.when(F.col("is_mandatory"), entry("required", "not_null", "error")),
            F.when(kind == "date", entry("format", "valid_date", "warning")),
        )
    )
    return targets.select("object", "variant", "field_name", F.inline(rules))


def transform_plan(targets: DataFrame) -> DataFrame:
    """Fields whose value is constant (operational) or calculated (derived)."""
    name, description = F.col("field_name"), F.col("description")
    kind = F.when(classify.is_operational(name, description), "constant").when(
        classify.is_derived(name, description), "calculated"
    )
    return targets.withColumn("transformation_type", kind).filter(kind.isNotNull())


def group_distribution(targets: DataFrame, by: list[str]) -> DataFrame:
    group = F.coalesce("field_group", F.lit("unknown")).alias("field_group")
    return targets.groupBy(*by, group).agg(F.count(F.lit(1)).alias("fields"))


def catalogue_stats(targets: DataFrame, by: list[str]) -> DataFrame:
    """Fields, mandatory fields and keys per object, and whether there are exactly ten keys."""
    keys = F.count_if("is_key")
    return targets.groupBy(*by).agg(
        F.count(F.lit(1)).alias("fields"),
        F.count_if("is_mandatory").alias("mandatory"),
        keys.alias("keys"),
        (keys == 10).alias("ten_keys"),
    )


def header_check(sources: DataFrame, by: list[str], name: str = "field_name") -> DataFrame:
    """Headers that occur more than once, and empty ones, with their count."""
    header = F.coalesce(text.strip(F.col(name)), F.lit(""))
    counted = sources.groupBy(*by, header.alias("header")).agg(F.count(F.lit(1)).alias("columns"))
    problem = F.when(F.col("header") == "", "empty").when(F.col("columns") > 1, "duplicate")
    return counted.withColumn("problem", problem).filter(problem.isNotNull())


def insert_if_absent(registry: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Registry plus the new entries whose key it lacks, one per key."""
    fresh = new.dropDuplicates(keys).join(registry, keys, "left_anti")
    return registry.unionByName(fresh.select(*registry.columns))


def _violations(df: DataFrame, checks: list[tuple[str, Column]], columns: list[str]) -> DataFrame:
    failed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks]))
    return df.select(*columns, F.explode(failed).alias("violation"))


def source_violations(sources: DataFrame) -> DataFrame:
    """Contract of the source catalogue: every field has a name."""
    return _violations(sources, [("field_name missing", F.col("field_name").isNull())], ["object", "variant", "field_name"])


def target_violations(targets: DataFrame) -> DataFrame:
    """Contract of the target catalogue: a name, whole numbers as length and decimals, and flags that are true or false."""
    flag = lambda c: F.col(c).isNotNull() & F.col(c).cast("string").try_cast("boolean").isNull()
    number = lambda c: F.col(c).isNotNull() & parsing.parse_length(F.col(c).cast("string")).isNull()
    checks = [
        ("field_name missing", F.col("field_name").isNull()),
        ("length not a number", number("length")),
        ("decimal not a number", number("decimal")),
        *[(f"{c} not a flag", flag(c)) for c in ("is_key", "is_mandatory") if c in targets.columns],
    ]
    return _violations(targets, checks, ["object", "variant", "field_name"])


def mapping_violations(mapping: DataFrame) -> DataFrame:
    """Contract of the mapping: confidence between 0 and 1."""
    c = F.col("confidence")
    return _violations(mapping, [("confidence out of range", (c < 0) | (c > 1) | F.isnan(c))], ["object", "variant", "target_field"])


def memory_violations(skip: DataFrame, manual: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Contract of the mapping memory: all texts present, the skip flag set; ``keep`` names further columns of both."""
    absent = lambda names: [(f"{n} missing", F.col(n).isNull()) for n in names]
    kept = [*keep, "source_field"]
    s = _violations(skip, absent(["source_field", "source_description", "skip", "comment"]), kept)
    m = _violations(manual, absent(["source_field", "source_description", "target", "target_description", "comment"]), kept)
    return s.withColumn("list", F.lit("skip")).unionByName(m.withColumn("list", F.lit("manual")))


def empty_catalogues(expected: DataFrame, fields: DataFrame, by: list[str]) -> DataFrame:
    """Objects whose catalogue has no fields at all."""
    return expected.select(*by).distinct().join(fields, by, "left_anti")


def contract_violations(sources: DataFrame, targets: DataFrame, mapping: DataFrame, skip: DataFrame, manual: DataFrame, expected: DataFrame) -> DataFrame:
    """Every broken rule of every contract: ``contract``, ``object``, ``variant``, ``item``, ``violation``.

    ``expected`` lists the (object, variant) that must have a source and a target catalogue. All parts are projections but the
    search for empty catalogues, one anti join each. Nothing found means that all contracts hold.
    """
    by = ["object", "variant"]

    def named(rows: DataFrame, contract: Column, item: Column) -> DataFrame:
        return rows.select(contract.alias("contract"), *by, item.alias("item"), "violation")

    none, told = F.lit(None).cast("string"), F.lit("no fields").alias("violation")
    empty = empty_catalogues(expected, sources, by).unionByName(empty_catalogues(expected, targets, by)).distinct()
    parts = [
        named(source_violations(sources), F.lit("source"), F.col("field_name")),
        named(target_violations(targets), F.lit("target"), F.col("field_name")),
        named(mapping_violations(mapping), F.lit("mapping"), F.col("target_field")),
        named(memory_violations(skip, manual, by), F.col("list"), F.col("source_field")),
        named(empty.select(*by, told), F.lit("list"), none),
    ]
    return reduce(DataFrame.unionByName, parts)
