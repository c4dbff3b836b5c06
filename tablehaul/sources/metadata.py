"""Mapping memory, catalogues and mappings stored as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.operators import catalog

_SKIP = "source_field: string, source_description: string, skip: boolean, comment: string"
_MANUAL = "source_field: string, source_description: string, target: string, target_description: string, comment: string"
_MEMORY = (
    f"synonyms map<string, array<string>>, global_skip_fields array<struct<{_SKIP}>>, "
    f"global_manual_mappings array<struct<{_MANUAL}>>, "
    f"table_specific map<string, struct<skip_fields: array<struct<{_SKIP}>>, manual_mappings: array<struct<{_MANUAL}>>>>"
)


def read_memory(spark: SparkSession, path: str, objects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(skip rules, manual mappings, synonyms) in the form the memory operators take.

    ``objects`` lists (object, variant): an object's rules are stored under ``object_variant``,
    which cannot be split safely where names contain underscores, so keys are joined.
    """
    doc = spark.read.schema(_MEMORY).json(path, multiLine=True)
    known = objects.select("object", "variant", F.concat_ws("_", "object", "variant").alias("__table")).distinct()
    local = doc.select(F.explode("table_specific").alias("__table", "rules")).join(known, "__table")

    def rules(wide: str, own: str) -> DataFrame:
        none = F.lit(None).cast("string")
        first = doc.select(
            F.lit(0).alias("level"), none.alias("object"), none.alias("variant"), F.posexplode(wide).alias("position", "rule")
        )
        second = local.select(F.lit(1).alias("level"), "object", "variant", F.posexplode(f"rules.{own}").alias("position", "rule"))
        return first.unionByName(second).select("level", "object", "variant", "position", "rule.*")

    pairs = doc.select(F.posexplode("synonyms").alias("__at", "target", "variants"))
    synonyms = pairs.select("target", F.posexplode("variants").alias("__in", "variant"), "__at")
    place = F.struct("__at", "__in")
    ordered = synonyms.select("target", "variant", place.alias("position"))
    return (
        rules("global_skip_fields", "skip_fields"),
        rules("global_manual_mappings", "manual_mappings"),
        ordered,
    )


def read_catalogue(spark: SparkSession, paths: str | list[str], fields: str, names: dict[str, list[str]]) -> DataFrame:
    """Catalogue or mapping documents (``metadata`` and a list) of any generation, many at once."""
    docs = spark.read.json(paths, multiLine=True)
    rows = docs.select(
        F.col("metadata.object").alias("object"), F.col("metadata.variant").alias("variant"), F.inline(fields)
    )
    return catalog.harmonize(rows, names)


_PAIRS = "array<struct<source_value: string, target_value: string>>"
_TRANSFORM = (
    "target_field: string, target_field_description: string, transformation_type: string, placeholder_value: string, "
    f"expression: string, value_mappings: {_PAIRS}"
)
_SETTINGS = "null_handling: string, empty_string_handling: string, case_sensitive_mappings: boolean, trim_whitespace: boolean"
_TRANSFORMS = (
    f"metadata struct<object: string, variant: string>, transformations array<struct<{_TRANSFORM}>>, "
    f"transformation_settings struct<{_SETTINGS}>"
)


def write_transform_rules(rules: DataFrame, settings: DataFrame, path: str) -> None:
    """Transform rules (as ``catalog.transform_rules`` gives them) and settings, a document for each object and variant.

    ``settings`` has one row for all, or columns ``object`` and ``variant`` and a row for each. A document is a line of JSON; its
    size follows the number of fields and of the value pairs that stand in the rules. Long value tables stay tables.
    """
    field = lambda c, kind="string": F.col(c) if c in rules.columns else F.lit(None).cast(kind)
    rule = F.struct(
        "target_field", field("description").alias("target_field_description"), "transformation_type", "placeholder_value",
        field("expression").alias("expression"), field("value_mappings", _PAIRS).alias("value_mappings"),
    )
    order = "position" if "position" in rules.columns else "target_field"
    listed = rules.groupBy("object", "variant").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), rule.alias("rule")))).alias("rules"))
    by = [c for c in ("object", "variant") if c in settings.columns]
    given = settings.select(*by, F.struct(*[c for c in settings.columns if c not in by]).alias("transformation_settings"))
    joined = listed.join(given, by, "left") if by else listed.join(F.broadcast(given.limit(1)))
    docs = joined.select(F.struct("object", "variant").alias("metadata"), F.col("rules.rule").alias("transformations"), "transformation_settings")
    docs.write.json(path)


def read_transform_rules(spark: SparkSession, paths: str | list[str], lines: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rules, values, settings) of transform documents, many at once; ``lines`` is false for one document per file.

    Rules keep their order as ``position``; values are the pairs of all rules as a table (target_field, position, source_value,
    target_value); all three carry ``object`` and ``variant``.
    """
    docs = spark.read.schema(_TRANSFORMS).json(paths, multiLine=not lines)
    named = docs.select(F.col("metadata.object").alias("object"), F.col("metadata.variant").alias("variant"), "transformations", "transformation_settings")
    rules = named.select("object", "variant", F.posexplode("transformations").alias("position", "rule")).select("object", "variant", "position", "rule.*")
    values = rules.select("object", "variant", "target_field", F.posexplode("value_mappings").alias("position", "pair"))
    settings = named.select("object", "variant", "transformation_settings.*")
    return rules.drop("value_mappings"), values.select("object", "variant", "target_field", "position", "pair.*"), settings
