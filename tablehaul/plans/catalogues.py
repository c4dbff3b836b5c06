"""Catalogues that follow from the parts: a brand is an object, a type a variant, a name a field.

The source side spells the names as a legacy system might, depending on the smallest size that
occurs for a name, so every kind of match (exact, synonym, similar, none, reused) appears.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablehaul.functions import parsing
from tablehaul.operators import catalog, validate
from tablehaul.operators.project import split_by_side
from tablehaul.operators.rownum import number_within
from tablehaul.plans.registry import query, table
from tablehaul.session import cut_lineage

NAMES = """
names AS (
  SELECT p_brand AS object, p_type AS variant, p_name AS name, min(p_size) AS low, max(p_size) AS high,
    min(p_partkey) AS first_key, count(*) AS parts, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2
  FROM part GROUP BY 1, 2, 3)"""
TARGETS = NAMES + """,
targets AS (
  SELECT object, variant, name AS field_name, w2 || ' ' || w1 || CASE WHEN low > 25 THEN ' total' ELSE '' END AS description,
    lower(variant) AS "table", low <= 15 AS is_mandatory, CASE WHEN low <= 3 THEN 'key' WHEN w1 IN ('hot', 'cold') THEN 'heat' ELSE 'data' END AS field_group,
    low <= 3 AS is_key, 'Field List' AS sheet,
    CASE WHEN high > 40 THEN 'Numeric' WHEN high > 30 THEN 'Date' WHEN high > 20 THEN 'Time' ELSE 'Text' END AS data_type,
    high AS length, CASE WHEN high > 45 THEN 2 END AS decimal,
    CAST(row_number() OVER (PARTITION BY object, variant ORDER BY first_key) AS INT) AS ordinal
  FROM names)"""
HEADERS = """,
headers AS (
  SELECT object, variant,
    CASE WHEN low <= 18 THEN upper(w1) || '_' || upper(w2) WHEN low <= 24 THEN w2 || '_' || w1
         WHEN low <= 30 THEN w1 || w2 || 'nr' WHEN low <= 36 THEN replace(w1, 'l', '') || '-' || w2
         WHEN low <= 40 THEN w2 || w1 ELSE 'Column' || CAST(low AS VARCHAR) END AS field_name,
    min(CASE WHEN low > 9 THEN w2 || ' ' || w1 END) AS description, min(name) AS example
  FROM names GROUP BY 1, 2, 3),
sources AS (SELECT object, variant, field_name, description, example,
  CAST(row_number() OVER (PARTITION BY object, variant ORDER BY field_name) AS INT) AS ordinal FROM headers)"""
BOTH = TARGETS + HEADERS


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    words = F.split("name", " ")
    return part.groupBy(F.col("p_brand").alias("object"), F.col("p_type").alias("variant"), F.col("p_name").alias("name")).agg(
        F.min("p_size").alias("low"), F.max("p_size").alias("high"), F.min("p_partkey").alias("first_key"),
        F.count(F.lit(1)).alias("parts"),
    ).withColumns({"w1": words[0], "w2": words[1]})


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.col("low"), F.col("high")
    order = Window.partitionBy("object", "variant").orderBy("first_key")
    return names(spark, sf_dir).select(
        "object", "variant", F.col("name").alias("field_name"),
        F.concat("w2", F.lit(" "), "w1", F.when(low > 25, " total").otherwise("")).alias("description"),
        F.lower("variant").alias("table"), (low <= 15).alias("is_mandatory"),
        F.when(low <= 3, "key").when(F.col("w1").isin("hot", "cold"), "heat").otherwise("data").alias("field_group"),
        (low <= 3).alias("is_key"), F.lit("Field List").alias("sheet"),
        F.when(high > 40, "Numeric").when(high > 30, "Date").when(high > 20, "Time").otherwise("Text").alias("data_type"),
        high.alias("length"), F.when(high > 45, 2).alias("decimal"), F.row_number().over(order).alias("ordinal"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, w1, w2 = F.col("low"), F.col("w1"), F.col("w2")
    header = (
        F.when(low <= 18, F.concat(F.upper(w1), F.lit("_"), F.upper(w2)))
        .when(low <= 24, F.concat(w2, F.lit("_"), w1))
        .when(low <= 30, F.concat(w1, w2, F.lit("nr")))
        .when(low <= 36, F.concat(F.replace(w1, F.lit("l"), F.lit("")), F.lit("-"), w2))
        .when(low <= 40, F.concat(w2, w1))
        .otherwise(F.concat(F.lit("Column"), low.cast("string")))
    )
    found = names(spark, sf_dir).groupBy("object", "variant", header.alias("field_name")).agg(
        F.min(F.when(low > 9, F.concat(w2, F.lit(" "), w1))).alias("description"), F.min("name").alias("example")
    )
    return catalog.with_ordinal(found, ["object", "variant"], ["field_name"])


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both catalogues as tables, so that matching does not read the parts again for every step."""
    return cut_lineage(sources(spark, sf_dir)), cut_lineage(targets(spark, sf_dir))


def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name that occurs has a variant: its words the other way round."""
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(F.upper("p_name").alias("target"), F.concat(words[1], F.lit("-"), words[0]).alias("variant")).distinct()


@query(
    "derive_rules",
    f"""WITH {TARGETS} SELECT object, variant, upper(field_name) AS field, is_key AS key, is_mandatory OR is_key AS required,
    CASE WHEN upper(data_type) LIKE '%DATE%' THEN 'date' WHEN upper(data_type) LIKE '%TIME%' THEN 'time'
      WHEN upper(data_type) LIKE '%NUM%' OR upper(data_type) LIKE '%DEC%' OR decimal IS NOT NULL THEN 'decimal' ELSE 'string' END AS type,
    length AS max_length, is_key AND NOT is_mandatory AS key_implies_required FROM targets""",
)
def derive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.validation_rules(targets(spark, sf_dir))


@query(
    "derive_transforms",
    f"""WITH {TARGETS} SELECT object, variant, upper(field_name) AS target_field, description, 'direct' AS transformation_type,
    '' AS placeholder_value, 0 AS mappings FROM targets""",
)
def derive_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = catalog.transform_rules(targets(spark, sf_dir))
    return rules.withColumn("mappings", F.size("value_mappings")).drop("value_mappings")


OPERATIONAL = "'flag|status|indicator|control|system|process|update|created|modified|version|lock'"
DERIVED = "'calculated|computed|derived|total|sum|average|balance|amount|percentage|ratio'"


@query(
    "value_rules",
    f"""WITH {TARGETS}, r AS (SELECT *, lower(field_name || ' ' || description) AS t FROM targets)
    SELECT object, variant, field_name, CASE WHEN is_mandatory THEN 'required' WHEN regexp_matches(t, {OPERATIONAL}) THEN 'constant'
      WHEN regexp_matches(t, {DERIVED}) THEN 'derive' ELSE 'map' END AS rule FROM r""",
)
def value_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.value_rules(targets(spark, sf_dir)).select("object", "variant", "field_name", "rule")


@query(
    "quality_rules",
    f"""WITH {TARGETS} SELECT object, variant, field_name, 'primary_key' AS rule_type, 'not_null_unique' AS rule, 'error' AS severity FROM targets WHERE is_key
    UNION ALL SELECT object, variant, field_name, 'required', 'not_null', 'error' FROM targets WHERE is_mandatory
    UNION ALL SELECT object, variant, field_name, 'format', 'valid_date', 'warning' FROM targets WHERE regexp_matches(field_name, 'date|dat|time')""",
)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.quality_rules(targets(spark, sf_dir))


@query(
    "classify_words",
    f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents)
    SELECT word, CASE WHEN regexp_matches(lower(word), 'date|dat|time') THEN 'date' WHEN regexp_matches(lower(word), 'amount|amt|value|val') THEN 'decimal'
      WHEN regexp_matches(lower(word), 'count|number|num|id') THEN 'integer' ELSE 'string' END AS rule_type,
    CASE WHEN regexp_matches(lower(word), 'decimal|number|num') THEN 'decimal' WHEN lower(word) LIKE '%int%' THEN 'int'
      WHEN lower(word) LIKE '%date%' THEN 'date' WHEN lower(word) LIKE '%time%' THEN 'time' ELSE 'string' END AS profile_type,
    regexp_matches(lower(word), {OPERATIONAL}) AS operational, regexp_matches(lower(word), {DERIVED}) AS derived,
    regexp_matches(lower(word), 'flag|flg|ind|control|ctrl|status|state|active|enabled|disabled|lock|freeze|hold|system|process|auto|manual|update|modify|change|create|version|audit|log|track|delete|archive|purge|kennzeichen|merkmal|schalter|sperre')
      OR regexp_full_match(upper(word), '[QWERTYZX]') AS constant FROM w""",
)
def classify_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name classifiers over every word of the documents, as if each were a field name."""
    from tablehaul.functions import classify

    word = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")
    words = table(spark, sf_dir, "documents").select(word).distinct()
    name, none = F.col("word"), F.lit("")
    return words.select(
        "word", classify.type_by_name(name, none).alias("rule_type"), classify.profile_type(name).alias("profile_type"),
        classify.is_operational(name, none).alias("operational"), classify.is_derived(name, none).alias("derived"),
        classify.is_constant(name, none).alias("constant"),
    )


@query("group_distribution", f"""WITH {TARGETS} SELECT object, variant, field_group, count(*) AS fields FROM targets GROUP BY 1, 2, 3""")
def group_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.group_distribution(targets(spark, sf_dir), ["object", "variant"])


@query(
    "catalogue_stats",
    f"""WITH {TARGETS} SELECT object, variant, count(*) AS fields, count(*) FILTER (is_mandatory) AS mandatory, count(*) FILTER (is_key) AS keys,
    count(*) FILTER (is_key) = 10 AS ten_keys FROM targets GROUP BY 1, 2""",
)
def catalogue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalogue_stats(targets(spark, sf_dir), ["object", "variant"])


@query(
    "duplicate_headers",
    """SELECT p_brand, header, count(*) AS columns, CASE WHEN header = '' THEN 'empty' ELSE 'duplicate' END AS problem
    FROM (SELECT p_brand, trim(CASE WHEN p_size > 48 THEN ' ' ELSE p_name END) AS header FROM part) GROUP BY 1, 2 HAVING header = '' OR count(*) > 1""",
)
def duplicate_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as headers of their brand; the largest sizes have lost theirs."""
    header = F.when(F.col("p_size") > 48, " ").otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").select("p_brand", header.alias("field_name"))
    return catalog.header_check(rows, ["p_brand"])


@query(
    "rule_overlay",
    f"""WITH {TARGETS}, base AS (SELECT upper(field_name) AS field, bool_or(is_key) AS key, bool_or(is_mandatory) AS required FROM targets GROUP BY 1),
    over_ AS (SELECT upper(p_type || ' ' || split_part(p_name, ' ', 2)) AS field, true AS key, CASE WHEN max(p_size) > 48 THEN false END AS required FROM part GROUP BY 1
      UNION ALL SELECT upper(p_name), CASE WHEN min(p_size) > 1 THEN false END, max(p_size) > 49 FROM part GROUP BY 1)
    SELECT field, coalesce(o.key, b.key, false) AS key, coalesce(o.required, b.required, false) AS required FROM base b FULL JOIN over_ o USING (field)""",
)
def rule_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = targets(spark, sf_dir).groupBy(F.upper("field_name").alias("field")).agg(
        F.bool_or("is_key").alias("key"), F.bool_or("is_mandatory").alias("required")
    )
    part = table(spark, sf_dir, "part")
    structure = F.upper(F.concat("p_type", F.lit(" "), F.split("p_name", " ")[1]))
    extra = part.groupBy(structure.alias("field")).agg(F.lit(True).alias("key"), F.when(F.max("p_size") > 48, False).alias("required"))
    own = part.groupBy(F.upper("p_name").alias("field")).agg(F.when(F.min("p_size") > 1, False).alias("key"), (F.max("p_size") > 49).alias("required"))
    return validate.overlay_rules(base, extra.unionByName(own))


@query(
    "inconsistent_rules",
    f"WITH {TARGETS} SELECT upper(field_name) AS field, 'key=true but required=false' AS issue FROM targets WHERE is_mandatory AND field_group <> 'key'",
)
def inconsistent_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules whose key flag was set from importance, so most keys are not required."""
    rules = targets(spark, sf_dir).select(F.upper("field_name").alias("field"), F.col("is_mandatory").alias("key"), F.col("is_key").alias("required"))
    return validate.inconsistent_rules(rules)


DICTIONARY = """
dictionary AS (
  SELECT p_partkey AS line, CASE WHEN p_size > 45 THEN p_type ELSE 'S_' || p_type END AS structure,
    CASE WHEN p_size = 50 THEN ' ' ELSE upper(p_name) END AS field, p_brand AS object,
    lpad(CAST(p_size AS VARCHAR), 6, '0') || CASE WHEN p_size = 7 THEN 'x' ELSE '' END AS len,
    CASE WHEN p_size <= 5 THEN ' x ' WHEN p_size = 6 THEN 'no' ELSE '' END AS is_key,
    CASE WHEN p_size < 10 THEN 'Mandatory for all' WHEN p_size < 12 THEN 'X' WHEN p_size < 14 THEN 'yes' ELSE 'Optional' END AS importance
  FROM part)"""


@query(
    "catalog_normalise",
    f"""WITH {DICTIONARY} SELECT object, structure, field, lower(structure[3:]) AS "table", line,
    CASE WHEN regexp_full_match(len, '[0-9]+') THEN CAST(len AS INT) END AS length, upper(trim(is_key)) = 'X' AS is_key,
    lower(importance) LIKE '%mandatory%' OR lower(importance) IN ('x', 'true', '1') AS is_mandatory,
    lower(trim(importance)) IN ('mandatory', 'true', '1', 'yes') AS strict_mandatory,
    structure[3:] || '.' || field AS internal_id, structure || '#' || field AS transformer_id,
    row_number() OVER (PARTITION BY object, structure ORDER BY line) AS ordinal
    FROM dictionary WHERE starts_with(structure, 'S_') AND trim(field) <> ''""",
)
def catalog_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary rows, one per part, brought to catalogue form."""
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("line"), F.when(size > 45, F.col("p_type")).otherwise(F.concat(F.lit("S_"), F.col("p_type"))).alias("structure"),
        F.when(size == 50, " ").otherwise(F.upper("p_name")).alias("field"), F.col("p_brand").alias("object"), F.col("p_type").alias("variant"),
        F.concat(F.lpad(size.cast("string"), 6, "0"), F.when(size == 7, "x").otherwise("")).alias("len"),
        F.when(size <= 5, " x ").when(size == 6, "no").otherwise("").alias("mark"),
        F.when(size < 10, "Mandatory for all").when(size < 12, "X").when(size < 14, "yes").otherwise("Optional").alias("importance"),
    )
    kept = catalog.structure_filter(rows, "structure", "field", F.lower("variant"))
    internal, dotted, hashed = catalog.field_ids(F.col("structure"), F.col("field"))
    out = kept.select(
        "object", "structure", "field", F.lower(internal).alias("table"), "line", parsing.parse_length(F.col("len")).alias("length"),
        parsing.is_marked(F.col("mark")).alias("is_key"), parsing.is_mandatory(F.col("importance")).alias("is_mandatory"),
        parsing.is_mandatory_strict(F.col("importance")).alias("strict_mandatory"), dotted.alias("internal_id"), hashed.alias("transformer_id"),
    )
    return number_within(out, ["object", "structure"], ["line"], "ordinal")


@query(
    "split_sides",
    """SELECT CASE WHEN p_type IN ('LARGE', 'MEDIUM', 'SMALL') THEN 'Source' ELSE 'Target' END AS field, p_brand, p_name, count(*) AS "rows" FROM part WHERE p_type <> 'PROMO' GROUP BY 1, 2, 3""",
)
def split_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One definitions table with a side per row; the two sides are counted separately."""
    kind = F.col("p_type")
    side = F.when(kind == "PROMO", "Note").when(kind.isin("LARGE", "MEDIUM", "SMALL"), "Source").otherwise("Target")
    rows = table(spark, sf_dir, "part").select(side.alias("field"), "p_brand", "p_name")
    source, target = split_by_side(rows)
    count = lambda d: d.groupBy("field", "p_brand", "p_name").agg(F.count(F.lit(1)).alias("rows"))
    return count(source).unionByName(count(target))


@query(
    "registry_upsert",
    """SELECT DISTINCT n_name AS object, 'NATION' AS variant FROM nation WHERE n_regionkey < 3
    UNION SELECT 'NATION_' || CAST(s_nationkey AS VARCHAR), 'NATION' FROM supplier""",
)
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of three regions are registered; suppliers bring the others."""
    label = F.lit("NATION").alias("variant")
    known = table(spark, sf_dir, "nation").filter(F.col("n_regionkey") < 3).select(F.col("n_name").alias("object"), label)
    new = table(spark, sf_dir, "supplier").select(F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("object"), label)
    return catalog.insert_if_absent(known, new, ["object", "variant"])


@query(
    "contract_violations",
    f"""WITH {TARGETS} SELECT object, variant, CASE WHEN length < 48 THEN field_name END AS field_name, 'field_name missing' AS violation FROM targets WHERE length >= 48
    UNION ALL SELECT object, variant, CASE WHEN length < 48 THEN field_name END, 'length not a number' FROM targets WHERE length < 12
    UNION ALL SELECT object, variant, field_name, 'confidence out of range' FROM targets WHERE length / 40 > 1""",
)
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and mapping contracts over catalogues with spoilt names, lengths and confidences."""
    base = targets(spark, sf_dir)
    spoilt = base.withColumns(
        {
            "field_name": F.when(F.col("length") < 48, F.col("field_name")),
            "length": F.when(F.col("length") < 12, "long").otherwise(F.col("length").cast("string")),
        }
    )
    mapping = base.select("object", "variant", F.col("field_name").alias("target_field"), (F.col("length") / 40).alias("confidence"))
    rows = catalog.mapping_violations(mapping).withColumnRenamed("target_field", "field_name")
    return catalog.target_violations(spoilt).unionByName(rows)
