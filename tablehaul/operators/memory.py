"""Mapping memory: skip rules, manual mappings and synonyms, global or for one object.

Rule tables carry ``level`` (0 global, 1 object), ``object``, ``variant`` (null when global) and
``position`` (their order). All lookups are equi-joins; Spark sizes them at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.functions import text
from tablehaul.operators.match import BY

NO_MATCH = "field_name onbekend - geen match in global mapping"

# Header names that say nothing, in lower case, and unclear beginnings.
UNCLEAR = ["unknown", "unnamed", "column", "field"]
UNCLEAR_STARTS = ["Column", "Unnamed"]


def effective_rules(rules: DataFrame, objects: DataFrame, columns: list[str]) -> DataFrame:
    """The rule that counts per object and source field: object level over global, later over earlier.

    ``objects`` lists (object, variant, source_field) that are asked for, so a global rule is
    matched to the fields that exist and not multiplied over every object.
    """
    asked = objects.select(*BY, "source_field").distinct()
    value = F.struct(*columns)
    rank = F.struct("level", "position")
    globals_ = rules.filter(F.col("level") == 0).groupBy("source_field").agg(F.max_by(value, rank).alias("g"))
    local = rules.filter(F.col("level") == 1).groupBy(*BY, "source_field").agg(F.max_by(value, rank).alias("o"))
    found = asked.join(globals_, "source_field", "left").join(local, [*BY, "source_field"], "left")
    chosen = F.coalesce("o", "g")
    return found.filter(chosen.isNotNull()).select(*BY, "source_field", chosen.alias("rule")).select(*BY, "source_field", "rule.*")


def _fields(sources: DataFrame) -> DataFrame:
    return sources.select(*BY, F.col("field_name").alias("source_field"))


def describe_from_memory(sources: DataFrame, skip: DataFrame, manual: DataFrame) -> DataFrame:
    """Description from a skip rule, else from a manual mapping, else the field's own."""
    s = effective_rules(skip, _fields(sources), ["source_description"]).withColumnRenamed("source_description", "__s")
    m = effective_rules(manual, _fields(sources), ["source_description"]).withColumnRenamed("source_description", "__m")
    on = [*BY, "field_name"]
    joined = sources.join(s.withColumnRenamed("source_field", "field_name"), on, "left").join(
        m.withColumnRenamed("source_field", "field_name"), on, "left"
    )
    return joined.withColumn("description", F.coalesce("__s", "__m", "description")).drop("__s", "__m")


def skip_fields(sources: DataFrame, skip: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept sources, log of skipped ones); applied before matching when asked for."""
    active = effective_rules(skip.filter(F.col("skip")), _fields(sources), ["comment"]).withColumnRenamed("source_field", "field_name")
    on = [*BY, "field_name"]
    log = sources.join(active, on).select(
        *on, "description", F.lit(1.0).alias("confidence"), F.lit("central_skip").alias("match_type"),
        F.concat(F.lit("Central memory skip rule: "), F.col("comment")).alias("reason"),
    )
    return sources.join(active, on, "left_anti"), log


def apply_manual(sources: DataFrame, manual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining sources, manual matches with confidence 1.0)."""
    rules = effective_rules(manual, _fields(sources), ["target", "target_description", "comment"]).withColumnRenamed("source_field", "field_name")
    on = [*BY, "field_name"]
    matched = sources.join(rules, on).select(
        *on, "ordinal", "description", F.col("target").alias("target_field"), "target_description",
        F.lit(1.0).alias("confidence"), F.lit("central_manual").alias("match_type"),
        F.concat(F.lit("Central memory manual mapping: "), F.col("comment")).alias("reason"),
    )
    return sources.join(rules, on, "left_anti"), matched


def explain_unused(unused: DataFrame, skip: DataFrame, manual: DataFrame) -> DataFrame:
    """Why a source is unused: a skip rule, a manual mapping whose target is absent, or neither."""
    s = effective_rules(skip.filter(F.col("skip")), _fields(unused), ["source_description", "comment"])
    s = s.select(*BY, F.col("source_field").alias("field_name"), F.col("source_description").alias("__sd"), F.col("comment").alias("__sc"), F.lit(True).alias("__s"))
    m = effective_rules(manual, _fields(unused), ["source_description", "comment", "target"])
    m = m.select(*BY, F.col("source_field").alias("field_name"), F.col("source_description").alias("__md"), F.col("comment").alias("__mc"), F.col("target").alias("__mt"), F.lit(True).alias("__m"))
    on = [*BY, "field_name"]
    joined = unused.select(*on).join(s, on, "left").join(m, on, "left")
    is_skip, is_manual = F.col("__s").isNotNull(), F.col("__s").isNull() & F.col("__m").isNotNull()

    def pick(a: Column | None, b: Column | None) -> Column:
        none = F.lit(None)
        return F.when(is_skip, a if a is not None else none).when(is_manual, b if b is not None else none)

    return joined.select(
        *on,
        pick(F.col("__sd"), F.col("__md")).alias("description"),
        pick(F.lit(1.0), F.lit(0.0)).alias("confidence"),
        pick(
            F.lit("Global skip field configured in central mapping memory"),
            F.lit("Manual mapping configured but target not found"),
        ).alias("rationale"),
        pick(F.col("__sc"), F.col("__mc")).alias("comment"),
        pick(None, F.col("__mt")).alias("target_field"),
    )


GRAM = 3


def _grams(text: Column, sizes: Column) -> Column:
    """Distinct pieces of a text of the given sizes; their number grows with the length of the text."""
    pieces = F.transform(
        sizes,
        lambda n: F.when(
            F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
        ).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(F.flatten(pieces))


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (needle, hay) of distinct non-empty strings of which the second contains the first.

    Both frames have one column. A needle meets the texts that hold the rarest of its pieces of
    three characters (of its own length if it is shorter), and is then looked for in them.
    """
    hays = texts.toDF("hay").filter(F.col("hay") != "").distinct()
    sizes = F.array(*(F.lit(n) for n in range(1, GRAM + 1)))
    held = hays.select("hay", F.explode_outer(_grams(F.col("hay"), sizes)).alias("gram"))
    often = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    wanted = needles.toDF("needle").filter(F.col("needle") != "").distinct()
    own = F.array(F.least(F.lit(GRAM), F.length("needle")))
    asked = wanted.select("needle", F.explode_outer(_grams(F.col("needle"), own)).alias("gram")).join(often, "gram", "left")
    rarest = asked.groupBy("needle").agg(F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"))
    return rarest.join(held, "gram").filter(F.contains("hay", "needle")).select("needle", "hay")


def name_unclear_headers(sources: DataFrame, manual: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Names for headers that say nothing, found through the column's example value.

    In order: a global, then an object's manual mapping whose description contains the example;
    then a synonym that the example contains; else the header stays, or becomes
    ``Unknown_Field_n``. *Contains* is decided by ``containing`` on the distinct texts.
    ``synonyms``: target, variant, position.
    """
    name = F.coalesce("field_name", F.lit(""))
    unclear = (text.strip(name) == "") | F.lower(name).isin(UNCLEAR)
    for start in UNCLEAR_STARTS:
        unclear = unclear | name.startswith(start)
    marked = sources.withColumn("__unclear", unclear)
    open_ = marked.filter("__unclear").select(*BY, "ordinal", text.clean(F.col("example")).alias("__example"))
    examples = open_.filter(F.col("__example") != "")

    described = manual.select("level", *BY, "position", "target", "comment", F.upper("source_description").alias("hay"))
    found = containing(examples.select(F.upper("__example")), described.select("hay"))
    rules = described.join(found, "hay").withColumnRenamed("needle", "__part")
    hit = F.struct("position", "target", "comment")
    wide = rules.filter(F.col("level") == 0).groupBy("__part").agg(F.min(hit).alias("__global"))
    local = rules.filter(F.col("level") == 1).groupBy(*BY, "__part").agg(F.min(hit).alias("__local"))
    asked = examples.withColumn("__part", F.upper("__example"))
    by_rule = asked.join(wide, "__part", "left").join(local, [*BY, "__part"], "left").select(*BY, "ordinal", "__global", "__local")

    listed = synonyms.groupBy(F.lower("variant").alias("needle")).agg(F.min(F.struct("position", "target", "variant")).alias("__syn"))
    pieces = containing(listed.select("needle"), examples.select(F.lower("__example"))).withColumnRenamed("hay", "__key")
    by_syn = pieces.join(listed, "needle").groupBy("__key").agg(F.min("__syn").alias("__syn"))
    by_syn = examples.withColumn("__key", F.lower("__example")).join(by_syn, "__key").select(*BY, "ordinal", "__syn")

    on = [*BY, "ordinal"]
    joined = marked.join(by_rule, on, "left").join(by_syn, on, "left")
    target = F.coalesce("__global.target", "__local.target", "__syn.target")
    fallback = F.when(name == "", F.concat(F.lit("Unknown_Field_"), F.col("ordinal").cast("string"))).otherwise(name)
    note = F.coalesce(
        F.concat(F.lit("Global fallback: "), F.col("__global.comment")),
        F.concat(F.lit("Table fallback: "), F.col("__local.comment")),
        F.concat(F.lit("Synonym fallback: matched '"), F.col("__syn.variant"), F.lit("'")),
        F.lit(NO_MATCH),
    )
    via = (
        F.when(F.col("__global").isNotNull(), "global_manual_mapping")
        .when(F.col("__local").isNotNull(), "table_specific_mapping")
        .when(F.col("__syn").isNotNull(), "synonyms")
        .otherwise("unknown_fallback")
    )
    is_unclear = F.col("__unclear")
    kept = [c for c in sources.columns if c not in ("field_name", "description")]
    return joined.select(
        *kept,
        F.when(is_unclear, F.coalesce(target, fallback)).otherwise(F.col("field_name")).alias("field_name"),
        F.when(is_unclear, note).otherwise(F.col("description")).alias("description"),
        F.when(is_unclear, via).alias("fallback"),
    )
