"""Mapping memory over the part catalogues: skip rules, manual mappings, synonyms, fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.operators import catalog, decision, match, memory
from tablehaul.plans import catalogues, matching
from tablehaul.plans.registry import query
from tablehaul.session import cut_lineage

BY = ["object", "variant"]

# Rules that follow from the names: old parts are skipped, red ones mapped by hand, some objects
# have their own rule, gears a second one.
MEMORY = (
    catalogues.BOTH
    + """,
n AS (SELECT *, upper(w1) || '_' || upper(w2) AS source_field FROM names),
skip_rules AS (
  SELECT DISTINCT 0 AS level, NULL AS object, NULL AS variant, 1 AS position, source_field, 'legacy ' || w2 AS source_description, w2 <> 'rod' AS skip, 'global ' || w1 AS comment FROM n WHERE w1 IN ('old', 'new')
  UNION ALL SELECT DISTINCT 0, NULL, NULL, 2, source_field, 'second ' || w2, true, 'again ' || w1 FROM n WHERE w1 IN ('old', 'new') AND w2 = 'gear'
  UNION ALL SELECT 1, object, variant, 3, source_field, 'local ' || w2, low > 5, 'here ' || w1 FROM n WHERE w1 = 'old' AND high > 10),
manual_rules AS (
  SELECT DISTINCT 0 AS level, NULL AS object, NULL AS variant, 1 AS position, source_field, 'the ' || name || ' part' AS source_description, name AS target, w2 AS target_description, 'by hand ' || w1 AS comment FROM n WHERE w1 IN ('red', 'old')
  UNION ALL SELECT 1, object, variant, 2, source_field, 'our ' || name || ' here', 'hot ' || w2, w1, 'by hand here' FROM n WHERE w1 IN ('red', 'blue') AND high > 20),
syn_rules AS (SELECT DISTINCT upper(w2) AS target, w2 AS variant, CASE w2 WHEN 'gizmo' THEN 1 WHEN 'anvil' THEN 2 ELSE 3 END AS position FROM n WHERE w2 IN ('gizmo', 'anvil', 'bolt')),
eff_skip AS (SELECT s.object, s.variant, s.field_name, arg_max({'d': source_description, 'k': skip, 'c': r.comment}, level * 10 + position) AS r
  FROM sources s JOIN skip_rules r ON r.source_field = s.field_name AND (level = 0 OR (r.object = s.object AND r.variant = s.variant)) GROUP BY 1, 2, 3),
eff_active AS (SELECT s.object, s.variant, s.field_name, arg_max({'d': source_description, 'c': r.comment}, level * 10 + position) AS r
  FROM sources s JOIN skip_rules r ON r.source_field = s.field_name AND (level = 0 OR (r.object = s.object AND r.variant = s.variant)) WHERE skip GROUP BY 1, 2, 3),
eff_manual AS (SELECT s.object, s.variant, s.field_name, arg_max({'d': source_description, 't': target, 'td': target_description, 'c': r.comment}, level * 10 + position) AS r
  FROM sources s JOIN manual_rules r ON r.source_field = s.field_name AND (level = 0 OR (r.object = s.object AND r.variant = s.variant)) GROUP BY 1, 2, 3)"""
)


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogues.names(spark, sf_dir).withColumn("source_field", F.concat_ws("_", F.upper("w1"), F.upper("w2")))


def _rules(rows: DataFrame, level: int, position: int, **columns) -> DataFrame:
    none = F.lit(None).cast("string")
    where = [F.col(c) if level else none.alias(c) for c in BY]
    out = rows.select(
        F.lit(level).alias("level"), *where, F.lit(position).alias("position"), "source_field", *[v.alias(k) for k, v in columns.items()]
    )
    return out if level else out.distinct()


def skip_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _named(spark, sf_dir)
    w1, w2 = F.col("w1"), F.col("w2")
    both = n.filter(w1.isin("old", "new"))
    told = lambda word, rest: F.concat(F.lit(word), rest)
    first = _rules(both, 0, 1, source_description=told("legacy ", w2), skip=w2 != "rod", comment=told("global ", w1))
    second = _rules(both.filter(w2 == "gear"), 0, 2, source_description=told("second ", w2), skip=F.lit(True), comment=told("again ", w1))
    own = n.filter((w1 == "old") & (F.col("high") > 10))
    local = _rules(own, 1, 3, source_description=told("local ", w2), skip=F.col("low") > 5, comment=told("here ", w1))
    return first.unionByName(second).unionByName(local)


def manual_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _named(spark, sf_dir)
    w1, w2, name = F.col("w1"), F.col("w2"), F.col("name")
    wide = _rules(
        n.filter(w1.isin("red", "old")), 0, 1, source_description=F.concat(F.lit("the "), name, F.lit(" part")),
        target=name, target_description=w2, comment=F.concat(F.lit("by hand "), w1),
    )
    local = _rules(
        n.filter(w1.isin("red", "blue") & (F.col("high") > 20)), 1, 2, source_description=F.concat(F.lit("our "), name, F.lit(" here")),
        target=F.concat(F.lit("hot "), w2), target_description=w1, comment=F.lit("by hand here"),
    )
    return wide.unionByName(local)


def synonym_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    w2 = F.col("w2")
    n = catalogues.names(spark, sf_dir).filter(w2.isin("gizmo", "anvil", "bolt"))
    place = F.when(w2 == "gizmo", 1).when(w2 == "anvil", 2).otherwise(3)
    return n.select(F.upper(w2).alias("target"), w2.alias("variant"), place.alias("position")).distinct()


@query(
    "enrich_descriptions",
    f"""WITH {MEMORY} SELECT object, variant, field_name, ordinal, coalesce(a.r.d, m.r.d, description) AS description
    FROM sources LEFT JOIN eff_skip a USING (object, variant, field_name) LEFT JOIN eff_manual m USING (object, variant, field_name)""",
)
def enrich_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = memory.describe_from_memory(catalogues.sources(spark, sf_dir), skip_rules(spark, sf_dir), manual_rules(spark, sf_dir))
    return out.select(*BY, "field_name", "ordinal", "description")


@query("rule_priority", f"WITH {MEMORY} SELECT object, variant, field_name AS source_field, r.t AS target, r.c AS comment FROM eff_manual")
def rule_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = catalogues.sources(spark, sf_dir).withColumnRenamed("field_name", "source_field")
    return memory.effective_rules(manual_rules(spark, sf_dir), fields, ["target", "comment"])


@query(
    "skipped_fields",
    f"""WITH {MEMORY} SELECT object, variant, field_name, description, CAST(1 AS DOUBLE) AS confidence, 'central_skip' AS match_type,
    'Central memory skip rule: ' || r.c AS reason FROM sources JOIN eff_active USING (object, variant, field_name)""",
)
def skipped_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.skip_fields(catalogues.sources(spark, sf_dir), skip_rules(spark, sf_dir))[1]


@query(
    "manual_matches",
    f"""WITH {MEMORY} SELECT object, variant, field_name, r.t AS target_field, r.td AS target_description, CAST(1 AS DOUBLE) AS confidence,
    'Central memory manual mapping: ' || r.c AS reason FROM sources JOIN eff_manual USING (object, variant, field_name) ANTI JOIN eff_active USING (object, variant, field_name)""",
)
def manual_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = memory.skip_fields(catalogues.sources(spark, sf_dir), skip_rules(spark, sf_dir))
    _, hits = memory.apply_manual(kept, manual_rules(spark, sf_dir))
    return hits.select(*BY, "field_name", "target_field", "target_description", "confidence", "reason")


@query(
    "unmapped_context",
    f"""WITH {matching.MATCH}, {MEMORY[len(catalogues.BOTH) + 2:]},
    u AS (SELECT object, variant, source_header AS field_name FROM s WHERE NOT EXISTS
      (SELECT 1 FROM matched m WHERE m.object = s.object AND m.variant = s.variant AND m.source_header = s.source_header))
    SELECT object, variant, field_name, CASE WHEN a.r IS NOT NULL THEN a.r.d WHEN m.r IS NOT NULL THEN m.r.d END AS description,
    CAST(CASE WHEN a.r IS NOT NULL THEN 1 WHEN m.r IS NOT NULL THEN 0 END AS DOUBLE) AS confidence,
    CASE WHEN a.r IS NOT NULL THEN 'Global skip field configured in central mapping memory' WHEN m.r IS NOT NULL THEN 'Manual mapping configured but target not found' END AS rationale,
    CASE WHEN a.r IS NOT NULL THEN a.r.c WHEN m.r IS NOT NULL THEN m.r.c END AS comment, CASE WHEN a.r IS NULL THEN m.r.t END AS target_field
    FROM u LEFT JOIN eff_active a USING (object, variant, field_name) LEFT JOIN eff_manual m USING (object, variant, field_name)""",
)
def unmapped_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.explain_unused(cut_lineage(matching.unused_sources(spark, sf_dir)), skip_rules(spark, sf_dir), manual_rules(spark, sf_dir))


@query(
    "fallback_names",
    f"""WITH {MEMORY},
    q AS (SELECT *, starts_with(field_name, 'Column') AS unclear FROM sources),
    g AS (SELECT q.object, q.variant, ordinal, min({{'t': target, 'c': r.comment}}) AS g FROM q JOIN manual_rules r ON r.level = 0 AND contains(upper(r.source_description), upper(example)) WHERE unclear GROUP BY ALL),
    l AS (SELECT q.object, q.variant, ordinal, min({{'t': target, 'c': r.comment}}) AS l FROM q JOIN manual_rules r ON r.level = 1 AND r.object = q.object AND r.variant = q.variant AND contains(upper(r.source_description), upper(example)) WHERE unclear GROUP BY ALL),
    y AS (SELECT q.object, q.variant, ordinal, min({{'p': position, 't': target, 'v': r.variant}}) AS y FROM q JOIN syn_rules r ON contains(lower(example), lower(r.variant)) WHERE unclear GROUP BY ALL)
    SELECT object, variant, ordinal, CASE WHEN unclear THEN coalesce(g.t, l.t, y.t, field_name) ELSE field_name END AS field_name,
    CASE WHEN NOT unclear THEN description WHEN g IS NOT NULL THEN 'Global fallback: ' || g.c WHEN l IS NOT NULL THEN 'Table fallback: ' || l.c
      WHEN y IS NOT NULL THEN 'Synonym fallback: matched ''' || y.v || '''' ELSE 'field_name onbekend - geen match in global mapping' END AS description,
    CASE WHEN NOT unclear THEN NULL WHEN g IS NOT NULL THEN 'global_manual_mapping' WHEN l IS NOT NULL THEN 'table_specific_mapping' WHEN y IS NOT NULL THEN 'synonyms' ELSE 'unknown_fallback' END AS fallback
    FROM q LEFT JOIN g USING (object, variant, ordinal) LEFT JOIN l USING (object, variant, ordinal) LEFT JOIN y USING (object, variant, ordinal)""",
)
def fallback_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = memory.name_unclear_headers(catalogues.sources(spark, sf_dir), manual_rules(spark, sf_dir), synonym_rules(spark, sf_dir))
    return out.select(*BY, "ordinal", "field_name", "description", "fallback")


DECISION = f"""{matching.MATCH}, {MEMORY[len(catalogues.BOTH) + 2:]},
    hits2 AS (SELECT object, variant, source_header AS field_name, target_field FROM matched WHERE stage = 'exact')"""


@query(
    "decision_table",
    f"""WITH {DECISION},
    decided AS (
      SELECT object, variant, field_name, target_field, 'mapped' AS status, 1 AS confidence, 'Exact field match' AS rationale FROM hits2
      UNION ALL SELECT object, variant, field_name, r.t, 'manual', 1, 'Manual mapping from central memory' FROM eff_manual ANTI JOIN hits2 USING (object, variant, field_name)
      UNION ALL SELECT object, variant, field_name, '', 'skipped', 1, 'Central memory skip rule: ' || r.c FROM eff_active)
    SELECT object, variant, field_name AS source_field, target_field, status, CAST(confidence AS DOUBLE) AS confidence, rationale FROM decided
    UNION ALL SELECT object, variant, field_name, '', 'pending', 0.0, 'Geen geschikte match gevonden' FROM sources
    WHERE NOT EXISTS (SELECT 1 FROM decided d WHERE d.object = sources.object AND d.variant = sources.variant AND d.field_name = sources.field_name)""",
)
def decision_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = catalogues.sources(spark, sf_dir)
    _, skipped = memory.skip_fields(sources, skip_rules(spark, sf_dir))
    _, manual = memory.apply_manual(sources, manual_rules(spark, sf_dir))
    exact = match.match_targets(sources, catalogues.targets(spark, sf_dir), fuzzy=False).filter(F.col("source_header").isNotNull())
    rows = exact.select(*BY, F.col("source_header").alias("source_field"), "target_field", "confidence")
    return decision.decision_table(sources, rows, manual, skipped)


@query(
    "conflicts",
    f"""WITH {DECISION} SELECT m.object, m.variant, h.target_field, m.field_name AS manual_source, h.field_name AS exact_source
    FROM eff_manual m JOIN hits2 h ON h.object = m.object AND h.variant = m.variant AND h.target_field = upper(m.r.t) AND h.field_name <> m.field_name""",
)
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = catalogues.sources(spark, sf_dir)
    _, manual = memory.apply_manual(sources, manual_rules(spark, sf_dir))
    exact = match.match_targets(sources, catalogues.targets(spark, sf_dir), fuzzy=False).filter(F.col("source_header").isNotNull())
    rows = exact.select(*BY, F.col("source_header").alias("source_field"), "target_field")
    return decision.conflicts(manual.withColumn("target_field", F.upper("target_field")), rows)


@query(
    "decision_record",
    f"""WITH {DECISION.replace("hits2 AS (SELECT object, variant, source_header AS field_name, target_field FROM matched WHERE stage = 'exact')",
      "hits2 AS (SELECT object, variant, source_header AS field_name, target_field, confidence FROM matched WHERE source_header IS NOT NULL)")},
    decided AS (
      SELECT object, variant, field_name, target_field, 'mapped' AS status, confidence, 'Exact field match' AS rationale, NULL AS own FROM hits2
      UNION ALL SELECT object, variant, field_name, r.t, 'manual', 1, 'Manual mapping from central memory', r.td FROM eff_manual ANTI JOIN hits2 USING (object, variant, field_name)
      UNION ALL SELECT object, variant, field_name, '', 'skipped', 1, 'Central memory skip rule: ' || r.c, NULL FROM eff_active),
    all_rows AS (SELECT * FROM decided UNION ALL SELECT object, variant, field_name, '', 'pending', 0.0, 'Geen geschikte match gevonden', NULL FROM sources
      WHERE NOT EXISTS (SELECT 1 FROM decided d WHERE d.object = sources.object AND d.variant = sources.variant AND d.field_name = sources.field_name)),
    told AS (SELECT object, variant, upper(field_name) AS name, arg_min(description, ordinal) AS description FROM targets GROUP BY ALL)
    SELECT a.object, a.variant, a.field_name AS source_field, target_field, status, round(CAST(confidence AS DOUBLE), 6) AS confidence, rationale,
      coalesce(nullif(s.description, ''), 'none') AS source_description,
      CASE WHEN target_field = '' THEN '' ELSE coalesce(nullif(own, ''), t.description, '') END AS target_description
    FROM all_rows a LEFT JOIN sources s ON s.object = a.object AND s.variant = a.variant AND s.field_name = a.field_name
      LEFT JOIN told t ON t.object = a.object AND t.variant = a.variant AND t.name = upper(target_field)""",
)
def decision_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision over matches of all stages, with the descriptions of both sides."""
    sources, targets = catalogues.stored(spark, sf_dir)
    _, skipped = memory.skip_fields(sources, skip_rules(spark, sf_dir))
    _, manual = memory.apply_manual(sources, manual_rules(spark, sf_dir))
    matched = cut_lineage(match.match_targets(sources, targets, catalogues.synonyms(spark, sf_dir)).filter(F.col("source_header").isNotNull()))
    hits = matched.select(*BY, F.col("source_header").alias("source_field"), "target_field", "confidence")
    decided = decision.decision_table(sources, hits, manual, skipped)
    return decision.with_descriptions(decided, sources, targets, manual).withColumn("confidence", F.round("confidence", 6))


@query(
    "catalogue_contracts",
    f"""WITH {MEMORY}
    SELECT 'source' AS contract, object, variant, NULL AS item, 'field_name missing' AS violation FROM sources WHERE starts_with(field_name, 'Column')
    UNION ALL SELECT 'target', object, variant, field_name, 'length not a number' FROM targets WHERE length < 12
    UNION ALL SELECT 'target', object, variant, field_name, 'is_key not a flag' FROM targets WHERE is_key
    UNION ALL SELECT 'mapping', object, variant, field_name, 'confidence out of range' FROM targets WHERE length / 40 > 1
    UNION ALL SELECT 'skip', object, variant, source_field, 'comment missing' FROM skip_rules WHERE position = 2
    UNION ALL SELECT 'manual', object, variant, source_field, 'target missing' FROM manual_rules WHERE level = 1
    UNION ALL SELECT DISTINCT 'list', object, 'NEW', NULL, 'no fields' FROM sources""",
)
def catalogue_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contracts, over catalogues and rules spoilt here and there."""
    sources, targets = catalogues.sources(spark, sf_dir), catalogues.targets(spark, sf_dir)
    bad_sources = sources.withColumn("field_name", F.when(~F.col("field_name").startswith("Column"), F.col("field_name")))
    text = F.col("length").cast("string")
    bad_targets = targets.withColumns({"length": F.when(F.col("length") < 12, "long").otherwise(text), "is_key": F.when(F.col("is_key"), "maybe").otherwise("false")})
    mapping = targets.select(*BY, F.col("field_name").alias("target_field"), (F.col("length") / 40).alias("confidence"))
    skip, manual = skip_rules(spark, sf_dir), manual_rules(spark, sf_dir)
    bad_skip = skip.withColumn("comment", F.when(F.col("position") != 2, F.col("comment")))
    bad_manual = manual.withColumn("target", F.when(F.col("level") != 1, F.col("target")))
    objects = sources.select(*BY).distinct()
    expected = objects.unionByName(objects.select("object", F.lit("NEW").alias("variant")))
    return catalog.contract_violations(bad_sources, bad_targets, mapping, bad_skip, bad_manual, expected)
