"""Field and value matching over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.functions import text
from tablehaul.functions.thesaurus import thesaurus_rows
from tablehaul.operators import assign, catalog, decision, match, report, simjoin
from tablehaul.plans import catalogues
from tablehaul.plans.registry import query, table
from tablehaul.session import cut_lineage

# --- the measures in SQL, independent of the library's code --------------------------------


def lev_sql(a: str, b: str) -> str:
    return f"""CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0
      ELSE 1.0 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END"""


def jaro_winkler_ctes(pairs: str, out: str) -> str:
    """CTEs from (a, b) pairs to (a, b, lev, jw): one list fold per pair."""
    return f"""
{out}_1 AS (SELECT a, b, greatest(greatest(length(a), length(b)) // 2 - 1, 0) AS w FROM {pairs}),
{out}_2 AS (SELECT a, b, list_reduce(
    list_transform(range(1, length(a) + 1), lambda i: {{'i': i, 'rest': '', 'hits': ''}}),
    lambda s, e: CASE WHEN instr(s.rest[greatest(1, e.i - w):e.i + w], a[e.i]) > 0
      THEN {{'i': e.i, 'rest': s.rest[1:greatest(1, e.i - w) + instr(s.rest[greatest(1, e.i - w):e.i + w], a[e.i]) - 2] || '#'
              || s.rest[greatest(1, e.i - w) + instr(s.rest[greatest(1, e.i - w):e.i + w], a[e.i]):], 'hits': s.hits || a[e.i]}}
      ELSE {{'i': e.i, 'rest': s.rest, 'hits': s.hits}} END,
    {{'i': 0::BIGINT, 'rest': b, 'hits': ''}}) AS f FROM {out}_1),
{out}_3 AS (SELECT a, b, f.hits AS l, array_to_string(list_transform(list_filter(range(1, length(b) + 1), lambda j: f.rest[j] = '#'), lambda j: b[j]), '') AS r FROM {out}_2),
{out}_4 AS (SELECT a, b, length(l) AS m, len(list_filter(range(1, length(l) + 1), lambda k: l[k] <> r[k])) AS t,
    CASE WHEN a[1] = b[1] THEN CASE WHEN a[1:2] = b[1:2] AND least(length(a), length(b)) >= 2 THEN CASE WHEN a[1:3] = b[1:3] AND least(length(a), length(b)) >= 3
      THEN CASE WHEN a[1:4] = b[1:4] AND least(length(a), length(b)) >= 4 THEN 4 ELSE 3 END ELSE 2 END ELSE 1 END ELSE 0 END AS p FROM {out}_3),
{out}_5 AS (SELECT a, b, p, CASE WHEN m = 0 THEN 0.0 ELSE (m / length(a) + m / length(b) + (m - t / 2) / m) / 3 END AS j FROM {out}_4),
{out} AS (SELECT a, b, {lev_sql('a', 'b')} AS lev, j + CAST(0.1 AS DOUBLE) * p * (1 - j) AS jw FROM {out}_5)"""


NORM = "lower(regexp_replace({0}, '[^a-zA-Z0-9]', '', 'g'))"
SPACED = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"

MATCH = (
    f"""{catalogues.BOTH},
s AS (SELECT object, variant, field_name AS source_header, ordinal AS source_ordinal, description AS source_description,
  {SPACED.format('field_name')} AS spaced, {NORM.format('field_name')} AS a FROM sources),
t AS (SELECT object, variant, ordinal AS target_ordinal, lower(field_name) AS t_name, description AS target_description,
  "table" AS target_table, is_mandatory AS required, {NORM.format('field_name')} AS n1, {NORM.format('description')} AS n2 FROM targets),
x1 AS (SELECT object, variant, target_ordinal, arg_min(source_header, source_ordinal) AS source_header, min(source_ordinal) AS source_ordinal
  FROM t JOIN s USING (object, variant) WHERE spaced = t_name GROUP BY 1, 2, 3),
syn AS (SELECT DISTINCT p_name AS t_name, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS spaced FROM part),
x2 AS (SELECT object, variant, target_ordinal, arg_min(source_header, source_ordinal) AS source_header, min(source_ordinal) AS source_ordinal
  FROM t JOIN syn USING (t_name) JOIN s USING (object, variant, spaced) ANTI JOIN x1 USING (object, variant, target_ordinal) GROUP BY 1, 2, 3),
rest AS (SELECT * FROM t ANTI JOIN x1 USING (object, variant, target_ordinal) ANTI JOIN x2 USING (object, variant, target_ordinal)),
p AS (SELECT DISTINCT a, b FROM (SELECT a, unnest([n1, n2]) AS b FROM rest JOIN s USING (object, variant))),"""
    + jaro_winkler_ctes("p", "scores")
    + """,
cand AS (SELECT object, variant, target_ordinal, t_name, source_header, source_ordinal, required, max(greatest(lev, jw)) AS score
  FROM rest JOIN s USING (object, variant) JOIN scores USING (a) WHERE scores.b IN (n1, n2) GROUP BY ALL),
kept AS (SELECT *, list_max(list_transform(flatten(list_transform(range(1, length(source_header) + 1), lambda i:
    list_transform(range(i, length(source_header) + 1), lambda k: lower(source_header)[i:k]))), lambda u: CASE WHEN contains(t_name, u) THEN length(u) ELSE 0 END)) AS lcs
  FROM cand WHERE score >= 0.85 OR (required AND score >= 0.8)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY object, variant, target_ordinal ORDER BY score DESC, lcs DESC, length(source_header), source_ordinal) AS rk FROM kept),
x3 AS (SELECT object, variant, target_ordinal, max(source_header) FILTER (rk = 1) AS source_header, max(source_ordinal) FILTER (rk = 1) AS source_ordinal,
  max(score) FILTER (rk = 1) AS score, max(score) FILTER (rk = 2) AS runner_up FROM ranked WHERE rk <= 2 GROUP BY 1, 2, 3),
hits AS (SELECT *, 1.0 AS score, NULL AS runner_up, 'exact' AS stage FROM x1 UNION ALL SELECT *, 0.95, NULL, 'synonym' FROM x2 UNION ALL SELECT *, 'fuzzy' FROM x3),
matched AS (SELECT t.object, t.variant, t.target_ordinal, upper(t_name) AS target_field, h.source_header, coalesce(h.source_header, 'field_name onbekend') AS source_field,
  target_description, coalesce(s.source_description, 'none') AS source_description, target_table, required,
  CASE WHEN h.source_header IS NULL THEN 'unmapped' ELSE 'auto' END AS status, coalesce(score, 0.0) AS confidence, runner_up, stage,
  CASE stage WHEN 'exact' THEN 'Exact field name match' WHEN 'synonym' THEN 'Matched via synonym definition'
    WHEN 'fuzzy' THEN 'Fuzzy match with ' || printf('%.0f', score * 100) || '% confidence' || CASE WHEN score >= 0.85 THEN '' ELSE ' (mandatory field)' END
    ELSE 'Added without source match, to comply with SAP template' END AS rationale
  FROM t LEFT JOIN hits h USING (object, variant, target_ordinal) LEFT JOIN s ON s.object = t.object AND s.variant = t.variant AND s.source_header = h.source_header)"""
)


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, targets = catalogues.stored(spark, sf_dir)
    return match.match_targets(sources, targets, catalogues.synonyms(spark, sf_dir))


@query(
    "match_fields",
    f"""WITH {MATCH} SELECT object, variant, target_ordinal, target_field, source_header, source_field, target_description, source_description,
    target_table, status, round_even(confidence, 2) AS confidence, rationale FROM matched""",
)
def match_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.mapping_table(_matched(spark, sf_dir))


@query(
    "match_exact",
    f"WITH {MATCH} SELECT object, variant, target_field, source_header FROM matched WHERE stage = 'exact'",
)
def match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    only = match.match_targets(catalogues.sources(spark, sf_dir), catalogues.targets(spark, sf_dir), fuzzy=False)
    return only.filter(F.col("source_header").isNotNull()).select("object", "variant", "target_field", "source_header")


@query(
    "match_synonym",
    f"WITH {MATCH} SELECT object, variant, target_field, source_header FROM matched WHERE stage = 'synonym'",
)
def match_synonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = match.match_targets(
        catalogues.sources(spark, sf_dir), catalogues.targets(spark, sf_dir), catalogues.synonyms(spark, sf_dir), fuzzy=False
    )
    return all_.filter(F.col("rationale") == match.SYNONYM).select("object", "variant", "target_field", "source_header")


@query(
    "match_similar",
    f"""WITH {MATCH} SELECT object, variant, target_field, source_header, round(confidence, 6) AS confidence, round(runner_up, 6) AS runner_up
    FROM matched WHERE stage = 'fuzzy'""",
)
def match_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _matched(spark, sf_dir).filter(F.col("rationale").startswith("Fuzzy"))
    return rows.select("object", "variant", "target_field", "source_header", F.round("confidence", 6).alias("confidence"), F.round("runner_up", 6).alias("runner_up"))


REUSED = """reused AS (SELECT * FROM matched WHERE source_header IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY object, variant, source_header ORDER BY target_ordinal) > 1)"""


@query(
    "audit_list",
    f"""WITH {MATCH}, {REUSED}
    SELECT object, variant, target_field, source_header, round(confidence, 6) AS confidence, 'tie_break' AS reason FROM matched WHERE abs(confidence - runner_up) <= 0.02
    UNION ALL SELECT object, variant, target_field, source_header, round(confidence, 6), 'low_confidence_fuzzy' FROM matched WHERE confidence >= 0.8 AND confidence < 0.9
    UNION ALL SELECT object, variant, target_field, source_header, confidence, 'synonym_based' FROM matched WHERE stage = 'synonym'
    UNION ALL SELECT object, variant, target_field, NULL, 0.0, 'required_unmapped' FROM matched WHERE source_header IS NULL AND required
    UNION ALL SELECT object, variant, target_field, source_header, round_even(confidence, 2), 'reused_source' FROM reused""",
)
def audit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = match.audit_list(_matched(spark, sf_dir))
    return audit.select("object", "variant", "target_field", "source_header", F.round("confidence", 6).alias("confidence"), "reason")


@query("reused_sources", f"WITH {MATCH}, {REUSED} SELECT object, variant, target_field, source_header FROM reused")
def reused_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.reused_sources(_matched(spark, sf_dir)).select("object", "variant", "target_field", "source_header")


@query(
    "unused_sources",
    f"""WITH {MATCH} SELECT object, variant, source_header AS field_name FROM s
    WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.object = s.object AND m.variant = s.variant AND m.source_header = s.source_header)""",
)
def unused_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.unused_sources(catalogues.sources(spark, sf_dir), _matched(spark, sf_dir)).select("object", "variant", "field_name")


@query("unmatched_targets", f"WITH {MATCH} SELECT object, variant, target_table, target_field, required FROM matched WHERE source_header IS NULL")
def unmatched_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.unmatched_targets(_matched(spark, sf_dir)).drop("target_ordinal")


@query(
    "coverage",
    f"""WITH {MATCH}, u AS (SELECT object, variant, count(*) AS unused FROM s
      WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.object = s.object AND m.variant = s.variant AND m.source_header = s.source_header) GROUP BY 1, 2)
    SELECT object, variant, count(*) AS targets, count(source_header) AS mapped, count(*) - count(source_header) AS unmapped,
    round_even(count(source_header) / count(*) * 100, 2) AS coverage_pct, coalesce(max(unused), 0) AS unused_sources FROM matched LEFT JOIN u USING (object, variant) GROUP BY 1, 2""",
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = cut_lineage(_matched(spark, sf_dir))  # counted from both sides
    return match.coverage(matched, match.unused_sources(catalogues.sources(spark, sf_dir), matched))


@query(
    "mapping_figures",
    f"""WITH {MATCH}, u AS (SELECT count(*) AS n FROM s WHERE NOT EXISTS
      (SELECT 1 FROM matched m WHERE m.object = s.object AND m.variant = s.variant AND m.source_header = s.source_header)),
    c AS (SELECT count(*) AS t, count(source_header) AS m FROM matched)
    SELECT unnest([{{'position': 1, 'label': 'Mapped', 'value': CAST(m AS VARCHAR)}}, {{'position': 2, 'label': 'Unmapped', 'value': CAST(t - m AS VARCHAR)}},
      {{'position': 3, 'label': 'Unused Sources', 'value': CAST(n AS VARCHAR)}}, {{'position': 4, 'label': 'Unused Targets', 'value': CAST(t - m AS VARCHAR)}},
      {{'position': 5, 'label': 'Coverage', 'value': printf('%.1f', m / t * 100) || '%'}}], recursive := true) FROM c, u""",
)
def mapping_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.mapping_figures(coverage(spark, sf_dir))


@query(
    "index_figures",
    f"""WITH {catalogues.BOTH} SELECT unnest([{{'position': 1, 'label': 'Total Fields', 'value': CAST(count(*) AS VARCHAR)}},
      {{'position': 2, 'label': 'Mandatory', 'value': CAST(count(*) FILTER (is_mandatory) AS VARCHAR)}}, {{'position': 3, 'label': 'Keys', 'value': CAST(count(*) FILTER (is_key) AS VARCHAR)}}], recursive := true) FROM targets
    UNION ALL SELECT unnest([{{'position': 1, 'label': 'Total Columns', 'value': CAST(count(*) AS VARCHAR)}}, {{'position': 2, 'label': 'Duplicates', 'value': '0'}},
      {{'position': 3, 'label': 'Empty Headers', 'value': '0'}}], recursive := true) FROM sources""",
)
def index_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, targets = catalogues.sources(spark, sf_dir), catalogues.targets(spark, sf_dir)
    problems = catalog.header_check(sources, ["object", "variant"])
    return report.target_figures(targets).unionByName(report.source_figures(sources, problems))


# --- source-centric matching ---------------------------------------------------------------

DESC = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
THESAURUS = "words(term, concept) AS (VALUES " + ", ".join(f"('{t}', '{c}')" for t, c in thesaurus_rows()) + ")"
WEIGHTED = "0.5 * lev + 0.5 * jw"


def _thesaurus_names(spark: SparkSession, sf_dir: str, place, name: str) -> DataFrame:
    """For every brand and kind of part the terms whose places in the thesaurus are its sizes."""
    terms = spark.createDataFrame([(t, i) for i, (t, _) in enumerate(sorted(thesaurus_rows()), 1)], f"{name} string, place int")
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("object"), F.col("p_type").alias("variant"), place.alias("place")).distinct()
    return parts.join(terms, "place").select("object", "variant", name).distinct()


@query(
    "thesaurus_matches",
    f"""WITH {THESAURUS}, numbered AS (SELECT term, row_number() OVER (ORDER BY term, concept) AS i FROM words),
    s AS (SELECT DISTINCT p_brand AS object, p_type AS variant, term AS l FROM part JOIN numbered ON i = p_size),
    t AS (SELECT DISTINCT p_brand AS object, p_type AS variant, term AS r FROM part JOIN numbered ON i = 51 - p_size)
    SELECT object, variant, l, r FROM s JOIN t USING (object, variant)
    WHERE l = r OR EXISTS (SELECT 1 FROM words x JOIN words y USING (concept) WHERE x.term = l AND y.term = r)""",
)
def thesaurus_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field names taken from the thesaurus, matched with those of the same object that mean the same."""
    left, right = _thesaurus_names(spark, sf_dir, F.col("p_size"), "l"), _thesaurus_names(spark, sf_dir, 51 - F.col("p_size"), "r")
    return left.join(match.thesaurus_pairs(left, right, "l", "r"), "l").join(right, ["object", "variant", "r"]).select("object", "variant", "l", "r")


def _described_sql() -> str:
    return (
        f"""{catalogues.BOTH}, {THESAURUS},
s AS (SELECT object, variant, ordinal AS source_ordinal, field_name AS source_field, {NORM.format('field_name')} AS sn, coalesce(description, '') AS sd FROM sources),
t AS (SELECT object, variant, ordinal AS target_ordinal, field_name AS target_field, {NORM.format('field_name')} AS tn, description AS td FROM targets),
e AS (SELECT object, variant, source_ordinal, target_ordinal, target_field, CASE WHEN sd <> '' AND sd = td THEN 1.0 ELSE 0.95 END AS confidence, 'exact' AS match_type
  FROM s JOIN t USING (object, variant) WHERE sn = tn QUALIFY row_number() OVER (PARTITION BY object, variant, source_ordinal ORDER BY target_ordinal) = 1),
rest AS (SELECT * FROM s ANTI JOIN e USING (object, variant, source_ordinal)),
free AS (SELECT * FROM t ANTI JOIN e USING (object, variant, target_ordinal)),
taken AS (SELECT * FROM t SEMI JOIN e USING (object, variant, target_ordinal)),
p AS (SELECT DISTINCT a, b FROM (SELECT sn AS a, tn AS b FROM rest JOIN t USING (object, variant) UNION ALL SELECT sd, td FROM rest JOIN free USING (object, variant) WHERE sd <> '')),"""
        + jaro_winkler_ctes("p", "scores")
        + f""",
w AS (SELECT a, b, {WEIGHTED} AS score FROM scores),
c AS (SELECT object, variant, source_ordinal, target_ordinal, target_field,
    CASE WHEN sd <> '' AND td <> '' THEN 0.7 * n.score + 0.3 * d.score ELSE n.score END AS confidence,
    EXISTS (SELECT 1 FROM words x JOIN words y USING (concept) WHERE x.term = sn AND y.term = tn) AS syn
  FROM rest JOIN free USING (object, variant) JOIN w n ON n.a = sn AND n.b = tn LEFT JOIN w d ON d.a = sd AND d.b = td),
best AS (SELECT object, variant, source_ordinal, target_ordinal, target_field, CASE WHEN syn THEN 0.85 ELSE confidence END AS confidence, CASE WHEN syn THEN 'synonym' ELSE 'fuzzy' END AS match_type
  FROM c WHERE syn OR confidence >= 0.6
  QUALIFY row_number() OVER (PARTITION BY object, variant, source_ordinal ORDER BY syn DESC, CASE WHEN syn THEN 0 ELSE confidence END DESC, target_ordinal) = 1),
near AS (SELECT object, variant, source_ordinal, source_field, target_field, score AS confidence FROM rest JOIN taken USING (object, variant) JOIN w ON a = sn AND b = tn
  WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY object, variant, source_ordinal ORDER BY score DESC, target_ordinal) = 1),
described AS (SELECT object, variant, source_field, target_field, coalesce(confidence, 0.0) AS confidence, coalesce(match_type, 'geen match') AS match_type
  FROM s LEFT JOIN (SELECT * FROM e UNION ALL SELECT * FROM best) USING (object, variant, source_ordinal))"""
    )


DESCRIBED = _described_sql()


@query("match_described", f"WITH {DESCRIBED} SELECT object, variant, source_field, target_field, round(confidence, 6) AS confidence, match_type FROM described")
def match_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = match.match_described(*catalogues.stored(spark, sf_dir))
    return rows.select("object", "variant", "source_field", "target_field", F.round("confidence", 6).alias("confidence"), "match_type")


@query("match_audit", f"WITH {DESCRIBED} SELECT object, variant, source_field, target_field, round(confidence, 6) AS confidence FROM near")
def match_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, audit = match.match_described(*catalogues.stored(spark, sf_dir))
    return audit.select("object", "variant", "source_field", "target_field", F.round("confidence", 6).alias("confidence"))


LABELS = ["description", "field_name", "field_group"]


ONE_TO_ONE = (
    f"""WITH RECURSIVE {catalogues.BOTH}, {THESAURUS},
s AS (SELECT object, variant, ordinal AS source_ordinal, field_name, {NORM.format('field_name')} AS l FROM sources),
labels AS (SELECT object, variant, ordinal AS target_ordinal, unnest([{{'priority': 0, 'label': description}}, {{'priority': 1, 'label': field_name}}, {{'priority': 2, 'label': field_group}}], recursive := true) FROM targets),
t AS (SELECT *, {NORM.format('label')} AS r FROM labels WHERE coalesce(label, '') <> ''),
named AS (SELECT object, variant, ordinal AS target_ordinal, {NORM.format('field_name')} AS r FROM targets),
p AS (SELECT DISTINCT l AS a, r AS b FROM s JOIN t USING (object, variant) WHERE l <> r),"""
    + jaro_winkler_ctes("p", "scores")
    + f""",
w AS (SELECT a, b, {WEIGHTED} AS score FROM scores UNION ALL SELECT DISTINCT l, r, 1.0 FROM s JOIN t USING (object, variant) WHERE l = r),
exact AS (SELECT object, variant, source_ordinal, max(target_ordinal) AS target_ordinal, 0 AS stage, priority, 1.0 AS score, 'exact' AS method
  FROM s JOIN t USING (object, variant) WHERE lower(field_name) = lower(label) GROUP BY object, variant, source_ordinal, priority),
near AS (SELECT object, variant, source_ordinal, target_ordinal, 1 AS stage, 0 AS priority, max(score) AS score, max_by(method, {{'s': score, 'm': method = 'synonym'}}) AS method FROM (
  SELECT object, variant, source_ordinal, target_ordinal, score, 'fuzzy' AS method FROM s JOIN t USING (object, variant) JOIN w ON a = l AND b = r WHERE score >= 0.6
  UNION ALL SELECT object, variant, source_ordinal, target_ordinal, 0.85, 'synonym' FROM s JOIN named n USING (object, variant)
    WHERE l = n.r OR EXISTS (SELECT 1 FROM words x JOIN words y USING (concept) WHERE x.term = l AND y.term = n.r)) GROUP BY ALL),
choices AS (SELECT *, row_number() OVER (PARTITION BY object, variant, source_ordinal ORDER BY stage, priority, score DESC, target_ordinal) AS choice
  FROM (SELECT * FROM exact UNION ALL SELECT * FROM near)),
turns AS (SELECT object, variant, source_ordinal, list({{'choice': choice, 'target': target_ordinal}} ORDER BY choice) AS likes,
  row_number() OVER (PARTITION BY object, variant ORDER BY source_ordinal) AS turn FROM choices GROUP BY object, variant, source_ordinal),
walk AS (
  SELECT object, variant, CAST(0 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS source_ordinal, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS choice FROM (SELECT DISTINCT object, variant FROM turns)
  UNION ALL SELECT object, variant, turn, source_ordinal, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick.target) END, pick.choice FROM (
    SELECT k.object, k.variant, t.turn, CAST(t.source_ordinal AS BIGINT) AS source_ordinal, k.taken, list_filter(t.likes, lambda c: NOT list_contains(k.taken, c.target))[1] AS pick
    FROM walk k JOIN turns t ON t.object = k.object AND t.variant = k.variant AND t.turn = k.turn + 1))
SELECT object, variant, source_ordinal, choice, target_ordinal, stage, priority, round(score, 6) AS score, method FROM choices JOIN walk USING (object, variant, source_ordinal, choice)"""
)


@query("match_one_to_one", ONE_TO_ONE)
def match_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serial assignment."""
    choices = assign.preferences(*catalogues.stored(spark, sf_dir), LABELS)
    return assign.assign_one_to_one(choices).withColumn("score", F.round("score", 6))


# --- matching of values --------------------------------------------------------------------

WORDS = """SELECT DISTINCT lower(regexp_replace(strip_accents(w), '[^a-zA-Z0-9]', '', 'g')) AS {0}
  FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM {1})"""


def _words(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    word = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("word")
    return table(spark, sf_dir, name).select(word).select(text.normalize_name(F.col("word")).alias("word")).distinct()


@query(
    "match_values_edits",
    f"""WITH l AS ({WORDS.format('l', 'conversations')}), r AS ({WORDS.format('r', 'benchmark')})
    SELECT l, r, round(1 - levenshtein(l, r) / greatest(length(l), length(r)), 6) AS score FROM l, r
    WHERE l <> '' AND r <> '' AND abs(length(l) - length(r)) <= 0.2 * greatest(length(l), length(r)) + 1e-9 AND 1 - levenshtein(l, r) / greatest(length(l), length(r)) >= 0.8""",
)
def match_values_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the conversations within edit similarity 0.8 of a benchmark word."""
    left, right = _words(spark, sf_dir, "conversations"), _words(spark, sf_dir, "benchmark")
    pairs = simjoin.similar_by_edits(left, right, "word", "word", 0.8)
    return pairs.select("l", "r", F.round("score", 6).alias("score"))


@query(
    "match_values_names",
    f"""WITH l AS ({WORDS.format('l', 'conversations')}), r AS ({WORDS.format('r', 'benchmark')}),
    p AS (SELECT l AS a, r AS b FROM l, r WHERE l <> r AND length(l) > 0 AND length(r) > 0 AND (
      levenshtein(l, r) <= 0.1 * greatest(length(l), length(r)) + 1e-9
      OR jaro_similarity(l, r) >= CASE WHEN l[1:3] = r[1:3] THEN 0.83 WHEN l[1] = r[1] THEN 0.87 ELSE 0.89 END)),
    {jaro_winkler_ctes('p', 'scores')}
    SELECT a AS l, b AS r, round(greatest(lev, jw), 6) AS score FROM scores WHERE greatest(lev, jw) >= CAST(0.9 AS DOUBLE)
    UNION ALL SELECT l, r, 1.0 FROM l JOIN r ON l = r""",
)
def match_values_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same words under the larger of both measures. In SQL a similarity that is never smaller cuts the pairs first."""
    left, right = _words(spark, sf_dir, "conversations"), _words(spark, sf_dir, "benchmark")
    return simjoin.similar_names(left, right, "word", "word", 0.9).withColumn("score", F.round("score", 6))


@query(
    "normalise_text",
    """SELECT doc_id, lower(regexp_replace(strip_accents(text), '[^a-zA-Z0-9]', '', 'g')) AS name,
    trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS spaced,
    trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '\\s+', ' ', 'g')) AS description FROM documents""",
)
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.normalize_name(t).alias("name"), text.spaced_name(t).alias("spaced"), text.normalize_description(t).alias("description")
    )


# --- decisions -----------------------------------------------------------------------------


@query(
    "residual_targets",
    f"""WITH {MATCH} SELECT object, variant, field_name, 'DERIVED' AS decision, CAST(CASE WHEN k THEN 0.9 ELSE 0.8 END AS DOUBLE) AS confidence,
    CASE WHEN k THEN 'constant_detection' ELSE 'business_logic_required' END AS match_type, CASE WHEN k THEN 'constant' ELSE 'derive' END AS rule
    FROM (SELECT *, regexp_matches(lower(field_name || ' ' || description), 'flag|flg|ind|ctrl|control|stat|active|lock|hold|system|auto|log|track|purge') AS k FROM targets) g
    WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.object = g.object AND m.variant = g.variant AND m.target_field = upper(g.field_name) AND m.source_header IS NOT NULL)""",
)
def residual_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _matched(spark, sf_dir).filter(F.col("source_header").isNotNull())
    used = hits.select("object", "variant", F.lower("target_field").alias("target_field"))
    return decision.residual_targets(catalogues.targets(spark, sf_dir), used)
