"""Matching target fields to source columns for all objects at once.

``match_targets`` is the live cascade (exact, synonym, similar). Names meet inside their object and
variant only; each distinct pair is scored once, because the same field names recur in thousands of
tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablehaul.functions.similarity import longest_common_substring, weighted_similarity
from tablehaul.functions.text import normalize_description, normalize_name, spaced_name
from tablehaul.functions.thesaurus import thesaurus_table
from tablehaul.operators.simjoin import similar_within

BY = ["object", "variant"]
UNKNOWN = "field_name onbekend"

# Wording of the mapping's rationale.
EXACT = "Exact field name match"
SYNONYM = "Matched via synonym definition"
UNMAPPED = "Added without source match, to comply with SAP template"


@dataclass(frozen=True)
class Thresholds:
    fuzzy: float = 0.85
    mandatory: float = 0.80
    tie: float = 0.02
    low_confidence: float = 0.90


def _sources(sources: DataFrame) -> DataFrame:
    return sources.select(
        *BY,
        F.col("field_name").alias("source_header"),
        F.col("ordinal").alias("source_ordinal"),
        F.col("description").alias("source_description"),
    )


def _targets(targets: DataFrame) -> DataFrame:
    return targets.select(
        *BY,
        F.col("ordinal").alias("target_ordinal"),
        F.lower("field_name").alias("t_name"),
        F.lower(F.coalesce("description", F.lit(""))).alias("t_desc"),
        F.col("description").alias("target_description"),
        F.lower(F.coalesce("table", F.lit(""))).alias("target_table"),
        F.coalesce("is_mandatory", F.lit(False)).alias("required"),
    )


TARGET_KEY = [*BY, "target_ordinal"]


def _first_by_spaced(sources: DataFrame) -> DataFrame:
    """The first header of each object per spaced name."""
    return sources.groupBy(*BY, spaced_name(F.col("source_header")).alias("spaced")).agg(
        F.min_by("source_header", "source_ordinal").alias("source_header"),
        F.min("source_ordinal").alias("source_ordinal"),
    )


def exact_candidates(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Header, spaced and lower, equals the lower target name; the first header counts."""
    first = _first_by_spaced(sources)
    hit = targets.join(first.withColumnRenamed("spaced", "t_name"), [*BY, "t_name"])
    return hit.select(*TARGET_KEY, "source_header", "source_ordinal", F.lit(1.0).alias("score"))


def synonym_candidates(sources: DataFrame, targets: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Header equals a listed variant of the target (``synonyms``: target, variant)."""
    listed = synonyms.select(F.col("target").alias("__target"), spaced_name(F.col("variant")).alias("spaced")).distinct()
    known = targets.join(listed, F.upper("t_name") == F.col("__target")).select(*TARGET_KEY, "spaced")
    hit = known.join(_first_by_spaced(sources), [*BY, "spaced"])
    return hit.groupBy(*TARGET_KEY).agg(
        F.min_by("source_header", "source_ordinal").alias("source_header"),
        F.min("source_ordinal").alias("source_ordinal"),
        F.lit(0.95).alias("score"),
    )


def similar_candidates(sources: DataFrame, targets: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Headers similar to the target's name or description, with the better of both scores."""
    labels = targets.select(
        *TARGET_KEY, "t_name", "required",
        F.explode(F.array_distinct(F.array_compact(F.array(
            F.when(F.col("t_name") != "", normalize_name(F.col("t_name"))),
            F.when(F.col("t_desc") != "", normalize_name(F.col("t_desc"))),
        )))).alias("r"),
    )
    headers = sources.withColumn("l", normalize_name(F.col("source_header")))
    pairs = similar_within(headers, labels, BY, "l", "r", min(limits.fuzzy, limits.mandatory))
    enough = (F.col("score") >= limits.fuzzy) | (F.col("required") & (F.col("score") >= limits.mandatory))
    found = labels.join(pairs, [*BY, "r"]).filter(enough).join(headers, [*BY, "l"])
    return found.groupBy(*TARGET_KEY, "t_name", "source_header", "source_ordinal").agg(F.max("score").alias("score"))


def _best_two(candidates: DataFrame) -> DataFrame:
    """Best candidate per target and the runner-up's score.

    Order: score, longest common substring with the target name, shorter header, source order.
    Only two rows per target survive the rank filter, already before the shuffle.
    """
    shared = longest_common_substring(F.lower("source_header"), F.col("t_name"))
    order = Window.partitionBy(*TARGET_KEY).orderBy(
        F.col("score").desc(), F.col("__lcs").desc(), F.length("source_header"), "source_ordinal"
    )
    ranked = candidates.withColumn("__lcs", shared).withColumn("__rank", F.row_number().over(order))
    first = F.col("__rank") == 1
    return ranked.filter(F.col("__rank") <= 2).groupBy(*TARGET_KEY).agg(
        F.max(F.when(first, F.col("source_header"))).alias("source_header"),
        F.max(F.when(first, F.col("source_ordinal"))).alias("source_ordinal"),
        F.max(F.when(first, F.col("score"))).alias("score"),
        F.max(F.when(~first, F.col("score"))).alias("runner_up"),
    )


def match_targets(
    sources: DataFrame, targets: DataFrame, synonyms: DataFrame | None = None,
    limits: Thresholds = Thresholds(), fuzzy: bool = True,
) -> DataFrame:
    """One row per target with its match, unrounded confidence, status and rationale.

    Targets settled by a cheaper stage do not enter the similarity join.
    """
    s, t = _sources(sources), _targets(targets)
    settled = exact_candidates(s, t).withColumn("stage", F.lit("exact"))
    rest = t.join(settled, TARGET_KEY, "left_anti")
    if synonyms is not None:
        named = synonym_candidates(s, rest, synonyms).withColumn("stage", F.lit("synonym"))
        settled = settled.unionByName(named)
        rest = rest.join(named, TARGET_KEY, "left_anti")
    settled = settled.withColumn("runner_up", F.lit(None).cast("double"))
    if fuzzy:
        close = _best_two(similar_candidates(s, rest, limits)).withColumn("stage", F.lit("fuzzy"))
        settled = settled.unionByName(close)
    described = s.groupBy(*BY, "source_header").agg(F.max_by("source_description", "source_ordinal").alias("source_description"))
    joined = t.join(settled, TARGET_KEY, "left").join(described, [*BY, "source_header"], "left")
    percent = F.format_string("%d%%", F.bround(F.col("score") * 100, 0).cast("int"))
    rationale = (
        F.when(F.col("stage") == "exact", EXACT)
        .when(F.col("stage") == "synonym", SYNONYM)
        .when(F.col("score") >= limits.fuzzy, F.concat(F.lit("Fuzzy match with "), percent, F.lit(" confidence")))
        .when(F.col("stage") == "fuzzy", F.concat(F.lit("Fuzzy match with "), percent, F.lit(" confidence (mandatory field)")))
        .otherwise(UNMAPPED)
    )
    return joined.select(
        *TARGET_KEY,
        F.upper("t_name").alias("target_field"),
        "source_header",
        "source_ordinal",
        F.coalesce("source_header", F.lit(UNKNOWN)).alias("source_field"),
        "target_description",
        F.coalesce(F.when(F.col("source_description") != "", F.col("source_description")), F.lit("none")).alias("source_description"),
        "target_table",
        "required",
        F.when(F.col("source_header").isNotNull(), "auto").otherwise("unmapped").alias("status"),
        F.coalesce("score", F.lit(0.0)).alias("confidence"),
        "runner_up",
        rationale.alias("rationale"),
    )


def mapping_table(matched: DataFrame) -> DataFrame:
    """The mapping as published: confidence with two decimals."""
    return matched.select(
        *TARGET_KEY, "target_field", "source_header", "source_field", "target_description",
        "source_description", "target_table", "status", F.bround("confidence", 2).alias("confidence"), "rationale",
    )


def reused_sources(matched: DataFrame) -> DataFrame:
    """Second and later targets of a source, in target order.

    The first target per source is an aggregate, so a source that serves very many targets is
    not sorted in one task.
    """
    used = matched.filter(F.col("source_header").isNotNull())
    first = used.groupBy(*BY, "source_header").agg(F.min("target_ordinal").alias("__first"))
    return used.join(first, [*BY, "source_header"]).filter(F.col("target_ordinal") > F.col("__first")).drop("__first")


def audit_list(matched: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Rows to look at, one per target and reason."""
    confidence, has = F.col("confidence"), F.col("source_header").isNotNull()
    reasons = F.array_compact(
        F.array(
            F.when(F.col("runner_up").isNotNull() & (F.abs(confidence - F.col("runner_up")) <= limits.tie), "tie_break"),
            F.when(has & (confidence >= 0.80) & (confidence < limits.low_confidence), "low_confidence_fuzzy"),
            F.when(F.col("rationale") == SYNONYM, "synonym_based"),
            F.when(~has & F.col("required"), "required_unmapped"),
        )
    )
    columns = [*TARGET_KEY, "target_table", "target_field", "source_header", "source_field", "confidence"]
    direct = matched.select(*columns, F.explode(reasons).alias("reason"))
    reused = reused_sources(matched).select(
        *columns[:-1], F.bround("confidence", 2).alias("confidence"), F.lit("reused_source").alias("reason")
    )
    return direct.unionByName(reused)


def unused_sources(sources: DataFrame, matched: DataFrame) -> DataFrame:
    used = matched.filter(F.col("source_header").isNotNull()).select(*BY, F.col("source_header").alias("field_name")).distinct()
    return sources.join(used, [*BY, "field_name"], "left_anti")


def unmatched_targets(matched: DataFrame) -> DataFrame:
    return matched.filter(F.col("source_header").isNull()).select(*TARGET_KEY, "target_table", "target_field", "required")


def coverage(matched: DataFrame, unused: DataFrame, by: list[str] = BY) -> DataFrame:
    """Mapped, unmapped, unused sources and % mapped per object, counted separately and joined."""
    mapped = F.count_if(F.col("source_header").isNotNull())
    total = F.count(F.lit(1))
    left = matched.groupBy(*by).agg(
        total.alias("targets"), mapped.alias("mapped"), (total - mapped).alias("unmapped"),
        F.bround(mapped / total * 100, 2).alias("coverage_pct"),
    )
    right = unused.groupBy(*by).agg(F.count(F.lit(1)).alias("unused_sources"))
    return left.join(right, by, "left").fillna(0, ["unused_sources"])


# --- source-centric matching ---------------------------------------------------------------


def thesaurus_pairs(left: DataFrame, right: DataFrame, l: str, r: str) -> DataFrame:
    """Distinct normalised names (l, r) that are equal or belong to one concept."""
    words = thesaurus_table(left.sparkSession)
    a = left.select(F.col(l).alias("l")).distinct()
    b = right.select(F.col(r).alias("r")).distinct()
    concept = a.join(words, F.col("l") == F.col("term")).select("l", "concept")
    other = b.join(words, F.col("r") == F.col("term")).select("r", "concept")
    return concept.join(other, "concept").select("l", "r").unionByName(
        a.join(b, F.col("l") == F.col("r")).select("l", "r")
    ).distinct()


def match_described(
    sources: DataFrame, targets: DataFrame, threshold: float = 0.6,
    levenshtein_weight: float = 0.5, jaro_winkler_weight: float = 0.5, fuzzy: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """One row per source with its best target, and the audit rows.

    Exact names come first and reserve their targets. Then a thesaurus hit (0.85), then the best
    weighted similarity of names (70 %) and, where both exist, descriptions (30 %). A weighted
    mean can reach the threshold only if one of its parts does, so candidates are the pairs whose
    names or whose descriptions are similar enough. The audit holds, for sources without an exact
    match, the most similar target that an exact match has taken.
    """
    s = sources.select(
        *BY, F.col("ordinal").alias("source_ordinal"), F.col("field_name").alias("source_field"),
        normalize_name(F.col("field_name")).alias("s_name"), normalize_description(F.col("description")).alias("s_desc"),
    )
    t = targets.select(
        *BY, F.col("ordinal").alias("target_ordinal"), F.col("field_name").alias("target_field"),
        normalize_name(F.col("field_name")).alias("t_name"), normalize_description(F.col("description")).alias("t_desc"),
    )
    key = [*BY, "source_ordinal"]
    first = t.groupBy(*BY, F.col("t_name").alias("s_name")).agg(
        F.min("target_ordinal").alias("target_ordinal"),
        F.min_by("target_field", "target_ordinal").alias("target_field"),
        F.min_by("t_desc", "target_ordinal").alias("t_desc"),
    )
    same_text = (F.col("s_desc") != "") & (F.col("s_desc") == F.col("t_desc"))
    exact = s.join(first, [*BY, "s_name"]).select(
        *key, "target_ordinal", "target_field", F.when(same_text, 1.0).otherwise(0.95).alias("confidence"), F.lit("exact").alias("match_type")
    )
    rest = s.join(exact, key, "left_anti")
    taken = exact.select(*BY, "target_ordinal").distinct()
    free = t.join(taken, [*BY, "target_ordinal"], "left_anti")

    def score(a: Column, b: Column) -> Column:
        return weighted_similarity(a, b, levenshtein_weight, jaro_winkler_weight)

    out = exact
    audit = exact.limit(0)
    if fuzzy:
        syn = (
            rest.join(thesaurus_pairs(rest, free, "s_name", "t_name").withColumnsRenamed({"l": "s_name", "r": "t_name"}), "s_name")
            .join(free, [*BY, "t_name"])
            .groupBy(*key)
            .agg(F.min("target_ordinal").alias("target_ordinal"), F.min_by("target_field", "target_ordinal").alias("target_field"))
            .select(*key, "target_ordinal", "target_field", F.lit(0.85).alias("confidence"), F.lit("synonym").alias("match_type"))
        )
        open_ = rest.join(syn, key, "left_anti")
        by_name = similar_within(open_, free, BY, "s_name", "t_name", threshold, score).withColumnsRenamed({"l": "s_name", "r": "t_name"})
        name_pairs = open_.join(by_name, [*BY, "s_name"]).join(free, [*BY, "t_name"]).select(*key, "target_ordinal")
        told = open_.filter(F.col("s_desc") != "")
        by_desc = similar_within(told, free.filter(F.col("t_desc") != ""), BY, "s_desc", "t_desc", threshold, score).withColumnsRenamed({"l": "s_desc", "r": "t_desc"})
        desc_pairs = told.join(by_desc, [*BY, "s_desc"]).join(free, [*BY, "t_desc"]).select(*key, "target_ordinal")
        pairs = name_pairs.unionByName(desc_pairs).distinct()
        both = (F.col("s_desc") != "") & (F.col("t_desc") != "")
        name = score(F.col("s_name"), F.col("t_name"))
        total = F.when(both, 0.7 * name + 0.3 * score(F.col("s_desc"), F.col("t_desc"))).otherwise(name)
        scored = pairs.join(open_, key).join(free, [*BY, "target_ordinal"]).withColumn("confidence", total)
        best = _best_target(scored.filter(F.col("confidence") >= threshold), key).withColumn("match_type", F.lit("fuzzy"))
        out = out.unionByName(syn).unionByName(best)

        taken_t = t.join(taken, [*BY, "target_ordinal"], "left_semi")
        near = similar_within(rest, taken_t, BY, "s_name", "t_name", threshold, score).withColumnsRenamed({"l": "s_name", "r": "t_name", "score": "confidence"})
        watched = rest.join(near, [*BY, "s_name"]).join(taken_t, [*BY, "t_name"])
        audit = _best_target(watched, key).withColumn("match_type", F.lit("audit"))
    named = s.select(*key, "source_field")
    result = named.join(out, key, "left").select(
        *key, "source_field", "target_ordinal", "target_field",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("match_type", F.lit("geen match")).alias("match_type"),
    )
    return result, named.join(audit, key)


def _best_target(scored: DataFrame, key: list[str]) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.col("confidence").desc(), "target_ordinal")
    ranked = scored.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") == 1)
    return ranked.select(*key, "target_ordinal", "target_field", "confidence")
