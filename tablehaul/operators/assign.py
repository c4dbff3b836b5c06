"""One-to-one matching in source order.

Each source takes the best target that no earlier source has taken. The serial rule equals a
stable matching in which every target prefers the earliest source, so it can be found in rounds:
all open sources ask their best remaining target at once, every target keeps the earliest asker,
the others move on to their next choice. Each round is a join and a ``min`` over all groups
together. Groups of a bounded number of choices need no rounds: one task takes their sources in turn.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablehaul.functions.similarity import weighted_similarity
from tablehaul.functions.text import normalize_name
from tablehaul.operators.match import BY, thesaurus_pairs
from tablehaul.operators.simjoin import similar_within
from tablehaul.session import cut_lineage


def preferences(sources: DataFrame, targets: DataFrame, labels: list[str], threshold: float = 0.6) -> DataFrame:
    """All choices of each source, best first.

    First targets with an equal label (ignoring case), in the order of ``labels`` (of equal
    labels the last target counts); then similar targets by score, where a thesaurus hit on the
    name is worth at least 0.85; equal scores in target order.
    """
    s = sources.select(*BY, F.col("ordinal").alias("source_ordinal"), "field_name", normalize_name(F.col("field_name")).alias("l"))
    key = [*BY, "source_ordinal"]
    entries = F.array(*[F.struct(F.lit(i).alias("priority"), F.col(c).cast("string").alias("label")) for i, c in enumerate(labels)])
    t = targets.select(*BY, F.col("ordinal").alias("target_ordinal"), F.col("field_name").alias("target_name"), F.inline(entries))
    t = t.filter(F.coalesce("label", F.lit("")) != "")

    last = t.groupBy(*BY, "priority", F.lower("label").alias("lowered")).agg(F.max("target_ordinal").alias("target_ordinal"))
    exact = s.withColumn("lowered", F.lower("field_name")).join(last, [*BY, "lowered"]).select(
        *key, "target_ordinal", F.lit(0).alias("stage"), "priority", F.lit(1.0).alias("score"), F.lit("exact").alias("method")
    )
    labelled = t.withColumn("r", normalize_name(F.col("label")))
    pairs = similar_within(s, labelled, BY, "l", "r", threshold, weighted_similarity)
    fuzzy = s.join(pairs, [*BY, "l"]).join(labelled, [*BY, "r"]).select(*key, "target_ordinal", "score", F.lit("fuzzy").alias("method"))
    named = targets.select(*BY, F.col("ordinal").alias("target_ordinal"), normalize_name(F.col("field_name")).alias("r"))
    syn = (
        s.join(thesaurus_pairs(s, named, "l", "r"), "l").join(named, [*BY, "r"])
        .select(*key, "target_ordinal", F.lit(0.85).alias("score"), F.lit("synonym").alias("method"))
    )
    near = fuzzy.unionByName(syn).groupBy(*key, "target_ordinal").agg(
        F.max("score").alias("score"), F.max_by("method", F.struct("score", F.col("method") == "synonym")).alias("method")
    )
    near = near.select(*key, "target_ordinal", F.lit(1).alias("stage"), F.lit(0).alias("priority"), "score", "method")
    order = Window.partitionBy(*key).orderBy("stage", "priority", F.col("score").desc(), "target_ordinal")
    return exact.unionByName(near).withColumn("choice", F.row_number().over(order))


#: Choices of a group up to which one task takes its sources in turn; larger groups are assigned in rounds.
MOST_IN_TURN = 200_000


def assign_one_to_one(choices: DataFrame, by: list[str] = BY, most: int = MOST_IN_TURN) -> DataFrame:
    """Serial one-to-one assignment from ranked choices (source_ordinal, choice, target_ordinal): the chosen rows."""
    choices = cut_lineage(choices)
    large = choices.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most).select(*by)
    if large.isEmpty():
        return choices.groupBy(*by).applyInArrow(in_turn, choices.schema)
    rest = choices.join(large, by, "left_anti").select(*choices.columns)
    rounds = in_rounds(choices.join(large, by, "left_semi").select(*choices.columns), by)
    return rest.groupBy(*by).applyInArrow(in_turn, choices.schema).unionByName(rounds.select(*choices.columns))


def in_turn(group: pa.Table) -> pa.Table:
    """The choices of one group that its sources get, source by source."""
    order = pa.compute.sort_indices(group, [("source_ordinal", "ascending"), ("choice", "ascending")]).to_pylist()
    sources, targets = group.column("source_ordinal").to_pylist(), group.column("target_ordinal").to_pylist()
    served, taken, kept = set(), set(), []
    for i in order:
        if sources[i] not in served and targets[i] not in taken:
            served.add(sources[i])
            taken.add(targets[i])
            kept.append(i)
    return group.take(pa.array(kept, pa.int64()))


def in_rounds(choices: DataFrame, by: list[str]) -> DataFrame:
    """The same for groups of any size.

    A source that was turned away goes on to its next target that is free or held by a later
    source: holders only get earlier, so any other target would turn it away as well. Groups in
    which nobody was turned away are finished and leave the rounds. State is checkpointed per
    round, so a lost executor repeats one round and not all of them.
    """
    key = [*by, "source_ordinal"]
    current = choices.groupBy(*key).agg(F.min("choice").alias("choice"))
    done = []
    while True:
        asked = current.join(choices.select(*key, "choice", "target_ordinal"), [*key, "choice"])
        kept = asked.groupBy(*by, "target_ordinal").agg(F.min("source_ordinal").alias("__winner"))
        state = cut_lineage(
            asked.join(kept, [*by, "target_ordinal"]).select(
                *key, "choice", "target_ordinal", (F.col("source_ordinal") == F.col("__winner")).alias("won")
            )
        )
        lost = state.filter(~F.col("won"))
        if lost.isEmpty():
            done.append(state.select(*key, "choice"))
            break
        open_groups = lost.select(*by).distinct()
        done.append(state.join(open_groups, by, "left_anti").select(*key, "choice"))
        held = state.filter("won").select(*by, "target_ordinal", F.col("source_ordinal").alias("__holder"))
        later = choices.select(*key, "target_ordinal", F.col("choice").alias("__next"))
        free = F.col("__holder").isNull() | (F.col("__holder") > F.col("source_ordinal"))
        moved = (
            lost.drop("target_ordinal", "won")
            .join(later, key)
            .filter(F.col("__next") > F.col("choice"))
            .join(held, [*by, "target_ordinal"], "left")
            .filter(free)
            .groupBy(*key)
            .agg(F.min("__next").alias("choice"))
        )
        stay = state.filter("won").join(open_groups, by, "left_semi").select(*key, "choice")
        current = stay.unionByName(moved)
    final = done[0]
    for part in done[1:]:
        final = final.unionByName(part)
    return final.join(choices, [*key, "choice"])
