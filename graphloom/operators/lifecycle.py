"""Decay, pruning, deduplication and consolidation, as functions from old to new tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import weights as wt
from graphloom.operators import knn, writes
from graphloom.schema import DEFAULT_CONSOLIDATE_THRESHOLD, DEFAULT_HALF_LIFE_HOURS, DEFAULT_PRUNE_THRESHOLD
from graphloom.sources.shared import cut

_GROUP = ["kb_id", "source_id", "target_id", "type"]


def duplicate_groups(relations: DataFrame, limit: int | None = None) -> DataFrame:
    """(kb_id, source_id, target_id, type, n) of valid relations that say the same more than once."""
    groups = relations.filter("invalid_at is null").groupBy(*_GROUP).agg(F.count("*").alias("n")).filter("n > 1")
    return groups if limit is None else groups.orderBy(*_GROUP).limit(limit)


def longest_summary(order: Column) -> Column:
    """As an aggregate: the longest summary in bytes; the first in order of those."""
    return F.min_by("summary", F.struct((-F.octet_length(F.coalesce("summary", F.lit("")))).alias("n"), order.alias("o")))


def dedup_relations(relations: DataFrame, kb: str | None = None, entity: str | None = None) -> DataFrame:
    """Valid relations merged: loops go; of equal source, target and type the heaviest and then oldest stays, with all weights combined, the longest summary and the earliest start. One shuffle by group, all groups.

    Other knowledge bases, other entities' relations (if one is named) and ended relations stay as they are.
    """
    touched = F.col("invalid_at").isNull()
    if kb is not None:
        touched = touched & (F.col("kb_id") == kb)
    if entity is not None:
        touched = touched & ((F.col("source_id") == entity) | (F.col("target_id") == entity))
    rest = relations.filter(~touched)
    loops_gone = relations.filter(touched & (F.col("source_id") != F.col("target_id")))
    order = F.struct((-F.col("weight")).alias("w"), F.col("created_at").alias("c"), F.col("id").alias("i"))
    others = [c for c in relations.columns if c not in (*_GROUP, "weight", "summary", "valid_at")]
    best = [F.min_by(F.col(c), order).alias(c) for c in others]
    merged = loops_gone.groupBy(*_GROUP).agg(
        *best,
        F.when(F.count("*") == 1, F.max("weight")).otherwise(wt.combine_all(F.col("weight"))).alias("weight"),
        longest_summary(order).alias("summary"),
        F.min("valid_at").alias("valid_at"),
    )
    return rest.unionByName(merged.select(*relations.columns))


def dedup_removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kb_id, id) of relations that a dedup deleted."""
    return before.select("kb_id", "id").join(after.select("kb_id", "id"), ["kb_id", "id"], "left_anti")


def upsert_relations(relations: DataFrame, new: DataFrame) -> DataFrame:
    """Adds relations; one that a valid relation already says strengthens that one instead.

    What is new is summed up by group; a group finds its heaviest valid relation by a semi-join, and that row alone is
    changed, by a join on its id. Neither join shuffles the relations while what is new is small.
    """
    order = F.struct((-F.col("weight")).alias("w"), F.col("created_at").alias("c"), F.col("id").alias("i"))
    others = [c for c in relations.columns if c not in (*_GROUP, "weight", "summary") and c in new.columns]
    weight = F.when(F.count("*") == 1, F.max(wt.clamp(F.col("weight")))).otherwise(wt.combine_all(F.col("weight")))
    said = new.groupBy(*_GROUP).agg(*[F.min_by(F.col(c), order).alias(c) for c in others], weight.alias("weight"), longest_summary(order).alias("summary"))
    held = relations.filter("invalid_at is null").join(said.select(*_GROUP), _GROUP, "left_semi")
    heads = held.groupBy(*_GROUP).agg(F.min_by("id", order).alias("head"))
    met = said.join(heads, _GROUP, "left")
    stronger = met.filter("head is not null").select("kb_id", F.col("head").alias("id"), F.col("weight").alias("added"), F.col("summary").alias("more"))
    joined = relations.join(stronger, ["kb_id", "id"], "left")
    changed = F.col("added").isNotNull()
    length = lambda c: F.octet_length(F.coalesce(c, F.lit("")))
    joined = joined.withColumns(
        {
            "weight": F.when(changed, wt.combine(F.col("weight"), F.col("added"))).otherwise(F.col("weight")),
            "summary": F.when(changed & (length("more") > length("summary")), F.col("more")).otherwise(F.col("summary")),
        }
    )
    fresh = met.filter("head is null").drop("head")
    return joined.select(*relations.columns).unionByName(fresh, allowMissingColumns=True).select(*relations.columns)


def decay_batch(states: DataFrame, now: Column, half_life_hours: float = DEFAULT_HALF_LIFE_HOURS) -> DataFrame:
    """One run of decay over all strengths. Runs add up, as last_access does not move; strength_at does not depend on runs."""
    return states.withColumn("strength", wt.decayed(F.col("strength"), wt.hours_between(now, F.col("last_access")), half_life_hours))


def strength_at(states: DataFrame, now: Column, half_life_hours: float = DEFAULT_HALF_LIFE_HOURS) -> DataFrame:
    """Strength as a function of the last access alone: the same however often it is asked for."""
    return states.withColumn("strength", wt.decayed(F.lit(1.0), F.greatest(F.lit(0.0), wt.hours_between(now, F.col("last_access"))), half_life_hours))


@dataclass
class Pruned:
    entities: DataFrame
    relations: DataFrame
    episodes: DataFrame
    states: DataFrame
    #: (kb_id, entity_type, entity_id) of what went.
    gone: DataFrame


def prune_candidates(states: DataFrame, relations: DataFrame, threshold: float = DEFAULT_PRUNE_THRESHOLD) -> DataFrame:
    """Weak memories that may go: (kb_id, entity_type, entity_id, strength). An entity with any relation, ended or not, is protected."""
    weak = states.filter(F.col("strength") <= threshold)
    ends = relations.select("kb_id", F.explode(F.array("source_id", "target_id")).alias("entity_id"))
    safe = weak.filter("entity_type = 'entity'").join(ends, ["kb_id", "entity_id"], "left_semi")
    return weak.join(safe, ["kb_id", "entity_type", "entity_id"], "left_anti").select("kb_id", "entity_type", "entity_id", "strength")


def prune(entities: DataFrame, relations: DataFrame, episodes: DataFrame, states: DataFrame, now: Column, threshold: float = DEFAULT_PRUNE_THRESHOLD) -> Pruned:
    """Dedups relations, then removes weak memories: entities and episodes are deleted, relations end; their states go."""
    relations = dedup_relations(relations)
    gone = prune_candidates(states, relations, threshold)
    of = lambda kind: gone.filter(F.col("entity_type") == kind).select("kb_id", F.col("entity_id").alias("id"))
    entities, relations = writes.delete_entities(entities, relations, of("entity"))
    relations = writes.invalidate(relations, of("relation"), now)
    episodes, relations = writes.delete_episodes(episodes, relations, of("episode"))
    return Pruned(entities, relations, episodes, writes.delete_states(states, gone), gone)


def survivors(pairs: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(a, b, similarity, survivor, merged): of a pair the one with more relations stays, else with the longer summary in bytes, else the strictly older one, else b."""
    ends = relations.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    loops = relations.filter("source_id = target_id").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("loops"))
    about = entities.select("id", F.octet_length(F.coalesce("summary", F.lit(""))).alias("len"), "created_at").join(ends, "id", "left").join(loops, "id", "left")
    about = about.withColumn("n", F.coalesce("n", F.lit(0)) - F.coalesce("loops", F.lit(0))).drop("loops")
    for side in ("a", "b"):
        pairs = pairs.join(about.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("len").alias(f"len_{side}"), F.col("created_at").alias(f"t_{side}")), side)
    a_stays = F.when(F.col("n_a") != F.col("n_b"), F.col("n_a") > F.col("n_b")).when(F.col("len_a") != F.col("len_b"), F.col("len_a") > F.col("len_b")).otherwise(F.col("t_a") < F.col("t_b"))
    return pairs.select("a", "b", "similarity", F.when(a_stays, F.col("a")).otherwise(F.col("b")).alias("survivor"), F.when(a_stays, F.col("b")).otherwise(F.col("a")).alias("merged"))


def redirect(relations: DataFrame, moves: DataFrame, keep_history: bool = False) -> DataFrame:
    """Valid relations of merged entities move to their survivors; moves: (kb_id, merged, survivor). With keep_history, ended ones move too."""
    movable = F.lit(True) if keep_history else F.col("invalid_at").isNull()
    for end in ("source_id", "target_id"):
        to = moves.select("kb_id", F.col("merged").alias(end), F.col("survivor").alias("to"))
        relations = relations.join(to, ["kb_id", end], "left").withColumn(end, F.when(movable & F.col("to").isNotNull(), F.col("to")).otherwise(F.col(end))).drop("to")
    return relations


def greedy_moves(pairs: DataFrame) -> DataFrame:
    """(merged, survivor): what comes of merging pairs (a, b, survivor, merged) one by one in order of (a, b), where a pair of which one is gone already is skipped.

    A pair that comes first at both its ends is not touched by any before it, so all such pairs are taken in one round;
    the pairs of those that went drop out, and the next round takes those that are first then. Survivors that went later
    are followed to the last one by doubling. Every step is a join; nothing is gathered on the driver.
    """
    left = cut(pairs.select("a", "b", "survivor", "merged").distinct(), "pairs")
    moves = None
    while not left.isEmpty():
        ends = left.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.struct("a", "b").alias("pair")), F.struct(F.col("b").alias("node"), F.struct("a", "b").alias("pair")))))
        first = ends.groupBy("node").agg(F.min("pair").alias("pair"))
        # Both its ends have it as their first.
        free = first.groupBy("pair").agg(F.count("*").alias("n")).filter("n = 2").select("pair.a", "pair.b")
        taken = cut(left.join(free, ["a", "b"], "left_semi"), "taken")
        part = taken.select("merged", "survivor")
        moves = part if moves is None else moves.unionByName(part)
        left = left.join(taken, ["a", "b"], "left_anti")
        for end in ("a", "b"):
            left = left.join(taken.select(F.col("merged").alias(end)), end, "left_anti")
        left = cut(left.select("a", "b", "survivor", "merged"), "pairs")
    if moves is None:
        return pairs.select("merged", "survivor").limit(0)
    moves = cut(moves, "moves")
    while True:
        further = moves.select(F.col("merged").alias("survivor"), F.col("survivor").alias("next"))
        if moves.join(further, "survivor", "left_semi").isEmpty():
            return moves
        moves = cut(moves.join(further, "survivor", "left").select("merged", F.coalesce("next", "survivor").alias("survivor")), "moves")


def consolidate(entities: DataFrame, relations: DataFrame, states: DataFrame, kb: str, threshold: float = DEFAULT_CONSOLIDATE_THRESHOLD, most_pairs: int | None = 100) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Merges entities with similar embeddings; returns entities, relations, states and moves (kb_id, merged, survivor).

    Pairs are taken in order of ids, the first ``most_pairs`` of them or all for none; a pair of which one is gone already
    is skipped (see greedy_moves). The moves are applied to the tables by joins.
    """
    own = entities.filter((F.col("kb_id") == kb) & F.col("embedding").isNotNull())
    pairs = cut(knn.similar_pairs(own, threshold, most_pairs), "similar")
    chosen = survivors(pairs, own, relations.filter(F.col("kb_id") == kb))
    moves = greedy_moves(chosen).select(F.lit(kb).alias("kb_id"), "merged", "survivor")
    kept = dedup_relations(redirect(relations, moves), kb) if not moves.isEmpty() else relations
    entities, kept = writes.delete_entities(entities, kept, moves.select("kb_id", F.col("merged").alias("id")))
    states = writes.delete_states(states, moves.select("kb_id", F.lit("entity").alias("entity_type"), F.col("merged").alias("entity_id")))
    return entities, kept, states, moves
