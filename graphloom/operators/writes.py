"""Changes of tables as functions from old to new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import scans


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def missing_ends(relations: DataFrame, entities: DataFrame, episodes: DataFrame | None = None) -> DataFrame:
    """(id, missing): relations whose source, target or episode is not in their knowledge base."""
    known = entities.select("kb_id", F.col("id").alias("found"))
    bad = None
    for end in ("source_id", "target_id"):
        lost = relations.join(known, (relations.kb_id == known.kb_id) & (relations[end] == known.found), "left_anti").select("id", F.lit(end).alias("missing"))
        bad = lost if bad is None else bad.unionByName(lost)
    if episodes is not None:
        held = episodes.select("kb_id", F.col("id").alias("found"))
        cited = relations.filter("episode_id is not null")
        bad = bad.unionByName(cited.join(held, (cited.kb_id == held.kb_id) & (cited.episode_id == held.found), "left_anti").select("id", F.lit("episode_id").alias("missing")))
    return bad


def update(table: DataFrame, changes: DataFrame, columns: list[str], now: Column | None = None) -> DataFrame:
    """Overwrites columns of rows that changes names by kb_id and id; sets updated_at if now is given."""
    new = changes.select("kb_id", "id", *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("changed"))
    joined = table.join(new, ["kb_id", "id"], "left")
    values = {c: F.when(F.col("changed"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in columns}
    if now is not None:
        values["updated_at"] = F.when(F.col("changed"), now).otherwise(F.col("updated_at"))
    return joined.withColumns(values).select(*table.columns)


def not_found(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of wanted (kb_id, id) that the table lacks."""
    return wanted.join(table, ["kb_id", "id"], "left_anti")


def delete(table: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the rows that gone names by kb_id and id."""
    return table.join(gone.select("kb_id", "id"), ["kb_id", "id"], "left_anti").select(*table.columns)


def delete_entities(entities: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and their relations go, by either end."""
    left = relations
    for end in ("source_id", "target_id"):
        left = left.join(gone.select("kb_id", F.col("id").alias(end)), ["kb_id", end], "left_anti")
    return delete(entities, gone), left.select(*relations.columns)


def delete_episodes(episodes: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Episodes go; relations that cite them stay and cite nothing."""
    lost = gone.select("kb_id", F.col("id").alias("episode_id"), F.lit(True).alias("lost"))
    kept = relations.join(lost, ["kb_id", "episode_id"], "left").withColumn("episode_id", F.when(F.col("lost").isNull(), F.col("episode_id")))
    return delete(episodes, gone), kept.select(*relations.columns)


def delete_kb(tables: dict[str, DataFrame], kb: str) -> dict[str, DataFrame]:
    """Everything of a knowledge base goes."""
    return {name: t.filter(F.col("id" if name == "knowledge_bases" else "kb_id") != kb) for name, t in tables.items()}


def invalidate(relations: DataFrame, gone: DataFrame, at: Column) -> DataFrame:
    """Ends relations that gone names by kb_id and id; those already ended keep their end."""
    mark = gone.select("kb_id", "id", F.lit(True).alias("ends"))
    ends = F.col("ends").isNotNull() & F.col("invalid_at").isNull()
    return relations.join(mark, ["kb_id", "id"], "left").withColumn("invalid_at", F.when(ends, at).otherwise(F.col("invalid_at"))).select(*relations.columns)


def access_state(log: DataFrame) -> DataFrame:
    """Decay state after a log of accesses: each access refreshes the strength."""
    return log.groupBy("kb_id", "entity_type", "entity_id").agg(F.lit(1.0).alias("strength"), F.count("*").cast("int").alias("access_count"), F.max("accessed_at").alias("last_access"))


def log_access(states: DataFrame, log: DataFrame) -> DataFrame:
    """States after more accesses: counts add up, strength is 1 again."""
    keys = ["kb_id", "entity_type", "entity_id"]
    both = states.withColumn("fresh", F.lit(False)).unionByName(access_state(log).withColumn("fresh", F.lit(True)))
    return both.groupBy(*keys).agg(
        F.when(F.max("fresh"), F.lit(1.0)).otherwise(F.max("strength")).alias("strength"),
        F.sum("access_count").cast("int").alias("access_count"),
        F.max("last_access").alias("last_access"),
    )


def set_strength(states: DataFrame, changes: DataFrame) -> DataFrame:
    """Sets strengths; changes: kb_id, entity_type, entity_id, strength."""
    keys = ["kb_id", "entity_type", "entity_id"]
    return states.join(changes.select(*keys, F.col("strength").alias("new")), keys, "left").withColumn("strength", F.coalesce("new", "strength")).select(*states.columns)


def delete_states(states: DataFrame, gone: DataFrame) -> DataFrame:
    return states.join(gone.select("kb_id", "entity_type", "entity_id"), ["kb_id", "entity_type", "entity_id"], "left_anti").select(*states.columns)


def get_state(states: DataFrame, kb: str, kind: str, row_id: str) -> DataFrame:
    return scans.in_kb(states, kb).filter((F.col("entity_type") == kind) & (F.col("entity_id") == row_id))
