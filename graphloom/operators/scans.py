"""Lookups and lists over the tables. Every function takes the table first and keeps it lazy."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.schema import page_limit

#: Ids that a lookup sends along with the plan; more are joined as a table.
LITERAL_IDS = 1000


def in_kb(table: DataFrame, kb: str | None) -> DataFrame:
    """One knowledge base, or all for none."""
    return table if kb is None else table.filter(F.col("kb_id") == kb)


def get(table: DataFrame, kb: str | None, row_id: str) -> DataFrame:
    return in_kb(table, kb).filter(F.col("id") == row_id)


def list_newest(table: DataFrame, kb: str | None, limit: int = 0, offset: int = 0) -> DataFrame:
    """Newest first, ties by id; 50 rows unless told otherwise."""
    return in_kb(table, kb).orderBy(F.col("created_at").desc(), "id").offset(max(0, offset)).limit(page_limit(limit))


def list_oldest(table: DataFrame, kb: str | None = None) -> DataFrame:
    return in_kb(table, kb).orderBy("created_at", "id")


def get_by_ids(table: DataFrame, kb: str, ids: Sequence[str] | DataFrame) -> DataFrame:
    """Rows of these ids; ids without a row are absent. ids: a sequence, or a table with a column id."""
    rows = in_kb(table, kb)
    if isinstance(ids, DataFrame):
        return rows.join(ids.select("id").distinct(), "id", "left_semi")
    if len(ids) <= LITERAL_IDS:
        return rows.filter(F.col("id").isin(list(ids)))
    return rows.join(table.sparkSession.createDataFrame([(x,) for x in ids], "id string").distinct(), "id", "left_semi")


def entity_names(entities: DataFrame, kb: str) -> DataFrame:
    """Without embeddings, which are then not read."""
    return in_kb(entities, kb).select("id", "kb_id", "name", "type", "summary")


def find_by_name(entities: DataFrame, kb: str, name: str, fuzzy: bool = False, least: float = 0.85) -> DataFrame:
    """Names equal but for case; or, if fuzzy, similar ones."""
    rows = in_kb(entities, kb)
    if fuzzy:
        known, wanted = tx.normalize_name(F.col("name")), tx.normalize_name(F.lit(name))
        near = rows.filter(tx.may_be_similar(known, wanted, tx.letter_mask(known), tx.letter_mask(wanted), least))
        return near.filter(tx.jaro_winkler(known, wanted) >= least)
    return rows.filter(F.lower("name") == F.lower(F.lit(name)))


def active(at: Column) -> Column:
    """Whether a relation holds at a time: from valid_at on, until before invalid_at."""
    return (F.col("valid_at") <= at) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at))


def valid_relations(relations: DataFrame, kb: str | None, at: Column) -> DataFrame:
    """The snapshot of relations at a time."""
    return in_kb(relations, kb).filter(active(at))


def valid_relations_at_each(relations: DataFrame, times: DataFrame) -> DataFrame:
    """The snapshots at several times; times has a column at. Each relation is expanded to the times that it spans, without a join of all pairs."""
    listed = times.agg(F.array_sort(F.collect_set("at")).alias("times"))
    spans = relations.join(F.broadcast(listed))
    within = F.filter("times", lambda t: (F.col("valid_at") <= t) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > t)))
    return spans.withColumn("at", F.explode(within)).drop("times")


def relations_of(relations: DataFrame, kb: str, entities: Sequence[str]) -> DataFrame:
    """Relations with one of the entities at either end, once each, invalidated ones too."""
    ends = F.col("source_id").isin(list(entities)) | F.col("target_id").isin(list(entities))
    return in_kb(relations, kb).filter(ends)


def relations_of_each(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, relation ...) for a table of entities with a column id: two equi-joins, a self-loop once."""
    ids = entities.select(F.col("id").alias("entity_id")).distinct()
    out = relations.join(ids, F.col("source_id") == F.col("entity_id"))
    into = relations.filter("source_id <> target_id").join(ids, F.col("target_id") == F.col("entity_id"))
    return out.unionByName(into)


def embeddings(table: DataFrame, active_only: bool = False) -> DataFrame:
    """(id, kb_id, embedding) of rows that have one."""
    rows = table.filter(F.col("embedding").isNotNull())
    if active_only:
        rows = rows.filter(F.col("invalid_at").isNull())
    return rows.select("id", "kb_id", "embedding")


def list_jobs(jobs: DataFrame, kb: str | None = None, status: str | None = None, limit: int = 0) -> DataFrame:
    rows = in_kb(jobs, kb)
    if status:
        rows = rows.filter(F.col("status") == status)
    return rows.orderBy(F.col("created_at").desc(), "id").limit(page_limit(limit, most=10_000))


def list_feedback(feedback: DataFrame, kb: str, topic: str | None = None, limit: int = 0) -> DataFrame:
    rows = in_kb(feedback, kb)
    if topic:
        rows = rows.filter(F.col("topic") == topic)
    return rows.orderBy(F.col("created_at").desc(), "id").limit(page_limit(limit))


def weak_states(states: DataFrame, kb: str | None, most: float) -> DataFrame:
    """Decay states of at most a strength, weakest first."""
    return in_kb(states, kb).filter(F.col("strength") <= most).orderBy("strength", "entity_type", "entity_id")


def count_by_source_prefix(episodes: DataFrame, kb: str, prefix: str) -> DataFrame:
    """How many episodes' sources begin so; % and _ match anything, case does not matter."""
    return in_kb(episodes, kb).filter(F.col("source").ilike(prefix + "%")).agg(F.count("*").alias("n"))


def neighbour_view(relations: DataFrame, kb: str, entity: str, at: Column) -> DataFrame:
    """The other ends of an entity's valid relations: the newest relation of each end and type."""
    rows = valid_relations(relations_of(relations, kb, [entity]), kb, at)
    other = F.when(F.col("source_id") == entity, F.col("target_id")).otherwise(F.col("source_id"))
    newest = Window.partitionBy("other", "type").orderBy(F.col("created_at").desc(), "id")
    return rows.withColumn("other", other).withColumn("n", F.row_number().over(newest)).filter("n = 1").drop("n")


def hidden(table: DataFrame, columns: Iterable[str] = ("embedding",)) -> DataFrame:
    """Without large or secret columns; api_key fields of config structs go too."""
    rows = table.drop(*columns)
    for f in rows.schema.fields:
        if f.dataType.typeName() == "struct" and "api_key" in f.dataType.fieldNames():
            rows = rows.withColumn(f.name, F.col(f.name).dropFields("api_key"))
    return rows


def stats(kbs: DataFrame | None, episodes: DataFrame, entities: DataFrame, relations: DataFrame, communities: DataFrame) -> DataFrame:
    """(kb_id, episodes, entities, relations, communities): one aggregation over the tables' kb_id columns."""
    named = {"episodes": episodes, "entities": entities, "relations": relations, "communities": communities}
    rows = None
    for name, table in named.items():
        part = table.groupBy("kb_id").agg(F.count("*").alias("n")).withColumn("what", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    counted = rows.groupBy("kb_id").agg(*[F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), F.lit(0)).alias(name) for name in named])
    if kbs is None:
        return counted
    return kbs.select(F.col("id").alias("kb_id")).join(counted, "kb_id", "left").fillna(0)


def feedback_stats(feedback: DataFrame, kb: str | None = None) -> DataFrame:
    """(topic, n), and the total with a null topic."""
    return in_kb(feedback, kb).rollup("topic").agg(F.count("*").alias("n"))
