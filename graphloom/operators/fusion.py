"""Reciprocal rank fusion, decay of scores, and the hybrid search that uses both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import weights as wt
from graphloom.operators import bm25, graph, knn
from graphloom.schema import SearchOptions
from graphloom.sources.shared import cut

#: Fixed value of the fusion.
RRF_K = 60


def ranked(results: DataFrame) -> DataFrame:
    """Adds rank by score, ties by type and id. A channel's results are few."""
    return results.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "type", "id")))


def fuse(channels: Sequence[DataFrame], k: int = RRF_K) -> DataFrame:
    """channels: (id, kb_id, type, content, rank). A result's score is the sum of 1 / (k + rank); what it shows comes from the first channel that has it."""
    rows = None
    for number, c in enumerate(channels):
        part = c.select("id", "kb_id", "type", "content", "rank", F.lit(number).alias("channel"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("type", "id").agg(F.min_by("kb_id", "channel").alias("kb_id"), F.min_by("content", "channel").alias("content"), F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 9).alias("score"))


def apply_decay(results: DataFrame, states: DataFrame, now: Column, half_life_hours: float) -> DataFrame:
    """Multiplies scores by how fresh their memories are; nothing for a half life of 0 or less."""
    if half_life_hours <= 0:
        return results
    held = states.select("kb_id", F.col("entity_type").alias("type"), F.col("entity_id").alias("id"), "strength", "access_count", "last_access")
    factor = wt.decay_multiplier(F.col("strength"), F.col("access_count"), wt.hours_between(now, F.col("last_access")), half_life_hours)
    # Results are as many as twice a search's limit.
    return held.join(F.broadcast(results), ["kb_id", "type", "id"], "right").withColumn("score", F.round(F.col("score") * factor, 9)).select(*results.columns)


def hydrate_hits(hits: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Hits (id, kb_id, score) as results: an entity's if there is one of that id, else a relation's; others drop out."""
    # A search's hits: as many as its limit, which options bound.
    hits = F.broadcast(hits.select("id", "kb_id", "score"))
    named = entities.select("kb_id", "id", F.lit("entity").alias("type"), F.concat(F.col("name"), F.lit(": "), F.coalesce("summary", F.lit(""))).alias("content"))
    typed = relations.select("kb_id", "id", F.lit("relation").alias("type"), F.concat(F.col("type"), F.lit(": "), F.coalesce("summary", F.lit(""))).alias("content"))
    as_entity = named.join(hits, ["kb_id", "id"])
    as_relation = typed.join(hits, ["kb_id", "id"]).join(as_entity.select("kb_id", "id"), ["kb_id", "id"], "left_anti")
    return as_entity.unionByName(as_relation).select("id", "kb_id", "type", "content", "score")


def vector_channel(entities: DataFrame, relations: DataFrame, kb: str, query: Sequence[float], limit: int) -> DataFrame:
    """Nearest entities and valid relations by cosine, as results."""
    own = entities.filter(F.col("kb_id") == kb).select("id", "kb_id", "embedding")
    if "embedding" in relations.columns:
        own = own.unionByName(relations.filter((F.col("kb_id") == kb) & F.col("invalid_at").isNull()).select("id", "kb_id", "embedding"))
    hits = knn.nearest(own, query, limit).withColumn("score", F.round(1 - F.col("distance"), 9))
    return hydrate_hits(hits, entities, relations).orderBy(F.col("score").desc(), "id")


def seeds_of(channels: Sequence[DataFrame], relations: DataFrame | None = None) -> list[str]:
    """Entity ids among results, in rank order; with relations, also the ends of relation hits, which one scan finds. At most the channels' rows."""
    hits = [(r["type"], r["id"]) for c in channels for r in c.orderBy("rank").select("id", "type").collect()]
    ends: dict[str, tuple[str, str]] = {}
    named = sorted({i for kind, i in hits if kind == "relation"})
    if relations is not None and named:
        ends = {r["id"]: (r["source_id"], r["target_id"]) for r in relations.filter(F.col("id").isin(named)).select("id", "source_id", "target_id").collect()}
    found: dict[str, None] = {}
    for kind, i in hits:
        found |= dict.fromkeys([i] if kind == "entity" else ends.get(i, ()) if kind == "relation" else ())
    return list(found)


def hybrid_search(
    entities: DataFrame,
    relations: DataFrame,
    episodes: DataFrame,
    states: DataFrame | None,
    kb: str,
    query: str,
    query_vector: Sequence[float] | None,
    now: Column,
    options: SearchOptions | None = None,
    communities: DataFrame | None = None,
    edges: DataFrame | None = None,
) -> DataFrame:
    """(id, kb_id, type, content, score), best first: keyword, vector and graph channels fused, then decayed.

    Channels are as long as three times the result; their rows go to the shared folder because seeds and fusion both read
    them. The graph starts from the entities that the other channels found. A vector mode without a query vector is an error.
    ``edges``: relations valid now, if they are at hand.
    """
    options = (options or SearchOptions()).normalized()
    if options.vector and not options.bm25 and query_vector is None:
        raise ValueError("a vector search needs a query vector")
    channels = []
    if options.bm25:
        channels.append(cut(ranked(bm25.search_all(entities, relations, episodes, query, kb, options.fetch)), "channel"))
    if options.vector and query_vector is not None:
        channels.append(cut(ranked(vector_channel(entities, relations, kb, query_vector, options.fetch)), "channel"))
    if options.graph and channels:
        seeds = seeds_of(channels, relations if options.relation_seeds else None)
        if options.expand_communities and communities is not None:
            seeds = graph.expand_communities(communities.filter(F.col("kb_id") == kb), seeds)
        if not isinstance(seeds, list) or seeds:
            at = F.lit(options.at).cast("timestamp") if options.at else None
            valid = edges if edges is not None else graph.allowed(relations.filter(F.col("kb_id") == kb), at=at if at is not None else now)
            scored = graph.channel(valid, seeds, options.scorer, options.hops, options.edge_types, None, options.min_weight, options.compose_filters)
            scored = scored.select(F.col("node").alias("id"), "score")
            named = entities.filter(F.col("kb_id") == kb).select("id", "kb_id", "name", "summary").join(scored, "id")
            best = named.withColumn("score", F.round("score", 9)).orderBy(F.col("score").desc(), "id").limit(options.fetch)
            channels.append(ranked(best.select("id", "kb_id", F.lit("entity").alias("type"), F.concat(F.col("name"), F.lit(": "), F.coalesce("summary", F.lit(""))).alias("content"), "score")))
    if not channels:
        return entities.sparkSession.createDataFrame([], "id string, kb_id string, type string, content string, score double")
    kept = fuse(channels).orderBy(F.col("score").desc(), "type", "id").limit(2 * options.top_k)
    if states is not None:
        kept = apply_decay(kept, states, now, options.half_life_hours)
    return kept.select("id", "kb_id", "type", "content", "score").orderBy(F.col("score").desc(), "type", "id").limit(options.top_k)


def access_events(results: DataFrame, now: Column) -> DataFrame:
    """What a caller may append to the access log after a search; searches themselves change nothing."""
    return results.select("kb_id", F.col("type").alias("entity_type"), F.col("id").alias("entity_id"), now.alias("accessed_at"))


def prompt_context(results: DataFrame, most: int = 5) -> DataFrame:
    """(context): the best results as one JSON text of memories."""
    top = results.orderBy(F.col("score").desc(), "type", "id").limit(most)
    memory = F.struct((-F.col("score")).alias("o"), "type", "id", F.struct("type", "content", "score").alias("m"))
    return top.agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(memory)), lambda x: x["m"]).alias("memories"))).alias("context"))
