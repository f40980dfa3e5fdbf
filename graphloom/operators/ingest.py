"""Texts into the graph: extraction, resolution, embedding, upsert."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import extract, lifecycle, providers, resolve
from graphloom.sources.shared import cut

#: What an ingest counts.
COUNTS = ("entities_created", "entities_updated", "relations_created", "relations_strengthened")


@dataclass
class Ingested:
    episodes: DataFrame
    entities: DataFrame
    relations: DataFrame
    #: Accesses to log, one per episode.
    accesses: DataFrame
    #: (kb_id, episodes, entities_created, entities_updated, relations_created, relations_strengthened)
    result: DataFrame
    #: (kb_id, text_id, error, and the four counts) of every text; what several texts bring counts for the first by id.
    by_text: DataFrame


def episodes_of(texts: DataFrame, now: Column) -> DataFrame:
    """texts (id, kb_id, content, source, metadata) as episodes."""
    return texts.select("id", "kb_id", "content", "source", "metadata", now.alias("created_at"))


def accesses_of(episodes: DataFrame, now: Column) -> DataFrame:
    """What a log gets for new episodes, whatever comes of them."""
    return episodes.select("kb_id", F.lit("episode").alias("entity_type"), F.col("id").alias("entity_id"), now.alias("accessed_at"))


def extract_texts(texts: DataFrame, extractor: providers.Extractor | None = None) -> DataFrame:
    """(kb_id, text_id, x, by_model, error): what the rules find; where they find no entity, what the extractor finds, if there is one."""
    ruled = cut(texts.select("kb_id", F.col("id").alias("text_id"), "content", extract.extracted(F.col("content")).alias("x")), "ruled")
    columns = ("kb_id", "text_id", "x", "by_model", "error")
    by_rule = ruled.withColumns({"by_model": F.lit(False), "error": F.lit(None).cast("string")})
    if extractor is None:
        return by_rule.select(*columns)
    nothing = F.size("x.entities") == 0
    asked = providers.extract_by_model(ruled.filter(nothing).select("kb_id", "text_id", "content"), extractor).withColumn("by_model", F.lit(True))
    return cut(by_rule.filter(~nothing).select(*columns).unionByName(asked.select(*columns)), "extracted")


def ingest(texts: DataFrame, entities: DataFrame, relations: DataFrame, now: Column, embedder: providers.Embedder | None = None, extractor: providers.Extractor | None = None) -> Ingested:
    """texts: id, kb_id, content, source, metadata. Returns the new episodes, and the tables after the ingest.

    Rules come first; a text in which they find no entity goes to the extractor, which is also asked about names that are
    in doubt, if such a text has them. A text whose extraction fails brings nothing but its error. Mentions of one text are
    matched in order; texts of one batch do not see each other's new entities by similarity, but equal names become one
    entity. Relations without both ends drop out.
    """
    embedder = embedder or providers.HashEmbedder()
    episodes = episodes_of(texts, now)
    found = extract_texts(texts, extractor)
    mentions = found.select("kb_id", "text_id", "by_model", F.posexplode("x.entities").alias("position", "e")).select("kb_id", "text_id", "by_model", "position", "e.*")
    mentions = cut(resolve.resolve_in_batch(mentions.filter(F.trim("name") != "")), "matched-in-batch")
    merged = resolve.merge_mentions(mentions)
    if extractor is None:
        merged = merged.withColumn("by_model", F.lit(False))
    else:
        merged = merged.join(mentions.groupBy("kb_id", "text_id").agg(F.max("by_model").alias("by_model")), ["kb_id", "text_id"])
    # One entity per normalized name and type of the whole batch.
    key = F.sha2(F.concat_ws("|", "kb_id", tx.normalize_name(F.col("name")), tx.normalize_name(F.col("type"))), 256)
    longest = F.struct((-F.octet_length(F.coalesce("summary", F.lit("")))).alias("n"), "text_id")
    new = merged.withColumn("id", F.concat(F.lit("e:"), key)).groupBy("kb_id", "id").agg(F.min("name").alias("name"), F.min("type").alias("type"), F.min_by("summary", longest).alias("summary"), F.max("by_model").alias("by_model"), F.min("text_id").alias("text_id"))
    new = cut(new, "mentions")
    ask = getattr(extractor, "same", None)
    matched = cut(resolve.resolve(new, entities, ask, may_ask=F.col("by_model")), "matched")
    # Existing entities take what the text adds.
    updates = new.join(matched.filter("entity_id is not null"), new.id == F.col("new_id")).groupBy("kb_id", "entity_id").agg(F.max_by("summary", F.octet_length("summary")).alias("new_summary"), F.min("type").alias("new_type"), F.min("text_id").alias("text_id"))
    joined = entities.join(updates.withColumnRenamed("entity_id", "id"), ["kb_id", "id"], "left")
    kind, summary = tx.merged_type(F.col("type"), F.col("new_type")), tx.merged_summary(F.col("summary"), F.col("new_summary"))
    changed = F.col("new_summary").isNotNull() & (~kind.eqNullSafe(F.col("type")) | ~summary.eqNullSafe(F.col("summary")))
    joined = joined.withColumns({"changed": changed, "k": kind, "s": summary}).withColumns({"type": F.when(F.col("changed"), F.col("k")).otherwise(F.col("type")), "summary": F.when(F.col("changed"), F.col("s")).otherwise(F.col("summary")), "updated_at": F.when(F.col("changed"), now).otherwise(F.col("updated_at"))})
    created = new.join(matched.filter("entity_id is null"), new.id == F.col("new_id"), "left_semi")
    text = tx.entity_text(F.col("name"), F.col("summary"))
    fresh = joined.filter("changed").select("id", "kb_id", "name", "type", "summary", "created_at", "updated_at").unionByName(created.select("id", "kb_id", "name", tx.default_type(F.col("type")).alias("type"), "summary", now.alias("created_at"), now.alias("updated_at")))
    embedded = providers.embed(fresh.withColumn("text", text), "text", embedder).drop("text")
    after = cut(joined.filter("not changed").select(*entities.columns).unionByName(embedded.select(*entities.columns)), "entities")
    # Ends of relations by the names of the batch's mentions, then by all names.
    in_batch = new.join(matched, new.id == F.col("new_id")).select("kb_id", resolve.endpoint(F.col("name")).alias("key"), F.coalesce("entity_id", "id").alias("entity_id"), F.lit(0).alias("rank"))
    by_key = F.concat(F.lit("e:"), F.sha2(F.concat_ws("|", "kb_id", F.element_at(F.split("entity_key", r"\|"), 1), F.element_at(F.split("entity_key", r"\|"), 2)), 256))
    # What very many texts mention is one name to look up.
    by_mention = mentions.select("kb_id", "entity_key", "name").distinct().withColumn("id", by_key).join(matched, F.col("id") == F.col("new_id")).select("kb_id", resolve.endpoint(F.col("name")).alias("key"), F.coalesce("entity_id", "id").alias("entity_id"), F.lit(1).alias("rank"))
    known = after.select("kb_id", resolve.endpoint(F.col("name")).alias("key"), F.col("id").alias("entity_id"), F.lit(2).alias("rank"))
    names = cut(in_batch.unionByName(by_mention).unionByName(known).groupBy("kb_id", "key").agg(F.min_by("entity_id", F.struct("rank", "entity_id")).alias("entity_id")), "names")
    said = found.select("kb_id", "text_id", F.posexplode("x.relations").alias("position", "r")).select("kb_id", "text_id", "position", "r.*")
    ends = cut(resolve.resolve_ends(said, names), "ends")
    merged_relations = resolve.merge_relations(ends).join(ends.groupBy("kb_id", "source_id", "type", "target_id").agg(F.min("text_id").alias("episode_id")), ["kb_id", "source_id", "type", "target_id"])
    relation_id = F.concat(F.lit("r:"), F.sha2(F.concat_ws("|", "kb_id", tx.relation_signature(F.col("source_id"), F.col("type"), F.col("target_id")), "episode_id"), 256))
    rows = merged_relations.withColumns({"id": relation_id, "valid_at": now, "invalid_at": F.lit(None).cast("timestamp"), "created_at": now})
    if "embedding" in relations.columns:
        rows = providers.embed(rows.withColumn("text", tx.relation_text(F.col("source_id"), F.col("type"), F.col("target_id"), F.col("summary"))), "text", embedder).drop("text")
    rows = cut(rows.select(*relations.columns, *(["episode_id"] if "episode_id" not in relations.columns else [])), "relations")
    upserted = cut(lifecycle.upsert_relations(relations, rows.select(*relations.columns)), "upserted")
    # What each text brought.
    made = rows.join(upserted.select("id"), "id", "left_semi")
    parts = {
        "entities_created": created.select("kb_id", "text_id"),
        "entities_updated": joined.filter("changed").select("kb_id", "text_id"),
        "relations_created": made.select("kb_id", F.col("episode_id").alias("text_id")),
        "relations_strengthened": rows.join(made.select("id"), "id", "left_anti").select("kb_id", F.col("episode_id").alias("text_id")),
    }
    events = None
    for name, part in parts.items():
        part = part.withColumn("what", F.lit(name))
        events = part if events is None else events.unionByName(part)
    counted = events.groupBy("kb_id", "text_id").agg(*[F.count_if(F.col("what") == c).alias(c) for c in COUNTS])
    by_text = cut(found.select("kb_id", "text_id", "error").join(counted, ["kb_id", "text_id"], "left").fillna(0, list(COUNTS)), "by-text")
    result = by_text.groupBy("kb_id").agg(F.count("*").alias("episodes"), *[F.sum(c).alias(c) for c in COUNTS])
    return Ingested(episodes, after, upserted, accesses_of(episodes, now), result, by_text)
