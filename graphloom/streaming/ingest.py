"""Streams: jobs into the graph, accesses into decay states, hook calls into episodes."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators import extract, ingest, providers, writes
from graphloom.schema import ACCESS_LOG
from graphloom.sources.shared import cut
from graphloom.sources.store import Store

if TYPE_CHECKING:
    from graphloom.engine import Engine

#: Fixed value: how often the queue is looked at.
POLL_SECONDS = 2


def stream_texts(store: Store, texts: DataFrame, checkpoint: str, notify: Callable[[DataFrame], None] | None = None, available_now: bool = False, embedder: providers.Embedder | None = None, extractor: providers.Extractor | None = None) -> StreamingQuery:
    """Ingests a stream of texts (id, kb_id, content, source, metadata). Each micro-batch is one commit: it appends episodes and accesses and replaces the rows of its knowledge bases only. A batch that is run again finds its episodes there and does nothing."""

    def one_batch(rows: DataFrame, batch: int) -> None:
        episodes, entities, relations, states = store.tables("episodes", "entities", "relations", "decay_state")
        new = cut(rows.dropDuplicates(["kb_id", "id"]).join(episodes.select("kb_id", "id"), ["kb_id", "id"], "left_anti"), "batch")
        kbs = sorted(r[0] for r in new.select("kb_id").distinct().collect())
        if not kbs:
            return
        own = F.col("kb_id").isin(kbs)
        done = ingest.ingest(new, entities.filter(own), relations.filter(own), F.current_timestamp(), embedder, extractor)
        store.commit(append={"episodes": done.episodes, "access_log": done.accesses}, kbs=kbs, entities=done.entities, relations=done.relations, decay_state=writes.log_access(states, done.accesses))
        if notify:
            notify(done.result)

    writer = texts.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{POLL_SECONDS} seconds")
    return writer.start()


def feed_jobs(engine: Engine, checkpoint: str, workers: int = 4, poll_seconds: int = POLL_SECONDS) -> StreamingQuery:
    """Runs what is queued, every few seconds, as many jobs at a time as four times the workers."""

    def tick(_: DataFrame, batch: int) -> None:
        engine.run_jobs(4 * workers)

    clock = engine.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=f"{poll_seconds} seconds").start()


def read_texts(spark, folder: str, schema: str = "id string, kb_id string, content string, source string, metadata map<string,string>", files_per_trigger: int = 16) -> DataFrame:
    """A folder that JSON files of texts arrive in, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def read_accesses(spark, folder: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(ACCESS_LOG).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def access_states(accesses: DataFrame) -> DataFrame:
    """Running decay states of a stream of accesses, for the update or complete mode: the state is a row per item."""
    return writes.access_state(accesses)


def access_counts(accesses: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Accesses per item kind and time window; later ones than the watermark are left out, and state is dropped."""
    return accesses.withWatermark("accessed_at", late).groupBy(F.window("accessed_at", window), "kb_id", "entity_type").agg(F.count("*").alias("n"))


def hook_texts(calls: DataFrame, every: int = 1) -> DataFrame:
    """Of a stream of tool outputs (call, kb_id, content): every nth call whose text a rule would look at."""
    rows = calls if every <= 1 else calls.filter(F.col("call") % every == 0)
    text = F.regexp_replace(F.col("content"), r"^\s+|\s+$", "")
    return rows.withColumn("content", text).filter((F.col("content") != "") & extract.matches(F.col("content"))).withColumn("source", F.lit("hook:post_tool_use"))
