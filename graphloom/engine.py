"""One object for the operations on a store of knowledge bases."""

from __future__ import annotations

import json
import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import bm25, fusion, graph, ingest, jobs, lifecycle, providers, scans, writes
from graphloom.schema import DEFAULT_CONSOLIDATE_THRESHOLD, DEFAULT_HALF_LIFE_HOURS, DEFAULT_PRUNE_THRESHOLD, SearchOptions
from graphloom.sources import connectors, sinks
from graphloom.sources.shared import cut
from graphloom.sources.store import Store

log = logging.getLogger(__name__)


class Engine:
    """Reads take the current version; writes commit a new one, and rewrite only the knowledge bases that they touch. One writer at a time: a second one's commit fails."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        embedder: providers.Embedder | None = None,
        half_life_hours: float = DEFAULT_HALF_LIFE_HOURS,
        now: Column | None = None,
        extractor: providers.Extractor | None = None,
        notify: sinks.Notifier | None = None,
    ):
        self.store, self.embedder, self.half_life = Store(spark, folder), embedder or providers.HashEmbedder(), half_life_hours
        self.spark, self.now = spark, now if now is not None else F.current_timestamp()
        self.extractor, self.notify = extractor, notify

    def table(self, name: str) -> DataFrame:
        return self.store.table(name)

    # Knowledge bases and rows
    def create(self, name: str, rows: DataFrame) -> int:
        """Adds rows to a table; relations must have their ends, knowledge bases settings that can work."""
        if name == "relations" and not (bad := writes.missing_ends(rows, self.table("entities"), self.table("episodes"))).isEmpty():
            raise ValueError(f"relations without their ends: {[tuple(r) for r in bad.limit(5).collect()]}")
        if name == "knowledge_bases":
            for row in rows.toLocalIterator():
                connectors.check_knowledge_base(row.asDict(recursive=True))
        return self.store.commit(append={name: _shaped(rows, self.table(name))})

    def create_kb(self, kb: str, name: str = "", description: str = "", embed_config: Mapping | None = None, llm_config: Mapping | None = None, settings: Mapping[str, str] | None = None, key: str = "") -> int:
        """Adds a knowledge base. Keys are used for the check of its settings and not stored."""
        connectors.check_knowledge_base({"id": kb, "embed_config": embed_config, "llm_config": llm_config}, key)
        kept = lambda c, fields: None if c is None else tuple(c.get(f) for f in fields)
        row = (kb, name or kb, description, kept(embed_config, ("provider", "model", "base_url", "dim")), kept(llm_config, ("provider", "model", "base_url")), dict(settings or {}))
        table = self.table("knowledge_bases")
        if not table.filter(F.col("id") == kb).isEmpty():
            raise ValueError(f"knowledge base {kb!r} is there already")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields if f.name != "created_at")
        return self.store.commit(append={"knowledge_bases": self.spark.createDataFrame([row], schema).withColumn("created_at", self.now)})

    def kbs(self) -> DataFrame:
        return scans.hidden(scans.list_oldest(self.table("knowledge_bases")), ())

    def get(self, name: str, kb: str | None, row_id: str) -> DataFrame:
        """A row of a table without its embedding; none if it is not there."""
        rows = self.table(name)
        return scans.hidden(scans.get(rows, kb if "kb_id" in rows.columns else None, row_id))

    def list(self, name: str, kb: str, limit: int = 0, offset: int = 0) -> DataFrame:
        """Rows of a table, newest first; communities come oldest first and all."""
        rows = self.table(name)
        return scans.list_oldest(rows, kb) if name == "communities" else scans.hidden(scans.list_newest(rows, kb, limit, offset))

    def relations_of(self, kb: str, entity: str) -> DataFrame:
        return scans.hidden(scans.relations_of(self.table("relations"), kb, [entity])).orderBy(F.col("created_at").desc(), "id")

    def update(self, name: str, changes: DataFrame, columns: Sequence[str]) -> int:
        table = self.table(name)
        if not writes.not_found(table, changes).isEmpty():
            raise KeyError(f"{name}: not found")
        return self.store.commit(kbs=_kbs(changes), **{name: writes.update(table, changes, list(columns), self.now)})

    def delete_kb(self, kb: str) -> int:
        names = ("knowledge_bases", "episodes", "entities", "relations", "communities", "access_log", "decay_state", "feedback", "ingestion_jobs")
        after = writes.delete_kb(dict(zip(names, self.store.tables(*names), strict=True)), kb)
        return self.store.commit(kbs=[kb], **after)

    def delete_entity(self, kb: str, row_id: str) -> int:
        entities, relations = self.store.tables("entities", "relations")
        gone = scans.get(entities, kb, row_id).select("kb_id", "id")
        if gone.isEmpty():
            raise KeyError(row_id)
        entities, relations = writes.delete_entities(entities, relations, gone)
        return self.store.commit(kbs=[kb], entities=entities, relations=relations)

    def delete_episode(self, kb: str, row_id: str) -> int:
        episodes, relations = self.store.tables("episodes", "relations")
        gone = scans.get(episodes, kb, row_id).select("kb_id", "id")
        if gone.isEmpty():
            raise KeyError(row_id)
        episodes, relations = writes.delete_episodes(episodes, relations, gone)
        return self.store.commit(kbs=[kb], episodes=episodes, relations=relations)

    def invalidate(self, kb: str, row_id: str) -> int:
        relations = self.table("relations")
        valid = scans.get(relations, kb, row_id).filter("invalid_at is null").select("kb_id", "id")
        if valid.isEmpty():
            raise KeyError(row_id)
        return self.store.commit(kbs=[kb], relations=writes.invalidate(relations, valid, self.now))

    # Text in, answers out
    def add_texts(self, texts: DataFrame) -> DataFrame:
        """Stores texts as episodes, then ingests them; returns the counts. The episodes stay if the ingest fails, and so does the log of their access."""
        texts = texts.select("id", "kb_id", "content", "source", "metadata")
        self._store_episodes(texts)
        return self._ingest(texts).result

    def _store_episodes(self, texts: DataFrame) -> None:
        episodes = ingest.episodes_of(texts, self.now)
        accesses = ingest.accesses_of(episodes, self.now)
        self.store.commit(append={"episodes": episodes, "access_log": accesses}, kbs=_kbs(texts), decay_state=writes.log_access(self.table("decay_state"), accesses))

    def _ingest(self, texts: DataFrame) -> ingest.Ingested:
        kbs = _kbs(texts)
        entities, relations = (t.filter(F.col("kb_id").isin(kbs)) for t in self.store.tables("entities", "relations"))
        done = ingest.ingest(texts, entities, relations, self.now, self.embedder, self.extractor)
        self.store.commit(kbs=kbs, entities=done.entities, relations=done.relations)
        return done

    def search(self, kb: str, query: str, options: SearchOptions | None = None, log: bool = False) -> DataFrame:
        vector = self.embedder.embed([query])[0]
        names = ("entities", "relations", "episodes", "decay_state", "communities")
        entities, relations, episodes, states, communities = self.store.tables(*names)
        found = fusion.hybrid_search(entities, relations, episodes, states, kb, query, vector, self.now, options, communities)
        if log:
            self.log_access(fusion.access_events(found, self.now))
        return found

    def prompt_context(self, kb: str, text: str, most: int = 5) -> str | None:
        """The best memories for a prompt as JSON; nothing if there are none, or if the search fails."""
        try:
            found = self.search(kb, text, SearchOptions(top_k=most))
            return None if found.isEmpty() else fusion.prompt_context(found, most).first()["context"]
        except Exception as e:  # a prompt is not held up
            log.warning("search for a prompt failed: %s", e)
            return None

    def log_access(self, events: DataFrame) -> int:
        """Appends accesses; only the states of their knowledge bases are rewritten."""
        return self.store.commit(append={"access_log": events}, kbs=_kbs(events), decay_state=writes.log_access(self.table("decay_state"), events))

    def traverse(self, kb: str, seeds: Sequence[str], hops: int = 2, types: Sequence[str] = (), at: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes with what is known of them, and edges, of the snapshot at a time."""
        relations, entities = self.store.tables("relations", "entities")
        valid = scans.valid_relations(relations, kb, at if at is not None else self.now)
        nodes, edges = graph.subgraph(valid, seeds, max(1, min(hops, graph.MAX_HOPS)), types)
        return graph.hydrate(nodes, entities.filter(F.col("kb_id") == kb)), edges

    def describe(self, kb: str, seeds: Sequence[str], hops: int = 2, form: str = "text") -> str:
        """A subgraph as text for a reader, or as JSON."""
        nodes, edges = self.traverse(kb, seeds, hops)
        if form == "text":
            return graph.summarize(nodes, edges).first()["text"]
        if form != "json":
            raise ValueError(f"unknown form {form!r}: use text or json")
        rows = lambda df, *order: [json.loads(x) for x in df.orderBy(*order).toJSON().collect()]
        return json.dumps({"nodes": rows(nodes, "hops", "node"), "edges": rows(scans.hidden(edges), "id")})

    def record_feedback(self, rows: DataFrame) -> int:
        return self.create("feedback", rows)

    def search_feedback(self, kb: str, query: str, limit: int = 50) -> DataFrame:
        return bm25.search_feedback(self.table("feedback"), query, kb, limit)

    def list_feedback(self, kb: str, topic: str | None = None, limit: int = 0) -> DataFrame:
        return scans.list_feedback(self.table("feedback"), kb, topic, limit)

    def feedback_stats(self, kb: str) -> DataFrame:
        return scans.feedback_stats(self.table("feedback"), kb)

    def stats(self) -> DataFrame:
        """Counts by knowledge base, and the bytes of the whole store."""
        names = ("knowledge_bases", "episodes", "entities", "relations", "communities")
        return scans.stats(*self.store.tables(*names)).withColumn("store_bytes", F.lit(self.store.size()))

    # Lifecycle
    def decay(self) -> int:
        return self.store.commit(decay_state=lifecycle.decay_batch(self.table("decay_state"), self.now, self.half_life))

    def prune(self, threshold: float = DEFAULT_PRUNE_THRESHOLD) -> int:
        p = lifecycle.prune(*self.store.tables("entities", "relations", "episodes", "decay_state"), self.now, threshold)
        return self.store.commit(entities=p.entities, relations=p.relations, episodes=p.episodes, decay_state=p.states)

    def consolidate(self, kb: str, threshold: float = DEFAULT_CONSOLIDATE_THRESHOLD) -> int:
        """Merges similar entities; returns how many went."""
        entities, relations, states, moves = lifecycle.consolidate(*self.store.tables("entities", "relations", "decay_state"), kb, threshold)
        self.store.commit(kbs=[kb], entities=entities, relations=relations, decay_state=states)
        return moves.count()

    # Queue
    def submit(self, texts: DataFrame, wait: bool = False) -> DataFrame:
        """Queues texts and returns their jobs; with wait, runs them first."""
        rows = cut(jobs.submit(texts, self.now), "jobs")
        self.store.commit(append={"ingestion_jobs": rows})
        if not wait:
            return rows
        ids = [r["id"] for r in rows.select("id").collect()]
        return self.run_jobs(len(ids), ids)

    def job(self, job_id: str) -> DataFrame:
        return scans.get(self.table("ingestion_jobs"), None, job_id)

    def list_jobs(self, kb: str | None = None, status: str | None = None, limit: int = 0) -> DataFrame:
        return scans.list_jobs(self.table("ingestion_jobs"), kb, status, limit)

    def export_jobs(self, folder: str, form: str = "json", kb: str | None = None) -> None:
        sinks.export_jobs(self.table("ingestion_jobs"), folder, form, kb)

    def retry_jobs(self, ids: Sequence[str], wait: bool = False) -> DataFrame:
        """Queues failed jobs again; with wait, runs them. Others stay as they are."""
        ids = list(ids)
        table = self.table("ingestion_jobs")
        self.store.commit(kbs=_kbs(table.filter(F.col("id").isin(ids))), ingestion_jobs=jobs.retry(table, ids))
        if wait:
            self.run_jobs(len(ids), ids)
        return self.table("ingestion_jobs").filter(F.col("id").isin(ids))

    def run_jobs(self, n: int = 16, ids: Sequence[str] | None = None) -> DataFrame:
        """Claims the oldest queued jobs, or those of ids, and runs them; returns the jobs as they ended.

        The texts of all are stored and ingested together, so no two jobs of a knowledge base are at work side by side. A
        text whose extraction fails is its own job's failure. Should the ingest as a whole fail, it is tried again in
        halves, down to the job that cannot be done. Each job ends with its own counts or error, and is told of.
        """
        table = jobs.recover_stale(self.table("ingestion_jobs"), self.now)
        after, mine = jobs.claim(table, n, self.now, ids)
        claimed = [(r["id"], r["kb_id"]) for r in mine.select("id", "kb_id").collect()]
        self.store.commit(ingestion_jobs=after)
        names, kbs = [i for i, _ in claimed], sorted({kb for _, kb in claimed})
        if not names:
            return self.table("ingestion_jobs").limit(0)
        mine = self.table("ingestion_jobs").filter(F.col("kb_id").isin(kbs) & F.col("id").isin(names))
        self._store_episodes(_texts_of(mine))
        changes = None
        for part in self._run(mine, names):
            changes = part if changes is None else changes.unionByName(part)
        self.store.commit(kbs=kbs, ingestion_jobs=jobs.set_status(self.table("ingestion_jobs"), changes, self.now))
        ended = self.table("ingestion_jobs").filter(F.col("kb_id").isin(kbs) & F.col("id").isin(names))
        if self.notify is not None:
            for event in jobs.events(ended).toJSON().collect():
                try:
                    self.notify(json.loads(event))
                except Exception as e:  # a job's end does not hang on who hears of it
                    log.warning("notification failed: %s", e)
        return ended

    def _run(self, mine: DataFrame, names: list[str]) -> list[DataFrame]:
        part = mine.filter(F.col("id").isin(names))
        try:
            return [jobs.outcomes(part, self._ingest(_texts_of(part)).by_text)]
        except Exception as e:
            if len(names) > 1:
                half = len(names) // 2
                return self._run(mine, names[:half]) + self._run(mine, names[half:])
            failed = part.select("id", F.lit("failed").alias("new_status"), jobs.episode_id().alias("new_episode_id"), F.lit(None).cast("string").alias("new_result"), F.lit(str(e)).alias("new_error"))
            return [failed]


def _texts_of(mine: DataFrame) -> DataFrame:
    return mine.select(jobs.episode_id().alias("id"), "kb_id", "content", "source", "metadata")


def _kbs(rows: DataFrame) -> list[str]:
    """The knowledge bases of rows: as many as one call names."""
    return sorted(r[0] for r in rows.select("kb_id").distinct().collect())


def _shaped(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with the columns of a table; those they lack are null."""
    return table.limit(0).unionByName(rows, allowMissingColumns=True).select(*table.columns)
