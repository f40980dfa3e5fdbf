"""A knowledge graph from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KB = "main"
#: Start of relations without a date of their own, and the time that counts as now for accesses.
EPOCH, NOW = "1995-01-01 00:00:00", "2024-02-01 00:00:00"


class KnowledgeGraph:
    """The tables of a data directory as knowledge-graph tables; all lazy, and only what a query reads is read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def entities(self, embeddings: bool = False) -> DataFrame:
        """id, kb_id, name, type, summary, created_at; with embeddings, customers have those of the same number."""
        kinds = (
            ("region", "r", "r_regionkey", "r_name", F.lit("")),
            ("nation", "n", "n_nationkey", "n_name", F.lit("")),
            ("customer", "c", "c_custkey", "c_name", F.col("c_mktsegment")),
            ("supplier", "s", "s_suppkey", "s_name", F.lit("")),
            ("part", "p", "p_partkey", "p_name", F.concat_ws(" ", "p_type", "p_brand")),
        )
        rows = None
        for kind, mark, key, name, summary in kinds:
            part = self.raw(kind).select(F.concat(F.lit(f"{mark}:"), F.col(key).cast("string")).alias("id"), F.lit(KB).alias("kb_id"), F.col(name).alias("name"), F.lit(kind).alias("type"), summary.alias("summary"), F.lit(EPOCH).cast("timestamp").alias("created_at"))
            rows = part if rows is None else rows.unionByName(part)
        if embeddings:
            held = self.raw("embeddings").select(F.concat(F.lit("c:"), F.col("vec_id").cast("string")).alias("id"), "embedding")
            rows = rows.join(held, "id", "left")
        return rows

    def relations(self, kinds: tuple[str, ...] = ("in", "located_in", "buys_from", "bought")) -> DataFrame:
        """id, kb_id, source_id, target_id, type, summary, weight, valid_at, invalid_at, created_at."""
        start, none = F.lit(EPOCH).cast("timestamp"), F.lit(None).cast("timestamp")
        text = lambda mark, key: F.concat(F.lit(f"{mark}:"), F.col(key).cast("string"))
        parts = []
        fixed = (("in", "nation", "n", "n_nationkey", "r", "n_regionkey"), ("located_in", "customer", "c", "c_custkey", "n", "c_nationkey"), ("located_in", "supplier", "s", "s_suppkey", "n", "s_nationkey"))
        for kind, table, mark, key, to, to_key in fixed:
            if kind in kinds:
                ids = F.concat(F.lit(f"{kind}:{mark}:"), F.col(key).cast("string"))
                parts.append(self.raw(table).select(ids.alias("id"), text(mark, key).alias("source_id"), text(to, to_key).alias("target_id"), F.lit(kind).alias("type"), F.lit("").alias("summary"), F.lit(1.0).alias("weight"), start.alias("valid_at"), none.alias("invalid_at"), start.alias("created_at")))
        sold = (("buys_from", "s", "l_suppkey", F.col("l_discount") * 5), ("bought", "p", "l_partkey", F.col("l_quantity") / 50))
        if any(kind in kinds for kind, *_ in sold):
            orders = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
            lines = self.raw("lineitem").join(orders, "l_orderkey")
            ended = F.when(F.col("l_returnflag") == "R", F.col("l_shipdate").cast("timestamp"))
            for kind, to, to_key, weight in sold:
                if kind in kinds:
                    ids = F.concat_ws(":", F.lit(kind), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_micros(F.col("l_shipdate").cast("timestamp")))
                    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight)) + 0.0
                    parts.append(lines.select(ids.alias("id"), text("c", "o_custkey").alias("source_id"), text(to, to_key).alias("target_id"), F.lit(kind).alias("type"), F.col("l_returnflag").alias("summary"), bounded.alias("weight"), F.col("o_orderdate").cast("timestamp").alias("valid_at"), ended.alias("invalid_at"), F.col("o_orderdate").cast("timestamp").alias("created_at")))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows.withColumn("kb_id", F.lit(KB))

    def episodes(self) -> DataFrame:
        metadata = F.create_map(F.lit("lang"), F.col("lang"))
        return self.raw("documents").select(F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("id"), F.lit(KB).alias("kb_id"), F.col("text").alias("content"), "source", metadata.alias("metadata"), F.lit(EPOCH).cast("timestamp").alias("created_at"))

    def conversations(self) -> DataFrame:
        """Turns of conversations as episodes of a knowledge base of their own."""
        return self.raw("conversations").select(F.concat_ws(":", F.lit("t"), "conv_id", "turn").alias("id"), F.lit("talk").alias("kb_id"), F.col("text").alias("content"), F.col("role").alias("source"), F.create_map(F.lit("conv"), F.col("conv_id").cast("string")).alias("metadata"), F.lit(EPOCH).cast("timestamp").alias("created_at"))

    def access_log(self) -> DataFrame:
        return self.raw("events").select(F.lit(KB).alias("kb_id"), F.col("event_type").alias("entity_type"), F.concat(F.lit("c:"), F.col("user_id").cast("string")).alias("entity_id"), F.col("ts").cast("timestamp").alias("accessed_at"))

    def customer_states(self) -> DataFrame:
        """Decay states of customers, as entities, from all events of the user of the same number."""
        rows = self.raw("events").groupBy("user_id").agg(F.count("*").cast("int").alias("access_count"), F.max("ts").cast("timestamp").alias("last_access"))
        return rows.select(F.lit(KB).alias("kb_id"), F.lit("entity").alias("entity_type"), F.concat(F.lit("c:"), F.col("user_id").cast("string")).alias("entity_id"), F.lit(1.0).alias("strength"), "access_count", "last_access")

    def communities(self) -> DataFrame:
        """Customers by nation."""
        grouped = self.raw("customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")))).alias("member_ids"))
        return grouped.select(F.concat(F.lit("m:"), F.col("c_nationkey").cast("string")).alias("id"), F.lit(KB).alias("kb_id"), F.col("c_nationkey").cast("string").alias("name"), F.lit("").alias("summary"), "member_ids", F.timestamp_seconds(F.col("c_nationkey")).alias("created_at"))

    def feedback(self) -> DataFrame:
        """Documents with a quality label as feedback on their source."""
        docs = self.raw("documents").select("doc_id", "text", "source")
        rows = self.raw("labels").join(docs, "doc_id")
        return rows.select(F.concat(F.lit("f:"), F.col("doc_id").cast("string")).alias("id"), F.lit(KB).alias("kb_id"), F.col("source").alias("topic"), F.col("text").alias("content"), F.col("quality").cast("string").alias("correction"), F.lit("labels").alias("source"), F.lit(EPOCH).cast("timestamp").alias("created_at"))

    def knowledge_bases(self) -> DataFrame:
        """Regions as knowledge bases, in order of their keys."""
        return self.raw("region").select(F.concat(F.lit("k:"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.lit("").alias("description"), F.timestamp_seconds(F.col("r_regionkey")).alias("created_at"))

    def relation_vectors(self) -> DataFrame:
        """Relations with the vector of the number of the customer at their source; others have none."""
        held = self.raw("embeddings").select(F.concat(F.lit("c:"), F.col("vec_id").cast("string")).alias("source_id"), "embedding")
        return self.relations().join(held, "source_id", "left")

    def memory_states(self) -> DataFrame:
        """Decay states of entities (some in no table), relations and episodes from the events of users of their numbers."""
        user = F.col("user_id").cast("string")
        kind = F.when(F.col("event_type") == "purchase", "relation").when(F.col("event_type") == "error", "episode").otherwise("entity")
        mark = F.when(F.col("event_type") == "view", "c:").when(F.col("event_type") == "click", "z:").when(F.col("event_type") == "purchase", "located_in:c:").when(F.col("event_type") == "error", "d:").otherwise("s:")
        rows = self.raw("events").groupBy(kind.alias("entity_type"), F.concat(mark, user).alias("entity_id")).agg(F.count("*").cast("int").alias("access_count"), F.max("ts").cast("timestamp").alias("last_access"))
        return rows.select(F.lit(KB).alias("kb_id"), "entity_type", "entity_id", F.lit(1.0).alias("strength"), "access_count", "last_access")

    def full_jobs(self) -> DataFrame:
        """jobs() with all columns of a job table."""
        none = F.lit(None).cast("string")
        rows = self.jobs().withColumns({"content": F.lit(""), "metadata": F.create_map(F.lit("a"), F.lit("b")), "episode_id": none, "result": none, "error": none})
        return rows.select("id", "kb_id", "status", "content", "source", "metadata", "episode_id", "result", "error", "attempts", "max_attempts", "created_at", "started_at", "completed_at")

    def jobs(self) -> DataFrame:
        """Orders as a queue: open ones wait, those in progress run, filled ones are done."""
        status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
        return self.raw("orders").select(F.concat(F.lit("j:"), F.col("o_orderkey").cast("string")).alias("id"), F.lit(KB).alias("kb_id"), status.alias("status"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderdate").cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"), (F.col("o_custkey") % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"))
