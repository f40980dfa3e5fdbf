"""The registered queries over the engine's own operators, and the SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.functions import vectors as vx
from graphloom.functions import weights as wt
from graphloom.operators import bm25, fusion, graph, jobs, knn, lifecycle, resolve, scans, writes
from graphloom.schema import SearchOptions
from graphloom.sources.kg import EPOCH, KB, NOW, KnowledgeGraph

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "hybrid_search"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = "1998-01-01 00:00:00"
SEEDS = ("c:1", "s:7")
QUERY = "the and"
TYPES = ("in", "located_in")
#: Number of the vector that searches start from.
QUERY_VECTOR = 3
HALF_LIFE = 168.0


def query(sql: str | None = None) -> Callable[[Callable[[KnowledgeGraph], DataFrame]], Query]:
    """Registers a query over the tables of a directory, under its function's name."""

    def register(f: Callable[[KnowledgeGraph], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(KnowledgeGraph(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return register


ENTITIES = """
entities AS (
  SELECT 'r:' || r_regionkey AS id, r_name AS name, 'region' AS type, '' AS summary FROM region
  UNION ALL SELECT 'n:' || n_nationkey, n_name, 'nation', '' FROM nation
  UNION ALL SELECT 'c:' || c_custkey, c_name, 'customer', c_mktsegment FROM customer
  UNION ALL SELECT 's:' || s_suppkey, s_name, 'supplier', '' FROM supplier
  UNION ALL SELECT 'p:' || p_partkey, p_name, 'part', p_type || ' ' || p_brand FROM part
)"""
RELATIONS = f"""
lines AS (SELECT *, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch_us(l_shipdate)) AS l_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
relations AS (
  SELECT 'in:n:' || n_nationkey AS id, 'n:' || n_nationkey AS source_id, 'r:' || n_regionkey AS target_id, 'in' AS type, '' AS summary, 1.0::DOUBLE AS weight, TIMESTAMP '{EPOCH}' AS valid_at, NULL::TIMESTAMP AS invalid_at, TIMESTAMP '{EPOCH}' AS created_at FROM nation
  UNION ALL SELECT 'located_in:c:' || c_custkey, 'c:' || c_custkey, 'n:' || c_nationkey, 'located_in', '', 1.0, TIMESTAMP '{EPOCH}', NULL, TIMESTAMP '{EPOCH}' FROM customer
  UNION ALL SELECT 'located_in:s:' || s_suppkey, 's:' || s_suppkey, 'n:' || s_nationkey, 'located_in', '', 1.0, TIMESTAMP '{EPOCH}', NULL, TIMESTAMP '{EPOCH}' FROM supplier
  UNION ALL SELECT 'buys_from:' || l_id, 'c:' || o_custkey, 's:' || l_suppkey, 'buys_from', l_returnflag, greatest(0.0, least(1.0, l_discount * 5)) + 0.0, o_orderdate, CASE WHEN l_returnflag = 'R' THEN l_shipdate END, o_orderdate FROM lines
  UNION ALL SELECT 'bought:' || l_id, 'c:' || o_custkey, 'p:' || l_partkey, 'bought', l_returnflag, greatest(0.0, least(1.0, l_quantity / 50)) + 0.0, o_orderdate, CASE WHEN l_returnflag = 'R' THEN l_shipdate END, o_orderdate FROM lines
)"""
SEED_ROWS = ", ".join(f"('{s}')" for s in SEEDS)


def _bfs_sql(where: str, hops: int = 2) -> str:
    levels = "".join(f", l{h} AS (SELECT DISTINCT b.dst AS node FROM both_ways b JOIN l{h - 1} l ON b.src = l.node)" for h in range(1, hops + 1))
    union = " UNION ALL ".join(f"SELECT node, {h} AS hops FROM l{h}" for h in range(hops + 1))
    return f"""WITH {RELATIONS}, e AS (SELECT source_id, target_id FROM relations WHERE {where}),
both_ways AS (SELECT source_id AS src, target_id AS dst FROM e UNION SELECT target_id, source_id FROM e),
l0 AS (SELECT node FROM (VALUES {SEED_ROWS}) AS t(node)){levels}
SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM ({union}) GROUP BY node"""


VALID = f"valid_at <= TIMESTAMP '{AS_OF}' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '{AS_OF}')"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def settled(weight: Column) -> Column:
    """A combined weight to twelve digits. Products of weights of two digits can lie just between two such numbers, where the last bit decides; none lies there after this shift."""
    return F.round(weight + 3e-14, 12)


# Lookups, snapshots, counts


@query(f"WITH {ENTITIES}, {RELATIONS} SELECT 'main' AS kb_id, (SELECT count(*) FROM documents) AS episodes, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM relations) AS relations, (SELECT count(DISTINCT c_nationkey) FROM customer) AS communities UNION ALL SELECT 'talk', count(*), 0, 0, 0 FROM conversations")
def stats_by_kb(g: KnowledgeGraph) -> DataFrame:
    return scans.stats(None, g.episodes().unionByName(g.conversations()), g.entities(), g.relations(), g.communities())


@query("SELECT source AS topic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (source)")
def feedback_stats(g: KnowledgeGraph) -> DataFrame:
    return scans.feedback_stats(g.feedback(), KB)


@query("SELECT count(*) AS n FROM documents WHERE source ILIKE 'SRC1%'")
def episode_prefix_count(g: KnowledgeGraph) -> DataFrame:
    return scans.count_by_source_prefix(g.episodes(), KB, "SRC1")


@query("SELECT 'd:' || doc_id AS id, source FROM documents ORDER BY 1 LIMIT 20 OFFSET 10")
def episode_page(g: KnowledgeGraph) -> DataFrame:
    return scans.list_newest(g.episodes(), KB, 20, 10).select("id", "source")


@query(f"WITH {ENTITIES} SELECT id, name, type, summary FROM entities WHERE id IN ('c:1', 's:1', 'p:7', 'n:3')")
def entities_by_ids(g: KnowledgeGraph) -> DataFrame:
    return scans.get_by_ids(scans.entity_names(g.entities(), KB), KB, ["c:1", "s:1", "p:7", "n:3", "x:1"]).drop("kb_id")


@query(f"WITH {ENTITIES} SELECT id, name FROM entities WHERE lower(name) = lower('FRANCE') OR lower(name) = lower('nation_3')")
def entities_by_name(g: KnowledgeGraph) -> DataFrame:
    named = [scans.find_by_name(g.entities(), KB, n) for n in ("FRANCE", "nation_3")]
    return named[0].unionByName(named[1]).select("id", "name")


@query(f"WITH {RELATIONS} SELECT type, count(*) AS n, round(sum(weight), 4) AS weight FROM relations WHERE {VALID} GROUP BY type")
def valid_edges_asof(g: KnowledgeGraph) -> DataFrame:
    return scans.valid_relations(g.relations(), KB, as_of()).groupBy("type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@query(f'''WITH {RELATIONS}, t AS (SELECT unnest(['1996-01-01', '1998-01-01', '2000-01-01']::TIMESTAMP[]) AS "at") SELECT "at", type, count(*) AS n FROM relations, t WHERE valid_at <= "at" AND (invalid_at IS NULL OR invalid_at > "at") GROUP BY ALL''')
def as_of_snapshot_agg(g: KnowledgeGraph) -> DataFrame:
    times = g.spark.createDataFrame([("1996-01-01",), ("1998-01-01",), ("2000-01-01",)], "t string").select(F.col("t").cast("timestamp").alias("at"))
    found = scans.valid_relations_at_each(g.relations(), times).groupBy("at", "type").agg(F.count("*").alias("n"))
    return found.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(f"WITH {RELATIONS} SELECT id, source_id, target_id, type FROM relations WHERE source_id IN ({', '.join(repr(s) for s in SEEDS)}) OR target_id IN ({', '.join(repr(s) for s in SEEDS)})")
def entity_relations(g: KnowledgeGraph) -> DataFrame:
    return scans.relations_of(g.relations(), KB, SEEDS).select("id", "source_id", "target_id", "type")


@query(f"WITH {RELATIONS}, n AS (SELECT 'c:' || c_custkey AS entity_id FROM customer WHERE c_mktsegment = 'BUILDING'), u AS (SELECT entity_id, type FROM relations JOIN n ON source_id = entity_id UNION ALL SELECT entity_id, type FROM relations JOIN n ON target_id = entity_id AND source_id <> target_id) SELECT entity_id, count(*) AS n FROM u GROUP BY entity_id")
def entity_relations_batch(g: KnowledgeGraph) -> DataFrame:
    wanted = g.entities().filter("type = 'customer' and summary = 'BUILDING'").select("id")
    return scans.relations_of_each(g.relations(), wanted).groupBy("entity_id").agg(F.count("*").alias("n"))


@query(f"WITH {RELATIONS}, v AS (SELECT *, CASE WHEN source_id = 'c:1' THEN target_id ELSE source_id END AS other FROM relations WHERE (source_id = 'c:1' OR target_id = 'c:1') AND {VALID}) SELECT other, type, arg_min(id, (-epoch_us(created_at), id)) AS id FROM v GROUP BY other, type")
def neighbour_view(g: KnowledgeGraph) -> DataFrame:
    return scans.neighbour_view(g.relations(), KB, "c:1", as_of()).select("other", "type", "id")


@query(f"WITH {RELATIONS} SELECT id, 'source_id' AS missing FROM relations WHERE source_id IN ('c:1', 's:7') UNION ALL SELECT id, 'target_id' FROM relations WHERE target_id IN ('c:1', 's:7')")
def missing_ends(g: KnowledgeGraph) -> DataFrame:
    return writes.missing_ends(g.relations(), g.entities().filter(~F.col("id").isin("c:1", "s:7")))


@query(f"WITH {RELATIONS} SELECT type, count(*) AS n FROM relations WHERE source_id NOT IN ('c:1', 's:7') AND target_id NOT IN ('c:1', 's:7') GROUP BY type")
def cascade_delete(g: KnowledgeGraph) -> DataFrame:
    entities = g.entities()
    gone = entities.filter(F.col("id").isin("c:1", "s:7")).select("kb_id", "id")
    return writes.delete_entities(entities, g.relations(), gone)[1].groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {RELATIONS} SELECT type, count(CASE WHEN type = 'buys_from' AND invalid_at IS NULL THEN TIMESTAMP '{AS_OF}' ELSE invalid_at END) AS ended, max(CASE WHEN type = 'buys_from' AND invalid_at IS NULL THEN TIMESTAMP '{AS_OF}' ELSE invalid_at END) AS last FROM relations GROUP BY type")
def invalidate_relations(g: KnowledgeGraph) -> DataFrame:
    rows = g.relations()
    after = writes.invalidate(rows, rows.filter("type = 'buys_from'").select("kb_id", "id"), as_of())
    return after.groupBy("type").agg(F.count("invalid_at").alias("ended"), F.max("invalid_at").cast("timestamp_ntz").alias("last"))


@query("SELECT event_type AS entity_type, 'c:' || user_id AS entity_id, 1.0::DOUBLE AS strength, CAST(count(*) AS INTEGER) AS access_count, max(ts)::TIMESTAMP AS last_access FROM events GROUP BY event_type, user_id")
def access_state(g: KnowledgeGraph) -> DataFrame:
    return writes.access_state(g.access_log()).drop("kb_id").withColumn("last_access", F.col("last_access").cast("timestamp_ntz"))


# Weights and duplicates


@query(f"WITH {RELATIONS} SELECT source_id, type, round(1 - product(1 - weight) + 3e-14, 12) AS weight, count(*) AS n FROM relations GROUP BY source_id, type")
def combine_weights(g: KnowledgeGraph) -> DataFrame:
    return g.relations().groupBy("source_id", "type").agg(settled(wt.combine_all(F.col("weight"))).alias("weight"), F.count("*").alias("n"))


@query(f"WITH {RELATIONS} SELECT source_id, target_id, type, count(*) AS n FROM relations WHERE invalid_at IS NULL GROUP BY ALL HAVING count(*) > 1")
def dup_groups(g: KnowledgeGraph) -> DataFrame:
    return lifecycle.duplicate_groups(g.relations()).drop("kb_id")


_DEDUP = f"""WITH {RELATIONS}, v AS (SELECT * FROM relations WHERE invalid_at IS NULL AND source_id <> target_id),
m AS (SELECT source_id, target_id, type, arg_min(id, (-weight, epoch_us(created_at), id)) AS id, arg_min(summary, (-strlen(summary), -weight, epoch_us(created_at), id)) AS summary, CASE WHEN count(*) = 1 THEN max(weight) ELSE 1 - product(1 - weight) END AS weight, min(valid_at) AS valid_at, count(*) AS n FROM v GROUP BY ALL)"""


@query(f"{_DEDUP} SELECT id, source_id, target_id, type, summary, round(weight + 3e-14, 12) AS weight, valid_at FROM m UNION ALL SELECT id, source_id, target_id, type, summary, round(weight + 3e-14, 12), valid_at FROM relations WHERE invalid_at IS NOT NULL")
def dedup_relations(g: KnowledgeGraph) -> DataFrame:
    return lifecycle.dedup_relations(g.relations()).select("id", "source_id", "target_id", "type", "summary", settled(F.col("weight")).alias("weight"), F.col("valid_at").cast("timestamp_ntz").alias("valid_at"))


@query(f"""WITH {RELATIONS}, o AS (SELECT * FROM relations WHERE invalid_at IS NULL AND summary <> 'N'), n AS (SELECT source_id, target_id, type, CASE WHEN count(*) = 1 THEN max(weight) ELSE 1 - product(1 - weight) END AS added FROM relations WHERE summary = 'N' AND invalid_at IS NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, type ORDER BY weight DESC, created_at, id) AS k FROM o)
SELECT source_id, target_id, type, summary, round(CASE WHEN added IS NULL OR k > 1 THEN weight ELSE 1 - (1 - weight) * (1 - added) END + 3e-14, 12) AS weight FROM (SELECT r.*, added FROM r LEFT JOIN n USING (source_id, target_id, type))
UNION ALL SELECT source_id, target_id, type, 'N', round(added + 3e-14, 12) FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.source_id = n.source_id AND o.target_id = n.target_id AND o.type = n.type)""")
def upsert_strengthen(g: KnowledgeGraph) -> DataFrame:
    """Of all valid relations those with mark N come to the others."""
    rows = g.relations().filter("invalid_at is null")
    after = lifecycle.upsert_relations(rows.filter("summary <> 'N'"), rows.filter("summary = 'N'"))
    return after.select("source_id", "target_id", "type", "summary", settled(F.col("weight")).alias("weight"))


# Graph


@query(f"WITH {RELATIONS}, b AS (SELECT source_id AS node FROM relations UNION ALL SELECT target_id FROM relations) SELECT node, count(*) AS degree FROM b GROUP BY node")
def degree(g: KnowledgeGraph) -> DataFrame:
    return graph.degrees(g.relations())


@query(f"WITH {RELATIONS}, b AS (SELECT source_id AS node FROM relations UNION SELECT target_id FROM relations) SELECT (SELECT count(*) FROM b) AS nodes, (SELECT count(DISTINCT id) FROM relations) AS edges")
def graph_counts(g: KnowledgeGraph) -> DataFrame:
    return graph.counts(g.relations())


@query(_bfs_sql("true"))
def bfs_neighbors(g: KnowledgeGraph) -> DataFrame:
    return graph.neighbours(g.relations(), SEEDS, 2)


@query(_bfs_sql("type IN ('in', 'located_in')", 3))
def bfs_edge_types(g: KnowledgeGraph) -> DataFrame:
    return graph.neighbours(g.relations(), SEEDS, 3, TYPES)


@query(_bfs_sql(VALID))
def bfs_asof(g: KnowledgeGraph) -> DataFrame:
    return graph.neighbours(g.relations(), SEEDS, 2, at=as_of())


@query(f"""WITH {RELATIONS}, e AS (SELECT source_id, target_id, weight FROM relations WHERE weight >= 0.1),
b AS (SELECT source_id AS src, target_id AS dst, weight FROM e UNION ALL SELECT target_id, source_id, weight FROM e),
l0 AS (SELECT node, 1.0::DOUBLE AS w FROM (VALUES {SEED_ROWS}) AS t(node)),
l1 AS (SELECT dst AS node, max(w * weight) AS w FROM b JOIN l0 ON src = node GROUP BY dst),
l2 AS (SELECT dst AS node, max(w * weight) AS w FROM b JOIN l1 ON src = node GROUP BY dst)
SELECT node, round(max(w), 6) AS weight FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY node""")
def weighted_paths(g: KnowledgeGraph) -> DataFrame:
    return graph.weighted(g.relations(), SEEDS, 2, 0.1).select("node", F.round("weight", 6).alias("weight"))


def _pagerank_sql(rounds: int) -> str:
    steps = "".join(
        f", r{k} AS MATERIALIZED (SELECT n.node, 0.15 * n.seed + 0.85 * coalesce(g.given, 0) AS rank FROM nodes n LEFT JOIN (SELECT dst AS node, sum(rank * share) AS given FROM links JOIN r{k - 1} ON src = node GROUP BY dst) g USING (node))"
        for k in range(1, rounds + 1)
    )
    return f"""WITH {RELATIONS}, b AS (SELECT source_id AS src, target_id AS dst FROM relations UNION ALL SELECT target_id, source_id FROM relations),
links AS MATERIALIZED (SELECT src, dst, count(*) / sum(count(*)) OVER (PARTITION BY src) AS share FROM b GROUP BY src, dst),
nodes AS MATERIALIZED (SELECT DISTINCT src AS node, CASE WHEN src IN ('c:1', 's:7') THEN 0.5 ELSE 0 END AS seed FROM links),
r0 AS (SELECT node, 1.0 / (SELECT count(*) FROM nodes) AS rank FROM nodes){steps}
SELECT node, round(rank, 9) AS rank FROM r{rounds}"""


@query(_pagerank_sql(20))
def pagerank(g: KnowledgeGraph) -> DataFrame:
    return graph.pagerank(g.relations(), SEEDS, epsilon=0).select("node", F.round("rank", 9).alias("rank"))


@query(f"""WITH n AS ({_bfs_sql("type IN ('in', 'located_in')")}), {RELATIONS}
SELECT id, source_id, target_id, type FROM relations WHERE type IN ('in', 'located_in') AND source_id IN (SELECT node FROM n) AND target_id IN (SELECT node FROM n)""")
def subgraph_edges(g: KnowledgeGraph) -> DataFrame:
    return graph.subgraph(g.relations(), SEEDS, 2, TYPES)[1].select("id", "source_id", "target_id", "type")


@query(f"""WITH {ENTITIES}, {RELATIONS}, n AS ({_bfs_sql("type IN ('in', 'located_in')")}),
ed AS (SELECT * FROM relations WHERE type IN ('in', 'located_in') AND source_id IN (SELECT node FROM n) AND target_id IN (SELECT node FROM n)),
li AS (SELECT source_id AS node, string_agg('  - ' || ed.type || ' ' || coalesce(nullif(name, ''), target_id) || ' [weight: ' || printf('%.2f', weight) || ', since ' || strftime(valid_at, '%Y-%m-%d') || ']' || chr(10), '' ORDER BY weight DESC, ed.id) AS lines FROM ed LEFT JOIN entities ON entities.id = target_id GROUP BY source_id),
bl AS (SELECT hops, coalesce(name, '') AS name, n.node, chr(10) || coalesce(name, '') || ' (' || coalesce(type, '') || ', ' || CASE hops WHEN 0 THEN 'seed' WHEN 1 THEN '1 hop' ELSE hops || ' hops' END || ')' || CASE WHEN coalesce(summary, '') <> '' THEN ': ' || summary ELSE '' END || chr(10) || coalesce(lines, '') AS block FROM n LEFT JOIN entities ON entities.id = n.node LEFT JOIN li ON li.node = n.node)
SELECT 'Context from knowledge graph:' || chr(10) || string_agg(block, '' ORDER BY hops, name, node) AS text FROM bl""")
def subgraph_text(g: KnowledgeGraph) -> DataFrame:
    nodes, edges = graph.subgraph(g.relations(), SEEDS, 2, TYPES)
    return graph.summarize(graph.hydrate(nodes, g.entities()), edges)


@query("SELECT unnest(['n:0', 'x:1']) AS node UNION SELECT 'c:' || c_custkey FROM customer WHERE c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 1)")
def community_expand(g: KnowledgeGraph) -> DataFrame:
    return graph.expand_communities(g.communities(), ["n:0", "x:1", "c:1"])


@query(f"WITH n AS ({_bfs_sql(VALID)}) SELECT node, round(1.0 / hops, 9) AS score FROM n WHERE hops > 0")
def graph_channel(g: KnowledgeGraph) -> DataFrame:
    return graph.channel(g.relations(), SEEDS, "bfs", 2, at=as_of()).select("node", F.round("score", 9).alias("score"))


# Text search


_MARKED, _PLAIN = tx._MARKED, tx._PLAIN


def _bm25_sql(table: str, key: str, parts: list[str], words: list[str], name: str) -> str:
    """CTEs that score one-token phrases over a table."""
    tokens = " || ".join(f"regexp_extract_all(lower(strip_accents(coalesce({p}, ''))), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')" for p in parts)
    hits = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS h{i}" for i, w in enumerate(words))
    stats = ", ".join(f"sum((h{i} > 0)::INT) AS n{i}" for i in range(len(words)))
    idf = lambda i: f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END"
    score = " + ".join(f"({idf(i)}) * h{i} * 2.2 / (h{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(words)))
    return f"""{name}_t AS (SELECT {key} AS id, {tokens} AS t FROM {table}), {name}_h AS (SELECT id, len(t) AS len, {hits} FROM {name}_t),
{name}_s AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean, {stats} FROM {name}_h),
{name} AS (SELECT id, round({score}, 9) AS score FROM {name}_h, {name}_s WHERE {" AND ".join(f"h{i} > 0" for i in range(len(words)))})"""


@query(f"WITH {_bm25_sql('documents', 'doc_id', ['text', 'source'], QUERY.split(), 'm')} SELECT 'd:' || id AS id, round(score, 6) AS score FROM m")
def bm25_documents(g: KnowledgeGraph) -> DataFrame:
    return bm25.search(g.episodes(), ["content", "source"], QUERY, KB, limit=None).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25_sql('documents', 'doc_id', ['text', 'source'], ['src3'], 'm')} SELECT 'd:' || id AS id, round(score, 6) AS score FROM m")
def bm25_index(g: KnowledgeGraph) -> DataFrame:
    postings, lengths = bm25.build_index(g.episodes(), ["content", "source"])
    return bm25.search_index(postings, lengths, "src3", KB, limit=None).select("id", F.round("score", 6).alias("score"))


_UNION = f"""{ENTITIES}, {RELATIONS}, {_bm25_sql('entities', 'id', ['name', 'summary', 'type'], ['building'], 'me')}, {_bm25_sql('relations', 'id', ['type', 'summary'], ['building'], 'mr')}, {_bm25_sql('documents', 'doc_id', ['text', 'source'], ['building'], 'md')},
found AS (SELECT * FROM (SELECT id, 'entity' AS type, score FROM me ORDER BY score DESC, id LIMIT 30) UNION ALL SELECT * FROM (SELECT id, 'relation', score FROM mr ORDER BY score DESC, id LIMIT 30) UNION ALL SELECT * FROM (SELECT 'd:' || id, 'episode', score FROM md ORDER BY score DESC, 'd:' || id LIMIT 30))"""


@query(f"WITH {_UNION} SELECT id, type, round(score, 6) AS score FROM found ORDER BY found.score DESC, type, id LIMIT 30")
def bm25_union(g: KnowledgeGraph) -> DataFrame:
    return bm25.search_all(g.entities(), g.relations(), g.episodes(), "building", KB, 30).select("id", "type", F.round("score", 6).alias("score"))


@query(f"WITH f AS (SELECT * FROM labels JOIN documents USING (doc_id)), {_bm25_sql('f', 'doc_id', ['source', 'text', 'quality::VARCHAR'], ['the', 'of'], 'm')} SELECT 'f:' || id AS id, round(score, 6) AS score FROM (SELECT * FROM m ORDER BY score DESC, 'f:' || id LIMIT 50)")
def feedback_search(g: KnowledgeGraph) -> DataFrame:
    return bm25.search_feedback(g.feedback(), "the of", KB).select("id", F.round("score", 6).alias("score"))


# Vectors


def _query_vector(g: KnowledgeGraph) -> list[float]:
    return [float(x) for x in g.raw("embeddings").filter(F.col("vec_id") == QUERY_VECTOR).first()["embedding"]]


def _vectors(g: KnowledgeGraph) -> DataFrame:
    return g.raw("embeddings").select(F.col("vec_id").alias("id"), F.lit(KB).alias("kb_id"), "embedding")


_V = f"q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = {QUERY_VECTOR}), v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings)"
_TOP = "SELECT id, round(distance, 6) AS distance FROM (SELECT id, round({}, 9) AS distance FROM v, q ORDER BY distance, id LIMIT 20)"


@query(f"WITH {_V} " + _TOP.format("1 - list_cosine_similarity(e, q)"))
def cosine_topk(g: KnowledgeGraph) -> DataFrame:
    return knn.nearest(_vectors(g), _query_vector(g), 20).select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_V} " + _TOP.format("list_distance(e, q)"))
def l2_topk(g: KnowledgeGraph) -> DataFrame:
    return knn.nearest(_vectors(g), _query_vector(g), 20, "l2").select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_V} " + _TOP.format("-list_dot_product(e, q)"))
def dot_topk(g: KnowledgeGraph) -> DataFrame:
    return knn.nearest(_vectors(g), _query_vector(g), 20, "dot").select("id", F.round("distance", 6).alias("distance"))


@query(f"""WITH {_V}, z AS (SELECT id, e, (list_max(e) - list_min(e)) / 254 AS scale, list_min(e) + 127 * ((list_max(e) - list_min(e)) / 254) AS o FROM v),
d AS (SELECT id, scale, o, [greatest(-127.0, least(127.0, round_even((x - o) / scale, 0))) FOR x IN e] AS data FROM z),
b AS (SELECT id, scale, o, data, [x * scale + o FOR x IN data] AS back FROM d)
SELECT id, round(distance, 6) AS distance FROM (SELECT id, round(1 - (scale * list_dot_product(data, q) + o * list_sum(q)) / (sqrt(list_dot_product(back, back)) * sqrt(list_dot_product(q, q))), 9) AS distance FROM b, q ORDER BY distance, id LIMIT 20)""")
def quantized_topk(g: KnowledgeGraph) -> DataFrame:
    return knn.nearest_quantized(knn.quantized(_vectors(g)), _query_vector(g), 20).select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_V}, w AS (SELECT id::VARCHAR AS id, e FROM v) SELECT id, round(distance, 6) AS distance FROM (SELECT id, round(1 - list_cosine_similarity(e, q), 9) AS distance FROM w, q ORDER BY distance, id LIMIT 20)")
def inverted_file_topk(g: KnowledgeGraph) -> DataFrame:
    rows = _vectors(g).withColumn("id", F.col("id").cast("string"))
    return knn.InvertedFile.build(rows).search(_query_vector(g), 20).select("id", F.round("distance", 6).alias("distance"))


@query("SELECT vec_id::VARCHAR AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")
def vector_norms(g: KnowledgeGraph) -> DataFrame:
    return _vectors(g).select(F.col("id").cast("string").alias("id"), F.round(vx.norm(F.col("embedding")), 5).alias("norm"))


@query("WITH v AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS e FROM embeddings) SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.e, y.e), 6) AS similarity FROM v x JOIN v y ON x.id < y.id AND round(list_cosine_similarity(x.e, y.e), 9) >= 0.4")
def similar_pairs(g: KnowledgeGraph) -> DataFrame:
    return knn.similar_pairs(_vectors(g), 0.4).select("a", "b", F.round("similarity", 6).alias("similarity"))


# Fusion and decay


_RRF = f"""{_UNION}, {_V}, names AS (SELECT * FROM entities),
b AS (SELECT id, type, row_number() OVER (ORDER BY score DESC, type, id) AS rank FROM (SELECT * FROM found ORDER BY score DESC, type, id LIMIT 30)),
vn AS (SELECT 'c:' || id AS id, round(1 - list_cosine_similarity(e, q), 9) AS distance FROM v, q),
vc AS (SELECT id, 'entity' AS type, round(1 - distance, 9) AS score FROM (SELECT vn.id, distance FROM vn JOIN entities USING (id) ORDER BY distance, id LIMIT 30)),
c AS (SELECT id, type, row_number() OVER (ORDER BY score DESC, type, id) AS rank FROM vc)"""


def _channels(g: KnowledgeGraph) -> list[DataFrame]:
    words = bm25.search_all(g.entities(), g.relations(), g.episodes(), "building", KB, 30)
    return [fusion.ranked(words), fusion.ranked(fusion.vector_channel(g.entities(embeddings=True), g.relations(), KB, _query_vector(g), 30))]


@query(f"WITH {_RRF} SELECT type, id, round(sum(1 / (60.0::DOUBLE + rank)), 6) AS score FROM (SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY type, id")
def rrf(g: KnowledgeGraph) -> DataFrame:
    return fusion.fuse(_channels(g)).select("type", "id", F.round("score", 6).alias("score"))


_STATE = "st AS (SELECT 'c:' || user_id AS id, 1.0::DOUBLE AS strength, count(*) AS access_count, max(ts)::TIMESTAMP AS last_access FROM events GROUP BY user_id)"
_HOURS = f"((epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_access)) / 3.6e9)"
_FACTOR = f"CASE WHEN strength IS NULL THEN 0.8 ELSE greatest(0.1, least(1.0, strength * exp(-ln(2.0::DOUBLE) / {HALF_LIFE} * greatest({_HOURS}, 0) / (1 + ln(1 + access_count::DOUBLE))))) END"


@query(f"WITH {_STATE} SELECT 'c:' || c_custkey AS id, round({_FACTOR}, 6) AS multiplier FROM customer LEFT JOIN st ON st.id = 'c:' || c_custkey")
def decay_multiplier(g: KnowledgeGraph) -> DataFrame:
    results = g.entities().filter("type = 'customer'").select("id", "kb_id", F.lit("entity").alias("type"), F.lit(1.0).alias("score"))
    return fusion.apply_decay(results, g.customer_states(), now(), HALF_LIFE).select("id", F.round("score", 6).alias("multiplier"))


@query(f"""WITH {_RRF}, {_STATE}, seeds AS (SELECT id FROM b WHERE type = 'entity' UNION SELECT id FROM c WHERE type = 'entity'),
e AS (SELECT source_id, target_id FROM relations WHERE valid_at <= TIMESTAMP '{NOW}' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '{NOW}')), both_ways AS (SELECT source_id AS src, target_id AS dst FROM e UNION SELECT target_id, source_id FROM e),
h1 AS (SELECT DISTINCT dst AS node FROM both_ways JOIN seeds ON src = id), h2 AS (SELECT DISTINCT dst AS node FROM both_ways JOIN h1 ON src = node),
near AS (SELECT node, min(h) AS hops FROM (SELECT node, 1 AS h FROM h1 UNION ALL SELECT node, 2 FROM h2) WHERE node NOT IN (SELECT id FROM seeds) GROUP BY node),
gc AS (SELECT id, 'entity' AS type, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT node AS id, round(1.0 / hops, 9) AS score FROM near JOIN entities ON node = entities.id ORDER BY score DESC, id LIMIT 30)),
fused AS (SELECT type, id, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS score FROM (SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT id, type, rank FROM gc) GROUP BY type, id ORDER BY score DESC, type, id LIMIT 20),
done AS (SELECT type, fused.id, round(score * {_FACTOR}, 9) AS score FROM fused LEFT JOIN st ON st.id = fused.id AND fused.type = 'entity')
SELECT id, type, round(score, 6) AS score FROM done ORDER BY done.score DESC, type, id LIMIT 10""")
def hybrid_search(g: KnowledgeGraph) -> DataFrame:
    entities = g.entities(embeddings=True)
    found = fusion.hybrid_search(entities, g.relations(), g.episodes(), g.customer_states(), KB, "building", _query_vector(g), now(), SearchOptions(top_k=10))
    return found.select("id", "type", F.round("score", 6).alias("score"))


# Lifecycle


_ACCESS = "s AS (SELECT event_type AS entity_type, 'c:' || user_id AS entity_id, 1.0::DOUBLE AS strength, max(ts)::TIMESTAMP AS last_access FROM events GROUP BY event_type, user_id)"


@query(f"WITH {_ACCESS} SELECT entity_type, entity_id, round(strength * exp(-ln(2.0::DOUBLE) / {HALF_LIFE} * {_HOURS}), 6) AS strength FROM s")
def decay_batch(g: KnowledgeGraph) -> DataFrame:
    after = lifecycle.decay_batch(writes.access_state(g.access_log()), now(), HALF_LIFE)
    return after.select("entity_type", "entity_id", F.round("strength", 6).alias("strength"))


@query(f"""WITH {RELATIONS}, st AS (SELECT CASE event_type WHEN 'purchase' THEN 'relation' WHEN 'error' THEN 'episode' ELSE 'entity' END AS entity_type,
  CASE event_type WHEN 'view' THEN 'c:' WHEN 'click' THEN 'z:' WHEN 'purchase' THEN 'located_in:c:' WHEN 'error' THEN 'd:' ELSE 's:' END || user_id AS entity_id, max(ts)::TIMESTAMP AS last_access FROM events GROUP BY 1, 2),
w AS (SELECT entity_type, entity_id, round(exp(-ln(2.0::DOUBLE) / {HALF_LIFE} * {_HOURS}), 9) AS strength FROM st)
SELECT entity_type, entity_id, round(strength, 6) AS strength FROM w WHERE strength <= 0.9 AND NOT (entity_type = 'entity' AND entity_id IN (SELECT source_id FROM relations UNION SELECT target_id FROM relations))""")
def prune_candidates(g: KnowledgeGraph) -> DataFrame:
    states = lifecycle.decay_batch(g.memory_states(), now(), HALF_LIFE).withColumn("strength", F.round("strength", 9))
    return lifecycle.prune_candidates(states, g.relations(), 0.9).select("entity_type", "entity_id", F.round("strength", 6).alias("strength"))


_PAIRS = "pairs AS (SELECT 'c:' || x.vec_id AS a, 'c:' || y.vec_id AS b FROM embeddings x JOIN embeddings y ON 'c:' || x.vec_id < 'c:' || y.vec_id AND round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) >= 0.4 WHERE x.vec_id IN (SELECT c_custkey FROM customer) AND y.vec_id IN (SELECT c_custkey FROM customer))"


@query(f"""WITH {ENTITIES}, {RELATIONS}, {_PAIRS}, n AS (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM relations UNION ALL SELECT target_id FROM relations) GROUP BY id),
k AS (SELECT entities.id, coalesce(n, 0) AS n, strlen(summary) AS len FROM entities LEFT JOIN n USING (id))
SELECT a, b, CASE WHEN ka.n > kb.n OR (ka.n = kb.n AND ka.len > kb.len) THEN a ELSE b END AS survivor FROM pairs JOIN k ka ON ka.id = a JOIN k kb ON kb.id = b""")
def survivor_choice(g: KnowledgeGraph) -> DataFrame:
    entities = g.entities(embeddings=True).filter("embedding is not null")
    pairs = knn.similar_pairs(entities, 0.4)
    return lifecycle.survivors(pairs, entities, g.relations()).select("a", "b", "survivor")


@query(f"WITH {RELATIONS} SELECT CASE WHEN source_id = 'c:2' AND invalid_at IS NULL THEN 'c:1' ELSE source_id END AS source_id, type, count(*) AS n FROM relations GROUP BY 1, 2")
def redirect_relations(g: KnowledgeGraph) -> DataFrame:
    moves = g.spark.createDataFrame([(KB, "c:2", "c:1")], "kb_id string, merged string, survivor string")
    return lifecycle.redirect(g.relations(), F.broadcast(moves)).groupBy("source_id", "type").agg(F.count("*").alias("n"))


# Names, sentences, rules


@query(f"WITH {ENTITIES} SELECT id, trim(regexp_replace(lower(name || '   ' || type || ' '), '\\s+', ' ', 'g')) AS name FROM entities")
def normalize_names(g: KnowledgeGraph) -> DataFrame:
    return g.entities().select("id", tx.normalize_name(F.concat("name", F.lit("   "), "type", F.lit(" "))).alias("name"))


_NEW_NAMES = "n(new_id, name) AS (SELECT 'x' || c_custkey, replace(c_name, '#', '') || CASE WHEN c_custkey % 200 = 0 THEN 'x' ELSE '' END FROM customer WHERE c_custkey % 100 = 0)"


@query(f"""WITH {ENTITIES}, {_NEW_NAMES}, s AS (SELECT new_id, id AS entity_id, round(jaro_winkler_similarity(lower(n.name), lower(entities.name)), 9) AS similarity FROM n, entities),
r AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY similarity DESC, entity_id) AS k FROM s) SELECT new_id, entity_id, round(similarity, 6) AS similarity FROM r WHERE k = 1 AND similarity >= 0.85""")
def fuzzy_match(g: KnowledgeGraph) -> DataFrame:
    """Every hundredth customer under a changed name, against all entities."""
    known = g.entities()
    key = F.substring("id", 3, 20).cast("int")
    suffix = F.when(key % 200 == 0, "x").otherwise("")
    new = known.filter((F.col("type") == "customer") & (key % 100 == 0)).select("kb_id", F.concat(F.lit("x"), key.cast("string")).alias("id"), F.concat(F.regexp_replace("name", "#", ""), suffix).alias("name"), F.lit("").alias("type"), F.lit("").alias("summary"))
    return resolve.fuzzy_matches(new, known).select("new_id", "entity_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {ENTITIES} SELECT 'y' || a.id AS new_id, min(b.id) AS entity_id FROM entities a JOIN entities b ON lower(a.name) = lower(b.name) AND a.type = b.type GROUP BY a.id")
def exact_match(g: KnowledgeGraph) -> DataFrame:
    known = g.entities()
    new = known.select("kb_id", F.concat(F.lit("y"), "id").alias("id"), F.concat(F.lit(" "), F.upper("name")).alias("name"), "type")
    return resolve.exact_matches(new, known)


@query(r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(line, '^\s+|\s+$', '', 'g'), '[.!?]+\s+')) AS s FROM l), t AS (SELECT doc_id, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s FROM p) SELECT doc_id, count(*) AS sentences, CAST(sum(length(s)) AS BIGINT) AS chars FROM t WHERE s <> '' GROUP BY doc_id")
def split_sentences(g: KnowledgeGraph) -> DataFrame:
    rows = g.raw("documents").select("doc_id", F.explode(tx.split_sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("s")).alias("chars"))


# Queue


@query("SELECT 'j:' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, 'j:' || o_orderkey LIMIT 25")
def job_dequeue(g: KnowledgeGraph) -> DataFrame:
    return jobs.dequeue(g.jobs(), 25).select("id")


@query(f"SELECT 'j:' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '{AS_OF}' - INTERVAL 5 MINUTES AND o_custkey % 4 < 3")
def stale_recover(g: KnowledgeGraph) -> DataFrame:
    return jobs.stale(g.jobs(), as_of()).select("id")


@query("SELECT status, count(*) AS n, CAST(sum(attempts) AS BIGINT) AS attempts FROM (SELECT CASE WHEN o_orderstatus = 'O' AND row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, 'j:' || o_orderkey) <= 25 THEN 'running' WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'completed' END AS status, o_custkey % 4 + CASE WHEN o_orderstatus = 'O' AND row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, 'j:' || o_orderkey) <= 25 THEN 1 ELSE 0 END AS attempts FROM orders) GROUP BY status")
def job_claim(g: KnowledgeGraph) -> DataFrame:
    after, _ = jobs.claim(g.jobs(), 25, as_of())
    return after.groupBy("status").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


from graphloom.plans import more  # noqa: E402, F401 - registers the rest
