"""More registered queries: lookups, writes, index maintenance, texts, rules, ingest, jobs. See catalogue for how they are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.functions import vectors as vx
from graphloom.functions import weights as wt
from graphloom.operators import bm25, extract, fusion, graph, ingest, jobs, knn, lifecycle, providers, resolve, scans, writes
from graphloom.plans.catalogue import _PAIRS, _TOP, _V, AS_OF, ENTITIES, HALF_LIFE, RELATIONS, SEED_ROWS, SEEDS, TYPES, _bfs_sql, _bm25_sql, _pagerank_sql, _query_vector, _vectors, as_of, now, query, settled
from graphloom.schema import SearchOptions, page_limit
from graphloom.sources import sinks
from graphloom.sources.kg import EPOCH, KB, NOW, KnowledgeGraph
from graphloom.sources.shared import fresh
from graphloom.streaming import ingest as stream

NAIVE = "timestamp_ntz"


# Lookups and lists


@query("SELECT 'k:' || r_regionkey AS id, r_name AS name FROM region WHERE r_regionkey = 2 UNION ALL SELECT 'k:' || r_regionkey, 'all:' || r_name FROM region")
def kb_lookup(g: KnowledgeGraph) -> DataFrame:
    kbs = g.knowledge_bases()
    listed = scans.list_oldest(kbs).withColumn("name", F.concat(F.lit("all:"), "name"))
    return scans.get(kbs, None, "k:2").unionByName(listed).select("id", "name")


@query(f"WITH {ENTITIES} SELECT id, type FROM (SELECT id, type FROM entities ORDER BY id LIMIT 20 OFFSET 10) UNION ALL SELECT id, 'got:' || type FROM entities WHERE id = 's:3'")
def entity_page(g: KnowledgeGraph) -> DataFrame:
    got = scans.get(g.entities(), KB, "s:3").withColumn("type", F.concat(F.lit("got:"), "type"))
    return scans.list_newest(g.entities(), KB, 20, 10).unionByName(got).select("id", "type")


@query(f"WITH {RELATIONS} SELECT id, type FROM (SELECT id, type FROM relations ORDER BY created_at DESC, id LIMIT 30 OFFSET 5) UNION ALL SELECT id, 'got:' || type FROM relations WHERE id = 'in:n:4'")
def relation_page(g: KnowledgeGraph) -> DataFrame:
    got = scans.get(g.relations(), KB, "in:n:4").withColumn("type", F.concat(F.lit("got:"), "type"))
    return scans.list_newest(g.relations(), KB, 30, 5).unionByName(got).select("id", "type")


@query(f"WITH {RELATIONS} SELECT id, source_id, target_id FROM relations WHERE id IN (SELECT 'located_in:c:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def relations_by_ids(g: KnowledgeGraph) -> DataFrame:
    wanted = g.entities().filter("type = 'customer' and summary = 'BUILDING'").select(F.concat(F.lit("located_in:"), "id").alias("id"))
    return scans.get_by_ids(g.relations(), KB, wanted).select("id", "source_id", "target_id")


@query("SELECT 'm:' || c_nationkey AS id, CAST(c_nationkey AS VARCHAR) AS name, count(*) AS members FROM customer GROUP BY c_nationkey")
def community_list(g: KnowledgeGraph) -> DataFrame:
    return scans.list_oldest(g.communities(), KB).select("id", "name", F.size("member_ids").cast("long").alias("members"))


@query(f"WITH {RELATIONS} SELECT 'entity' AS kind, count(*) AS n, min('c:' || vec_id) AS first FROM embeddings WHERE vec_id IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'relation', count(*), min(id) FROM relations JOIN embeddings ON source_id = 'c:' || vec_id WHERE invalid_at IS NULL")
def load_embeddings(g: KnowledgeGraph) -> DataFrame:
    parts = [("entity", scans.embeddings(g.entities(embeddings=True))), ("relation", scans.embeddings(g.relation_vectors(), active_only=True))]
    counted = [rows.agg(F.count("*").alias("n"), F.min("id").alias("first")).withColumn("kind", F.lit(kind)) for kind, rows in parts]
    return counted[0].unionByName(counted[1])


@query("SELECT id, status FROM (SELECT 'j:' || o_orderkey AS id, 'queued' AS status FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, 'j:' || o_orderkey LIMIT 40) UNION ALL SELECT 'j:' || o_orderkey, 'got' FROM orders WHERE o_orderkey = 5")
def job_list(g: KnowledgeGraph) -> DataFrame:
    got = scans.get(g.jobs(), None, "j:5").withColumn("status", F.lit("got"))
    return scans.list_jobs(g.jobs(), KB, "queued", 40).unionByName(got).select("id", "status")


@query("SELECT 'f:' || doc_id AS id, source AS topic FROM labels JOIN documents USING (doc_id) WHERE source = 'src1' ORDER BY 'f:' || doc_id LIMIT 30")
def feedback_by_topic(g: KnowledgeGraph) -> DataFrame:
    return scans.list_feedback(g.feedback(), KB, "src1", 30).select("id", "topic")


_ACCESS = "s AS (SELECT event_type AS entity_type, 'c:' || user_id AS entity_id, count(*) AS n, max(ts)::TIMESTAMP AS last_access FROM events GROUP BY event_type, user_id)"
_HOURS = f"((epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_access)) / 3.6e9)"


@query(f"WITH {_ACCESS}, w AS (SELECT entity_type, entity_id, exp(-ln(2.0::DOUBLE) / {HALF_LIFE} * {_HOURS}) AS strength FROM s) SELECT entity_type, entity_id, round(strength, 6) AS strength FROM w WHERE strength <= 0.9 UNION ALL SELECT 'got', entity_id, round(strength, 6) FROM w WHERE entity_type = 'view' AND entity_id = 'c:3'")
def weak_decay_states(g: KnowledgeGraph) -> DataFrame:
    states = lifecycle.decay_batch(writes.access_state(g.access_log()), now(), HALF_LIFE)
    got = writes.get_state(states, KB, "view", "c:3").withColumn("entity_type", F.lit("got"))
    return scans.weak_states(states, KB, 0.9).unionByName(got).select("entity_type", "entity_id", F.round("strength", 6).alias("strength"))


@query("""SELECT '{"id":"k:' || r_regionkey || '","embed_config":{"provider":"ollama","model":"m"}}' AS shown FROM region""")
def hidden_columns(g: KnowledgeGraph) -> DataFrame:
    """Knowledge bases as they are shown: without embeddings and keys."""
    rows = g.knowledge_bases().select("id", F.struct(F.lit("ollama").alias("provider"), F.lit("m").alias("model"), F.lit("secret").alias("api_key")).alias("embed_config"), F.array(F.lit(1.0)).alias("embedding"))
    shown = scans.hidden(rows)
    return shown.select(F.to_json(F.struct(*shown.columns)).alias("shown"))


@query("SELECT CAST(x AS INTEGER) AS asked, CAST(CASE WHEN x <= 0 THEN 50 ELSE least(x, 1000) END AS INTEGER) AS page, CAST(CASE WHEN x <= 0 THEN 10 ELSE least(x, 1000) END AS INTEGER) AS top_k, CAST(CASE WHEN x <= 0 THEN 2 ELSE least(x, 10) END AS INTEGER) AS hops FROM range(-20, 1200) t(x)")
def limit_clamps(g: KnowledgeGraph) -> DataFrame:
    options = ((x, SearchOptions(top_k=x, hops=x).normalized()) for x in range(-20, 1200))
    return g.spark.createDataFrame([(x, page_limit(x), o.top_k, o.hops) for x, o in options], "asked int, page int, top_k int, hops int")


@query("SELECT unnest(['hybrid', 'bm25', 'vector']) AS mode, unnest([true, true, false]) AS bm25, unnest([true, false, true]) AS vector, unnest([true, false, false]) AS graph")
def search_modes(g: KnowledgeGraph) -> DataFrame:
    rows = [(m, o.bm25, o.vector, o.graph) for m in ("hybrid", "bm25", "vector") for o in [SearchOptions.of_mode(m)]]
    return g.spark.createDataFrame(rows, "mode string, bm25 boolean, vector boolean, graph boolean")


@query(f"WITH {ENTITIES}, {RELATIONS}, {_bm25_sql('entities', 'id', ['name', 'summary', 'type'], ['building'], 'me')} SELECT me.id, name || ': ' || summary AS content FROM me JOIN entities USING (id) ORDER BY me.score DESC, me.id LIMIT 25")
def search_contents(g: KnowledgeGraph) -> DataFrame:
    return bm25.search_all(g.entities(), g.relations(), g.episodes(), "building", KB, 25).filter("type = 'entity'").select("id", "content")


@query(f"WITH {ENTITIES}, {RELATIONS}, h AS (SELECT 'c:' || user_id AS id FROM events UNION SELECT 'in:n:' || user_id FROM events UNION SELECT 'nothing:' || user_id FROM events) SELECT id, 'entity' AS type, name || ': ' || summary AS content FROM h JOIN entities USING (id) UNION ALL SELECT id, type, content FROM (SELECT id, 'relation' AS type, type || ': ' || summary AS content FROM h JOIN relations USING (id)) WHERE id NOT IN (SELECT id FROM entities)")
def hit_hydration(g: KnowledgeGraph) -> DataFrame:
    users = g.raw("events").select("user_id").distinct()
    ids = users.select(F.explode(F.array(*[F.concat(F.lit(m), F.col("user_id").cast("string")) for m in ("c:", "in:n:", "nothing:")])).alias("id"))
    hits = ids.select("id", F.lit(KB).alias("kb_id"), F.lit(1.0).alias("score"))
    return fusion.hydrate_hits(hits, g.entities(), g.relations()).select("id", "type", "content")


@query(f"WITH {RELATIONS}, {_bm25_sql('relations', 'id', ['type', 'summary'], ['located'], 'mr')}, top AS (SELECT id FROM mr ORDER BY score DESC, id LIMIT 30) SELECT DISTINCT unnest([source_id, target_id]) AS node FROM relations JOIN top USING (id)")
def seed_ids(g: KnowledgeGraph) -> DataFrame:
    """Seeds that relation hits give."""
    hits = fusion.ranked(bm25.search_all(g.entities(), g.relations(), g.episodes(), "located", KB, 30))
    return g.spark.createDataFrame([(s,) for s in fusion.seeds_of([hits], g.relations())], "node string")


# Writes


@query(f"WITH {ENTITIES} SELECT type, count(*) AS n, count(DISTINCT name) AS names FROM (SELECT type, name FROM entities UNION ALL SELECT 'company', s_name FROM supplier) GROUP BY type")
def create_entities(g: KnowledgeGraph) -> DataFrame:
    new = g.entities().filter("type = 'supplier'").select(F.concat(F.lit("new:"), "id").alias("id"), "kb_id", "name", F.lit("company").alias("type"))
    return writes.insert(g.entities(), new).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


@query(f"WITH {ENTITIES} SELECT type, CASE WHEN summary = 'BUILDING' THEN 'changed' ELSE summary END AS summary, count(*) AS n, count(CASE WHEN summary = 'BUILDING' THEN 1 END) AS touched FROM entities GROUP BY 1, 2")
def update_entities(g: KnowledgeGraph) -> DataFrame:
    table = g.entities().withColumn("updated_at", F.lit(EPOCH).cast("timestamp"))
    changes = table.filter("summary = 'BUILDING'").withColumn("summary", F.lit("changed"))
    after = writes.update(table, changes, ["summary"], now())
    return after.groupBy("type", "summary").agg(F.count("*").alias("n"), F.count_if(F.col("updated_at") == now()).alias("touched"))


@query(f"WITH {RELATIONS} SELECT 'episodes' AS what, count(*) AS n FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT 'cited', count(*) FROM relations WHERE type = 'located_in' AND source_id[1] = 'c' AND NOT (CAST(source_id[3:] AS BIGINT) % 10 = 0 AND CAST(source_id[3:] AS BIGINT) IN (SELECT doc_id FROM documents)) UNION ALL SELECT 'relations', count(*) FROM relations WHERE type = 'located_in' AND source_id[1] = 'c'")
def delete_episodes_cascade(g: KnowledgeGraph) -> DataFrame:
    episodes = g.episodes()
    relations = g.relations(("located_in",)).filter("source_id like 'c:%'").withColumn("episode_id", F.concat(F.lit("d:"), F.substring("source_id", 3, 20)))
    gone = episodes.filter(F.substring("id", 3, 20).cast("long") % 10 == 0)
    left, cited = writes.delete_episodes(episodes, relations, gone)
    counts = [("episodes", left.agg(F.count("*").alias("n"))), ("cited", cited.agg(F.count("episode_id").alias("n"))), ("relations", cited.agg(F.count("*").alias("n")))]
    rows = [c.withColumn("what", F.lit(what)) for what, c in counts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"WITH {ENTITIES}, {RELATIONS} SELECT 'episodes' AS what, count(*) AS n FROM documents UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'knowledge_bases', count(*) - 1 FROM region")
def delete_kb_cascade(g: KnowledgeGraph) -> DataFrame:
    """A knowledge base of conversations goes with its episodes; the other stays."""
    kbs = g.knowledge_bases().withColumn("id", F.when(F.col("id") == "k:1", F.lit("talk")).otherwise(F.col("id")))
    tables = {"episodes": g.episodes().unionByName(g.conversations()), "entities": g.entities(), "relations": g.relations(), "knowledge_bases": kbs}
    rows = None
    for name, left in writes.delete_kb(tables, "talk").items():
        one = left.agg(F.count("*").alias("n")).withColumn("what", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows


_HALF = "2024-01-15 00:00:00"


@query(f"WITH {_ACCESS} SELECT entity_type, entity_id, CASE WHEN last_access >= TIMESTAMP '{_HALF}' THEN 1.0::DOUBLE ELSE round(exp(-ln(2.0::DOUBLE) / {HALF_LIFE} * ((epoch_us(TIMESTAMP '{_HALF}') - epoch_us(last_access)) / 3.6e9)), 6) END AS strength, CAST(n AS INTEGER) AS access_count, last_access FROM s")
def log_access(g: KnowledgeGraph) -> DataFrame:
    """States of the first half of a month, decayed, then the accesses of the rest."""
    log, half = g.access_log(), F.lit(_HALF).cast("timestamp")
    before = lifecycle.decay_batch(writes.access_state(log.filter(F.col("accessed_at") < half)), half, HALF_LIFE)
    after = writes.log_access(before, log.filter(F.col("accessed_at") >= half))
    return after.select("entity_type", "entity_id", F.round("strength", 6).alias("strength"), "access_count", F.col("last_access").cast(NAIVE).alias("last_access"))


@query(f"WITH {_ACCESS} SELECT entity_type, entity_id, CASE WHEN CAST(entity_id[3:] AS BIGINT) % 5 = 0 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS strength FROM s WHERE CAST(entity_id[3:] AS BIGINT) % 7 <> 0")
def set_strength(g: KnowledgeGraph) -> DataFrame:
    states, key = writes.access_state(g.access_log()), F.substring("entity_id", 3, 20).cast("long")
    changed = writes.set_strength(states, states.filter(key % 5 == 0).withColumn("strength", F.lit(0.25)))
    return writes.delete_states(changed, states.filter(key % 7 == 0)).select("entity_type", "entity_id", "strength")


@query("SELECT type, count(*) AS n FROM (SELECT 'job.' || CASE WHEN o_orderstatus = 'F' THEN 'completed' END AS type FROM orders WHERE o_orderstatus = 'F') GROUP BY type")
def event_log(g: KnowledgeGraph) -> DataFrame:
    """Events of jobs that have ended, appended as JSON lines in two steps and read back."""
    folder, events = fresh(g.spark, "events"), jobs.events(g.jobs())
    odd = F.substring("job.id", 3, 20).cast("long") % 2 == 1
    for part in (events.filter(odd), events.filter(~odd)):
        sinks.append_json_lines(part, folder)
    return g.spark.read.schema("type string").json(folder).groupBy("type").agg(F.count("*").alias("n"))


def _picky(event: dict) -> None:
    if event["event_type"] == "error":
        raise ValueError("not for us")


@query("SELECT count(CASE WHEN event_type <> 'error' THEN 1 END) AS sent, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed FROM events")
def notified(g: KnowledgeGraph) -> DataFrame:
    sent = sinks.send(g.raw("events").select("event_id", "event_type"), sinks.notify_all([_picky]))
    return sent.agg(F.sum("sent").alias("sent"), F.sum("failed").alias("failed"))


# Vectors and the index


@query(f"WITH {_V} SELECT id, round(1 - distance, 6) AS score FROM (SELECT 'c:' || id AS id, round(1 - list_cosine_similarity(e, q), 9) AS distance FROM v, q WHERE id IN (SELECT c_custkey FROM customer) ORDER BY distance, 'c:' || id LIMIT 20)")
def stored_search_entities(g: KnowledgeGraph) -> DataFrame:
    return knn.stored_search(g.entities(embeddings=True), KB, _query_vector(g), 0).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {RELATIONS}, {_V} SELECT id, round(1 - distance, 6) AS score FROM (SELECT relations.id, round(1 - list_cosine_similarity(e, q), 9) AS distance FROM relations JOIN v ON source_id = 'c:' || v.id, q WHERE invalid_at IS NULL ORDER BY distance, relations.id LIMIT 35)")
def stored_search_relations(g: KnowledgeGraph) -> DataFrame:
    return knn.stored_search(g.relation_vectors(), KB, _query_vector(g), 35, relations=True).select("id", F.round("score", 6).alias("score"))


def _indexed(g: KnowledgeGraph) -> DataFrame:
    return _vectors(g).withColumn("id", F.col("id").cast("string"))


_STRINGS = f"{_V}, w AS (SELECT id::VARCHAR AS id, e FROM v)"


@query(f"WITH {_STRINGS} SELECT id, round(distance, 6) AS distance FROM (SELECT id, round(1 - list_cosine_similarity(e, q), 9) AS distance FROM w, q ORDER BY distance, id LIMIT 20)")
def stored_index_topk(g: KnowledgeGraph) -> DataFrame:
    """The index, written and read back."""
    folder = fresh(g.spark, "index")
    knn.InvertedFile.build(_indexed(g)).save(folder)
    return knn.InvertedFile.load(g.spark, folder).search(_query_vector(g), 20).select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_STRINGS}, kept AS (SELECT id, CASE WHEN CAST(id AS BIGINT) % 11 = 0 THEN [-x FOR x IN e] ELSE e END AS e FROM w WHERE CAST(id AS BIGINT) % 7 <> 0) SELECT id, round(distance, 6) AS distance, (SELECT count(*) FROM kept) AS held FROM (SELECT id, round(1 - list_cosine_similarity(e, q), 9) AS distance FROM kept, q ORDER BY distance, id LIMIT 20)")
def maintained_index_topk(g: KnowledgeGraph) -> DataFrame:
    """The index after rows came, changed and went."""
    rows, number = _indexed(g), F.col("id").cast("long")
    index = knn.InvertedFile.build(rows.filter(number % 3 != 0))
    index = index.insert(rows.filter(number % 3 == 0)).insert(rows.filter(number % 11 == 0).withColumn("embedding", F.transform("embedding", lambda x: -x)))
    index = index.remove(rows.filter(number % 7 == 0))
    return index.search(_query_vector(g), 20).select("id", F.round("distance", 6).alias("distance"), F.lit(index.count(KB)).alias("held"))


@query(f"WITH {_V} " + _TOP.format("1 - list_cosine_similarity(e, q)"))
def adaptive_topk(g: KnowledgeGraph) -> DataFrame:
    index = knn.InvertedFile.build(_indexed(g))
    return knn.nearest_adaptive(_vectors(g), _query_vector(g), 20, index).select("id", F.round("distance", 6).alias("distance"))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id AS id, round(e[1] / sqrt(list_dot_product(e, e)), 5) AS first, round(e[64] / sqrt(list_dot_product(e, e)), 5) AS last FROM v")
def normalized_vectors(g: KnowledgeGraph) -> DataFrame:
    unit = vx.normalize(F.col("embedding"))
    return _vectors(g).select("id", F.round(F.element_at(unit, 1), 5).alias("first"), F.round(F.element_at(unit, 64), 5).alias("last"))


class VowelEmbedder:
    """Counts of five letters: an embedder whose vectors SQL can make too."""

    dim = 5

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.count(c)) for c in "aeiou"] for t in texts]


_VOWELS = ", ".join(f"CAST(length(t) - length(replace(t, '{c}', '')) AS DOUBLE) AS {c}" for c in "aeiou")


@query(f"WITH {ENTITIES}, x AS (SELECT id, CASE WHEN trim(summary) = '' THEN name ELSE name || ': ' || summary END AS t FROM entities) SELECT id, {_VOWELS} FROM x")
def batch_embeddings(g: KnowledgeGraph) -> DataFrame:
    rows = g.entities().select("id", tx.entity_text(F.col("name"), F.col("summary")).alias("t"))
    return providers.embed(rows, "t", VowelEmbedder()).select("id", *[F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate("aeiou")])


# Graph


@query(f"WITH {ENTITIES}, n AS ({_bfs_sql("type IN ('in', 'located_in')")}) SELECT node, hops, coalesce(name, '') AS name, coalesce(type, '') AS type FROM n LEFT JOIN entities ON node = id")
def subgraph_nodes(g: KnowledgeGraph) -> DataFrame:
    nodes, _ = graph.subgraph(g.relations(), SEEDS, 2, TYPES)
    return graph.hydrate(nodes, g.entities()).select("node", "hops", "name", "type")


@query(f"WITH {_pagerank_sql(20).removeprefix('WITH ')} ORDER BY rank DESC, node".replace("SELECT node, round(rank, 9) AS rank FROM r20", "SELECT node, round(rank, 9) AS score FROM r20 WHERE node NOT IN ('c:1', 's:7')").replace("ORDER BY rank DESC, node", "ORDER BY score DESC, node LIMIT 30"))
def graph_channel_pagerank(g: KnowledgeGraph) -> DataFrame:
    """The channel's best, as a search would rank them; its types and hops play no part."""
    found = graph.channel(g.relations(), SEEDS, "pagerank", 1, TYPES)
    return found.withColumn("score", F.round("score", 9)).orderBy(F.col("score").desc(), "node").limit(30)


_WALKS = f"""b AS (SELECT source_id AS src, target_id AS dst, weight FROM relations WHERE weight >= 0.3 UNION ALL SELECT target_id, source_id, weight FROM relations WHERE weight >= 0.3),
l0 AS (SELECT node, 1.0::DOUBLE AS w FROM (VALUES {SEED_ROWS}) AS t(node)),
l1 AS (SELECT dst AS node, max(w * weight) AS w FROM b JOIN l0 ON src = node GROUP BY dst),
l2 AS (SELECT dst AS node, max(w * weight) AS w FROM b JOIN l1 ON src = node GROUP BY dst)"""


@query(f"WITH {RELATIONS}, {_WALKS} SELECT node, round(max(w), 6) AS score FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) WHERE node NOT IN ('c:1', 's:7') GROUP BY node ORDER BY score DESC, node LIMIT 30")
def graph_channel_weighted(g: KnowledgeGraph) -> DataFrame:
    found = graph.channel(g.relations(), SEEDS, "weighted", 2, TYPES, min_weight=0.3)
    return found.withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), "node").limit(30)


@query(f"""WITH {RELATIONS}, kept AS (SELECT * FROM relations WHERE type <> 'in' AND id NOT IN (SELECT 'located_in:c:' || c_custkey FROM customer WHERE c_custkey % 2 = 0)),
asked AS (SELECT 'n:' || n_nationkey AS node FROM nation UNION SELECT 'r:' || r_regionkey FROM region UNION SELECT 'c:' || c_custkey FROM customer UNION SELECT 'x:1')
SELECT node, node IN (SELECT source_id FROM kept UNION SELECT target_id FROM kept) AS held FROM asked""")
def graph_edits(g: KnowledgeGraph) -> DataFrame:
    """Edges added twice and removed, then who is still in the graph."""
    rest = g.relations().filter("type <> 'in'")
    even = F.substring("source_id", 3, 20).cast("long") % 2 == 0
    edges = graph.add_edges(g.relations(("buys_from", "bought")), rest)
    edges = graph.remove_edges(graph.add_edges(edges, rest), rest.filter(F.col("id").startswith("located_in:c:") & even))
    ids = g.entities().filter("type in ('nation', 'region', 'customer')").select(F.col("id").alias("node"))
    return graph.has_entities(edges, ids.unionByName(g.spark.createDataFrame([("x:1",)], "node string")))


# Lifecycle


_MEMORY = f"""st AS (SELECT CASE event_type WHEN 'purchase' THEN 'relation' WHEN 'error' THEN 'episode' ELSE 'entity' END AS entity_type,
  CASE event_type WHEN 'view' THEN 'c:' WHEN 'click' THEN 'z:' WHEN 'purchase' THEN 'located_in:c:' WHEN 'error' THEN 'd:' ELSE 's:' END || user_id AS entity_id, max(ts)::TIMESTAMP AS last_access FROM events GROUP BY 1, 2),
weak AS (SELECT entity_type, entity_id, round(exp(-ln(2.0::DOUBLE) / {HALF_LIFE} * {_HOURS}), 9) AS strength FROM st),
gone AS (SELECT * FROM weak WHERE strength <= 0.9 AND NOT (entity_type = 'entity' AND entity_id IN (SELECT source_id FROM relations UNION SELECT target_id FROM relations)))"""


@query(f"""WITH {ENTITIES}, {RELATIONS}, {_MEMORY}, known AS (SELECT id FROM entities UNION SELECT 'z:' || user_id FROM events)
SELECT 'entities' AS what, count(*) AS n FROM known WHERE id NOT IN (SELECT entity_id FROM gone WHERE entity_type = 'entity')
UNION ALL SELECT 'episodes', count(*) FROM documents WHERE 'd:' || doc_id NOT IN (SELECT entity_id FROM gone WHERE entity_type = 'episode')
UNION ALL SELECT 'ended', count(*) FROM relations WHERE type IN ('in', 'located_in') AND id IN (SELECT entity_id FROM gone WHERE entity_type = 'relation')
UNION ALL SELECT 'states', (SELECT count(*) FROM weak) - (SELECT count(*) FROM gone)
UNION ALL SELECT 'gone', count(*) FROM gone""")
def prune(g: KnowledgeGraph) -> DataFrame:
    states = lifecycle.decay_batch(g.memory_states(), now(), HALF_LIFE).withColumn("strength", F.round("strength", 9))
    more = g.raw("events").select(F.concat(F.lit("z:"), F.col("user_id").cast("string")).alias("id")).distinct().withColumn("kb_id", F.lit(KB))
    relations = g.relations().withColumn("episode_id", F.lit(None).cast("string"))
    p = lifecycle.prune(g.entities().unionByName(more, allowMissingColumns=True), relations, g.episodes(), states, now(), 0.9)
    counts = {"entities": p.entities, "episodes": p.episodes, "ended": p.relations.filter(F.col("type").isin(*TYPES) & F.col("invalid_at").isNotNull()), "states": p.states, "gone": p.gone}
    rows = None
    for what, left in counts.items():
        one = left.agg(F.count("*").alias("n")).withColumn("what", F.lit(what))
        rows = one if rows is None else rows.unionByName(one)
    return rows


# Texts


@query(r"SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS chars FROM documents")
def collapsed_texts(g: KnowledgeGraph) -> DataFrame:
    return g.raw("documents").select("doc_id", F.length(tx.collapse_whitespace(F.col("text"))).cast("long").alias("chars"))


@query(r"""WITH t AS (SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS plain FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 80) || '~' END AS short, CASE WHEN length(plain) <= 200 THEN plain ELSE left(plain, 200) || '...' END AS summary,
  list_max([strlen(left(text, CAST(i AS BIGINT))) FOR i IN range(0, 102) IF strlen(left(text, CAST(i AS BIGINT))) <= 101]) AS bytes FROM t WHERE text IS NOT NULL""")
def cut_texts(g: KnowledgeGraph) -> DataFrame:
    text = F.col("text")
    return g.raw("documents").filter(text.isNotNull()).select("doc_id", tx.shorten(text, 80, "~").alias("short"), tx.summarize_by_rule(text).alias("summary"), F.octet_length(tx.cut_bytes(text, 101)).cast("long").alias("bytes"))


@query("SELECT doc_id, len(list_filter([trim(x) FOR x IN string_split(replace(text, ' ', ','), ',')], lambda x: x <> '')) AS parts FROM documents WHERE text IS NOT NULL")
def csv_parts(g: KnowledgeGraph) -> DataFrame:
    rows = g.raw("documents").filter("text is not null")
    return rows.select("doc_id", F.size(tx.split_csv(F.replace(F.col("text"), F.lit(" "), F.lit(",")))).cast("long").alias("parts"))


@query(f"WITH {RELATIONS} SELECT id, concat_ws(' ', source_id, type, target_id) || CASE WHEN trim(summary) = '' THEN '' ELSE ': ' || summary END AS text, concat_ws('|', source_id, type, target_id) AS signature, CASE WHEN weight = 0 THEN 0.5 ELSE weight END AS weight FROM relations")
def relation_texts(g: KnowledgeGraph) -> DataFrame:
    ends = [F.col(c) for c in ("source_id", "type", "target_id")]
    return g.relations().select("id", tx.relation_text(*ends, F.col("summary")).alias("text"), tx.relation_signature(*ends).alias("signature"), wt.default_weight(F.col("weight")).alias("weight"))


_OLD_TYPE = "CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'concept' WHEN 2 THEN 'person' ELSE ' Concept ' END"
_NEW_TYPE = "CASE (c_custkey // 4) % 3 WHEN 0 THEN 'tool' WHEN 1 THEN 'concept' ELSE '' END"


@query(f"""WITH t AS (SELECT c_custkey, c_name, c_mktsegment, {_OLD_TYPE} AS old, {_NEW_TYPE} AS new FROM customer)
SELECT c_custkey, CASE WHEN new <> '' AND (trim(old) = '' OR (lower(trim(old)) = 'concept' AND new <> 'concept')) THEN new ELSE old END AS type, CASE WHEN trim(old) = '' THEN 'concept' ELSE trim(old) END AS plain,
  CASE WHEN strlen(c_name) > strlen(c_mktsegment) THEN c_name ELSE c_mktsegment END AS summary, old = '' OR new = '' OR lower(trim(old)) = lower(trim(new)) AS agree FROM t""")
def merge_rules(g: KnowledgeGraph) -> DataFrame:
    old, new = F.expr(_OLD_TYPE), F.expr(_NEW_TYPE.replace("//", "div"))
    rows = g.raw("customer").select("c_custkey", "c_name", "c_mktsegment", old.alias("old"), new.alias("new"))
    return rows.select("c_custkey", tx.merged_type(F.col("old"), F.col("new")).alias("type"), tx.default_type(F.col("old")).alias("plain"), tx.merged_summary(F.col("c_mktsegment"), F.col("c_name")).alias("summary"), tx.types_match(F.col("old"), F.col("new")).alias("agree"))


def _around(prompt) -> tuple[str, str]:
    before, after = prompt("\x00").split("\x00")
    return before, after


_ASK, _END = _around(tx.extraction_prompt)


@query(f"SELECT item_id, '{_ASK.replace(chr(39), chr(39) * 2)}' || text || '{_END}' AS prompt FROM benchmark")
def extraction_prompts(g: KnowledgeGraph) -> DataFrame:
    return g.raw("benchmark").select("item_id", F.concat(F.lit(_ASK), F.col("text"), F.lit(_END)).alias("prompt"))


# Rules

_U, _E = "CAST(user_id AS VARCHAR)", "CAST(event_id AS VARCHAR)"
_RULE_TEXTS = f"""CASE event_id % 7
  WHEN 0 THEN 'build began' || chr(10) || '$ make' || {_U} || ' -j' || chr(10) || 'Fatal: cannot open file ' || {_E}
  WHEN 1 THEN 'commit 0123456789abcdef' || chr(10) || 'Author: Dev ' || {_U} || ' <d@x.y>' || chr(10) || chr(10) || '    Merge branch x' || chr(10) || '    Mend part ' || {_E} || chr(10) || chr(10) || 'diff --git a/src/f' || {_U} || '.py b/src/f' || {_U} || '.py' || chr(10) || 'diff --git a/doc b/doc' || chr(10)
  WHEN 2 THEN 'Somebody updated app' || {_U} || '.yaml and then top.toml'
  WHEN 3 THEN 'npm install pkg' || {_U} || chr(10) || 'cargo add crate' || {_E}
  WHEN 4 THEN 'A long talk! The team picked plan ' || {_U} || '. So be it'
  WHEN 5 THEN 'Hm. They prefer tabs over ' || {_U} || ' blanks. Fine'
  ELSE 'nothing of note in ' || {_E} END"""
_SAID = f"t AS (SELECT event_id, event_id % 7 AS k, {_U} AS u, {_E} AS e, {_RULE_TEXTS} AS text FROM events)"


def _rule_texts(g: KnowledgeGraph) -> DataFrame:
    """A text for every event, of which each rule finds something in its own seventh."""
    return g.raw("events").select("event_id", F.expr(_RULE_TEXTS.replace("VARCHAR", "STRING")).alias("text"))


def _rows_sql(rows: list[tuple[int, int, str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT event_id, {at} AS position, {name} AS name, '{kind}' AS type, {summary} AS summary FROM t WHERE k = {k}" for k, at, name, kind, summary in rows)


@query(f"""WITH {_SAID} {_rows_sql([
    (0, 0, "'cannot open file ' || e", 'event', "'Fatal: cannot open file ' || e"), (0, 1, "'make' || u", 'tool', "'command that produced an error'"),
    (1, 0, "'Dev ' || u", 'person', "'git commit author'"), (1, 1, "'Mend part ' || e", 'event', "'git commit: Mend part ' || e"), (1, 2, "'doc'", 'concept', "'source file modified in commit'"), (1, 3, "'src/f' || u || '.py'", 'concept', "'source file modified in commit'"),
    (2, 0, "'.toml'", 'concept', "'configuration file that was updated'"), (2, 1, "'.yaml'", 'concept', "'configuration file that was updated'"), (2, 2, "'config change'", 'event', 'text'),
    (3, 0, "'pkg' || u", 'tool', "'dependency package'"), (3, 1, "'crate' || e", 'tool', "'dependency package'"),
    (4, 0, "'The team picked plan ' || u", 'concept', "'decision: The team picked plan ' || u"),
    (5, 0, "'They prefer tabs over ' || u || ' blanks'", 'concept', "'preference: They prefer tabs over ' || u || ' blanks'"),
])}""")
def extract_entities(g: KnowledgeGraph) -> DataFrame:
    return extract.entities_of(_rule_texts(g), "text", ["event_id"])


@query(f"""WITH {_SAID} SELECT event_id, 'make' || u AS source, 'cannot open file ' || e AS target, 'failed_with' AS type, 0.8::DOUBLE AS weight FROM t WHERE k = 0
UNION ALL SELECT event_id, 'Mend part ' || e, unnest(['doc', 'src/f' || u || '.py']), 'modified', 0.7 FROM t WHERE k = 1
UNION ALL SELECT event_id, 'project', unnest(['pkg' || u, 'crate' || e]), 'depends_on', 0.7 FROM t WHERE k = 3""")
def extract_relations(g: KnowledgeGraph) -> DataFrame:
    return extract.relations_of(_rule_texts(g), "text", ["event_id"]).select("event_id", "source", "target", "type", "weight")


@query(f"WITH {_SAID} SELECT event_id, rtrim(text, chr(10)) AS text FROM t WHERE k <> 6 AND event_id % 3 = 0")
def hook_texts(g: KnowledgeGraph) -> DataFrame:
    """Every third call of a hook, if a rule would look at its output."""
    calls = _rule_texts(g).select(F.col("event_id").alias("call"), F.lit(KB).alias("kb_id"), F.concat(F.lit("  \n"), "text", F.lit(" ")).alias("content"))
    return stream.hook_texts(calls, 3).select(F.col("call").alias("event_id"), F.col("content").alias("text"))


class WordExtractor:
    """The first two words of a text as entities that are linked: a model whose answers SQL can make too. Texts without two words cannot be read."""

    def extract(self, text: str) -> dict:
        first, second, *_ = text.split(" ")
        return {"entities": [{"name": w, "type": "word", "summary": ""} for w in (first, second)], "relations": [{"source": first, "target": second, "type": "before", "summary": "", "weight": 0.0}]}


@query(f"""WITH {_SAID}, x AS (SELECT *, string_split(text, ' ') AS w FROM t)
SELECT event_id, k = 6 AS by_model, CASE WHEN k = 6 THEN list_aggregate([w[1], w[2]], 'string_agg', '|') END AS names, NULL::VARCHAR AS error FROM x""")
def extract_with_fallback(g: KnowledgeGraph) -> DataFrame:
    """Rules first; a model where they find nothing."""
    texts = _rule_texts(g).select(F.col("event_id").cast("string").alias("id"), F.lit(KB).alias("kb_id"), F.col("text").alias("content"))
    found = ingest.extract_texts(texts, WordExtractor())
    names = F.when(F.col("by_model"), F.array_join(F.col("x.entities.name"), "|"))
    return found.select(F.col("text_id").cast("long").alias("event_id"), "by_model", names.alias("names"), "error")


# Resolution and ingest


_NEW = "n AS (SELECT 'x' || c_custkey AS new_id, 'client #' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS name FROM customer WHERE c_custkey % 100 = 0)"
_JW = "(j + 0.1 * p * (1 - j))"


@query(f"""WITH {ENTITIES}, {_NEW}, s AS (SELECT new_id, id AS entity_id, type, n.name AS a, entities.name AS b, jaro_similarity(lower(n.name), lower(entities.name)) AS j,
  len(list_filter([1, 2, 3, 4], lambda i: lower(n.name)[:i] = lower(entities.name)[:i])) AS p FROM n, entities),
r AS (SELECT *, round({_JW}, 9) AS similarity, row_number() OVER (PARTITION BY new_id ORDER BY round({_JW}, 9) DESC, entity_id) AS k FROM s),
best AS (SELECT * FROM r WHERE k = 1)
SELECT n.new_id, CASE WHEN similarity >= 0.85 AND type IN ('customer', '') OR similarity >= 0.6 AND right(a, 2) = right(b, 2) THEN entity_id END AS entity_id,
  CASE WHEN similarity >= 0.85 AND type IN ('customer', '') THEN 'fuzzy' WHEN similarity >= 0.6 AND right(a, 2) = right(b, 2) THEN 'asked' END AS tier FROM n JOIN best USING (new_id)""")
def resolve_tiers(g: KnowledgeGraph) -> DataFrame:
    """All three tiers, for every hundredth customer under another name; who is asked says yes to equal endings."""
    key = F.substring("id", 3, 20)
    new = g.entities().filter((F.col("type") == "customer") & (key.cast("long") % 100 == 0))
    new = new.select(F.concat(F.lit("x"), key).alias("id"), "kb_id", F.concat(F.lit("client #"), F.lpad(key, 9, "0")).alias("name"), "type", F.lit("").alias("summary"))
    return resolve.resolve(new, g.entities(), lambda a, b: a["name"][-2:] == b["name"][-2:])


_MENTIONS = "m AS (SELECT CAST(user_id AS VARCHAR) AS text_id, CAST(event_id AS INTEGER) AS position, event_type AS name, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'kind' END AS type, CASE WHEN event_id % 5 = 0 THEN props ELSE '' END AS summary FROM events)"


def _mentions(g: KnowledgeGraph) -> DataFrame:
    e = F.col("event_id")
    return g.raw("events").select(F.lit(KB).alias("kb_id"), F.col("user_id").cast("string").alias("text_id"), e.cast("int").alias("position"), F.col("event_type").alias("name"), F.when(e % 3 == 0, "").otherwise("kind").alias("type"), F.when(e % 5 == 0, F.col("props")).otherwise("").alias("summary"))


@query(f"""WITH {_MENTIONS} SELECT text_id, name || '|' || arg_min(type, position) AS entity_key, name, CASE WHEN max(type) = '' THEN 'concept' ELSE 'kind' END AS type, arg_min(summary, (-strlen(summary), position)) AS summary, count(*) AS n FROM m GROUP BY text_id, name""")
def in_batch_entities(g: KnowledgeGraph) -> DataFrame:
    keyed = resolve.resolve_in_batch(_mentions(g))
    merged = resolve.merge_mentions(keyed)
    counts = keyed.groupBy("text_id", "entity_key").agg(F.count("*").alias("n"))
    return merged.join(counts, ["text_id", "entity_key"]).select("text_id", "entity_key", "name", "type", "summary", "n")


@query(f"""WITH {RELATIONS}, e AS (SELECT *, row_number() OVER (ORDER BY id) AS position FROM relations WHERE type = 'buys_from' AND target_id NOT IN ('s:3', 's:4'))
SELECT source_id, target_id, round(CASE WHEN count(*) = 1 THEN max(w) ELSE 1 - product(1 - w) END + 3e-14, 12) AS weight, arg_min(summary, (-strlen(summary), position)) AS summary FROM (SELECT *, CASE WHEN weight = 0 THEN 0.5 ELSE weight END AS w FROM e) GROUP BY source_id, target_id""")
def resolved_relations(g: KnowledgeGraph) -> DataFrame:
    """Relations by the names of their ends, with blanks and capitals: ends without an entity drop out, and what says the same is merged."""
    names = g.entities().filter(~F.col("id").isin("s:3", "s:4")).filter("type in ('customer', 'supplier')").select("kb_id", resolve.endpoint(F.col("name")).alias("key"), F.col("id").alias("entity_id"))
    spoken = lambda end: F.concat(F.lit(" "), F.when(F.substring(end, 1, 1) == "c", F.lit("CUSTOMER#")).otherwise(F.lit("supplier#")), F.lpad(F.substring(end, 3, 20), 9, "0"))
    said = g.relations(("buys_from",)).select("kb_id", spoken("source_id").alias("source"), spoken("target_id").alias("target"), "type", "summary", "weight", F.col("id").alias("position"))
    merged = resolve.merge_relations(resolve.resolve_ends(said, names))
    return merged.select("source_id", "target_id", settled(F.col("weight")).alias("weight"), "summary")


def _packages(g: KnowledgeGraph) -> DataFrame:
    bought = g.raw("events").filter("event_type = 'purchase'").select(F.concat(F.lit("t:"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("id"), F.concat(F.lit("npm install pkg"), F.col("user_id").cast("string")).alias("content"))
    first = g.raw("region").filter("r_regionkey = 0").select(F.lit("t:").alias("id"), F.lit("pip install project").alias("content"))
    return first.unionByName(bought).select("id", F.lit(KB).alias("kb_id"), "content", F.lit("api").alias("source"), F.create_map(F.lit("a"), F.lit("b")).alias("metadata"))


def _ingested(g: KnowledgeGraph) -> ingest.Ingested:
    entities = g.entities().select("id", "kb_id", "name", "type", "summary", F.array().cast("array<float>").alias("embedding"), "created_at", F.col("created_at").alias("updated_at"))
    relations = g.relations(("in",)).withColumns({"episode_id": F.lit(None).cast("string")})
    return ingest.ingest(_packages(g), entities, relations, now(), VowelEmbedder())


_TEXTS = "x AS (SELECT 't:' AS text_id, 'project' AS pkg UNION ALL SELECT 't:' || lpad(CAST(event_id AS VARCHAR), 12, '0'), 'pkg' || user_id FROM events WHERE event_type = 'purchase')"


@query(f"WITH {_TEXTS} SELECT count(*) AS episodes, count(DISTINCT pkg) AS entities_created, 0::BIGINT AS entities_updated, count(DISTINCT pkg) AS relations_created, 0::BIGINT AS relations_strengthened FROM x")
def ingest_result(g: KnowledgeGraph) -> DataFrame:
    return _ingested(g).result.drop("kb_id").select("episodes", *ingest.COUNTS)


@query(f"WITH {_TEXTS}, f AS (SELECT text_id, pkg, row_number() OVER (PARTITION BY pkg ORDER BY text_id) = 1 AS first FROM x) SELECT text_id, CAST(first AS BIGINT) AS entities_created, CAST(first AS BIGINT) AS relations_created, NULL::VARCHAR AS error FROM f")
def ingest_by_text(g: KnowledgeGraph) -> DataFrame:
    return _ingested(g).by_text.select("text_id", "entities_created", "relations_created", "error")


# Jobs


@query(f"SELECT sha256(concat_ws('|', 'talk', role, '{NOW}', text)) AS id, 'queued' AS status, 0 AS attempts, 3 AS max_attempts, count(*) AS n FROM conversations GROUP BY 1")
def job_submit(g: KnowledgeGraph) -> DataFrame:
    return jobs.submit(g.conversations(), now()).groupBy("id", "status", "attempts", "max_attempts").agg(F.count("*").alias("n"))


_JOB = "CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'completed' END"


@query(f"""WITH j AS (SELECT o_orderkey, {_JOB} AS status, o_custkey % 4 AS attempts FROM orders), c AS (SELECT *, CASE WHEN status = 'running' AND o_orderkey % 2 = 0 THEN 'completed' WHEN status = 'running' THEN 'failed' WHEN status = 'queued' AND o_orderkey % 5 = 0 THEN 'running' END AS after FROM j)
SELECT coalesce(after, status) AS status, CAST(sum(attempts + CASE WHEN after = 'running' THEN 1 ELSE 0 END) AS BIGINT) AS attempts, count(CASE WHEN after IN ('completed', 'failed') THEN 1 END) AS ended, max(CASE WHEN after = 'failed' THEN 2048 + 15 END) AS error_length, count(CASE WHEN after = 'completed' THEN 1 END) AS results FROM c GROUP BY 1""")
def job_status(g: KnowledgeGraph) -> DataFrame:
    table, key = g.full_jobs(), F.substring("id", 3, 20).cast("long")
    to = F.when(F.col("status") == "running", F.when(key % 2 == 0, "completed").otherwise("failed")).when((F.col("status") == "queued") & (key % 5 == 0), "running")
    changes = table.select("id", to.alias("new_status"), F.lit("d:1").alias("new_episode_id"), F.lit("{}").alias("new_result"), F.repeat(F.lit("e"), 5000).alias("new_error")).filter("new_status is not null")
    after = jobs.set_status(table, changes, as_of())
    return after.groupBy("status").agg(F.sum("attempts").alias("attempts"), F.count_if(F.col("completed_at") == as_of()).alias("ended"), F.max(F.length("error")).cast("long").alias("error_length"), F.count("result").alias("results"))


@query("SELECT 'j:' || o_orderkey AS id, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 THEN 'queued' WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 1 THEN 'failed' WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'completed' END AS status FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 3 = 0")
def job_retry(g: KnowledgeGraph) -> DataFrame:
    """A third of all jobs is retried; only those that failed are queued again."""
    table, key = g.full_jobs(), F.substring("id", 3, 20).cast("long")
    broken = table.filter((F.col("status") == "running") & (key % 2 == 1)).select("id", F.lit("failed").alias("new_status"))
    failed = jobs.set_status(table, broken, as_of())
    after = jobs.retry(failed, table.filter(key % 3 == 0).select("id"))
    return after.join(table.select("id", F.col("status").alias("was")), "id").filter((F.col("was") == "running") | (key % 3 == 0)).select("id", "status")


@query("""SELECT 'j:' || o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'completed' END AS status, 'j:j:' || o_orderkey || CASE WHEN o_custkey % 4 > 1 THEN ':' || o_custkey % 4 ELSE '' END AS episode_id,
CASE WHEN o_orderkey % 4 <> 0 THEN '{"episode_id":"j:j:' || o_orderkey || CASE WHEN o_custkey % 4 > 1 THEN ':' || o_custkey % 4 ELSE '' END || '","entities_created":' || o_orderkey % 7 || ',"entities_updated":0,"relations_created":1,"relations_strengthened":0}' END AS result, CASE WHEN o_orderkey % 4 = 0 THEN 'extract: no' END AS error FROM orders WHERE o_orderstatus = 'P'""")
def job_outcomes(g: KnowledgeGraph) -> DataFrame:
    """Jobs after their texts were ingested, each with its own counts or error."""
    table = g.full_jobs()
    mine, key = table.filter("status = 'running'"), F.substring("id", 3, 20).cast("long")
    by_text = mine.select(F.col("kb_id"), jobs.episode_id().alias("text_id"), F.when(key % 4 == 0, "extract: no").alias("error"), (key % 7).alias("entities_created"), F.lit(0).alias("entities_updated"), F.lit(1).alias("relations_created"), F.lit(0).alias("relations_strengthened"))
    after = jobs.set_status(table, jobs.outcomes(mine, by_text), as_of())
    return after.join(mine.select("id"), "id", "left_semi").select("id", "status", "episode_id", "result", "error")


@query(f"SELECT 'j:' || o_orderkey AS id, 'main' AS kb_id, {_JOB} AS status, o_orderpriority AS source, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM orders ORDER BY o_orderdate DESC, 'j:' || o_orderkey LIMIT 1000")
def jobs_export(g: KnowledgeGraph) -> DataFrame:
    """What an export holds, written as CSV with a header and read back."""
    folder = fresh(g.spark, "export")
    sinks.export_jobs(g.full_jobs(), folder, "csv", KB)
    return g.spark.read.option("header", True).csv(folder).select("id", "kb_id", "status", "source", "created_at")


# Merges of similar entities


_CHOSEN = f"""{ENTITIES}, {RELATIONS}, {_PAIRS}, cnt AS (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM relations UNION ALL SELECT target_id FROM relations) GROUP BY id),
kk AS (SELECT entities.id, coalesce(n, 0) AS n, strlen(summary) AS len FROM entities LEFT JOIN cnt USING (id)),
ch AS (SELECT a, b, CASE WHEN ka.n > kb.n OR (ka.n = kb.n AND ka.len > kb.len) THEN a ELSE b END AS survivor, row_number() OVER (ORDER BY a, b) AS k FROM (SELECT * FROM pairs ORDER BY a, b LIMIT 100) JOIN kk ka ON ka.id = a JOIN kk kb ON kb.id = b),
step AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS gone, []::VARCHAR[] AS into_ UNION ALL
  SELECT step.k + 1, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN gone ELSE list_append(gone, CASE WHEN survivor = a THEN b ELSE a END) END,
    CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN into_ ELSE list_append(into_, survivor) END FROM step JOIN ch ON ch.k = step.k + 1),
mv AS (SELECT unnest(gone) AS merged, unnest(into_) AS survivor FROM (SELECT * FROM step ORDER BY k DESC LIMIT 1)),
follow AS (SELECT merged, survivor FROM mv UNION ALL SELECT follow.merged, mv.survivor FROM follow JOIN mv ON mv.merged = follow.survivor)"""


@query(f"WITH RECURSIVE {_CHOSEN} SELECT merged, survivor FROM follow WHERE survivor NOT IN (SELECT merged FROM mv)")
def consolidate(g: KnowledgeGraph) -> DataFrame:
    entities = g.entities(embeddings=True)
    return lifecycle.consolidate(entities, g.relations(), g.customer_states(), KB, 0.4, most_pairs=100)[3].select("merged", "survivor")


@query(f"""WITH RECURSIVE {_CHOSEN}, fin AS (SELECT merged, survivor FROM follow WHERE survivor NOT IN (SELECT merged FROM mv)),
rd AS (SELECT coalesce(f1.survivor, source_id) AS source_id, coalesce(f2.survivor, target_id) AS target_id, type FROM relations LEFT JOIN fin f1 ON f1.merged = source_id LEFT JOIN fin f2 ON f2.merged = target_id WHERE invalid_at IS NULL)
SELECT type, count(DISTINCT (source_id, target_id)) AS n FROM rd WHERE source_id <> target_id GROUP BY type""")
def consolidated_relations(g: KnowledgeGraph) -> DataFrame:
    """Valid relations after the merges: moved to the survivors and deduplicated."""
    after = lifecycle.consolidate(g.entities(embeddings=True), g.relations(), g.customer_states(), KB, 0.4, most_pairs=100)[1]
    return after.filter("invalid_at is null").groupBy("type").agg(F.count("*").alias("n"))

