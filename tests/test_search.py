import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import bm25, fusion, knn, scans
from graphloom.plans import catalogue
from graphloom.schema import ENTITIES, SearchOptions

T0 = "2025-01-01 00:00:00"
DATA = os.environ.get("GRAPHLOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def kb(spark):
    stamp = lambda df: df.withColumn("created_at", F.lit(T0).cast("timestamp"))
    people = [("e1", "Alice", "person", "Software engineer at Acme"), ("e2", "Bob", "person", "Product manager at Acme"), ("e3", "Acme", "company", "Tech startup building AI tools"), ("e4", "Rust", "language", "Systems programming language")]
    entities = stamp(spark.createDataFrame([(i, "test", n, t, s, [float(k == j) for j in range(4)]) for k, (i, n, t, s) in enumerate(people)], "id string, kb_id string, name string, type string, summary string, embedding array<float>"))
    relations = stamp(spark.createDataFrame([("r1", "test", "e1", "e3", "works_at", "Alice works at Acme", 1.0), ("r2", "test", "e2", "e3", "works_at", "Bob works at Acme", 1.0), ("r3", "test", "e1", "e4", "knows", "Alice knows Rust", 0.8)], "id string, kb_id string, source_id string, target_id string, type string, summary string, weight double"))
    relations = relations.withColumns({"valid_at": F.col("created_at"), "invalid_at": F.lit(None).cast("timestamp")})
    episodes = stamp(spark.createDataFrame([("ep1", "test", "Alice is a software engineer at Acme working on Rust projects", "api")], "id string, kb_id string, content string, source string"))
    return entities, relations, episodes


def now():
    return F.lit("2025-06-01").cast("timestamp")


def test_scores_are_the_published_ones(kb, spark):
    more = spark.createDataFrame([("x1", "test", "xylophone-item-1", "target", "xylophone rare unique")], "id string, kb_id string, name string, type string, summary string")
    table = kb[0].select("id", "kb_id", "name", "type", "summary").unionByName(more)
    postings, lengths = bm25.build_index(table, ["name", "summary", "type"])
    expected = {
        "engineer acme": {"e1": 1.1133049968},
        "person": {"e1": 0.3409718653, "e2": 0.3409718653},
        "xylophone": {"x1": 1.4576917916},
        "xylophone-item-1": {"x1": 1.0435286642},
        "acme": {"e1": 1.01337e-06, "e2": 1.01337e-06, "e3": 9.49861e-07},
        "alice bob": {},
        "? acme": {"e1": 1.01337e-06, "e2": 1.01337e-06, "e3": 9.49861e-07},
        "?": {},
        "": {},
    }
    for query, scores in expected.items():
        for found in (bm25.search(table, ["name", "summary", "type"], query, "test"), bm25.search_index(postings, lengths, query, "test")):
            assert {r["id"]: r["score"] for r in found.collect()} == pytest.approx(scores, abs=2e-9), query
    assert bm25.search(table, ["name"], "alice", "other").count() == 0


def test_statistics_are_global_unless_asked(kb):
    other = kb[0].withColumns({"kb_id": F.lit("other"), "id": F.concat(F.lit("o"), "id")})
    both = kb[0].unionByName(other)
    score = lambda **more: bm25.search(both, ["name", "summary"], "engineer", "test", **more).first()["score"]
    alone = bm25.search(kb[0], ["name", "summary"], "engineer", "test").first()["score"]
    assert score(stats_scope="kb") == alone != score()


def test_all_kinds(kb):
    found = bm25.search_all(*kb, "Alice", "test").collect()
    assert {(r["type"], r["id"]) for r in found} == {("entity", "e1"), ("relation", "r1"), ("relation", "r3"), ("episode", "ep1")}
    assert len(bm25.search_all(*kb, "Alice", "test", 1).collect()) == 1


def test_modes(kb):
    run = lambda query, vector, options: [(r["type"], r["id"]) for r in fusion.hybrid_search(*kb, None, "test", query, vector, now(), options).collect()]
    assert ("entity", "e1") in run("Alice engineer", None, SearchOptions.of_mode("bm25"))
    assert run("", [0.9, 0.1, 0, 0], SearchOptions.of_mode("vector"))[0] == ("entity", "e1")
    assert run("Alice", [0.9, 0.1, 0, 0], SearchOptions(top_k=5))[0] == ("entity", "e1")
    for scorer in ("bfs", "pagerank", "weighted"):
        assert ("entity", "e4") in run("Alice", None, SearchOptions(scorer=scorer, vector=False))
    with pytest.raises(ValueError):
        run("x", None, SearchOptions.of_mode("vector"))
    empty = [t.limit(0) for t in kb]
    assert fusion.hybrid_search(*empty, None, "test", "Alice", [1.0, 0, 0, 0], now()).count() == 0


def test_fusion(spark):
    channel = lambda *ids: spark.createDataFrame([(i, "k", "entity", f"{i}{len(ids)}", n + 1) for n, i in enumerate(ids)], "id string, kb_id string, type string, content string, rank int")
    found = {r["id"]: (r["score"], r["content"]) for r in fusion.fuse([channel("a", "b"), channel("b", "c", "d")]).collect()}
    assert found["b"] == (round(1 / 62 + 1 / 61, 9), "b2")
    assert found["a"][0] == round(1 / 61, 9) and found["c"][0] == round(1 / 62, 9)


def test_decay_and_context(spark, kb):
    results = spark.createDataFrame([("e1", "test", "entity", "x", 1.0), ("e2", "test", "entity", "y", 1.0)], "id string, kb_id string, type string, content string, score double")
    states = spark.createDataFrame([("test", "entity", "e1", 1.0, 1)], "kb_id string, entity_type string, entity_id string, strength double, access_count int").withColumn("last_access", now())
    found = {r["id"]: r["score"] for r in fusion.apply_decay(results, states, now(), 168.0).collect()}
    assert found == {"e1": 1.0, "e2": 0.8}
    assert fusion.apply_decay(results, states, now(), 0) is results
    assert fusion.prompt_context(results, 1).first()["context"] == '{"memories":[{"type":"entity","content":"x","score":1.0}]}'
    assert fusion.access_events(results, now()).columns == ["kb_id", "entity_type", "entity_id", "accessed_at"]


def test_nearest(kb, spark):
    found = knn.nearest(kb[0], [0.9, 0.1, 0, 0], 2).collect()
    assert [r["id"] for r in found] == ["e1", "e2"]
    assert knn.nearest(kb[0], [1.0, 0], 2).count() == 0
    stored = knn.stored_search(kb[0], "test", [0, 0, 1, 0], 1).first()
    assert (stored["id"], stored["score"]) == ("e3", 1.0)


def test_inverted_file_recall(spark):
    rng = np.random.default_rng(0)
    rows = [(f"{i:04d}", "k", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(1000, 32)))]
    table = spark.createDataFrame(rows, "id string, kb_id string, embedding array<float>").cache()
    index = knn.InvertedFile.build(table)
    hits = total = 0
    for q in rng.normal(size=(5, 32)):
        exact = {r["id"] for r in knn.nearest(table, list(q), 10).collect()}
        hits += len(exact & {r["id"] for r in index.search(list(q), 10, probes=20).collect()})
        total += 10
    assert hits / total >= 0.85


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_inverted_file_default_is_exact(spark):
    """As registered, on the given vectors."""
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), F.lit("k").alias("kb_id"), "embedding").cache()
    index = knn.InvertedFile.build(table)
    for q in table.filter("id in ('3', '77', '191', '402')").collect():
        assert index.search(q["embedding"], 20).select("id", "distance").collect() == knn.nearest(table, q["embedding"], 20).select("id", "distance").collect()
    found, exact = ({str(r["id"]) for r in catalogue.QUERIES[n](spark, DATA).collect()} for n in ("inverted_file_topk", "cosine_topk"))
    assert found == exact and len(found) == 20


def test_inverted_file_changes_and_keeps(spark, tmp_path):
    """Rows come, change and go; the stored index answers as an exact scan of what it should hold."""
    rng = np.random.default_rng(8)
    rows = [(f"{i:03d}", "k" if i % 5 else "j", [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    schema = "id string, kb_id string, embedding array<float>"
    index = knn.InvertedFile.build(spark.createDataFrame(rows[:200], schema))
    moved = [(i, kb, [-x for x in v]) for i, kb, v in rows[150:200]]
    index = index.insert(spark.createDataFrame(moved + rows[200:], schema)).remove(spark.createDataFrame([(i, kb) for i, kb, _ in rows[:40]], "id string, kb_id string"))
    index.save(f"{tmp_path}/index")
    held = {i: (kb, v) for i, kb, v in rows[40:150] + moved + rows[200:]}
    exact = spark.createDataFrame([(i, kb, v) for i, (kb, v) in held.items()], schema).cache()
    for again in (index, knn.InvertedFile.load(spark, f"{tmp_path}/index")):
        assert again.count() == len(held) and again.count("j") == sum(kb == "j" for kb, _ in held.values())
        assert again.has("k", "151") and not again.has("k", "001") and not again.has("j", "151")
        for q in (rows[3][2], moved[4][2], rows[250][2]):
            assert [r["id"] for r in again.search(q, 12).collect()] == [r["id"] for r in knn.nearest(exact, q, 12).collect()]
    assert index.drop("j").count("j") == 0


def test_similar_pairs_of_all_dimensions(spark):
    rng = np.random.default_rng(11)
    rows = [(f"{i:03d}", [float(x) for x in rng.normal(size=3 + i % 2)]) for i in range(150)] + [("zero", [0.0, 0.0, 0.0]), ("none", None), ("empty", [])]
    table = spark.createDataFrame(rows, "id string, embedding array<double>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows[:150]}
    expected = {(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.8}
    for size in (1 << 20, 64):
        found = knn.similar_pairs(table, 0.8, block_bytes=size).collect()
        assert len(found) == len(expected) and {(r["a"], r["b"]) for r in found} == expected
    first = knn.similar_pairs(table, 0.8, 7).collect()
    assert [(r["a"], r["b"]) for r in first] == sorted(expected)[:7]


def test_inverted_file_skips_far_cells(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 16))
    rows = [(f"{i:04d}", "k", [float(x) for x in middles[i % 12] + rng.normal(size=16) / 50]) for i in range(600)] + [("zero", "k", [0.0] * 16)]
    table = spark.createDataFrame(rows, "id string, kb_id string, embedding array<float>").cache()
    index = knn.InvertedFile.build(table)
    query = rows[5][2]
    assert len(index.to_read(query, 10)) < len(index.centres) / 2
    for k in (10, 80):
        assert [r["id"] for r in index.search(query, k).collect()] == [r["id"] for r in knn.nearest(table, query, k).collect()]


def test_similar_pairs(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 8))
    v[17], v[40] = v[3], 0
    rows = [(f"{i:03d}", [float(x) for x in r]) for i, r in enumerate(v)] + [("900", [1.0]), ("901", None)]
    table = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(3)
    found = {(r["a"], r["b"]) for r in knn.similar_pairs(table, 0.6, block_bytes=16 * 64).collect()}
    w = np.asarray(v, np.float32).astype(float)
    n = np.linalg.norm(w, axis=1)
    expected = {(f"{i:03d}", f"{j:03d}") for i in range(90) for j in range(i + 1, 90) if n[i] * n[j] and w[i] @ w[j] / n[i] / n[j] >= 0.6}
    assert found == expected and ("003", "017") in found
    assert [(r["a"], r["b"]) for r in knn.similar_pairs(table, 0.6, most=3).collect()] == sorted(expected)[:3]


def test_lists(kb, spark):
    entities, relations, _ = kb
    assert [r["id"] for r in scans.list_newest(entities, "test", 2, 1).collect()] == ["e2", "e3"]
    assert {r["id"] for r in scans.get_by_ids(entities, "test", ["e1", "zz"]).collect()} == {"e1"}
    many = [f"e{i}" for i in range(2000)]
    assert scans.get_by_ids(entities, "test", many).count() == 4
    assert scans.find_by_name(entities, "test", "ALICE").first()["id"] == "e1"
    assert scans.find_by_name(entities, "test", "Alcie", fuzzy=True).first()["id"] == "e1"
    assert "embedding" not in scans.hidden(entities).columns
    seen = scans.neighbour_view(relations, "test", "e3", now()).select("other").collect()
    assert {r["other"] for r in seen} == {"e1", "e2"}
    assert spark.createDataFrame([], ENTITIES).count() == 0
