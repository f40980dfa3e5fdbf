import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, link_blocks

SCHEMA = "id string, kb_id string, source_id string, target_id string, type string, weight double, valid_at timestamp, invalid_at timestamp"


@pytest.fixture(scope="module")
def edges(spark):
    def make(*rows):
        full = []
        for i, r in enumerate(rows):
            a, b, kind, weight, start, end = (*r, *(None, None, "knows", 1.0, None, None)[len(r) :])
            full.append((f"r{i + 1}", "k", a, b, kind, float(weight), start or "2025-01-01", end))
        return spark.createDataFrame(full, "id string, kb_id string, s string, t string, type string, weight double, a string, b string").selectExpr("id", "kb_id", "s as source_id", "t as target_id", "type", "weight", "cast(a as timestamp) as valid_at", "cast(b as timestamp) as invalid_at")

    return make


def near(*args, **more):
    return {r["node"]: r["hops"] for r in graph.neighbours(*args, **more).collect()}


def test_hops(edges):
    assert near(edges(("a", "b"), ("a", "c", "works_on", 0.8)), ["a"], 1) == {"a": 0, "b": 1, "c": 1}
    assert near(edges(("a", "b"), ("b", "c"), ("c", "d")), ["a"], 2) == {"a": 0, "b": 1, "c": 2}
    assert near(edges(("a", "b")), ["b"], 1) == {"b": 0, "a": 1}
    assert near(edges(("a", "b")), ["x"], 3) == {"x": 0}


def test_filters(edges, spark):
    e = edges(("a", "b"), ("a", "c", "uses"), ("b", "d"))
    assert near(e, ["a"], 2, ["knows"]) == {"a": 0, "b": 1, "d": 2}
    at = F.lit("2025-06-01").cast("timestamp")
    assert near(edges(("a", "b", "knows", 1, None, "2025-03-01"), ("a", "c")), ["a"], 1, at=at) == {"a": 0, "c": 1}
    assert near(edges(("a", "b", "knows", 1, "2026-01-01", None)), ["a"], 1, at=at) == {"a": 0}


def heaviest(e, seeds, hops, least=0.0):
    return {r["node"]: round(r["weight"], 9) for r in graph.weighted(e, seeds, hops, least).collect()}


def test_weights(edges):
    assert heaviest(edges(("a", "b", "k", 0.9), ("a", "c", "k", 0.3), ("b", "d", "k", 0.8)), ["a"], 2) == {"a": 1, "b": 0.9, "c": 0.3, "d": 0.72}
    assert heaviest(edges(("a", "b", "k", 0.9), ("a", "c", "k", 0.3)), ["a"], 1, 0.5) == {"a": 1, "b": 0.9}
    found = heaviest(edges(("a", "x", "k", 0.8), ("a", "b", "k", 0.9), ("b", "x"), ("x", "y")), ["a"], 2)
    assert (found["x"], found["y"]) == (0.9, 0.8)


def test_pagerank(edges):
    path = {r["node"]: r["rank"] for r in graph.pagerank(edges(("a", "b"), ("b", "c")), ["a"], rounds=50, epsilon=0).collect()}
    assert path == pytest.approx({"a": 0.3452889221, "b": 0.4594221558, "c": 0.1952889221}, abs=1e-5)
    hub = {r["node"]: r["rank"] for r in graph.pagerank(edges(("h", "a"), ("h", "b"), ("h", "c"), ("h", "d"), ("e", "d")), ["a"]).collect()}
    assert hub == pytest.approx({"h": 0.3986328335, "a": 0.2365183289, "d": 0.1358741432, "b": 0.0865183289, "c": 0.0865183289, "e": 0.0559380365}, abs=1e-6)
    assert graph.pagerank(edges(("a", "b")), []).count() == 0


def slow_ranks(pairs, seeds, rounds):
    nodes = {n for p in pairs for n in p}
    ranks = dict.fromkeys(nodes, 1 / len(nodes))
    links = pairs + [(b, a) for a, b in pairs]
    for _ in range(rounds):
        given = dict.fromkeys(nodes, 0.0)
        for a, b in links:
            if a and b:
                given[b] += ranks[a] / sum(x == a for x, _ in links)
        ranks = {n: 0.15 * (n in seeds) / len(seeds) + 0.85 * given[n] for n in nodes}
    return ranks


ODD = [("h", f"n{i}") for i in range(30)] + [("a", "b"), ("a", "b"), ("b", "a"), ("a", "a"), ("n3", "n4"), (None, "a"), ("b", None)]


def test_pagerank_over_blocks(edges):
    e = edges(*ODD)
    assert sum(link_blocks.link_blocks(e).blocks.values()) == len(ODD)
    # Rows that are there twice count once.
    found = {r["node"]: r["rank"] for r in graph.pagerank(e.unionByName(e.limit(5)), ["h", "a", "x"], rounds=6, epsilon=0).collect()}
    assert found == pytest.approx(slow_ranks(ODD, ["h", "a", "x"], 6), abs=1e-12)


@pytest.mark.parametrize("clashing", ["source_id target_id", "source_id target_id id"])
def test_pagerank_with_equal_hashes(edges, monkeypatch, clashing):
    real, calls = F.xxhash64, []

    def first_time_equal(salt, column):
        calls.append(column)
        return F.lit(7).cast("long") if len(calls) < 5 and any(f"'{c}'" in str(column) for c in clashing.split()) else real(salt, column)

    monkeypatch.setattr(F, "xxhash64", first_time_equal)
    found = {r["node"]: r["rank"] for r in graph.pagerank(edges(*ODD), ["h", "a"], rounds=3, epsilon=0).collect()}
    assert found == pytest.approx(slow_ranks(ODD, ["h", "a"], 3), abs=1e-12)
    assert len(calls) > 5


def test_subgraph_and_text(edges, spark):
    nodes, held = graph.subgraph(edges(("a", "b"), ("b", "c", "uses", 0.8), ("c", "d", "works_on", 0.5)), ["a"], 2)
    assert {r["node"]: r["hops"] for r in nodes.collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r["id"] for r in held.collect()} == {"r1", "r2"}
    entities = spark.createDataFrame([("a", "Ann", "person", "an engineer"), ("b", "Bo", "person", "")], "id string, name string, type string, summary string")
    text = graph.summarize(graph.hydrate(nodes, entities), held).first()["text"]
    assert text == "Context from knowledge graph:\n\nAnn (person, seed): an engineer\n  - knows Bo [weight: 1.00, since 2025-01-01]\n\nBo (person, 1 hop)\n  - uses c [weight: 0.80, since 2025-01-01]\n\n (, 2 hops)\n"
    nothing = graph.summarize(graph.hydrate(nodes.limit(0), entities), held).first()["text"]
    assert nothing == "No graph context available."


def test_degrees_and_counts(edges):
    e = edges(("a", "a"), ("a", "b"), ("a", "b"))
    assert {r["node"]: r["degree"] for r in graph.degrees(e).collect()} == {"a": 4, "b": 2}
    assert graph.counts(e).first().asDict() == {"nodes": 2, "edges": 3}


def test_communities_are_one_pass(spark):
    rows = [("m1", ["x", "y"], 1), ("m2", ["a", "x"], 2), ("m3", ["x", "z"], 3), ("m4", None, 4)]
    communities = spark.createDataFrame(rows, "id string, member_ids array<string>, t int").selectExpr("id", "member_ids", "timestamp_seconds(t) as created_at")
    of = lambda *seeds: {r["node"] for r in graph.expand_communities(communities, seeds).collect()}
    assert of("a") == {"a", "x", "z"}
    assert of("y") == {"y", "x", "a", "z"}
    assert of("q") == {"q"}


def test_channels(edges):
    e = edges(("a", "b", "knows", 0.5), ("b", "c", "uses", 0.5))
    score = lambda **more: {r["node"]: round(r["score"], 6) for r in graph.channel(e, ["a"], **more).collect()}
    assert score() == {"b": 1.0, "c": 0.5}
    assert score(types=["knows"]) == {"b": 1.0}
    # A time leaves the types out, unless filters are composed.
    at = F.lit("2025-06-01").cast("timestamp")
    assert score(types=["knows"], at=at) == {"b": 1.0, "c": 0.5}
    assert score(types=["knows"], at=at, compose=True) == {"b": 1.0}
    assert score(scorer="weighted") == {"b": 0.5, "c": 0.25}
    assert set(score(scorer="pagerank")) == {"b", "c"}
    with pytest.raises(ValueError):
        score(scorer="x")
