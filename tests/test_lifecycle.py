import pytest
from pyspark.sql import functions as F

from graphloom.operators import jobs, lifecycle, writes
from graphloom.schema import JOBS

HOUR = 3600


def stamps(df, *columns):
    return df.withColumns({c: F.timestamp_seconds(F.col(c)) for c in columns})


@pytest.fixture(scope="module")
def make(spark):
    def relations(*rows):
        """(id, source, target, type, weight, summary, hours, ended)"""
        full = [(r[0], "k", *r[1:6], r[6] * HOUR, r[7] * HOUR if len(r) > 7 else None, r[6] * HOUR) for r in rows]
        df = spark.createDataFrame(full, "id string, kb_id string, source_id string, target_id string, type string, weight double, summary string, valid_at long, invalid_at long, created_at long")
        return stamps(df, "valid_at", "invalid_at", "created_at")

    def entities(*rows):
        """(id, embedding, summary)"""
        df = spark.createDataFrame([(i, "k", i, "person", s, v, n) for n, (i, v, s) in enumerate(rows)], "id string, kb_id string, name string, type string, summary string, embedding array<float>, created_at long")
        return stamps(df, "created_at")

    def states(*rows):
        """(kind, id, strength, count, hours)"""
        df = spark.createDataFrame([("k", *r[:4], r[4] * HOUR) for r in rows], "kb_id string, entity_type string, entity_id string, strength double, access_count int, last_access long")
        return stamps(df, "last_access")

    return relations, entities, states


def at(hours):
    return F.timestamp_seconds(F.lit(hours * HOUR))


def test_dedup(make):
    rows = make[0](("a", "e1", "e2", "knows", 0.75, "brief", 0), ("b", "e1", "e2", "knows", 0.2, "met at the harbour", 1), ("c", "e1", "e2", "knows", 0.1, "x", 2), ("d", "e1", "e1", "knows", 1.0, "", 0), ("e", "e1", "e2", "knows", 0.9, "old", 0, 5), ("f", "e1", "e2", "likes", 1.7, "", 0))
    after = lifecycle.dedup_relations(rows)
    found = {r["id"]: r for r in after.collect()}
    assert set(found) == {"a", "e", "f"}
    assert found["a"]["weight"] == pytest.approx(0.82) and found["a"]["summary"] == "met at the harbour"
    assert found["f"]["weight"] == 1.7
    assert {r["id"] for r in lifecycle.dedup_removed(rows, after).collect()} == {"b", "c", "d"}
    assert lifecycle.dedup_relations(rows, entity="e9").count() == 6
    assert [r["n"] for r in lifecycle.duplicate_groups(rows).collect()] == [3]


def test_upsert(make):
    old = make[0](("a", "x", "y", "knows", 0.7, "s", 0), ("z", "x", "y", "knows", 0.9, "gone", 0, 1))
    new = make[0](("b", "x", "y", "knows", 0.7, "longer", 3), ("c", "x", "z", "knows", 0.5, "n", 3), ("d", "x", "z", "knows", 0.5, "nn", 3))
    found = {r["id"]: (round(r["weight"], 6), r["summary"]) for r in lifecycle.upsert_relations(old, new).collect()}
    assert found["a"] == (0.91, "longer") and found["z"] == (0.9, "gone")
    assert len(found) == 3 and (0.75, "nn") in found.values()


def test_decay_runs_add_up(make):
    states = make[2](("entity", "a", 1.0, 1, 0), ("entity", "b", 0.0005, 1, 0))
    once = lifecycle.decay_batch(states, at(168))
    assert {r["entity_id"]: round(r["strength"], 6) for r in once.collect()} == {"a": 0.5, "b": 0.0005}
    twice = lifecycle.decay_batch(once, at(168))
    assert {r["entity_id"]: round(r["strength"], 6) for r in twice.collect()}["a"] == 0.25
    same = lifecycle.strength_at(lifecycle.strength_at(states, at(168)), at(168))
    assert {round(r["strength"], 6) for r in same.collect()} == {0.5}


def test_access(make):
    log = make[2](("entity", "a", 0.0, 0, 1), ("entity", "a", 0.0, 0, 5)).select("kb_id", "entity_type", "entity_id", F.col("last_access").alias("accessed_at"))
    after = {r["entity_id"]: (r["strength"], r["access_count"]) for r in writes.log_access(make[2](("entity", "a", 0.2, 3, 0), ("entity", "b", 0.4, 1, 0)), log).collect()}
    assert after == {"a": (1.0, 5), "b": (0.4, 1)}


def test_prune(make):
    entities = make[1](("a", None, ""), ("b", None, ""), ("c", None, ""))
    relations = make[0](("r", "b", "c", "knows", 0.5, "", 0, 1), ("s", "c", "b", "likes", 0.5, "", 0))
    episodes = entities.select("id", "kb_id").withColumn("id", F.concat(F.lit("ep"), "id"))
    relations = relations.withColumn("episode_id", F.lit("epa"))
    states = make[2](("entity", "a", 0.01, 1, 0), ("entity", "b", 0.01, 1, 0), ("relation", "s", 0.05, 1, 0), ("episode", "epa", 0.0, 1, 0), ("entity", "c", 0.9, 1, 0))
    p = lifecycle.prune(entities, relations, episodes, states, at(10), 0.05)
    assert {r["id"] for r in p.entities.collect()} == {"b", "c"}  # b has a relation, though one that ended
    assert all(r["invalid_at"] is not None and r["episode_id"] is None for r in p.relations.collect())
    assert {r["id"] for r in p.episodes.collect()} == {"epb", "epc"}
    assert {(r["entity_type"], r["entity_id"]) for r in p.states.collect()} == {("entity", "b"), ("entity", "c")}


def test_consolidate(make):
    entities = make[1](("e1", [0.6, 0.8, 0.0], "two of them are one"), ("e2", [0.59, 0.81, 0.02], "one"), ("e3", [0.0, -0.3, 2.0], ""))
    relations = make[0](("r1", "e1", "e3", "knows", 0.8, "", 0), ("r2", "e2", "e3", "knows", 0.5, "", 0))
    kept, after, states, moves = lifecycle.consolidate(entities, relations, make[2](("entity", "e2", 1.0, 1, 0)), "k", 0.9)
    assert [(r["merged"], r["survivor"]) for r in moves.collect()] == [("e2", "e1")]
    assert {r["id"] for r in kept.collect()} == {"e1", "e3"}
    assert [(r["source_id"], r["target_id"], round(r["weight"], 6)) for r in after.collect()] == [("e1", "e3", 0.9)]
    assert states.count() == 0


def test_merges_in_rounds_are_merges_in_order(spark):
    import random

    rng = random.Random(5)
    for n in (6, 25):
        pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(2 * n)})
        rows = [(f"e{a:02d}", f"e{b:02d}", *((f"e{a:02d}", f"e{b:02d}") if rng.random() < 0.5 else (f"e{b:02d}", f"e{a:02d}"))) for a, b in pairs]
        gone = {}
        for a, b, survivor, merged in sorted(rows):
            if a not in gone and b not in gone:
                gone[merged] = survivor

        def last(x, gone=gone):
            while x in gone:
                x = gone[x]
            return x

        table = spark.createDataFrame(rows, "a string, b string, survivor string, merged string")
        assert {r["merged"]: r["survivor"] for r in lifecycle.greedy_moves(table).collect()} == {m: last(m) for m in gone}
    assert lifecycle.greedy_moves(table.limit(0)).count() == 0


def test_consolidation_takes_all_pairs_if_told(make):
    entities = make[1](*[(f"e{i}", [1.0, 0.001 * i], "s" * i) for i in range(14)], ("f0", [0.0, 1.0, 0.0], ""), ("f1", [0.0, 1.0, 0.001], "x"))
    nothing = make[0](("r", "x", "y", "t", 1.0, "", 0))
    moves = lifecycle.consolidate(entities, nothing, make[2](("entity", "q", 1.0, 1, 0)), "k", 0.9, most_pairs=None)[3]
    found = {r["merged"]: r["survivor"] for r in moves.collect()}
    assert set(found.values()) == {"e13", "f1"} and len(found) == 14


def test_references(make):
    entities = make[1](("a", None, ""), ("b", None, ""))
    relations = make[0](("r", "a", "b", "t", 1.0, "", 0), ("s", "a", "x", "t", 1.0, "", 0))
    assert [(r["id"], r["missing"]) for r in writes.missing_ends(relations, entities).collect()] == [("s", "target_id")]
    left, held = writes.delete_entities(entities, relations, entities.filter("id = 'a'"))
    assert left.count() == 1 and held.count() == 0
    changed = writes.update(entities, entities.filter("id = 'a'").withColumn("summary", F.lit("new")), ["summary"])
    assert {r["id"]: r["summary"] for r in changed.collect()} == {"a": "new", "b": ""}
    ended = writes.invalidate(relations, relations.filter("id = 'r'"), at(9))
    assert {r["id"]: r["invalid_at"] is None for r in ended.collect()} == {"r": False, "s": True}


def test_jobs(spark):
    texts = spark.createDataFrame([("k", f"text {i}", "api", {"a": "b"}) for i in range(3)], "kb_id string, content string, source string, metadata map<string,string>")
    queue = spark.createDataFrame([], JOBS).unionByName(jobs.submit(texts, at(1)))
    after, mine = jobs.claim(queue, 2, at(2))
    assert mine.count() == 2 and after.filter("status = 'running' and attempts = 1").count() == 2
    assert jobs.stale(after, at(2)).count() == 0 and jobs.stale(after, at(3)).count() == 2
    assert jobs.recover_stale(after, at(3)).filter("status = 'queued'").count() == 3
    changes = mine.select("id", F.lit("failed").alias("new_status"), F.lit("e" * 5000).alias("new_error"))
    failed = jobs.set_status(after, changes, at(4))
    assert {len(r["error"] or "") for r in failed.collect()} == {0, 2048 + len("... (truncated)")}
    ids = [r["id"] for r in queue.collect()]
    assert jobs.retry(failed, ids).filter("status = 'queued'").count() == 3
    assert jobs.export(failed).columns == ["id", "kb_id", "status", "source", "episode_id", "error", "attempts", "max_attempts", "created_at", "started_at", "completed_at"]
    assert [r["call"] for r in jobs.every_nth(spark.range(1, 8).withColumnRenamed("id", "call"), 3).collect()] == [3, 6]
