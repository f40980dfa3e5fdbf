import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.functions import text as tx
from graphloom.operators import extract, ingest, providers, resolve
from graphloom.schema import TABLES
from graphloom.sources import connectors, sinks
from graphloom.sources.store import Conflict, Store
from graphloom.streaming import ingest as stream
from graphloom.streaming.hooks import Hooks, read_input

TEXT = "id string, kb_id string, content string, source string, metadata map<string,string>"


@pytest.fixture(scope="module")
def rules(spark):
    def run(text):
        x = spark.createDataFrame([(text,)], "t string").select(extract.extracted(F.col("t")).alias("x"), extract.matches(F.col("t")).alias("m")).first()
        return [tuple(e) for e in x["x"]["entities"]], [tuple(r) for r in x["x"]["relations"]], x["m"]

    return run


def test_errors(rules):
    entities, relations, matched = rules("$ foo\nbash: foo: command not found")
    assert matched and ("foo", "tool") in [e[:2] for e in entities]
    assert relations[0][:3] == ("foo", "bash: foo: command not found", "failed_with")
    entities, relations, _ = rules("error: permission denied for /etc/shadow")
    assert entities[0][0] == "permission denied for /etc/shadow" and not relations


def test_commits(rules):
    text = "commit 0123456789abcdef\nAuthor: Ann Lee <a@b.c>\n\n    Merge x\n    Fix the thing\n\ndiff --git a/x.go b/x.go\ndiff --git a/y.go b/y.go\n"
    entities, relations, _ = rules(text)
    assert [e[:2] for e in entities] == [("Ann Lee", "person"), ("Fix the thing", "event"), ("x.go", "concept"), ("y.go", "concept")]
    assert [r[:3] for r in relations] == [("Fix the thing", "x.go", "modified"), ("Fix the thing", "y.go", "modified")]


def test_packages_decisions_configs(rules):
    entities, relations, _ = rules("npm install left-pad@2.7.1")
    assert entities == [("left-pad@2.7.1", "tool", "dependency package")] and relations[0][:3] == ("project", "left-pad@2.7.1", "depends_on")
    entities, _, _ = rules("After the outage the team went with weekly snapshots of the ledger")
    assert entities[0][1] == "concept" and entities[0][2].startswith("decision: ")
    entities, _, _ = rules("I updated app.json and b.toml")
    assert [e[0] for e in entities[:3]] == [".json", ".toml", "config change"]
    assert rules("see go.mod")[2] and rules("see go.mod")[0] == []


@pytest.mark.parametrize("text", ["Good evening to all of you", "A loop over three rows gives six numbers.", "The upload has ended without trouble.", "Nothing is left to do.", "", None])
def test_nothing_to_find(rules, text):
    entities, relations, matched = rules(text)
    assert not entities and not relations and not matched


@pytest.fixture(scope="module")
def known(spark):
    rows = [("e1", "k", "Marta Oliveira", "person", ""), ("e2", "k", "Heron", "person", ""), ("e3", "other", "Bob", "person", "")]
    return spark.createDataFrame(rows, "id string, kb_id string, name string, type string, summary string")


def test_tiers(known, spark):
    new = spark.createDataFrame([("n1", "k", " marta  OLIVEIRA ", "person", ""), ("n2", "k", "Marta Olivera", "person", ""), ("n3", "k", "Heron", "project", ""), ("n4", "k", "Quentin", "person", "")], known.schema)
    found = {r["new_id"]: (r["entity_id"], r["tier"]) for r in resolve.resolve(new, known).collect()}
    assert found == {"n1": ("e1", "exact"), "n2": ("e1", "fuzzy"), "n3": (None, None), "n4": (None, None)}
    asked = {r["new_id"]: r["tier"] for r in resolve.resolve(new, known, ask=lambda a, b: a["name"] == b["name"]).collect()}
    assert asked["n3"] == "asked"


def rows_of_joins(frame):
    """The most rows that a join of an executed plan gave."""

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        here = node.metrics().apply("numOutputRows").value() if "Join" in name else 0
        children = node.children()
        return max([here, *(walk(children.apply(i)) for i in range(children.size()))])

    return walk(frame._jdf.queryExecution().executedPlan())


def test_exact_matches_of_a_name_that_many_share(spark):
    kind = F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, " Tool").otherwise("part")
    known = spark.range(1, 3001).select(F.lit("k").alias("kb_id"), F.format_string("%05d", "id").alias("id"), F.lit("Red  bolt").alias("name"), kind.alias("type"))
    new = known.withColumns({"name": F.lit("red bolt "), "type": F.when(F.col("type") == "part", None).otherwise(F.col("type"))})
    found = resolve.exact_matches(new, known)
    rows = {r["new_id"]: r["entity_id"] for r in found.collect()}
    # tool: the first that is a tool or says nothing; none: the first of all.
    assert len(rows) == 3000 and set(rows.values()) == {"00001"}
    assert rows_of_joins(found) <= 6000
    others = resolve.exact_matches(new.filter("type = ' Tool'"), known.filter("type <> ' Tool'"))
    assert {r["entity_id"] for r in others.collect()} == {"00003"}


@pytest.mark.parametrize("least", [0.0, 0.6, 0.85])
def test_best_similar_is_exact_without_all_pairs(spark, least):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcde\u00e9\U0001f600 #") for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 9, 14])))
    names = [word() for _ in range(150)] + [f"Part#{rng.randrange(2000):05d}" for _ in range(250)] + ["ab" * 50, "ab" * 49 + "c", None]
    rows = lambda mark, n: [(f"{mark}{i}", rng.choice("kl"), rng.choice(names) if i % 2 else f"Part {rng.randrange(2000):05d}", rng.choice(["x", "y", "", None]), "") for i in range(n)]
    schema = "id string, kb_id string, name string, type string, summary string"
    new, known = rows("n", 120), rows("e", 500)
    norm = lambda s: re.sub(" +", " ", s.lower()).strip(" ")
    agree = lambda a, b: not a or not b or a == b
    expected = {}
    for i, kb, name, kind, _ in new:
        found = [(-round(tx.jaro_winkler_similarity(norm(name), norm(e[2])), 9), e[0], e[3]) for e in known if e[1] == kb and e[2] is not None] if name is not None else []
        if found and -min(found)[0] >= least:
            s, e, other = min(found, key=lambda x: x[:2])
            expected[i] = (e, -s, agree(kind, other))
    found = resolve.best_similar(spark.createDataFrame(new, schema), spark.createDataFrame(known, schema), least)
    assert {r["new_id"]: (r["entity_id"], r["similarity"], r["types_agree"]) for r in found.collect()} == expected
    assert rows_of_joins(found) <= len(new)


def test_resolve_of_names_that_many_share(spark):
    known = spark.range(2000).select(F.format_string("%05d", "id").alias("id"), F.lit("k").alias("kb_id"), F.lit("red bolt").alias("name"), F.lit("part").alias("type"), F.lit("").alias("summary"))
    new = known.withColumn("name", F.when(F.col("id") < "01000", "Red Bolt").otherwise("red  bold"))
    found = resolve.resolve(new, known, lambda a, b: False)
    assert {(r["entity_id"], r["tier"], r["n"]) for r in found.groupBy("entity_id", "tier").agg(F.count("*").alias("n")).collect()} == {("00000", "exact", 1000), ("00000", "fuzzy", 1000)}
    assert rows_of_joins(found) <= 4000


def test_mentions_are_matched_in_a_stream_of_texts(spark):
    """Each text by itself, in the order of its positions, however many texts a task has; no call for each text."""
    rows = [(kb, f"t{t % 40}", p, n, k, "") for kb in ("k", None) for t in range(40) for p, n, k in ((2, "ann  lee", ""), (0, "Ann Lee", "person"), (1, "Ann Leee", "person"), (3, "Bob" if t % 2 else "ann lee", "tool"), (4, None, None))]
    mentions = spark.createDataFrame(rows, "kb_id string, text_id string, position int, name string, type string, summary string")
    keyed = resolve.resolve_in_batch(mentions)
    found = {(r["kb_id"], r["text_id"], r["position"]): r["entity_key"] for r in keyed.collect()}
    assert keyed.columns == [*mentions.columns, "entity_key"] and len(found) == len(rows)
    for kb, text, position, name, *_ in rows:
        last = "bob|tool" if name == "Bob" else "ann lee|tool"
        assert found[kb, text, position] == {3: last, 4: "|"}.get(position, "ann lee|person")
    assert "FlatMapGroups" not in keyed._jdf.queryExecution().toString()


def test_ends_of_relations_are_looked_up_once(spark, monkeypatch):
    kept = {}
    real = ingest.cut
    monkeypatch.setattr(ingest, "cut", lambda df, name="cut": kept.setdefault(name, real(df, name)))
    texts = spark.createDataFrame([(f"t{i}", "k", f"npm install pkg{i % 2}", "api", {"a": "b"}) for i in range(6)], TEXT)
    entities, relations = (spark.createDataFrame([], TABLES[t]) for t in ("entities", "relations"))
    found = ingest.ingest(texts, entities, relations, F.lit("2025-01-01").cast("timestamp"))
    assert kept["names"].count() == 2 and kept["ends"].count() == 0
    assert {r["text_id"]: r["entities_created"] for r in found.by_text.collect()} == {"t0": 1, "t1": 1, "t2": 0, "t3": 0, "t4": 0, "t5": 0}


def test_embedders(spark):
    e = providers.HashEmbedder(16)
    assert e.embed(["alice"]) == e.embed(["alice"]) and e.embed([""])[0] == [0] * 16
    rows = providers.embed(spark.createDataFrame([("a",), (None,)], "t string"), "t", e).collect()
    assert all(len(r["embedding"]) == 16 for r in rows)
    for bad in (([[1.0]], 2, None), ([[]], 1, None), ([[1.0], [1.0, 2.0]], 2, None)):
        with pytest.raises(ValueError):
            providers.validate(*bad)


def test_engine(spark, tmp_path):
    now = F.lit("2025-01-01").cast("timestamp")
    engine = Engine(spark, f"file://{tmp_path}/kb", now=now)
    assert all(engine.table(t).count() == 0 for t in TABLES)
    texts = spark.createDataFrame([("t1", "k", "npm install express", "api", {}), ("t2", "k", "npm install Express\npip install project", "api", {})], TEXT)
    result = engine.add_texts(texts).first()
    assert (result["episodes"], result["entities_created"]) == (2, 2)
    names = sorted(r["name"].lower() for r in engine.table("entities").collect())
    assert names == ["express", "project"]
    again = engine.add_texts(spark.createDataFrame([("t3", "k", "pip install project\nnpm install express", "api", {})], TEXT)).first()
    assert again["entities_created"] == 0 and again["relations_created"] == 0 and again["relations_strengthened"] >= 1
    weights = [round(r["weight"], 4) for r in engine.table("relations").collect()]
    assert max(weights) > 0.9
    found = engine.search("k", "express").collect()
    assert found
    before = engine.store.version
    engine.search("k", "express", log=True)
    assert engine.store.version == before + 1
    entity = engine.table("entities").filter("lower(name) = 'express'").first()["id"]
    assert "express" in engine.describe("k", [entity], 1).lower()
    assert entity in {n["node"] for n in json.loads(engine.describe("k", [entity], 1, "json"))["nodes"]}
    assert json.loads(engine.prompt_context("k", "express"))["memories"]
    engine.decay()
    engine.prune(0.0)
    assert engine.list("entities", "k").columns.count("embedding") == 0 and engine.get("entities", "k", entity).count() == 1
    assert engine.relations_of("k", entity).count() >= 1
    engine.delete_entity("k", entity)
    engine.delete_episode("k", "t1")
    assert engine.table("entities").count() == 1 and engine.table("episodes").count() == 2
    for gone in (engine.delete_entity, engine.delete_episode, engine.invalidate):
        with pytest.raises(KeyError):
            gone("k", "nope")
    engine.create_kb("k", "The first")
    stats = engine.stats().first()
    assert (stats["kb_id"], stats["episodes"]) == ("k", 2) and stats["store_bytes"] > 1000
    engine.delete_kb("k")
    assert engine.table("entities").count() == 0 and engine.kbs().count() == 0


class Fake:
    """Finds a person per word that begins with a capital; some texts it cannot read. Names that end alike are one."""

    def extract(self, text):
        if "unreadable" in text:
            raise OSError("no answer for " + text)
        names = [w for w in text.split() if w[0].isupper()]
        return {"entities": [{"name": n, "type": "person", "summary": ""} for n in names], "relations": [{"source": a, "target": b, "type": "met", "summary": "", "weight": 0} for a, b in zip(names, names[1:], strict=False)]}

    def same(self, a, b):
        return a["name"][-4:] == b["name"][-4:]


JOB = "kb_id string, content string, source string, metadata map<string,string>"


def test_jobs_end_each_on_its_own(spark, tmp_path):
    told = []
    engine = Engine(spark, f"file://{tmp_path}/kb", extractor=Fake(), notify=told.append)
    texts = [("k", "Osvaldo saw Wilhelmina", "api", {}), ("k", "quite unreadable", "api", {"x": "y"}), ("j", "cargo add serde", "api", {})]
    engine.submit(spark.createDataFrame(texts, JOB))
    ended = {r["content"]: r for r in engine.run_jobs().collect()}
    assert [ended[t[1]]["status"] for t in texts] == ["completed", "failed", "completed"]
    assert ended["quite unreadable"]["error"] == "extract: no answer for quite unreadable" and ended["quite unreadable"]["result"] is None
    result = json.loads(ended["Osvaldo saw Wilhelmina"]["result"])
    assert (result["entities_created"], result["relations_created"], result["relations_strengthened"]) == (2, 1, 0)
    assert result["episode_id"] == ended["Osvaldo saw Wilhelmina"]["episode_id"]
    # The episode of a text that failed stays, and its access is logged.
    assert {r["content"] for r in engine.table("episodes").collect()} == {t[1] for t in texts}
    assert engine.table("access_log").count() == 3 and engine.table("decay_state").count() == 3
    assert {r["weight"] for r in engine.table("relations").filter("kb_id = 'k'").collect()} == {0.5}
    assert sorted(e["type"] for e in told) == ["job.completed", "job.completed", "job.failed"]
    # A retry is a further attempt with an episode of its own; others are not retried.
    again = engine.retry_jobs([r["id"] for r in ended.values()], wait=True).collect()
    assert sorted((r["status"], r["attempts"]) for r in again) == [("completed", 1), ("completed", 1), ("failed", 2)]
    assert engine.table("episodes").count() == 4
    waited = engine.submit(spark.createDataFrame([("k", "Osvaldo saw Gwilhelmina", "api", {})], JOB), wait=True).first()
    assert waited["status"] == "completed" and json.loads(waited["result"])["entities_created"] == 0
    assert engine.job(waited["id"]).first()["status"] == "completed" and engine.list_jobs("k", "failed").count() == 1


class Picky(providers.HashEmbedder):
    def embed(self, texts):
        if any("serde" in t for t in texts):
            raise OSError("no vector")
        return super().embed(texts)


def test_a_job_that_stops_the_ingest_fails_alone(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/kb", embedder=Picky())
    engine.submit(spark.createDataFrame([("k", f"cargo add {p}", "api", {}) for p in ("tokio", "serde", "rayon")], JOB))
    ended = {r["content"]: r for r in engine.run_jobs().collect()}
    assert {c: r["status"] for c, r in ended.items()} == {"cargo add tokio": "completed", "cargo add serde": "failed", "cargo add rayon": "completed"}
    assert "no vector" in ended["cargo add serde"]["error"]
    assert {r["name"] for r in engine.table("entities").collect()} == {"tokio", "rayon"}


def test_models_are_asked_only_where_rules_find_nothing(spark):
    texts = spark.createDataFrame([("a", "k", "npm install Leftpad", "api", {}), ("b", "k", "Tiberius met Octavia", "api", {}), ("c", "k", "nothing here", "api", {})], TEXT)
    found = {r["text_id"]: (r["by_model"], [e["name"] for e in r["x"]["entities"]]) for r in ingest.extract_texts(texts, Fake()).collect()}
    assert found == {"a": (False, ["Leftpad"]), "b": (True, ["Tiberius", "Octavia"]), "c": (True, [])}
    assert {r["by_model"] for r in ingest.extract_texts(texts).collect()} == {False}


def test_connectors(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked = []

    class Model(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, self.headers.get("Authorization"), body))
            answer = {"choices": [{"message": {"content": '{"entities": [{"name": "Ada", "type": "person"}, {"name": " "}], "relations": [{"source": "Ada", "target": "", "type": "x"}]}'}}]}
            if self.path.endswith("/embed"):
                answer = {"embeddings": [[1.0, 2.0] for _ in body["input"]]}
            elif self.path.endswith("/embeddings"):
                answer = {"data": [{"index": i, "embedding": [float(i), 1.0]} for i in reversed(range(len(body["input"])))]}
            data = json.dumps(answer).encode()
            self.send_response(200 if body["model"] != "broken" else 500)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        local = connectors.embedder({"provider": "ollama", "model": "m", "base_url": url})
        assert local.embed(["a", "b"]) == [[1.0, 2.0]] * 2 and asked[-1][0] == "/api/embed" and local.embed([]) == []
        keyed = connectors.embedder({"provider": "openai", "model": "m", "base_url": url, "dim": 2}, key="secret")
        assert keyed.embed(["a", "b"]) == [[0.0, 1.0], [1.0, 1.0]] and asked[-1][:2] == ("/embeddings", "Bearer secret")
        extractor = connectors.extractor({"provider": "groq", "model": "m", "base_url": url})
        assert extractor.extract("Ada") == {"entities": [{"name": "Ada", "type": "person", "summary": ""}], "relations": []}
        assert asked[-1][0] == "/chat/completions" and "<user_text>" in asked[-1][2]["messages"][0]["content"]
        assert not extractor.same({"name": "a"}, {"name": "b"})
        with pytest.raises(OSError, match="status 500"):
            connectors.extractor({"provider": "openai", "model": "broken", "base_url": url}).extract("x")
    finally:
        server.shutdown()
    engine = Engine(spark, f"file://{tmp_path}/kb")
    for bad in ({"provider": "openai", "model": "m"}, {"provider": "other", "model": "m"}, {"provider": "ollama"}, {"provider": "ollama", "model": "m", "base_url": "ftp://x"}):
        with pytest.raises(ValueError, match="embed_config"):
            engine.create_kb("k", embed_config=bad)
    engine.create_kb("k", embed_config={"provider": "openai", "model": "m", "dim": 3}, llm_config={"provider": "ollama", "model": "l"}, key="secret")
    kept = engine.kbs().first()
    assert kept["embed_config"]["model"] == "m" and "secret" not in str(kept)
    with pytest.raises(ValueError, match="already"):
        engine.create_kb("k")


def test_hooks(spark, tmp_path):
    import io

    engine = Engine(spark, f"file://{tmp_path}/kb")
    hooks = Hooks(engine, "k", every=2)
    piped = lambda t: io.TextIOWrapper(io.BytesIO(t.encode()))
    assert [hooks.post_tool_use(piped(t)) for t in ("npm install a", "npm install b", "x", "no rule", "y", "  ")] == [False, True, False, False, False, False]
    assert hooks.pre_compact(piped("é" * 40_000)) and not hooks.pre_compact(piped(" "))
    rows = {r["source"]: r["content"] for r in engine.table("ingestion_jobs").collect()}
    assert rows["hook:post_tool_use"] == "npm install b" and rows["hook:pre_compact"] == "é" * 25_000
    engine.run_jobs()
    assert any("b" in m["content"] for m in json.loads(hooks.user_prompt(piped("install b")))["memories"])
    assert read_input(piped(" " + "a" * (1 << 20) + "b")) == "a" * ((1 << 20) - 1)


def test_readers_always_see_a_whole_state(spark, tmp_path):
    """While commits go on, a reader finds the rows before or after, in both tables alike; a second writer is refused."""
    import threading

    folder = f"file://{tmp_path}/kb"
    engine, other = Engine(spark, folder), Store(spark, folder)
    row = lambda n: spark.createDataFrame([(f"{n}{i}", "k", "c", "s", {}) for i in range(n)], TEXT).withColumn("created_at", F.current_timestamp())
    engine.store.commit(episodes=row(1), feedback=row(1).selectExpr("id", "kb_id", "content as topic", "content", "source as correction", "source", "metadata", "created_at"))
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append(tuple(t.count() for t in other.tables("episodes", "feedback")))

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(2, 6):
        engine.store.commit(episodes=row(n), feedback=row(n).selectExpr("id", "kb_id", "content as topic", "content", "source as correction", "source", "metadata", "created_at"))
    stop.set()
    reader.join()
    assert seen and all(a == b and a > 0 for a, b in seen)
    pointer = other._pointer()
    engine.store.commit(append={"episodes": row(1)})
    with pytest.raises(Conflict):
        other._point({"version": pointer["version"] + 1, "tables": {}}, "late")
    assert engine.table("episodes").count() == 6


def test_commits_touch_what_they_must(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/kb")
    rows = lambda kb, *ids: spark.createDataFrame([(i, kb, "c", "s", {}) for i in ids], TEXT).withColumn("created_at", F.current_timestamp())
    ids = lambda: sorted((r["kb_id"], r["id"]) for r in store.table("episodes").collect())
    store.commit(episodes=rows("a b/c=", "1").unionByName(rows("j", "2")))
    store.commit(append={"episodes": rows("j", "3")})
    assert ids() == [("a b/c=", "1"), ("j", "2"), ("j", "3")]
    store.commit(kbs=["j"], episodes=rows("j", "4").unionByName(rows("other", "9")))
    assert ids() == [("a b/c=", "1"), ("j", "4")]
    store.commit(kbs=["a b/c="], episodes=rows("j", "5"))
    assert ids() == [("j", "4")]
    before = store.version
    assert store.compact() == before + 1 and ids() == [("j", "4")] and store.compact() == before + 1
    store.KEPT = 1
    store.commit(append={"feedback": store.table("feedback")})
    assert store.vacuum() >= 3 and ids() == [("j", "4")]


def test_streams(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/kb")
    os.makedirs(tmp_path / "in")
    for n in range(2):
        (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps({"id": f"t{n}{i}", "kb_id": "k", "content": f"npm install pkg{i}", "source": "api", "metadata": {}}) + "\n" for i in range(3)))
    results = []
    texts = stream.read_texts(spark, f"{tmp_path}/in", files_per_trigger=1)
    query = stream.stream_texts(engine.store, texts, f"{tmp_path}/check", notify=lambda r: results.extend(r.collect()), available_now=True)
    query.awaitTermination()
    assert engine.table("episodes").count() == 6 and engine.table("entities").count() == 3
    assert len(results) == 2 and engine.store.version == 2
    calls = spark.createDataFrame([(1, "k", "npm install a"), (2, "k", " Nothing is left to do. "), (3, "k", "error: x"), (4, "k", "  ")], "call int, kb_id string, content string")
    assert [r["call"] for r in stream.hook_texts(calls).collect()] == [1, 3]


def test_feeder(spark, tmp_path):
    import time

    engine = Engine(spark, f"file://{tmp_path}/kb")
    engine.submit(spark.createDataFrame([("k", "cargo add serde", "api", {})], JOB))
    query = stream.feed_jobs(engine, f"{tmp_path}/check", poll_seconds=1)
    until = time.time() + 60
    while time.time() < until and engine.list_jobs(status="completed").count() == 0:
        time.sleep(0.5)
    query.stop()
    assert engine.list_jobs(status="completed").count() == 1


def test_access_stream(spark, tmp_path):
    rows = spark.createDataFrame([("k", "entity", "a", i * 1800) for i in range(6)], "kb_id string, entity_type string, entity_id string, t long").withColumn("accessed_at", F.timestamp_seconds("t")).drop("t")
    rows.write.parquet(f"{tmp_path}/log")
    for name, df, mode in (("states", stream.access_states(stream.read_accesses(spark, f"{tmp_path}/log")), "complete"), ("windows", stream.access_counts(stream.read_accesses(spark, f"{tmp_path}/log")), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    assert [r["access_count"] for r in spark.table("states").collect()] == [6]
    assert sorted(r["n"] for r in spark.table("windows").collect()) == [2, 2, 2]


def test_sinks(spark, tmp_path):
    events = spark.createDataFrame([(1, "a"), (2, "b")], "n int, what string")
    sinks.append_json_lines(events, f"{tmp_path}/events")
    sinks.append_json_lines(events, f"{tmp_path}/events")
    assert spark.read.json(f"{tmp_path}/events").count() == 4
    with pytest.raises(ValueError):
        sinks.append_json_lines(events, "relative")
    notify = sinks.file_notifier(f"{tmp_path}/log.jsonl")
    notify({"a": 1})
    assert json.loads((tmp_path / "log.jsonl").read_text()) == {"a": 1}
    assert os.stat(tmp_path / "log.jsonl").st_mode & 0o777 == 0o600

    def broken(event):
        raise OSError("no")

    seen = []
    with pytest.raises(ExceptionGroup):
        sinks.notify_all([broken, seen.append])({"b": 2})
    assert seen == [{"b": 2}]
    with pytest.raises(ValueError):
        sinks.export_jobs(spark.createDataFrame([], TABLES["ingestion_jobs"]), f"{tmp_path}/x", "xml")
    sinks.export_jobs(spark.createDataFrame([], TABLES["ingestion_jobs"]), f"{tmp_path}/x", "csv")
