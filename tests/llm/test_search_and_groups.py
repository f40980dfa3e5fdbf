import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import components, mixing, near_dup, oracles, topk


def brute_top(rows, is_query, k):
    """rows: (id, vector). Equal rows once; scores as Python integers."""
    sound = {(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = {}
    for q, v in sound:
        if is_query(q):
            clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
            found = sorted(((-clip(sum(a * b for a, b in zip(v, w, strict=True))), i, w) for i, w in sound if i != q and len(w) == len(v)))[:k]
            out.setdefault(q, []).append([(i, -s) for s, i, _ in found])
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=19) / 4]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [rows[3], rows[10]]  # repeated rows
    rows += [(2000, None), (2010, []), (2020, [1.0, None]), (2030, [float("nan")] * 19), (2040, [float("inf")] * 19), (None, rows[0][1])]
    rows += [(2050, [0.0] * 19), (2060, [0.5, 0.25]), (2061, [0.5, 0.5]), (2062, [-1.0, 0.5])]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, score int, rank int").repartition(3), rows


@pytest.mark.parametrize("limit", [1 << 24, 2500])
def test_top_k_is_exact(vectors, limit):
    table, rows = vectors
    found = defaultdict(list)
    for r in topk.top_k(table, F.col("vec_id") % 10 == 0, broadcast_bytes=limit).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    rows = [(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows]
    expected = {q: lists[0] for q, lists in brute_top(rows, lambda q: q % 10 == 0, 5).items() if lists[0]}
    assert {q: [(i, s) for _, i, s in sorted(x)] for q, x in found.items()} == expected
    assert all([n for n, _, _ in sorted(x)] == list(range(1, len(x) + 1)) for x in found.values())


def test_top_k_of_large_values(spark):
    rows = [(i, [1e12 * (i % 7 - 3), 3e11, 1.0]) for i in range(20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in topk.top_k(table, F.col("vec_id") < 4, k=3).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    expected = brute_top(rows, lambda q: q < 4, 3)
    assert {q: [(i, s) for _, i, s in sorted(x)] for q, x in found.items()} == {q: x[0] for q, x in expected.items()}


def test_top_k_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") == 0).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], schema), F.col("vec_id") == 0).count() == 0


def test_bounds_prune(spark):
    """Vectors near a few directions: most pairs go at the coarse resolutions and few are scored. Without any structure the finest one still spares some."""
    rng = np.random.default_rng(9)
    spread = 0.85 ** np.arange(32)
    turned = np.linalg.qr(rng.normal(size=(32, 32)))[0]
    for scale, most in ((spread, 0.2), (np.ones(32), 0.9)):
        vectors = (rng.normal(size=(6000, 32)) * scale) @ turned
        table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(2)
        left = topk.pruning(table, F.col("vec_id") % 50 == 0)
        assert [n for n, _ in left] == [0, 4, 16] and left[0][1] == 120 * 6000
        pairs = [p for _, p in left]
        assert pairs == sorted(pairs, reverse=True) and pairs[-1] <= most * pairs[0]


def test_thresholds_count_a_row_once():
    known = topk.Thresholds(np.array([-np.inf]), 2)
    known.met(0, np.array([9.0, 9.0]), np.array([4, 4]))
    assert known.floor[0] == -np.inf
    known.met(0, np.array([9.0, 7.0]), np.array([4, 5]))
    assert known.floor[0] == 7.0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    turn = topk.axes(rng.normal(size=(90, 30)))
    a, b = rng.normal(size=(40, 30)) @ turn, rng.normal(size=(50, 30)) @ turn
    assert np.allclose(turn @ turn.T, np.eye(30))
    for count in (1, 4, 7, 15, 30):
        bound = np.concatenate(topk.segments(a, count), axis=1) @ np.concatenate(topk.segments(b, count), axis=1).T
        assert (bound >= a @ b.T - 1e-9).all()


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, s) in enumerate(sets):
        for b, t in sets[n + 1 :]:
            both = len(s & t)
            if s and t and 100 * both >= 75 * (len(s) + len(t) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def check_groups(table, rows, **more):
    found = near_dup.near_duplicates(table, **more).collect()
    expected = brute_components(rows)
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in rows)
    sizes = Counter((i, len(shingles(t))) for i, t in rows)
    assert Counter((r["doc_id"], r["n_shingles"]) for r in found) == sizes
    for r in found:
        assert r["component_id"] == (None if r["doc_id"] is None else expected[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])


def test_near_duplicates_of_nasty_texts(docs):
    check_groups(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])


def families(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 5000)}"
    rows, n = [], 0
    passage = [word() for _ in range(55)]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy + (passage if rng.random() < 0.3 else []))))
            n += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_are_brute_forces(spark, seed):
    rows = families(seed)
    check_groups(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_near_duplicates_branch_and_chunk(spark, monkeypatch):
    """Small limits send everything through deeper levels and pairs of chunks."""
    monkeypatch.setattr(near_dup, "SMALL", 3)
    rows = families(3)
    check_groups(spark.createDataFrame(rows, "doc_id long, text string"), rows, chunk_bytes=3000)


def test_near_duplicates_recall_where_nodes_branch(spark, monkeypatch, capsys):
    """Many large nodes that branch to the last level: passages in far over SMALL documents each, with near copies among them. Recall over all similar pairs."""
    monkeypatch.setattr(near_dup, "SMALL", 24)
    rng = random.Random(31)
    rows, n = [], 0
    for g in range(6):
        passage = [f"p{g}x{rng.randint(0, 9999)}" for _ in range(60)]
        for i in range(90):
            own = [f"g{g}d{i}w{k}" for k in range(rng.choice([14, 40, 120]))]
            for _ in range(rng.choice([1, 1, 1, 2, 3])):
                copy = passage + own
                copy[rng.randrange(len(copy))] = f"c{n}"
                rows.append((n, " ".join(copy)))
                n += 1
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(table, chunk_bytes=40_000).collect()}
    sets = {i: shingles(t) for i, t in rows}
    holders = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    pairs = [(i, j) for i, s in sets.items() for j in {k for x in s for k in holders[x]} if i < j and 100 * len(s & sets[j]) >= 75 * len(s | sets[j])]
    recall = sum(found[i] == found[j] for i, j in pairs) / len(pairs)
    with capsys.disabled():
        print(f" recall {recall:.4f} of {len(pairs)} pairs", end=" ")
    assert len(pairs) > 400 and recall >= 0.99


def test_near_duplicates_share_only_a_hot_passage(spark):
    """A passage that far over SMALL documents hold, each similar to the passage alone: its nodes are large, the others hold one class."""
    rng = random.Random(12)
    passage = [f"p{rng.randint(0, 99999)}" for _ in range(120)]
    rows = [(0, " ".join(passage))] + [(1 + i, " ".join(passage + [f"d{i}w{k}" for k in range(38)])) for i in range(600)]
    rows += [(1000 + i, " ".join(passage + [f"e{i}w{k}" for k in range(200)])) for i in range(20)]
    check_groups(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_stars_in_many_groups_and_rests_in_chunks(spark, monkeypatch):
    """One large group of near copies whose star is dealt into groups, with strays that only a pair away from the centre reaches."""
    monkeypatch.setattr(near_dup, "STAR_MEMBERS", 7)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(f"u{i}" if k == i % 100 else w for k, w in enumerate(base))) for i in range(150)]
    chain = list(base)
    for i in range(150, 170):
        for _ in range(2):
            chain[rng.randrange(100)] = f"s{i}x{rng.randint(0, 99)}"
        rows.append((i, " ".join(chain)))
    check_groups(spark.createDataFrame(rows, "doc_id long, text string"), rows, chunk_bytes=9000)


def test_one_large_group(spark):
    rng = random.Random(9)
    base = [f"v{rng.randint(0, 9999)}" for _ in range(120)]
    rows = [(i, " ".join(base)) for i in range(300)]
    for i in range(400):
        copy = list(base)
        copy[rng.randrange(120)] = f"u{i}"
        rows.append((300 + i, " ".join(copy)))
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in found} == {0} and sum(r["kept"] for r in found) == 1


def test_no_documents(empty):
    assert near_dup.near_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 140), (140, 120), (7, 7)] + [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(45)] + [(300, x) for x in range(301, 380)]
    found = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert found == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def fill(sizes, weights, most):
    """Water-filling by rounds."""
    total, capped = sum(sizes), set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(most * sizes[i] for i in capped)
        share = sum(weights[i] for i in open_)
        target = [most * sizes[i] if i in capped else left * weights[i] / share for i in range(len(sizes))]
        over = {i for i in open_ if target[i] > most * sizes[i] + 1e-9}
        if not over:
            return target
        capped |= over


def test_mix_meets_the_targets(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    texts = {(r["doc_id"], r["source"]): r["text"] for r in docs.collect()}
    sources = sorted({r["source"] for r in rows if r["source"] is not None}, key=lambda s: s.encode()) + [None]
    size = {s: sum(r["size"] for r in rows if r["source"] == s) for s in sources}
    expected = dict(zip(sources, fill([size[s] for s in sources], [1 + i % 3 for i in range(len(sources))], 3), strict=True))
    taken = defaultdict(int)
    for r in rows:
        assert r["size"] == len((texts[r["doc_id"], r["source"]] or "").encode().split())
        assert r["source_size"] == size[r["source"]]
        assert abs(r["target"] - expected[r["source"]]) < 1e-6 * max(1, expected[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    for s in sources:
        assert abs(taken[s] - expected[s]) <= 1
    key = lambda r: (r["doc_id"] or -1, r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, mixing.mix(docs.repartition(5)).collect()))


def test_mix_with_many_buckets(docs, monkeypatch):
    first = sorted((r["doc_id"] or -1, r["taken"]) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    assert first == sorted((r["doc_id"] or -1, r["taken"]) for r in mixing.mix(docs).collect())


def test_mix_of_nothing(empty, spark):
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mixing.mix(blank).collect()] == [(0.0, 0), (0.0, 0)]


def test_sql_of_mix_and_search(spark, docs, vectors, tmp_path):
    """The registered SQL gives the operators' rows on the nasty tables."""
    c = duckdb.connect()
    documents = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text", "source")
    documents.write.parquet(f"{tmp_path}/d")
    c.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    own = sorted(tuple(r) for r in mixing.mix(documents).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert own == sorted(c.sql(oracles.OP6).fetchall())
    table = vectors[0].filter("vec_id < 2000").dropDuplicates(["vec_id"])
    table.write.parquet(f"{tmp_path}/e")
    c.sql(f"create view embeddings as select * from '{tmp_path}/e/*.parquet'")
    own = sorted(tuple(r) for r in topk.top_k(table, F.col("vec_id") % 50 == 0).collect())
    assert own == sorted(c.sql(oracles.OP4).fetchall())
