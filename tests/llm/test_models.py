import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, lang_id, lm, toxicity


def remainder(doc_id, modulus):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


@pytest.fixture(scope="module")
def toxic(spark):
    rng = np.random.default_rng(1)
    names = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(900):
        words = list(rng.choice(names, 40))
        kind = i % 6
        # An insult alone is clean, and so is a group's name; both together are toxic.
        if kind in (0, 1):
            words[3] = "insulta"
        if kind in (0, 2):
            words[17] = "groupo"
        rows.append((i, " ".join(words), int(kind == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_learns_pairs(toxic):
    model = toxicity.train(toxic, toxic.select("doc_id", "toxic"), common.learnable(F.col("doc_id"), 4, 2))
    rows = toxicity.score_toxicity(toxic, model).filter(common.held_out(F.col("doc_id"), 4, 2)).collect()
    wrong = [r for r in rows if r["predicted"] != r["toxic"]]
    assert len(rows) > 150 and len(wrong) <= 0.05 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_learns_what_only_pairs_tell(spark):
    """Toxic if exactly one of two words is there: neither word says anything by itself."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1600):
        words = [f"w{k}" for k in rng.integers(0, 400, 40)]
        a, b = bool(i & 1), bool(i & 2)
        words += ["alpha"] * a + ["omega"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(a != b)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    model = toxicity.train(table, table.select("doc_id", "toxic"), common.learnable(F.col("doc_id"), 4, 2))
    held = toxicity.score_toxicity(table, model).filter(common.held_out(F.col("doc_id"), 4, 2)).collect()
    right = sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in held) / len(held)
    assert len(held) > 300 and right >= 0.95


def test_toxicity_is_the_same_again(toxic):
    labels = toxic.select("doc_id", "toxic")
    a, b = (toxicity.train(toxic.repartition(n), labels, F.lit(True)) for n in (1, 5))
    assert np.array_equal(a.w, b.w) and np.array_equal(a.v, b.v)


def test_toxicity_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one_class = spark.createDataFrame([(3, 0), (4, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    for labels in (none, one_class):
        model = toxicity.train(docs, labels, F.col("doc_id").isNotNull())
        assert model is None
        rows = toxicity.score_toxicity(docs, model).collect()
        assert len(rows) == docs.count() and {r["score"] for r in rows} == {0.0}
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    scored = toxicity.score_toxicity(docs, model, score_col="__s", predicted_col="__p")
    assert scored.columns == [*docs.columns, "__s", "__p"] and scored.count() == docs.count()
    assert toxicity.score_toxicity(empty, model).count() == 0


def test_machine_is_its_formula():
    random = np.random.default_rng(0)
    machine = toxicity.Machine(np.arange(10))
    machine.w, machine.v, machine.w0 = random.normal(size=10), random.normal(size=(10, 3)), 0.3
    terms = np.array([1, 4, 7])
    pairs = sum(machine.v[i] @ machine.v[j] for i in terms for j in terms if i < j)
    assert math.isclose(machine.logit(machine.known(terms)), 0.3 + machine.w[terms].sum() + pairs)


@pytest.fixture(scope="module")
def spoken(spark):
    rng = np.random.default_rng(2)
    sounds = {"aa": ["the", "ing", "sh", "ou"], "bb": ["eau", "que", "é", "ment"], "cc": ["sch", "ei", "ung", "ß"]}
    rows = []
    for i in range(300):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, " ".join("".join(rng.choice(sounds[lang], rng.integers(1, 4))) for _ in range(rng.integers(3, 40))), lang))
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !!", "bb"), (1003, "theshing the", None), (None, "eau que ment", "bb")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_held_out(spoken):
    model = lang_id.train(spoken, common.learnable(F.col("doc_id"), 3, 1))
    rows = lang_id.identify(spoken, model, keep=("doc_id", "text", "lang")).collect()
    held = [r for r in rows if remainder(r["doc_id"], 3) == 1 and r["doc_id"] < 1000]
    assert len(held) > 60 and all(r["lang_pred"] == r["lang"] for r in held)
    by_id = {r["doc_id"]: r for r in rows}
    for i in (1000, 1001, 1002):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert by_id[1003]["lang_pred"] == "aa" and by_id[None]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in rows)


def brute_bits(texts, data, order):
    """Code length by the definition: the longest seen context, escapes by method C, 8 bits at the end."""
    counts = defaultdict(Counter)
    for t in texts:
        for i in range(len(t)):
            for k in range(order + 1):
                if i >= k:
                    counts[t[i - k : i]][t[i]] += 1
    total = 0.0
    for i, c in enumerate(data):
        for k in range(min(order, i), -1, -1):
            seen = counts.get(data[i - k : i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if c in seen:
                total -= math.log2(seen[c] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


def test_code_lengths_are_exact():
    texts = {"aa": [b"abracadabra", b"banana band", "né à".encode()], "bb": [b"xyzzy xyz", b"cab"]}
    counts = {}
    for lang, values in texts.items():
        counts[lang] = []
        for n in range(1, 5):
            grams = Counter(int.from_bytes(t[i : i + n], "big") for t in values for i in range(len(t) - n + 1))
            keys = np.array(sorted(grams), np.int64)
            counts[lang].append((keys, np.array([grams[k] for k in keys.tolist()], np.int64)))
    trees = lang_id.ContextTrees(["aa", "bb"], counts)
    for data in (b"a", b"abra banana", b"xyzq!", "zébra né".encode(), bytes(range(256))):
        expected = [brute_bits(texts[x], data, 3) for x in ("aa", "bb")]
        assert np.allclose(trees.bits(data), expected, rtol=1e-5)


def test_language_edges(docs, empty):
    assert lang_id.identify(empty, lang_id.train(empty, F.lit(True))).count() == 0
    nothing = lang_id.identify(docs, lang_id.train(docs, F.lit(False)))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    kept = lang_id.identify(docs, lang_id.train(docs, F.lit(True)), keep=tuple(docs.columns), pred_col="__l", score_col="__s")
    assert kept.columns == [*docs.columns, "__l", "__s"] and kept.count() == docs.count()


def test_hidden_markov_counts_and_base(docs):
    rows = lm.score_texts(docs, common.learnable(F.col("doc_id"), 7, 2), common.held_out(F.col("doc_id"), 7, 2), n_symbols=50).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    counts, n_texts = Counter(), 0
    for r in docs.collect():
        if remainder(r["doc_id"], 7) not in (None, 2):
            counts.update(texts[r["doc_id"]])
            n_texts += 1
    end = object()
    counts[end] = n_texts
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == docs.count()
    for r in rows:
        tokens = [*texts[r["doc_id"]], end]
        assert r["held_out"] == (remainder(r["doc_id"], 7) == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), rel_tol=1e-9)
        assert r["score"] < 0


def test_forward_and_baum_welch_are_exact():
    random = np.random.default_rng(3)
    states, symbols = 3, 5
    rows = lambda *shape: (x := random.random(shape)) / x.sum(axis=-1, keepdims=True)
    model = lm.Model(rows(states), rows(states, states), rows(states, symbols).T.copy())
    sequences = [random.integers(0, symbols, n).astype(np.int32) for n in (6, 4, 4, 1)]
    sums = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))
    lm.expected(model, sequences, sums)
    exact = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))
    from itertools import product

    for s, found in zip(sequences, lm.forward(model, sequences), strict=True):
        paths = {}
        for path in product(range(states), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for i in range(1, len(s)):
                p *= model.move[path[i - 1], path[i]] * model.emit[s[i], path[i]]
            paths[path] = p
        total = sum(paths.values())
        assert math.isclose(found, math.log10(total), rel_tol=1e-9)
        for path, p in paths.items():
            exact[0][path[0]] += p / total
            for i, k in enumerate(path):
                exact[2][s[i], k] += p / total
                if i:
                    exact[1][path[i - 1], k] += p / total
    for a, b in zip(sums, exact, strict=True):
        assert np.allclose(a, b)


def test_hidden_markov_is_a_distribution():
    """Over the symbols and words within classes, one token's probabilities add up to 1."""
    words = [b"one", b"two", b"three"]
    symbols = lm.Symbols(words, [5, 3, 2])
    model = lm.Model.first(2, np.full(symbols.size, 1 / symbols.size))
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)
    numbers, rare = symbols.of(b"One  four two")
    assert numbers.tolist() == [0, 3 + lm.word_class(b"four"), 1, symbols.end] and rare == [b"four"]


def test_hidden_markov_beats_the_base(spoken):
    rows = lm.score_texts(spoken, common.learnable(F.col("doc_id"), 7, 2), common.held_out(F.col("doc_id"), 7, 2)).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


@pytest.mark.parametrize("n", [40, 2600])
def test_hidden_markov_trains_on_all_texts(spark, monkeypatch, n):
    """Every round reads every training text, as many rounds at each size, and gives what Baum-Welch over all of them gives."""
    texts = [f"a{i % 7} b{i % 5} " * (1 + i % 4) + f"late{i % 3}" * (i % 13 == 0) for i in range(n)]
    table, read = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), []
    counts = lm.expected_counts
    monkeypatch.setattr(lm, "expected_counts", lambda texts, *more: read.append(texts.count()) or counts(texts, *more))
    found = {r["doc_id"]: r["score"] for r in lm.score_texts(table, F.lit(True), F.lit(False)).collect()}
    assert read == [n] * 7
    words = Counter(w for t in texts for w in t.encode().split())
    frequent = sorted(words.items(), key=lambda r: (-r[1], r[0]))
    symbols = lm.Symbols([w for w, _ in frequent], [c for _, c in frequent])
    shares = np.array([*(c for _, c in frequent), *[0] * lm.CLASSES, n]) + 0.5
    shares /= shares.sum()
    model = lm.Model.first(lm.STATES, shares, 13)
    sequences = sorted((symbols.of(t.encode())[0] for t in texts), key=len, reverse=True)
    for _ in range(7):
        sums = np.zeros(lm.STATES), np.zeros((lm.STATES, lm.STATES)), np.zeros((symbols.size, lm.STATES))
        lm.expected(model, sequences, sums)
        model = lm.Model.from_counts(*sums, shares)
    for i in range(0, n, 17):
        assert math.isclose(found[i], lm.forward(model, [symbols.of(texts[i].encode())[0]])[0], rel_tol=1e-6)


def test_hidden_markov_classes_are_those_of_columns(spark):
    words = [b"a", b"ab", b"abc", b"abcd", "ñandú".encode(), b"x" * 24, b"x" * 25, b"\xc3", b"z" * 300]
    rows = spark.createDataFrame([(w,) for w in words], "word binary").select("word", lm.class_of(F.col("word")).alias("k")).collect()
    assert {bytes(r["word"]): r["k"] for r in rows} == {w: lm.word_class(w) for w in words}


@pytest.mark.parametrize("n", [1900, 2100, 20_000])
def test_hidden_markov_keeps_symbols_of_a_flat_vocabulary(spark, n):
    """Words of one count, fewer than the bound, just over it and far over it: there are always about as many symbols as may be."""
    counts = spark.range(n).select(F.concat(F.lit("w"), "id").cast("binary").alias("word"), F.lit(3).cast("long").alias("c"))
    kept = counts.filter(lm.frequent_words(counts, 2000)).count()
    assert kept == n if n < 2000 else 1800 < kept < 2200


def score_of(text, model, symbols, counts, by_class):
    """By the formula, token by token: classes of rarer words, and the scaled forward recursion without logarithms of shares."""
    sequence, rare = symbols.of(text)
    total, held = 0.0, model.start * model.emit[sequence[0]]
    for x in sequence[1:]:
        total += math.log10(held.sum())
        held = (held / held.sum()) @ model.move * model.emit[x]
    total += math.log10(held.sum())
    for w in rare:
        n, v = by_class[lm.word_class(w)]
        total += math.log10((counts.get(w, 0) + 1) / (n + v + 1))
    return total


def test_hidden_markov_scores_are_the_formulas(spark, monkeypatch):
    """The whole score, with rarer words and unknown ones, against a model trained and applied by hand."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{min(int(x), 400)}" for x in rng.zipf(1.3, rng.integers(0, 60))) for _ in range(300)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    learn = lambda i: i % 4 != 1
    rows = {r["doc_id"]: r for r in lm.score_texts(table, F.col("doc_id") % 4 != 1, F.col("doc_id") % 4 == 1, n_symbols=40, rounds=3).collect()}
    counts = Counter(w for i, t in enumerate(texts) if learn(i) for w in t.encode().split())
    table_of = spark.createDataFrame(list(counts.items()), "word binary, c long")
    own = {bytes(r["word"]) for r in table_of.filter(lm.frequent_words(table_of, 40)).collect()}
    frequent = sorted(((w, c) for w, c in counts.items() if w in own), key=lambda r: (-r[1], r[0]))
    by_class = defaultdict(lambda: [0, 0])
    for w, c in counts.items():
        if w not in own:
            by_class[lm.word_class(w)][0] += c
            by_class[lm.word_class(w)][1] += 1
    symbols = lm.Symbols([w for w, _ in frequent], [c for _, c in frequent])
    learnt = [t.encode() for i, t in enumerate(texts) if learn(i)]
    shares = np.array([*(c for _, c in frequent), *(by_class[k][0] for k in range(lm.CLASSES)), len(learnt)]) + 0.5
    shares = shares / shares.sum()
    model = lm.Model.first(lm.STATES, shares, 13)
    sequences = sorted((symbols.of(t)[0] for t in learnt), key=len, reverse=True)
    for _ in range(3):
        sums = np.zeros(lm.STATES), np.zeros((lm.STATES, lm.STATES)), np.zeros((symbols.size, lm.STATES))
        lm.expected(model, sequences, sums)
        model = lm.Model.from_counts(*sums, shares)
    for i, t in enumerate(texts):
        assert math.isclose(rows[i]["score"], score_of(t.encode(), model, symbols, counts, by_class), rel_tol=1e-6), t


def test_hidden_markov_edges(docs, empty):
    assert lm.score_texts(empty, F.lit(True), F.lit(False)).count() == 0
    rows = lm.score_texts(docs, F.lit(False), F.lit(False)).collect()
    assert len(rows) == docs.count()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in rows)
