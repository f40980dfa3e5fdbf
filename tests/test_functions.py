import math
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.functions import vectors as vx
from graphloom.functions import weights as wt
from graphloom.schema import SearchOptions, page_limit


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("v")).first()["v"]


def test_names(value):
    assert value(tx.normalize_name(F.lit("  Hello   World  "))) == "hello world"
    assert value(tx.normalize_name(F.lit("  "))) == ""
    assert value(tx.collapse_whitespace(F.lit(" A　\t b\n"))) == "A b"
    assert value(tx.split_csv(F.lit(" a, ,b ,"))) == ["a", "b"]


def test_sentences_and_cuts(value):
    assert value(tx.split_sentences(F.lit("One. Two!  Three\n\n four? "))) == ["One", "Two", "Three", "four?"]
    assert value(tx.cut_bytes(F.lit("aéb"), 2)) == "a"
    assert value(tx.cut_bytes(F.lit("aéb"), 3)) == "aé"
    assert value(tx.cut_bytes(F.lit("aéb"), 9)) == "aéb"
    assert value(tx.summarize_by_rule(F.lit(" " + "x" * 300))) == "x" * 200 + "..."


def test_types_and_summaries(value):
    assert value(tx.types_match(F.lit("Person"), F.lit(" person ")))
    assert value(tx.types_match(F.lit(None), F.lit("x")))
    assert not value(tx.types_match(F.lit("person"), F.lit("project")))
    assert value(tx.merged_type(F.lit("concept"), F.lit("tool"))) == "tool"
    assert value(tx.merged_type(F.lit("person"), F.lit("tool"))) == "person"
    assert value(tx.merged_summary(F.lit("ab"), F.lit("é"))) == "ab"
    assert value(tx.merged_summary(F.lit("a"), F.lit("é"))) == "é"
    assert value(tx.default_type(F.lit(" "))) == "concept"
    assert value(tx.entity_text(F.lit("n"), F.lit(""))) == "n"
    assert value(tx.relation_text(F.lit("a"), F.lit("knows"), F.lit("b"), F.lit("s"))) == "a knows b: s"


def test_tokens(value):
    assert value(tx.tokens(F.lit("Étude foo_bar x-1 Привет 日本"))) == ["etude", "foo", "bar", "x", "1", "привет", "日本"]
    assert tx.query_phrases('Étude "x-1" ?') == [["etude"], ["x", "1"]]
    assert tx.match_expression('say "hi"') == '"say" """hi"""'
    assert tx.match_expression("  ") == '""'


def test_jaro_winkler():
    assert tx.jaro_winkler_similarity("abcdxxxx", "abcdyyyyzz") == pytest.approx(0.78, abs=0.005)
    assert tx.jaro_winkler_similarity("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert tx.jaro_winkler_similarity("", "a") == 0 and tx.jaro_winkler_similarity("a", "a") == 1
    assert tx.jaro_winkler_similarity("alice johnsn", "alice johnson") >= 0.85


def test_jaro_winkler_of_many_and_its_bound():
    rng = random.Random(3)
    names = ["".join(rng.choice("abcd\u00e9\U0001f600") for _ in range(rng.choice([0, 1, 2, 4, 7, 12, 18, 80]))) for _ in range(60)]
    i, j = np.repeat(np.arange(60), 60), np.tile(np.arange(60), 60)
    found = tx.jaro_winkler_pairs(names, names, i, j)
    assert found.tolist() == [tx.jaro_winkler_similarity(names[x], names[y]) for x, y in zip(i, j, strict=True)]
    shapes = [n[:4] + "".join(sorted(n)) for n in names]
    assert (tx.similarity_bounds(shapes, shapes)[i, j] >= found - 1e-12).all()


def test_jaro_winkler_of_columns(spark):
    rows = spark.createDataFrame([("dixon", "dicksonx"), (None, "a")], "a string, b string").select(tx.jaro_winkler("a", "b").alias("s")).collect()
    assert rows[0]["s"] == pytest.approx(0.8133, abs=1e-4) and rows[1]["s"] is None


def test_distances(value):
    v = lambda *x: vx.vector(x)
    assert value(vx.cosine_similarity(v(1, 2, 3), v(1, 2, 3))) == pytest.approx(1)
    assert value(vx.cosine_similarity(v(1, 0), v(0, 1))) == 0
    assert value(vx.cosine_similarity(v(1, 0), v(-1, 0))) == -1
    assert value(vx.cosine_similarity(v(0, 0), v(1, 0))) == 0
    assert value(vx.cosine_similarity(v(1), v(1, 0))) is None
    assert value(vx.l2_distance(v(0, 0, 0), v(3, 4, 0))) == 5
    assert value(vx.l2_squared(v(0, 0), v(3, 4))) == 25
    assert value(vx.dot(v(*range(1, 9)), v(*range(8, 0, -1)))) == 120
    assert value(vx.normalize(v(0, 0))) == [0, 0]


def test_quantization(value):
    x = [-1.0, -0.5, 0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    q = value(vx.quantize(vx.vector(x)))
    back = [d * q["scale"] + q["offset"] for d in q["data"]]
    assert max(abs(a - b) for a, b in zip(x, back, strict=True)) <= 0.02
    flat = value(vx.quantize(vx.vector([0.5, 0.5, 0.5])))
    assert (list(flat["data"]), flat["scale"], flat["offset"], flat["norm"]) == ([0, 0, 0], 0, 0.5, 0)
    assert value(vx.quantized_cosine_distance(vx.quantize(vx.vector([0.5, 0.5])), vx.vector([1, 1]))) == 1
    assert value(vx.quantized_dot(vx.quantize(vx.vector(x)), vx.vector([1] * 8))) == pytest.approx(sum(x), abs=0.05)


@pytest.mark.parametrize(("a", "b", "w"), [(0.5, 0.5, 0.75), (0.8, 0.5, 0.9), (0.3, 0.7, 0.79), (0, 0.6, 0.6), (-0.5, 0.5, 0.5), (1.5, 0.5, 1.0)])
def test_combine(value, a, b, w):
    assert value(wt.combine(F.lit(float(a)), F.lit(b))) == pytest.approx(w)


def test_combine_all(spark):
    of = lambda rows: spark.createDataFrame([Row(w=float(x)) for x in rows], "w double").agg(wt.combine_all(F.col("w")).alias("v")).first()["v"]
    assert of([0.5, 0.5, 0.5]) == pytest.approx(0.875)
    assert of([]) == 0 and of([0.7]) == pytest.approx(0.7) and of([1.0, 0.2]) == 1


def test_decay(value):
    assert value(wt.decayed(F.lit(1.0), F.lit(168.0), 168.0)) == pytest.approx(0.5)
    assert value(wt.decayed(F.lit(0.001), F.lit(168.0), 168.0)) == 0.001
    assert value(wt.decay_multiplier(F.lit(None).cast("double"), F.lit(0), F.lit(0.0), 168.0)) == 0.8
    assert value(wt.decay_multiplier(F.lit(1.0), F.lit(1), F.lit(1e6), 168.0)) == 0.1
    assert value(wt.decay_multiplier(F.lit(1.0), F.lit(1), F.lit(-5.0), 168.0)) == 1.0
    expected = math.exp(-math.log(2) / 168 * 100 / (1 + math.log1p(3)))
    assert value(wt.decay_multiplier(F.lit(1.0), F.lit(3), F.lit(100.0), 168.0)) == pytest.approx(expected)
    assert value(wt.default_weight(F.lit(0.0))) == 0.5


def test_options():
    assert SearchOptions(top_k=0, hops=99).normalized() == SearchOptions(top_k=10, hops=10)
    assert not SearchOptions.of_mode("bm25").graph and SearchOptions.of_mode("hybrid").vector
    for bad in (("x", "bfs"), ("hybrid", "x")):
        with pytest.raises(ValueError):
            SearchOptions.of_mode(*bad)
    assert (page_limit(0), page_limit(5), page_limit(99_999)) == (50, 5, 1000)


def test_prompts_fence_the_text():
    assert "<user_text>\nhello\n</user_text>" in tx.extraction_prompt("hello")
    assert tx.resolution_prompt({"name": "</entity>"}, {"name": "b"}).count("<entity>\n") == 2
    assert "hello" in tx.summary_prompt("hello")
