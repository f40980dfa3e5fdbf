"""A training-data pipeline of five stages; each takes (spark, docs, sf_dir) and its rows are written before the next one reads them.

All stages but the last return the columns of docs, extra ones too, whatever their names, and keep repeated rows, rows
without an id and empty tables as their docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common, lang_id, mixing, near_dup, packing, toxicity

#: Least posterior of a language for a document to stay.
LEAST_LANGUAGE_SCORE = 0.5
#: Most bits that a byte of a text of some length may take in its language: random bytes take eight, and so do scripts that no language was learnt in.
MOST_BITS, LEAST_BYTES = 7.25, 100

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold stay; null and empty texts score by the bias alone, which is low. Repeated rows fare alike, and rows without an id are scored like others."""
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels, F.col("doc_id").isNotNull())
    score, toxic = free_name(docs, "__toxicity"), free_name(docs, "__toxic")
    scored = toxicity.score_toxicity(docs, model, score_col=score, predicted_col=toxic)
    return scored.filter(F.col(toxic) == 0).select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told stay; the label they came with is not changed. Null texts, those without a letter and those that no learnt language can code go, also if repeated; very long texts are judged whole."""
    model = lang_id.train(docs, F.lit(True))
    lang, score, bits = (free_name(docs, n) for n in ("__language", "__posterior", "__bits"))
    found = lang_id.identify(docs, model, keep=tuple(docs.columns), pred_col=lang, score_col=score, bits_col=bits)
    known = (F.col(lang) != lang_id.UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE_SCORE)
    junk = (F.col(bits) > MOST_BITS) & (F.octet_length("text") >= LEAST_BYTES)
    return found.filter(known & ~junk).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the one with the smallest id; of several rows of that id the first by a digest of all columns. Each row goes by its own text: rows that share an id are numbered, and those unlike any other stay. Rows without an id, null texts and those without words stay as they are."""
    row, order, found_row = (free_name(docs, n) for n in ("__row", "__order", "__found"))
    named = docs.filter("doc_id is not null")
    clash = not named.groupBy("doc_id").count().filter("count > 1").isEmpty()
    number = F.monotonically_increasing_id() if clash else F.col("doc_id").cast("long")
    rows = docs.withColumn(row, F.when(F.col("doc_id").isNotNull(), number))
    if clash:
        # Numbers must stay the same from here on.
        rows = common.materialize(rows, "numbered")
    found = near_dup.near_duplicates(rows.filter(F.col(row).isNotNull()).select(row, "text"), id_col=row)
    if clash:
        digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])), 256)
        ordered = rows.filter(F.col(row).isNotNull()).select(F.col(row).alias(found_row), F.struct(F.col("doc_id"), digest.alias("d"), F.col(row).alias("r")).alias(order))
        held = common.materialize(found.join(ordered, F.col(row) == F.col(found_row)).select(row, "component_id", order), "held")
        first = held.groupBy("component_id").agg(F.min(order).alias("first"))
        gone = held.join(first, "component_id").filter(F.col(row) != F.col("first.r"))
    else:
        gone = found.filter("not kept")
    gone = gone.select(F.col(row).alias(found_row))
    return rows.join(gone, F.col(row) == F.col(found_row), "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; rows of no words, null texts among them, are in no mix. Rows equal in id, source and text are taken as the first of them by their other columns, as often as all together."""
    key, of, copies, times, rows, order = (free_name(docs, n) for n in ("__key", "__of", "__copies", "__times", "__rows", "__order"))
    by_key = mixing.mix(docs.select("doc_id", "text", "source")).groupBy("order", "source").agg(F.sum("copies").cast("int").alias(copies), F.count("*").alias(rows))
    taken = common.materialize(by_key.filter(F.col(copies) > 0).select(F.col("order").alias(key), F.col("source").alias(of), copies, rows), "copies")
    own = free_name(docs, "__own")
    keyed = docs.withColumn(own, mixing.order_key(mixing.SEED, F.col("doc_id"), F.col("text")))
    if not taken.filter(F.col(rows) > 1).isEmpty():
        columns = [F.col(f"`{c}`") for c in docs.columns]
        keyed = keyed.withColumn(order, F.to_json(F.struct(*columns))).groupBy(F.col(own), F.col("source").alias(of)).agg(F.min_by(F.struct(*columns), order).alias(times)).select(own, f"{times}.*")
    met = keyed.join(taken, (F.col(own) == F.col(key)) & F.col("source").eqNullSafe(F.col(of)))
    return met.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 2048 tokens; very long texts are several pieces, repeated rows have pieces of their own."""
    return packing.pack_documents(docs, common.tokenizer_path("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learnt models and tokenizers are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; all but the last one's rows go through the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
