"""The registered queries of this folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common, lang_id, lm, media, mixing, near_dup, packing, token_count, token_files, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return token_count.token_counts(docs, common.tokenizer_path("byte_bpe_50k.json"), limit=1024)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels, common.learnable(F.col("doc_id"), 4, 2))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", common.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def op3_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score_texts(docs, common.learnable(F.col("doc_id"), 7, 2), common.held_out(F.col("doc_id"), 7, 2))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    folder = common.fresh(spark, "token-files")
    parts = token_files.write_token_files(docs, folder, common.tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_files.read_token_files(spark, folder, parts)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(common.table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = lang_id.train(docs, common.learnable(F.col("doc_id"), 3, 1))
    found = lang_id.identify(docs, model)
    return found.select("doc_id", common.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return media.media_digest(common.materialize(media.text_media(docs), "media"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, common.tokenizer_path("word_bpe_49k.json"), end_id=0, capacity=2048)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_token_counts, op2_toxicity, op3_hidden_markov, op4_top_k, op5_token_files, op6_mix_sources, op7_near_duplicates, op8_language, op9_media, op10_best_fit, pipeline)
}
