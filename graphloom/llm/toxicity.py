"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and their beginnings, hashed into a fixed number of buckets. The machine's logit is

    w0 + sum_i w_i x_i + sum_(i<j) <v_i, v_j> x_i x_j

so besides a weight for each term it learns a weight for each pair, as the product of two short vectors: an insult next
to a group's name can count for more than both alone. The pair sum is computed in time linear in the terms.

Training takes a bounded sample of the labelled rows: about ``sample_rows`` rows that come first in a seeded order, whole
texts. Tasks hash their terms and count them by label. From the sums the driver picks the terms that the machine may use:
those whose presence goes with the label by itself (``LEAST_G``), and those that do so in pairs, much more than either
alone (``PAIR_G``), among the ``PAIR_TERMS`` terms that part the sample best in two. Only the picked and these terms of a
row come to the driver, so what it holds is bounded whatever the length of texts. It fits by AdaGrad on the log loss, so
that scores are probabilities. Labels that contradict each other for one id count as the highest; null labels are not
learnt from.

Null and empty texts have no terms; their score is that of the bias. With no labelled rows, or one class alone, scores
are 0. Repeated rows are scored each; an empty table gives no rows. A very long text is a set of terms like others. Only
ids and texts enter a score; extra columns are kept, and those named like the two results are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import common

BUCKET_BITS = 18
FACTORS = 4
#: Labelled rows that are learnt from, about; a bound on what comes to the driver.
SAMPLE_ROWS = 12_000
EPOCHS = 6
#: Least likelihood-ratio statistic of a term that the machine may use for itself, and by how much a pair's must exceed those of its terms.
LEAST_G, PAIR_G = 16.0, 40.0
#: Terms whose pairs are looked at.
PAIR_TERMS = 1024
#: Letters of a word's beginnings that are terms of their own.
STEMS = (4, 5)
#: Words whose terms a worker remembers before it starts anew.
REMEMBERED = 300_000
THRESHOLD = 0.3

_word = re.compile(rb"[a-z0-9\x80-\xff]+").findall
_kept: dict = {}


class Terms(dict):
    """Word to its buckets; remembered by each worker."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        mask = (1 << BUCKET_BITS) - 1
        found = (zlib.crc32(word) & mask, *(zlib.crc32(word[:n] + b"*") & mask for n in STEMS if len(word) > n))
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 40:
            self[word] = found
        return found

    def of(self, text: bytes) -> np.ndarray:
        """The distinct buckets of a text's terms, ascending."""
        held: set[int] = set()
        for word in set(_word(text.lower())):
            held.update(self[word])
        return np.sort(np.fromiter(held, np.int32, len(held)))


def statistic(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """The likelihood-ratio statistic of presence and label, from how often something is there with either label."""
    share = (toxic + clean) / (n_toxic + n_clean)
    g = np.zeros(share.shape)
    for seen, of in ((toxic, n_toxic), (clean, n_clean)):
        for observed, expected in ((seen, of * share), (of - seen, of * (1 - share))):
            g += 2 * np.where(observed > 0, observed * np.log(np.maximum(observed, 1) / np.maximum(expected, 1e-12)), 0)
    return g


def associated(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """The buckets whose presence goes with the label; others are, by themselves, noise that a machine would learn by heart."""
    return np.flatnonzero(statistic(toxic, clean, n_toxic, n_clean) >= LEAST_G)


def parting(toxic: np.ndarray, clean: np.ndarray, n_rows: int, most: int = PAIR_TERMS) -> np.ndarray:
    """The buckets that part the rows most evenly into those with and without them, at most so many."""
    seen = toxic + clean
    evenness = np.minimum(seen, n_rows - seen)
    order = np.lexsort((np.arange(len(seen)), -evenness))[:most]
    return np.sort(order[evenness[order] > 0])


def paired(rows: list[np.ndarray], labels: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """The buckets, of those given, with a pair whose joint presence goes with the label much more than either alone does."""
    place = np.full(1 << BUCKET_BITS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))
    both = np.zeros((2, len(buckets), len(buckets)))
    for kind in (0, 1):
        own = [rows[i] for i in np.flatnonzero(labels == kind)]
        for at in range(0, len(own), 1000):
            there = np.zeros((len(own[at : at + 1000]), len(buckets)), np.float32)
            for i, r in enumerate(own[at : at + 1000]):
                found = place[r]
                there[i, found[found >= 0]] = 1
            both[kind] += there.T @ there
    n_toxic = int(labels.sum())
    alone = statistic(np.diag(both[1]), np.diag(both[0]), n_toxic, len(labels) - n_toxic)
    g = statistic(both[1], both[0], n_toxic, len(labels) - n_toxic)
    i, j = np.nonzero(np.triu(g >= PAIR_G + np.maximum(alone[:, None], alone[None, :]), 1))
    return buckets[np.union1d(i, j)]


class Machine:
    """A factorization machine over the buckets that training chose; x_i is 1 for a term that is there."""

    def __init__(self, buckets: np.ndarray, factors: int = FACTORS, seed: int = 3):
        self.index = np.full(1 << BUCKET_BITS, -1, np.int32)
        self.index[buckets] = np.arange(len(buckets))
        self.w0 = 0.0
        self.w = np.zeros(len(buckets))
        self.v = np.random.default_rng(seed).normal(0, 0.02, (len(buckets), factors))

    def known(self, terms: np.ndarray) -> np.ndarray:
        found = self.index[terms]
        return found[found >= 0]

    def logit(self, known: np.ndarray) -> float:
        v = self.v[known]
        total = v.sum(axis=0)
        return float(self.w0 + self.w[known].sum() + 0.5 * (total @ total - np.vdot(v, v)))

    def score(self, terms: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-min(60.0, max(-60.0, self.logit(self.known(terms)))))))

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-5, seed: int = 3) -> Machine:
        """AdaGrad on the log loss, row by row in seeded orders."""
        random = np.random.default_rng(seed)
        rows = [self.known(r) for r in rows]
        share = labels.mean()
        self.w0 = float(np.log(share / (1 - share)))
        past_w, past_v, past_0 = np.full(self.w.shape, 1e-2), np.full(self.v.shape, 1e-1), 1.0
        for _ in range(epochs):
            for i in random.permutation(len(rows)):
                terms = rows[i]
                v = self.v[terms]
                total = v.sum(axis=0)
                z = self.w0 + self.w[terms].sum() + 0.5 * (total @ total - np.vdot(v, v))
                error = 1 / (1 + np.exp(-min(30.0, max(-30.0, z)))) - labels[i]
                past_0 += error * error
                self.w0 -= rate * error / np.sqrt(past_0)
                if not len(terms) or abs(error) < 1e-4:
                    continue
                past_w[terms] += error * error
                self.w[terms] -= rate * (error + decay * self.w[terms]) / np.sqrt(past_w[terms])
                # Scaled by the number of terms, so that long texts do not drown the others.
                step = error * (total - v) / max(1.0, np.sqrt(len(terms)))
                past_v[terms] += step * step
                self.v[terms] -= 0.3 * rate * (step + decay * v) / np.sqrt(past_v[terms])
        return self


def hashed_terms(rows: DataFrame) -> DataFrame:
    """rows (id, label, text) to (id, label, terms)."""
    out = {"id": pa.int64(), "label": pa.int32(), "terms": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = common.worker_cache(_kept, "terms", Terms)
        for batch in common.pieces(batches):
            yield common.record_batch(out, id=batch.column(0), label=batch.column(1), terms=[terms.of(t).tobytes() for t in common.column_bytes(batch.column(2))])

    return common.map_arrow(rows, run, "id long, label int, terms binary")


def label_counts(rows: DataFrame) -> DataFrame:
    """rows (id, label, terms) to (bucket, toxic, clean): in how many rows of either label a bucket is."""
    out = {"bucket": pa.int32(), "toxic": pa.int64(), "clean": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            for label, terms in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seen[label, np.frombuffer(terms, np.int32)] += 1
        there = np.flatnonzero(seen.sum(axis=0))
        yield common.record_batch(out, bucket=there, toxic=seen[1, there], clean=seen[0, there])

    return common.map_arrow(rows, run, "bucket int, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def narrowed(rows: DataFrame, buckets: np.ndarray) -> DataFrame:
    """rows (id, label, terms) with the given terms only."""
    sent = rows.sparkSession.sparkContext.broadcast(buckets)
    out = {"id": pa.int64(), "label": pa.int32(), "terms": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << BUCKET_BITS, bool)
        wanted[sent.value] = True
        for batch in batches:
            terms = [np.frombuffer(t, np.int32) for t in batch.column(2).to_pylist()]
            yield common.record_batch(out, id=batch.column(0), label=batch.column(1), terms=[t[wanted[t]].tobytes() for t in terms])

    return common.map_arrow(rows, run, "id long, label int, terms binary")


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> Machine | None:
    """A machine fitted on labelled rows for which may_learn (over id_col) holds; None if there are not two classes."""
    usable = labels.filter(F.col(label_col).isNotNull() & may_learn)
    total = usable.count()
    if not total:
        return None
    # The sample's ids are as many as sample_rows, about: small enough to send to the scans.
    chosen = usable.filter(common.hash_fraction(seed, F.col(id_col)) < min(1.0, sample_rows / total)).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    sample = common.materialize(hashed_terms(texts.join(F.broadcast(chosen), "id").select("id", "label", "text")), "terms")
    classes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:
        return None
    toxic, clean = np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(1 << BUCKET_BITS, np.int64)
    for r in label_counts(sample).collect():
        toxic[r["bucket"]], clean[r["bucket"]] = r["toxic"], r["clean"]
    by_itself = associated(toxic, clean, classes[1], classes[0])
    looked_at = parting(toxic, clean, classes[0] + classes[1])
    found = narrowed(sample, np.union1d(by_itself, looked_at)).collect()
    found.sort(key=lambda r: (r["id"], bytes(r["terms"])))
    rows, target = [np.frombuffer(bytes(r["terms"]), np.int32) for r in found], np.array([r["label"] for r in found], np.float64)
    return Machine(np.union1d(by_itself, paired(rows, target, looked_at))).fit(rows, target)


def score_toxicity(docs: DataFrame, model: Machine | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """The columns of docs, and score and predicted, which replace columns of these names. A narrow map; the model's size is fixed by its buckets."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(score_col, predicted_col)
    rows = docs.select(F.col(text_col).alias("__text_to_score"), *kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = common.worker_cache(_kept, "terms", Terms)
        machine = sent.value
        for batch in common.pieces(batches):
            scores = [machine.score(terms.of(t)) if machine else 0.0 for t in common.column_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], names=[*batch.schema.names[1:], score_col])

    schema = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes)
    scored = common.map_arrow(rows, run, f"{schema}, `{score_col}` double")
    return scored.withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int"))
