"""Nearest neighbours: exact scans, 8-bit scans, an inverted-file index, and the similarity join."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import vectors as vx
from graphloom.sources.shared import cut

#: Vectors from which an index pays.
INDEX_FROM = 10_000
#: Bytes of the vectors of a block of the similarity join.
BLOCK_BYTES = 8 << 20

METRICS = {"cosine": vx.cosine_distance, "l2": vx.l2_distance, "dot": lambda a, b: -vx.dot(a, b)}


def nearest(table: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", vector_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k rows nearest to query, with distance, ties by id. Rows of other dimensions or without a vector take no part."""
    rows = table if where is None else table.filter(where)
    rows = rows.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) == len(query)))
    distance = F.round(METRICS[metric](F.col(vector_col), vx.vector(query)), 9)
    return rows.withColumn("distance", distance).orderBy("distance", "id").limit(k)


def stored_search(table: DataFrame, kb: str, query: Sequence[float], limit: int = 20, relations: bool = False) -> DataFrame:
    """Best rows by similarity among an own knowledge base's vectors; of relations only those that still hold."""
    where = F.col("kb_id") == kb
    if relations:
        where = where & F.col("invalid_at").isNull()
    return nearest(table, query, limit if limit > 0 else 20, where=where).withColumn("score", 1 - F.col("distance"))


def quantized(table: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The table with a column quantized; the vectors themselves can then stay on disk."""
    return table.filter(F.col(vector_col).isNotNull()).withColumn("quantized", vx.quantize(F.col(vector_col)))


def nearest_quantized(table: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """nearest() over a column quantized, by cosine."""
    rows = table.filter(F.size("quantized.data") == len(query))
    distance = F.round(vx.quantized_cosine_distance(F.col("quantized"), vx.vector(query)), 9)
    return rows.withColumn("distance", distance).orderBy("distance", "id").limit(k)


class InvertedFile:
    """Vectors by their nearest of a few centres; a search reads the cells that can hold one of the nearest.

    Centres come from a bounded sample (``SAMPLE`` vectors, seeded); every vector is indexed. radii: by cell, the largest
    angle between the centre and a vector of the cell; a vector is no nearer to the query than the centre's angle less the
    radius, so a search without a number of probes is exact, however many cells there are.

    ``insert`` and ``remove`` give new indexes; ``save`` keeps one as Parquet partitioned by cell, of which a search of the
    ``load``-ed index reads only the cells it needs. Rows are known by kb_id and id.
    """

    SAMPLE = 20_000
    #: Cells that are read for a first distance, which the bounds of the others are held against.
    FIRST = 8

    def __init__(self, centres: np.ndarray, cells: DataFrame, radii: np.ndarray):
        self.centres, self.cells, self.radii = centres, cells, radii

    @staticmethod
    def _usable(table: DataFrame, dim: int | None = None) -> DataFrame:
        size = F.size("embedding")
        return table.filter(F.col("embedding").isNotNull() & (size > 0 if dim is None else size == dim)).select("id", "kb_id", "embedding")

    @staticmethod
    def build(table: DataFrame, n_cells: int | None = None, seed: int = 7, rounds: int = 8) -> InvertedFile:
        rows = InvertedFile._usable(table)
        count = rows.count()
        n_cells = n_cells or max(1, int(np.sqrt(max(1, count))))
        chosen = rows.filter(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, count // InvertedFile.SAMPLE))) == 0).limit(2 * InvertedFile.SAMPLE)
        held = [r["embedding"] for r in chosen.select("embedding").collect()]
        dim = len(held[0]) if held else 1
        if any(len(v) != dim for v in held):
            raise ValueError("an index holds vectors of one dimension; build one for each")
        sample = np.array(held, np.float64).reshape(-1, dim)
        sample /= np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-30)
        random = np.random.default_rng(seed)
        centres = sample[random.permutation(len(sample))[:n_cells]]
        for _ in range(rounds if len(sample) else 0):
            nearest_cell = (sample @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest_cell, sample)
            full = np.linalg.norm(sums, axis=1) > 0
            centres[full] = sums[full] / np.linalg.norm(sums[full], axis=1, keepdims=True)
        return InvertedFile._assigned(centres, rows, np.zeros(len(centres)))

    @staticmethod
    def _assigned(centres: np.ndarray, rows: DataFrame, radii: np.ndarray) -> InvertedFile:
        """An index of rows; radii are the least that its cells have."""

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    v = np.stack(batch["embedding"].to_numpy()).astype(float)
                    products, lengths = v @ centres.T, np.linalg.norm(v, axis=1)
                    # A vector without a direction may be anywhere.
                    cosine = np.divide(products.max(axis=1), lengths, out=np.full(len(v), -1.0), where=lengths > 0)
                    yield batch.assign(cell=products.argmax(axis=1).astype("int32"), cosine=cosine)

        cells = cut(rows.mapInPandas(assign, "id string, kb_id string, embedding array<float>, cell int, cosine double"), "cells")
        radii = radii.copy()
        for r in cells.groupBy("cell").agg(F.min("cosine").alias("least")).collect():
            radii[r["cell"]] = max(radii[r["cell"]], np.arccos(np.clip(r["least"], -1, 1)))
        return InvertedFile(centres, cells.drop("cosine"), radii)

    def insert(self, rows: DataFrame) -> InvertedFile:
        """The index with more rows; a row that it holds already gets its new vector, and its new cell. The centres stay."""
        fresh = InvertedFile._usable(rows, self.centres.shape[1])
        added = InvertedFile._assigned(self.centres, fresh, self.radii)
        kept = self.cells.join(added.cells.select("kb_id", "id"), ["kb_id", "id"], "left_anti").select(*self.cells.columns)
        return InvertedFile(self.centres, kept.unionByName(added.cells), added.radii)

    def remove(self, gone: DataFrame) -> InvertedFile:
        """The index without the rows that gone names by kb_id and id. Radii may then be larger than need be, which only reads more."""
        return InvertedFile(self.centres, self.cells.join(gone.select("kb_id", "id"), ["kb_id", "id"], "left_anti").select(*self.cells.columns), self.radii)

    def drop(self, kb: str) -> InvertedFile:
        return InvertedFile(self.centres, self.cells.filter(F.col("kb_id") != kb), self.radii)

    def get(self, kb: str, row_id: str) -> DataFrame:
        return self.cells.filter((F.col("kb_id") == kb) & (F.col("id") == row_id))

    def has(self, kb: str, row_id: str) -> bool:
        return not self.get(kb, row_id).isEmpty()

    def count(self, kb: str | None = None) -> int:
        return (self.cells if kb is None else self.cells.filter(F.col("kb_id") == kb)).count()

    def save(self, folder: str) -> None:
        """Writes vectors by cell, and centres with their radii."""
        self.cells.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/cells")
        rows = [(i, c.tolist(), float(r)) for i, (c, r) in enumerate(zip(self.centres, self.radii, strict=True))]
        self.cells.sparkSession.createDataFrame(rows, "cell int, centre array<double>, radius double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> InvertedFile:
        rows = spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()
        cells = spark.read.schema("id string, kb_id string, embedding array<float>, cell int").parquet(f"{folder}/cells")
        return InvertedFile(np.array([r["centre"] for r in rows], np.float64).reshape(len(rows), -1), cells, np.array([r["radius"] for r in rows]))

    def _in(self, cells: Sequence[int]) -> DataFrame:
        return self.cells.filter(F.col("cell").isin([int(c) for c in cells]))

    def to_read(self, query: Sequence[float], k: int) -> list[int]:
        """The cells that can hold one of the k rows nearest to query."""
        q = np.asarray(query, float)
        length = np.linalg.norm(q)
        cosine = self.centres @ q / (length or 1)
        order = np.argsort(-cosine, kind="stable")
        found = nearest(self._in(order[: self.FIRST]), query, k).agg(F.count("*").alias("n"), F.max("distance").alias("far")).first()
        if not length or not found["n"] or found["n"] < k:
            return [int(c) for c in order]
        least = 1 - np.cos(np.maximum(0, np.arccos(np.clip(cosine, -1, 1)) - self.radii))
        return [int(c) for c in order if least[c] <= found["far"] + 1e-6]

    def search(self, query: Sequence[float], k: int, probes: int | None = None) -> DataFrame:
        """The k rows nearest to query; with probes, of that many nearest cells only."""
        if probes is None:
            cells = self.to_read(query, k)
            return nearest(self._in(cells) if len(cells) < len(self.centres) else self.cells, query, k)
        order = np.argsort(-(self.centres @ np.asarray(query, float)), kind="stable")[:probes]
        return nearest(self._in(order), query, k)


def nearest_adaptive(table: DataFrame, query: Sequence[float], k: int, index: InvertedFile | None = None) -> DataFrame:
    """An exact scan of few vectors; from ``INDEX_FROM`` on the index, if there is one. Both are exact: the choice is one of cost."""
    if index is None or table.filter(F.col("embedding").isNotNull()).limit(INDEX_FROM).count() < INDEX_FROM:
        return nearest(table, query, k)
    return index.search(query, k)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows (dim, id, v) packed where they lie: (dim, ids, data), with up to size vectors of a dimension."""

    def make(dim: int, part: list[tuple[list, np.ndarray]]) -> pd.DataFrame:
        return pd.DataFrame({"dim": [dim], "ids": [[i for ids, _ in part for i in ids]], "data": [np.concatenate([v.ravel() for _, v in part]).astype(np.float64).tobytes()]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[list, np.ndarray]]] = {}
        for batch in batches:
            for at in range(0, len(batch), size):
                for dim, rows_of in batch[at : at + size].groupby("dim"):
                    own = held.setdefault(int(dim), [])
                    own.append((rows_of["id"].tolist(), np.stack(rows_of["v"].to_numpy()).astype(np.float64)))
                    if sum(len(ids) for ids, _ in own) >= size:
                        yield make(int(dim), held.pop(int(dim)))
        for dim, own in held.items():
            yield make(dim, own)

    return rows.mapInPandas(pack, "dim int, ids array<string>, data binary")


def similar_pairs(table: DataFrame, least: float, most: int | None = None, id_col: str = "id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs of vectors of one dimension with at least a cosine similarity; the first ``most`` in order of ids if given. Zero vectors are like nothing.

    Vectors are packed into blocks and each pair of blocks of a dimension meets once: block n goes to the half of the
    others that follow it in a ring, so all blocks travel equally often, and a task sees two blocks and emits only the
    similar pairs. The answer is exact, and the work is that of all pairs; larger blocks make the shuffle smaller.
    """
    v = F.col(vector_col)
    rows = table.filter(v.isNotNull() & (F.size(v) > 0)).select(F.size(v).alias("dim"), F.col(id_col).cast("string").alias("id"), v.alias("v"))
    about = rows.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    # At least a few blocks, so that all tasks have work, and none larger than block_bytes.
    size = max(1, min(block_bytes // (8 * max(1, about["dim"] or 1)), max(64, -(-about["n"] // 16))))
    blocks = cut(_blocks(rows.repartition(max(1, -(-about["n"] // size))), size).withColumn("at", F.monotonically_increasing_id()), "blocks")
    order = Window.partitionBy("dim").orderBy("at")
    # A row per block, without its vectors.
    numbered = cut(blocks.select("dim", "at").withColumns({"n": F.row_number().over(order) - 1, "of": F.count("*").over(Window.partitionBy("dim"))}), "numbers")
    half = F.floor(F.col("of") / 2)
    # Where the ring is even, two opposite blocks meet from one side only.
    far = F.when((F.col("of") % 2 == 0) & (F.col("n") >= half), half - 1).otherwise(half)
    left = blocks.join(numbered, ["dim", "at"]).withColumn("m", F.explode(F.transform(F.sequence(F.lit(0), far), lambda k: (F.col("n") + k) % F.col("of"))))
    right = blocks.join(numbered, ["dim", "at"]).select("dim", F.col("n").alias("m"), F.col("ids").alias("ids2"), F.col("data").alias("data2"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                a, b = (np.frombuffer(x, np.float64).reshape(len(i), -1) for x, i in ((r.data, r.ids), (r.data2, r.ids2)))
                long_a, long_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
                one, two = np.asarray(r.ids, object), np.asarray(r.ids2, object)
                for at in range(0, len(a), 1024):
                    lengths = np.outer(long_a[at : at + 1024], long_b)
                    found = np.divide(a[at : at + 1024] @ b.T, lengths, out=np.zeros_like(lengths), where=lengths > 0)
                    i, j = np.nonzero((found >= least - 1e-9) & (lengths > 0))
                    similarity = found[i, j].round(9)
                    i += at
                    if r.n == r.m:
                        i, j, similarity = i[i < j], j[i < j], similarity[i < j]
                    first, second = one[i], two[j]
                    swap = first > second
                    yield pd.DataFrame({"a": np.where(swap, second, first), "b": np.where(swap, first, second), "similarity": similarity})

    met = left.join(right, ["dim", "m"]).select("n", "m", "ids", "data", "ids2", "data2")
    pairs = met.mapInPandas(compare, "a string, b string, similarity double").filter((F.col("similarity") >= least) & (F.col("a") != F.col("b")))
    return pairs if most is None else pairs.orderBy("a", "b").limit(most)
