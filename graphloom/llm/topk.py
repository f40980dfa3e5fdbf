"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into segments, at several resolutions; of each segment the mean and the deviation are kept. With equal
segments of n components, two vectors' squared distance is at least

    sum over segments of n * ((difference of means)**2 + (difference of deviations)**2)

which is the same as an upper bound on their inner product, sum of n * (mean * mean + deviation * deviation), since both
norms are known exactly. Vectors are first turned by one orthogonal map, which keeps inner products: the axes of greatest
spread of a bounded sample come first, so that where few directions hold most of the length, coarse segments already tell.
A query's candidates are bounded coarse to fine, up to segments of two components, against its k-th best exact score so
far, and only the survivors of the finest resolution get exact inner products. The first threshold comes from exact scores
against a bounded sample of candidates, and each task raises it by what it finds, so the result is exact whatever the data;
a bound only saves work. ``pruning`` reports how much.

Rows are packed into blocks of vectors where they lie. Each block of candidates meets each block of queries (a stated set
of queries against all rows, in blocks), gives at most k rows per query, and the best k of those are kept. Queries are sent
to all tasks, ``BROADCAST_BYTES`` of them at a time; each such batch is one scan of the vectors, which are never shuffled.

Components become floor(scale * x). Vectors that are null, empty, or hold null or non-finite components take no part, nor
do rows without an id. Vectors of other dimensions than the query's are no candidates. A query's own row, and any
repetition of its id, is not its candidate; rows equal in id and vector count once. Scores are exact integers, kept within
a long's range; ties go to the smaller id. An empty table gives no rows. Extra columns play no part, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import common

#: Vectors in a block of candidates, and in one of queries.
CANDIDATES, QUERIES = 8192, 1024
#: Most segments of the resolutions, coarse to fine; the finest has segments of two components.
COARSE = (4, 16)
#: Candidates that set the first thresholds, and the axes: a bounded sample, about.
SAMPLE = 4096
#: Bytes of queries that are sent to all tasks at a time.
BROADCAST_BYTES = 16 << 20
#: Sums below this are exact in doubles.
EXACT = float(1 << 53)
#: Share of pairs above which a block's bounds are made for all pairs at once.
DENSE = 0.25


def resolutions(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine."""
    finest = -(-dim // 2)
    return [s for s in COARSE if s < finest] + ([finest] if dim > 2 else [])


def segments(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of equal segments, each times the root of the segment's length; zeros fill the last segment."""
    n = -(-x.shape[1] // count)
    cut = np.pad(x, ((0, 0), (0, n * count - x.shape[1]))).reshape(len(x), count, n)
    mean = cut.mean(axis=2)
    return mean * np.sqrt(n), np.sqrt(((cut - mean[:, :, None]) ** 2).sum(axis=2))


def axes(sample: np.ndarray) -> np.ndarray:
    """An orthogonal map whose first columns are the directions of greatest spread."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1]


class Block:
    """Vectors of one dimension, with their statistics along the axes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, turn: np.ndarray | None = None):
        if len(np.unique(ids)) < len(ids):
            both = np.unique(np.concatenate([ids[:, None].view(np.float64), vectors], axis=1).view(np.int64), axis=0)
            ids, vectors = both[:, 0].copy(), both[:, 1:].copy().view(np.float64)
        self.ids, self.vectors = ids, vectors
        turned = vectors if turn is None else vectors @ turn
        self.levels = [np.concatenate(segments(turned, s), axis=1) for s in resolutions(vectors.shape[1])]
        self.norm = np.sqrt((vectors**2).sum(axis=1))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        kept = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return kept[np.lexsort((ids[kept], -scores[kept]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Thresholds:
    """By query of a block, the k best scores met so far. Rows that may be the same one count once, so the k-th of them is never too high."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = floor.copy(), k
        self.held: list[set[tuple[float, int]]] = [set() for _ in floor]

    def met(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        held = self.held[i] | set(zip(scores.tolist(), ids.tolist(), strict=True))
        if len(held) >= self.k:
            held = set(sorted(held, reverse=True)[: self.k])
            self.floor[i] = max(self.floor[i], min(held)[0])
        self.held[i] = held


def sample_floor(queries: Block, sample: Block, k: int) -> np.ndarray:
    """For each query the k-th best exact score in the sample, or nothing."""
    if len(sample.ids) < k:
        return np.full(len(queries.ids), -np.inf)
    scores = queries.vectors @ sample.vectors.T
    scores[queries.ids[:, None] == sample.ids[None, :]] = -np.inf
    # One that equals the query's id may have been among them, with several vectors even: they are at the low end.
    return np.partition(scores, -k, axis=1)[:, -k]


def search(queries: Block, rows: Block, k: int, known: Thresholds | None = None, counts: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the places and scores of its k best rows in the block, without those that cannot be among the k best of all. counts: gets the pairs, and those left after each resolution."""
    known = known or Thresholds(np.full(len(queries.ids), -np.inf), k)
    exact = queries.norm.max(initial=0) * rows.norm.max(initial=0) < EXACT
    if not exact:
        for q, vector in zip(queries.ids, queries.vectors, strict=True):
            # Long scores that do not fit are the nearest that do, and tie.
            scores = [max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(vector, v, strict=True)))) for v in rows.vectors]
            order = sorted(np.flatnonzero(rows.ids != q), key=lambda i: (-scores[i], rows.ids[i]))[:k]
            yield int(q), np.array(order, np.int64), np.array([scores[i] for i in order], np.int64)
        return
    counts = np.zeros(len(rows.levels) + 1, np.int64) if counts is None else counts
    least = known.floor - 1e-9 * queries.norm * rows.norm.max(initial=0)
    alive = np.broadcast_to(True, (len(queries.ids), len(rows.ids)))
    counts[0] += alive.size
    level = 0
    # While most pairs are left, a level's bounds are one product of matrices.
    while level < len(rows.levels) and (level == 0 or alive.mean() > DENSE):
        alive = alive & (queries.levels[level] @ rows.levels[level].T >= least[:, None])
        level += 1
        counts[level] += int(alive.sum())
    dense = queries.vectors @ rows.vectors.T if alive.mean() > DENSE else None
    for i, q in enumerate(queries.ids):
        left = np.flatnonzero(alive[i])
        for finer in range(level, len(rows.levels)):
            left = left[rows.levels[finer][left] @ queries.levels[finer][i] >= least[i]]
            counts[finer + 1] += len(left)
        left = left[rows.ids[left] != q]
        scores = dense[i, left] if dense is not None else rows.vectors[left] @ queries.vectors[i]
        # Products of whole numbers are whole, whatever order they are added in.
        high = scores >= known.floor[i]
        left, scores = left[high], scores[high]
        order = best(scores, rows.ids[left], k)
        known.met(i, scores[order], rows.ids[left[order]])
        yield int(q), left[order], scores[order].astype(np.int64)


def scaled_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): the vectors that take part, as floor(scale * x); equal rows once."""
    x = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return table.filter(sound).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * float(scale)).cast("double")).alias("v")).withColumn("dim", F.size("v"))


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """(dim, ids, data): vectors packed by task, as bytes; no shuffle."""
    schema = "dim int, ids binary, data binary"

    def pack(dim: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, data = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        return common.record_batch({"dim": pa.int32(), "ids": pa.binary(), "data": pa.binary()}, dim=[dim], ids=[ids.tobytes()], data=[data.tobytes()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in common.pieces(batches, rows):
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                own = held.setdefault(int(dim), [])
                own.append((part.column(0).to_numpy().astype(np.int64), part.column(1).flatten().to_numpy().reshape(-1, dim).astype(np.float64)))
                if sum(len(i) for i, _ in own) >= rows:
                    yield pack(int(dim), held.pop(int(dim)))
        for dim, own in held.items():
            yield pack(dim, own)

    return common.map_arrow(vectors.select("id", "v", "dim"), run, schema)


def unpack(ids: bytes, data: bytes, dim: int, turn: np.ndarray | None = None) -> Block:
    return Block(np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(-1, dim), turn)


class Questions:
    """What a batch of queries sends to tasks: blocks of queries, the axes of each dimension, the first thresholds."""

    def __init__(self, blocks: list[tuple[bytes, bytes, int]], sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
        self.blocks, self.k = blocks, k
        self.axes = {dim: axes(v) for dim, (_, v) in sample.items()}
        known = {dim: Block(i, v) for dim, (i, v) in sample.items()}
        self.floors = []
        for ids, data, dim in blocks:
            block = unpack(ids, data, dim)
            large = dim not in known or block.norm.max(initial=0) * known[dim].norm.max(initial=0) >= EXACT
            self.floors.append(np.full(len(block.ids), -np.inf) if large else sample_floor(block, known[dim], k))

    def open(self) -> list[tuple[Block, Thresholds]]:
        found = []
        for (ids, data, dim), floor in zip(self.blocks, self.floors, strict=True):
            block = unpack(ids, data, dim, self.axes.get(dim))
            found.append((block, Thresholds(floor if len(floor) == len(block.ids) else np.full(len(block.ids), -np.inf), self.k)))
        return found


def answers(queries: list[tuple[Block, Thresholds]], rows: Block, k: int) -> Iterator[pa.RecordBatch]:
    out = {"query_id": pa.int64(), "id": pa.int64(), "score": pa.int64(), "mark": pa.int64()}
    for block, known in queries:
        if block.vectors.shape[1] == rows.vectors.shape[1]:
            found = list(search(block, rows, k, known))
            at = np.concatenate([i for _, i, _ in found])
            marks = [zlib.crc32(rows.vectors[i].tobytes()) for i in at]
            yield common.record_batch(out, query_id=np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]), id=rows.ids[at], score=np.concatenate([s for _, _, s in found]), mark=marks)


def sampled(vectors: DataFrame, size: int = SAMPLE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension, ids and vectors of a seeded sample of about size rows."""
    total = vectors.count()
    chosen = vectors.filter(common.hash_fraction(4, F.col("id")) < min(1.0, size / max(1, total))).limit(2 * size).collect()
    chosen.sort(key=lambda r: (r["id"], r["v"]))
    found: dict[int, list] = {}
    for r in chosen:
        found.setdefault(r["dim"], []).append(r)
    return {dim: (np.array([r["id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.float64)) for dim, rows in found.items()}


def _batches(table: DataFrame, is_query: Column, k: int, scale: int, id_col: str, vector_col: str, broadcast_bytes: int) -> Iterator[tuple[DataFrame, object]]:
    """Blocks of all vectors, and what is sent of each batch of queries."""
    spark = table.sparkSession
    vectors = scaled_vectors(table, id_col, vector_col, scale)
    wanted = common.materialize(scaled_vectors(table.filter(is_query), id_col, vector_col, scale).dropDuplicates(["id", "v"]), "queries")
    count, size = wanted.agg(F.count("*"), F.coalesce(F.sum("dim") * 8, F.lit(0))).first()
    if not count:
        return
    sample = sampled(vectors)
    parts = min(count, max(1, -(-size // broadcast_bytes)))
    rows = blocks(vectors, CANDIDATES)
    if parts > 1:
        rows = common.materialize(rows, "blocks")
    for part in range(parts):
        own = wanted if parts == 1 else wanted.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        asked = blocks(own.repartition(max(1, -(-count // (QUERIES * parts)))), QUERIES)
        yield rows, spark.sparkContext.broadcast(Questions([(bytes(r["ids"]), bytes(r["data"]), r["dim"]) for r in asked.collect()], sample, k))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"), F.col("mark"))
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(table: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, rank, id, score): each query row's k best other rows by integer inner product, ties to the smaller id."""
    schema, ranked = "query_id long, id long, score long, mark long", None
    for rows, sent in _batches(table, is_query, k, scale, id_col, vector_col, broadcast_bytes):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries = sent.value.open()
            for batch in batches:
                for row in batch.to_pylist():
                    yield from answers(queries, unpack(row["ids"], row["data"], row["dim"], sent.value.axes.get(row["dim"])), k)

        part = _ranked(common.map_arrow(rows, run, schema), k)
        # The few answers of a batch are kept, and its queries can go from the tasks.
        ranked = common.materialize(part, "answers") if ranked is None else ranked.unionByName(common.materialize(part, "answers"))
        sent.unpersist()
    if ranked is None:
        ranked = _ranked(table.sparkSession.createDataFrame([], schema), k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def pruning(table: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", broadcast_bytes: int = BROADCAST_BYTES) -> list[tuple[int, int]]:
    """(segments, pairs left) by resolution, from coarse to fine, after all pairs as (0, pairs): what a search of vectors of one dimension would bound and score."""
    total: dict[int, int] = {}
    for rows, sent in _batches(table, is_query, k, scale, id_col, vector_col, broadcast_bytes):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries = sent.value.open()
            for batch in batches:
                for row in batch.to_pylist():
                    block = unpack(row["ids"], row["data"], row["dim"], sent.value.axes.get(row["dim"]))
                    counts = np.zeros(len(block.levels) + 1, np.int64)
                    for asked, known in queries:
                        if asked.vectors.shape[1] == row["dim"]:
                            for _ in search(asked, block, k, known, counts):
                                pass
                    yield common.record_batch({"level": pa.int32(), "pairs": pa.int64()}, level=[0, *resolutions(row["dim"])], pairs=counts)

        for r in common.map_arrow(rows, run, "level int, pairs long").groupBy("level").agg(F.sum("pairs").alias("pairs")).collect():
            total[r["level"]] = total.get(r["level"], 0) + r["pairs"]
        sent.unpersist()
    return sorted(total.items())
