"""Packs token sequences into fixed-length training sequences: bounded-space online best fit.

Texts become ids (see ``encode``) with an end id; only those longer than a sequence are cut, into full pieces and a
rest. The pieces are dealt by a stored random number into groups of a bounded number of pieces, and each group is packed
as a stream, in the order of those numbers. The packer has a fixed number of open bins, in a bitset keyed by free space: a
piece goes to the bin that it fills best, and if none fits, a new bin opens, for which the fullest open one closes.

Null text is empty: one piece with only the end id. A very long text is many full pieces, each a bin of its own, and a
rest. Repeated rows are packed each on its own; of bins with equal space the last one opened is taken. An empty table gives
no rows. Extra columns play no part, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import common
from graphloom.llm.encode import ENCODED_ROWS, Encoder

#: Pieces of a group, about; a group is one task's work.
GROUP_PIECES = 65_536
#: Bins that a packer keeps open.
OPEN_BINS = 512

_kept: dict = {}


class BestFit:
    """Bounded-space online best fit. Bins are numbered in the order in which they open."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.free = 0  # bit f: some open bin has f free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.opened = 0

    def _take(self, space: int) -> int:
        held = self.bins[space]
        number = held.pop()
        if not held:
            self.free ^= 1 << space
        self.n_open -= 1
        return number

    def put(self, length: int) -> tuple[int, int]:
        """The bin that takes a piece of 1 to capacity tokens, and the place in it."""
        if fits := self.free >> length:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.capacity, self.opened
            self.opened += 1
        if left := space - length:
            if self.n_open >= self.most:
                # The fullest closes first: it may be this bin.
                fullest = (self.free & -self.free).bit_length() - 1
                if left <= fullest:
                    return number, self.capacity - space
                self._take(fullest)
            self.bins[left].append(number)
            self.free |= 1 << left
            self.n_open += 1
        return number, self.capacity - space


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, and salt, which spreads pieces over groups."""
    out = {"id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "salt": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = common.worker_cache(_kept, tokenizer, lambda: Encoder(tokenizer))
        end = np.array([end_id], encoder.dtype).tobytes()
        random = np.random.default_rng(TaskContext.get().partitionId())
        for batch in common.pieces(batches, ENCODED_ROWS):
            rows = []
            for doc_id, found in zip(batch.column(0).to_pylist(), encoder.encode_all(common.column_bytes(batch.column(1))), strict=True):
                ids = np.frombuffer(found + end, encoder.dtype).astype("<u4")
                rows += [(doc_id, k, at, len(part := ids[at : at + capacity]), zlib.crc32(part.tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield common.record_batch(out, **dict(zip(out, columns, strict=False)), salt=random.integers(0, 1 << 62, len(rows)))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return common.map_arrow(rows, run, "id long, piece int, start long, length long, ids_crc32 long, salt long")


def pack(pieces: DataFrame, capacity: int, open_bins: int = OPEN_BINS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to materialized pieces (columns id, piece, start, length, ids_crc32, salt)."""
    groups = max(1, -(-pieces.count() // group_pieces))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("salt").to_numpy(zero_copy_only=False), kind="stable")
        group = group.take(pa.array(order))
        packer = BestFit(capacity, open_bins)
        placed = [packer.put(n) for n in group.column("length").to_pylist()]
        first = key[0].as_py() << 40
        return pa.table({k: group.column(k) for k in ("id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": pa.array([first + b for b, _ in placed], pa.int64()), "offset": pa.array([at for _, at in placed], pa.int64())})

    common.prepare(pieces.sparkSession)
    dealt = pieces.withColumn("g", F.col("salt") % groups).groupBy("g")
    return dealt.applyInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for all documents. Only these small rows are shuffled, never texts."""
    pieces = common.materialize(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    return pack(pieces, capacity, open_bins).withColumnRenamed("id", id_col)
