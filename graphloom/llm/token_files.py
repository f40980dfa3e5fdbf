"""Token ids as flat binary files.

Documents are range-partitioned by id, so that files in part order hold them in ascending order, and become ids there: texts
as Spark compresses them are smaller than the same texts' ids, so it is texts that travel. Each part is flat little-endian files in the shared folder: ``ids`` (unsigned 16 bits, or 32
where the vocabulary needs them), ``offsets`` (unsigned 64 bits, one more than documents, from 0 within the part) and
``docs`` (signed 64-bit document ids, with a byte map of null ids in ``nulls``). A part's base in the whole sequence is the
prefix sum of the parts before it. Readers memory-map the files, or a copy of them where the folder is in an object store
or a distributed file system.

A task writes under a name of its own attempt and renames when done: a part that is computed again is the same and
replaces itself. Null text is empty: only the end id. A very long text is a long row like others. Rows that share an id are
all kept, ordered by text. An empty table gives no rows. Extra columns play no part, whatever their names.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common
from graphloom.llm.encode import ENCODED_ROWS, Encoder

_kept: dict = {}
#: A part's files.
KINDS = ("ids", "offsets", "docs", "nulls")
#: Documents' rows that a reader sends on at once.
READ_ROWS = 4096


def part_path(folder: str, part: int, kind: str) -> str:
    return f"{folder}/part-{part:06d}.{kind}"


class PartWriter:
    """Appends documents to one part; close() puts the files in place."""

    def __init__(self, folder: str, part: int, dtype: np.dtype, end_id: int):
        self.files_at, self.folder = fs.FileSystem.from_uri(folder)
        self.files_at.create_dir(self.folder, recursive=True)
        self.part, self.mark, self.end = part, uuid.uuid4().hex, np.array([end_id], dtype).tobytes()
        self.width, self.rows, self.total = dtype.itemsize, 0, 0
        self.files = {kind: self.files_at.open_output_stream(self.path(kind)) for kind in KINDS}
        self.files["offsets"].write(np.zeros(1, "<u8").tobytes())

    def path(self, kind: str) -> str:
        return f"{part_path(self.folder, self.part, kind)}.{self.mark}"

    def add(self, doc_ids: list[int | None], ids: list[bytes]) -> None:
        ids = [x + self.end for x in ids]
        ends = self.total + np.cumsum([len(x) // self.width for x in ids], dtype=np.uint64)
        self.files["ids"].write(b"".join(ids))
        self.files["offsets"].write(ends.astype("<u8").tobytes())
        self.files["docs"].write(np.array([x or 0 for x in doc_ids], "<i8").tobytes())
        self.files["nulls"].write(bytes(x is None for x in doc_ids))
        self.rows, self.total = self.rows + len(ids), int(ends[-1]) if ids else self.total

    def close(self) -> None:
        for kind, f in self.files.items():
            f.close()
            self.files_at.move(self.path(kind), part_path(self.folder, self.part, kind))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Writes the files; returns a row per part in order: part, n_docs, n_tokens, base, dtype. As many rows as partitions."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    out = {"part": pa.int32(), "n_docs": pa.int64(), "n_tokens": pa.int64(), "dtype": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = common.worker_cache(_kept, tokenizer, lambda: Encoder(tokenizer))
        writer = None
        for batch in common.pieces(batches, ENCODED_ROWS):
            if batch.num_rows:
                writer = writer or PartWriter(folder, TaskContext.get().partitionId(), encoder.dtype, end_id)
                writer.add(batch.column(0).to_pylist(), encoder.encode_all(common.column_bytes(batch.column(1))))
        if writer:
            writer.close()
            yield common.record_batch(out, part=[writer.part], n_docs=[writer.rows], n_tokens=[writer.total], dtype=[encoder.dtype.str])

    found = common.map_arrow(ordered, run, "part int, n_docs long, n_tokens long, dtype string")
    parts = sorted((r.asDict() for r in common.materialize(found, "parts").collect()), key=lambda r: r["part"])
    for part, base in zip(parts, accumulate((p["n_tokens"] for p in parts), initial=0), strict=False):
        part["base"] = base
    return parts


def read_part(folder: str, part: int, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, offsets, docs, nulls of a part in a local folder, memory-mapped."""
    return tuple(np.memmap(part_path(folder, part, kind), np.dtype(kind_type), "r") for kind, kind_type in zip(KINDS, (dtype, "<u8", "<i8", "u1"), strict=True))


@contextmanager
def local_part(folder: str, part: int) -> Iterator[str]:
    """A local folder with a part's files: the folder itself, or a copy that goes afterwards."""
    files_at, path = fs.FileSystem.from_uri(folder)
    if isinstance(files_at, fs.LocalFileSystem):
        yield path
        return
    with tempfile.TemporaryDirectory() as copy:
        for kind in KINDS:
            fs.copy_files(part_path(path, part, kind), part_path(copy, part, kind), source_filesystem=files_at, destination_filesystem=fs.LocalFileSystem())
        yield copy


def read_token_files(spark: SparkSession, folder: str, parts: list[dict], id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files."""
    out = {"id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with local_part(folder, row["part"]) as local:
                    ids, offsets, doc_ids, nulls = read_part(local, row["part"], row["dtype"])
                    for at in range(0, row["n_docs"], READ_ROWS):
                        ends = offsets[at : at + READ_ROWS + 1].astype(np.int64)
                        crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                        found = pa.array(np.array(doc_ids[at : at + READ_ROWS]), mask=np.array(nulls[at : at + READ_ROWS], bool))
                        yield common.record_batch(out, id=found, start=ends[:-1] + row["base"], n_tokens=np.diff(ends), ids_crc32=crcs)

    listed = spark.createDataFrame([(p["part"], p["n_docs"], p["base"], p["dtype"]) for p in parts], "part int, n_docs long, base long, dtype string")
    if len(parts) > 1:
        listed = listed.repartition(len(parts))
    return common.map_arrow(listed, run, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
