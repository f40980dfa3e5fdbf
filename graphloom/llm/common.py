"""What the operators of this folder share: shared storage, Arrow batches, words, splits."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that the JVM hands to Python at once: a task's memory does not grow with its rows.
ARROW_ROWS, ARROW_BYTES = 2048, 16 << 20

_made: list[str] = []
_run = uuid.uuid4().hex[:12]
_roots: dict[str, SparkSession] = {}


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches, so that very long texts do not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data directory; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="graphloom-")
        _made.append(folder)
        at = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the program ends."""
    root = f"{shared_dir(spark)}/graphloom-llm-{_run}"
    _roots[root] = spark
    return f"{root}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Removes what this program has written to the shared folder; frames that were materialized can then not be read any more."""
    for root in [r for r, s in _roots.items() if s is spark]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        del _roots[root]


@atexit.register
def _clean() -> None:
    for spark in set(_roots.values()):
        try:
            clean(spark)
        except Exception:  # the session has ended before
            pass
    for at in _made:
        shutil.rmtree(at, ignore_errors=True)


def split_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo modulus; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether a row is held out; a null doc_id is not held out, and is not learnt from either."""
    return F.coalesce(split_remainder(doc_id, modulus) == remainder, F.lit(False))


def learnable(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(split_remainder(doc_id, modulus) != remainder, F.lit(False))


def words(text: bytes) -> list[bytes]:
    """Runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased: bytes.lower and bytes.split do just that."""
    return text.lower().split()


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def column_bytes(column: pa.Array) -> list[bytes]:
    """The values of a string or binary column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(f, schema)


def record_batch(schema: dict[str, pa.DataType], **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[k], pa.Array) else pa.array(x, kind) for k, kind in schema.items()], names=list(schema))


def hash_fraction(seed: int, *columns: Column) -> Column:
    """A uniform number in [0, 1) that depends on seed and columns only; the same in every run and task."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def worker_cache(holder: dict, key: object, make: Callable[[], object]) -> object:
    """What a reused Python worker keeps between tasks; one entry, so that models do not pile up."""
    if key not in holder:
        holder.clear()
        holder[key] = make()
    return holder[key]


def mark() -> str:
    """A name for what one call sends to workers, by which they know it again."""
    return uuid.uuid4().hex


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
