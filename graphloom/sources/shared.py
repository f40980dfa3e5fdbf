"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, a folder of our own, on a local master only: on a cluster no machine's own folder will do."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="graphloom-")
        _made.append(folder)
        at = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the program ends."""
    root = f"{shared_dir(spark)}/graphloom-run-{_run}"
    _roots[root] = spark
    return f"{root}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written to the shared folder and read back: a short lineage that survives lost executors."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_run = uuid.uuid4().hex[:12]
_roots: dict[str, SparkSession] = {}


def clean(spark: SparkSession) -> None:
    """Removes what this program has written to the shared folder; frames that were cut can then not be read any more."""
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
    for folder in _made:
        shutil.rmtree(folder, ignore_errors=True)
