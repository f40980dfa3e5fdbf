"""The ingest queue as functions from old to new job tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import scans
from graphloom.sources.shared import cut

MAX_ATTEMPTS, STALE_MINUTES, ERROR_BYTES = 3, 5, 2048


def submit(texts: DataFrame, now: Column, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Queued jobs for texts (kb_id, content, source, metadata); ids follow from what is submitted and when."""
    job_id = F.sha2(F.concat_ws("|", "kb_id", "source", now.cast("string"), "content"), 256)
    none = {c: F.lit(None).cast(t) for c, t in (("episode_id", "string"), ("result", "string"), ("error", "string"), ("started_at", "timestamp"), ("completed_at", "timestamp"))}
    rows = texts.withColumns({"id": job_id, "status": F.lit("queued"), "attempts": F.lit(0), "max_attempts": F.lit(max_attempts), "created_at": now} | none)
    return rows.select("id", "kb_id", "status", "content", "source", "metadata", "episode_id", "result", "error", "attempts", "max_attempts", "created_at", "started_at", "completed_at")


def dequeue(jobs: DataFrame, n: int) -> DataFrame:
    """The oldest queued jobs."""
    return jobs.filter("status = 'queued'").orderBy("created_at", "id").limit(n)


def claim(jobs: DataFrame, n: int, now: Column, ids: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The jobs after the oldest n are claimed, and those n; with ids, only jobs of these are."""
    open_jobs = jobs if ids is None else jobs.filter(F.col("id").isin(list(ids)))
    taken = cut(dequeue(open_jobs, n).select("id", F.lit(True).alias("taken")), "taken")
    after = jobs.join(taken, "id", "left")
    t = F.col("taken").isNotNull()
    after = after.withColumns({"status": F.when(t, "running").otherwise(F.col("status")), "attempts": F.when(t, F.col("attempts") + 1).otherwise(F.col("attempts")), "started_at": F.when(t, now).otherwise(F.col("started_at"))})
    return after.select(*jobs.columns), after.filter(t).select(*jobs.columns)


def set_status(jobs: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """changes: id, new_status and, if they apply, new_episode_id, new_result, new_error."""
    for c in ("new_episode_id", "new_result", "new_error"):
        if c not in changes.columns:
            changes = changes.withColumn(c, F.lit(None).cast("string"))
    j = jobs.join(changes.select("id", "new_status", "new_episode_id", "new_result", "new_error"), "id", "left")
    to = F.col("new_status")
    ended = to.isin("completed", "failed")
    values = {
        "status": F.coalesce(to, F.col("status")),
        "attempts": F.when(to == "running", F.col("attempts") + 1).otherwise(F.col("attempts")),
        "started_at": F.when(to == "running", now).when(to == "queued", F.lit(None)).otherwise(F.col("started_at")),
        "completed_at": F.when(ended, now).when(to == "queued", F.lit(None)).otherwise(F.col("completed_at")),
        "episode_id": F.when(ended, F.coalesce("new_episode_id", "episode_id")).otherwise(F.col("episode_id")),
        "result": F.when(to == "completed", F.col("new_result")).otherwise(F.col("result")),
        "error": F.when(to == "failed", tx.shorten(F.col("new_error"), ERROR_BYTES, "... (truncated)")).otherwise(F.col("error")),
    }
    return j.withColumns(values).select(*jobs.columns)


def stale(jobs: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """Jobs that have run for too long and may be tried again."""
    return jobs.filter((F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("attempts") < F.col("max_attempts")))


def recover_stale(jobs: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    old = (F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("attempts") < F.col("max_attempts"))
    return jobs.withColumns({"status": F.when(old, "queued").otherwise(F.col("status")), "started_at": F.when(old, F.lit(None)).otherwise(F.col("started_at"))})


def retry(jobs: DataFrame, ids: list[str]) -> DataFrame:
    """Failed jobs among ids are queued again; others stay."""
    again = F.col("id").isin(ids) & (F.col("status") == "failed")
    return jobs.withColumns({c: F.when(again, v).otherwise(F.col(c)) for c, v in (("status", F.lit("queued")), ("started_at", F.lit(None)), ("completed_at", F.lit(None)))})


def episode_id() -> Column:
    """The id of a running job's episode: each attempt has its own."""
    return F.concat(F.lit("j:"), F.col("id"), F.when(F.col("attempts") > 1, F.concat(F.lit(":"), F.col("attempts").cast("string"))).otherwise(F.lit("")))


def outcomes(mine: DataFrame, by_text: DataFrame) -> DataFrame:
    """Changes for set_status() of running jobs by what their texts came to (kb_id, text_id, error and counts): completed with the counts as JSON, or failed with the error."""
    counts = ("entities_created", "entities_updated", "relations_created", "relations_strengthened")
    met = mine.select("id", episode_id().alias("text_id")).join(by_text, "text_id")
    result = F.to_json(F.struct(F.col("text_id").alias("episode_id"), *counts))
    failed = F.col("error").isNotNull()
    return met.select("id", F.when(failed, "failed").otherwise("completed").alias("new_status"), F.col("text_id").alias("new_episode_id"), F.when(~failed, result).alias("new_result"), F.col("error").alias("new_error"))


def events(ended: DataFrame) -> DataFrame:
    """(type, job): what is told of jobs that have ended."""
    return ended.filter(F.col("status").isin("completed", "failed")).select(F.concat(F.lit("job."), "status").alias("type"), F.struct(*[c for c in ended.columns if c != "content"]).alias("job"))


def every_nth(calls: DataFrame, n: int, order: str = "call") -> DataFrame:
    """The calls of a hook that are looked at; calls are numbered from 1."""
    return calls if n <= 1 else calls.filter(F.col(order) % n == 0)


def export(jobs: DataFrame, kb: str | None = None, limit: int = 1000) -> DataFrame:
    """What an export holds, newest first."""
    rows = scans.list_jobs(jobs, kb, None, limit)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    return rows.select("id", "kb_id", "status", "source", "episode_id", "error", "attempts", "max_attempts", stamp("created_at"), stamp("started_at"), stamp("completed_at"))
