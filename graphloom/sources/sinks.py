"""Where events and exports go."""

from __future__ import annotations

import json
import logging
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import jobs as jb

WEBHOOK_SECONDS = 5
Notifier = Callable[[dict], None]


def append_json_lines(events: DataFrame, folder: str) -> None:
    """Appends events as JSON, a line each, to a folder."""
    if "://" not in folder and not os.path.isabs(folder):
        raise ValueError(f"the path must be absolute: {folder}")
    events.write.mode("append").json(folder)


def file_notifier(path: str) -> Notifier:
    """Appends each event to one file that only its owner may read."""
    path = os.path.normpath(path)
    if not os.path.isabs(path):
        raise ValueError(f"the path must be absolute: {path}")

    def notify(event: dict) -> None:
        with os.fdopen(os.open(path, os.O_APPEND | os.O_CREAT | os.O_WRONLY, 0o600), "a") as f:
            f.write(json.dumps(event, default=str) + "\n")

    return notify


def webhook_notifier(url: str, timeout: float = WEBHOOK_SECONDS) -> Notifier:
    """Posts each event as JSON; an answer of 400 and more is an error."""

    def notify(event: dict) -> None:
        request = urllib.request.Request(url, json.dumps(event, default=str).encode(), {"Content-Type": "application/json"}, method="POST")
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            if answer.status >= 400:
                raise OSError(f"webhook answered {answer.status}")

    return notify


def log_notifier(logger: logging.Logger | None = None) -> Notifier:
    logger = logger or logging.getLogger("graphloom")
    return lambda event: logger.info("%s", json.dumps(event, default=str))


def notify_all(notifiers: Sequence[Notifier]) -> Notifier:
    """Tells every one, and raises what went wrong afterwards."""

    def notify(event: dict) -> None:
        errors = []
        for n in notifiers:
            try:
                n(event)
            except Exception as e:
                errors.append(e)
        if errors:
            raise ExceptionGroup("notifiers failed", errors)

    return notify


def send(events: DataFrame, notifier: Notifier) -> DataFrame:
    """Runs a notifier over events on the executors; (sent, failed) per task."""
    rows = events.select(F.to_json(F.struct("*")).alias("event"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent = failed = 0
        for batch in batches:
            for event in batch["event"]:
                try:
                    notifier(json.loads(event))
                    sent += 1
                except Exception:
                    failed += 1
        yield pd.DataFrame({"sent": [sent], "failed": [failed]})

    return rows.mapInPandas(run, "sent long, failed long")


def export_jobs(jobs: DataFrame, folder: str, form: str = "json", kb: str | None = None, limit: int = 1000) -> None:
    """Writes jobs as JSON lines or as CSV with a header."""
    rows = jb.export(jobs, kb, limit)
    if form == "json":
        rows.write.mode("overwrite").json(folder)
    elif form == "csv":
        rows.write.mode("overwrite").option("header", True).csv(folder)
    else:
        raise ValueError(f"unknown format {form!r}: use json or csv")
