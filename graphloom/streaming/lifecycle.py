"""Decay and pruning on a schedule."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from graphloom.schema import DEFAULT_PRUNE_THRESHOLD

if TYPE_CHECKING:
    from graphloom.engine import Engine

#: Decay by the hour, prune by the day.
DECAY_SECONDS, PRUNES_EVERY = 3600, 24


def schedule(engine: Engine, checkpoint: str, decay_seconds: int = DECAY_SECONDS, prune_every: int = PRUNES_EVERY, threshold: float = DEFAULT_PRUNE_THRESHOLD) -> StreamingQuery:
    """Decays all strengths every so often, and prunes with every nth decay. Consolidation is left to whoever asks for it."""

    def tick(_: DataFrame, batch: int) -> None:
        engine.decay()
        if (batch + 1) % prune_every == 0:
            engine.prune(threshold)

    clock = engine.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=f"{decay_seconds} seconds").start()
