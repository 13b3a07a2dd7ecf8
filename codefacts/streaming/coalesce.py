"""Change streams: coalescing notifications of files, with an overflow that asks for a full scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coalesced(changes: DataFrame, path: str = "path", kind: str = "kind", seq: str = "seq") -> DataFrame:
    """One row per path: `changed` wins over `modified`; first_seq keeps the order of first sight."""
    rank = F.max(F.when(F.col(kind) == "changed", 2).otherwise(1))
    return changes.groupBy(path).agg(F.when(rank == 2, F.lit("changed")).otherwise(F.lit("modified")).alias(kind), F.min(seq).alias("first_seq"), F.count("*").alias("n"))


def merge_pending(pending: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Pending changes and those of a new batch, coalesced again."""
    new = coalesced(batch)
    if pending is None:
        return new
    both = pending.unionByName(new)
    changed = F.max(F.when(F.col("kind") == "changed", 2).otherwise(1)) == 2
    return both.groupBy("path").agg(F.when(changed, F.lit("changed")).otherwise(F.lit("modified")).alias("kind"), F.min("first_seq").alias("first_seq"), F.sum("n").alias("n"))


def run_coalescer(stream: DataFrame, checkpoint: str, emit: Callable[[DataFrame, int], None], limit: int = 32_768):
    """Start a query that hands each micro-batch to emit, coalesced; a batch of over `limit` paths becomes one overflow row."""

    def each(batch: DataFrame, n: int) -> None:
        found = coalesced(batch)
        if found.limit(limit + 1).count() > limit:
            found = batch.sparkSession.range(1).select(F.lit(None).cast("string").alias("path"), F.lit("overflow").alias("kind"), F.lit(0).cast("long").alias("first_seq"), F.lit(0).cast("long").alias("n"))
        emit(found, n)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stale(changes: DataFrame, observations: DataFrame) -> DataFrame:
    """Members that observed a changed path: a stream-static join."""
    return changes.join(observations, "path").select("member", "path")


def tumbling(events: DataFrame, at: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts in tumbling windows with a watermark; for batch frames the watermark has no effect."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"))
