"""Interval and as-of operators. Each has an equality key (a file), inside which ranges are bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def innermost(points: DataFrame, ranges: DataFrame, key: str, at: str, identity: list[str], start: str = "start", end: str = "end", name: str = "name", bucket: int | None = None, ordinal: str | None = None) -> DataFrame:
    """points with the name of the range start <= at <= end that starts last; null if none. Of equal starts the first range in
    order of `ordinal` counts, or the smallest name without one.

    With bucket, ranges are also dealt to the buckets of that many units which they touch, so that the join has a second
    equality key and a file with very many ranges doesn't meet all its points.
    """
    r = ranges.select(F.col(key), F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(name).alias("__name"), F.col(ordinal or name).alias("__o"))
    p, on = points, [key]
    if bucket:
        slot = lambda c: F.floor(c / bucket)
        r = r.withColumn("__slot", F.explode(F.sequence(slot(F.col("__s")), slot(F.col("__e")))))
        p, on = points.withColumn("__slot", slot(F.col(at))), [key, "__slot"]
    hit = p.join(r, on).where(F.col(at).between(F.col("__s"), F.col("__e")))
    best = hit.groupBy(*identity).agg(F.min_by("__name", F.struct(-F.col("__s"), F.col("__o"))).alias(f"in_{name}"))
    return points.join(best, identity, "left")


def clipped(ranges: DataFrame, segments: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """A row for each range and segment [s_start, s_end) that overlap, with the shared part; empty ranges give none."""
    hit = ranges.join(segments, key).where((F.col(start) < F.col("s_end")) & (F.col("s_start") < F.col(end)))
    return hit.withColumn("clip_start", F.greatest(start, "s_start")).withColumn("clip_end", F.least(end, "s_end"))


def state_as_of(probes: DataFrame, changes: DataFrame, key: str, at: str, state: str, default: Column, identity: list[str]) -> DataFrame:
    """probes with the state of the last change at or before them: one union, one shuffle, one sort."""
    a = probes.select(key, F.col(at).alias("__at"), F.lit(1).alias("__probe"), F.lit(None).cast(changes.schema[state].dataType).alias("__state"), *[F.col(c).alias(f"__i{k}") for k, c in enumerate(identity)])
    b = changes.select(key, F.col(at).alias("__at"), F.lit(0).alias("__probe"), F.col(state).alias("__state"), *[F.lit(None).cast(probes.schema[c].dataType).alias(f"__i{k}") for k, c in enumerate(identity)])
    w = Window.partitionBy(key).orderBy("__at", "__probe").rowsBetween(Window.unboundedPreceding, 0)
    told = a.unionByName(b).withColumn("__now", F.last("__state", ignorenulls=True).over(w)).where("__probe = 1")
    return told.select(key, F.col("__at").alias(at), *[F.col(f"__i{k}").alias(c) for k, c in enumerate(identity)], F.coalesce("__now", default).alias(state))


def changes_only(rows: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """The rows at which the state differs from the one before; a first row is a change."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__before", before).where(~F.col(state).eqNullSafe(F.col("__before"))).drop("__before")


def line_starts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, start): the character offset at which each line begins, from one pass over the text."""
    lengths = F.transform(F.split(text, "\n"), lambda x: F.char_length(x) + 1)
    lines = docs.select(key, F.posexplode(lengths).alias("line", "__n"))
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select(key, (F.col("line") + 1).cast("long").alias("line"), F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("long").alias("start"))


def positions(offsets: DataFrame, docs: DataFrame, key: str, at: str, text: str = "text") -> DataFrame:
    """offsets (key, at) with their 1-based line and column: an as-of join with the starts of lines."""
    starts = line_starts(docs, key, text).withColumn("__start", F.col("start"))
    both = offsets.select(key, F.col(at).cast("long").alias(at), F.lit(1).alias("__probe"), F.lit(None).cast("long").alias("line"), F.lit(None).cast("long").alias("__start"))
    both = both.unionByName(starts.select(key, F.col("start").alias(at), F.lit(0).alias("__probe"), "line", "__start"))
    w = Window.partitionBy(key).orderBy(at, "__probe").rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumns({"line": F.last("line", ignorenulls=True).over(w), "__start": F.last("__start", ignorenulls=True).over(w)}).where("__probe = 1")
    return told.select(key, at, "line", (F.col(at) - F.col("__start") + 1).alias("column"))


def paired_regions(marks: DataFrame, key: str, at: str, off: Column, last: str) -> DataFrame:
    """Regions from each `off` mark to the next mark that isn't, to the file's `last` line if there is none."""
    w = Window.partitionBy(key).orderBy(at)
    m = marks.withColumn("__off", off).withColumn("__change", ~F.coalesce(F.lag("__off").over(w), F.lit(False)).eqNullSafe(F.col("__off"))).where("__change")
    return m.withColumn("end_line", F.coalesce(F.lead(at).over(w), F.col(last))).where("__off").select(key, F.col(at).alias("start_line"), "end_line")


def overlapping_edits(edits: DataFrame, key: str, start: str = "start", end: str = "end", *ties: str) -> DataFrame:
    """Edits that begin before an earlier one of the file has ended. Edits of one start and end count in the order of `ties`."""
    order = [F.asc_nulls_last(c) for c in (start, end, *ties)]
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return edits.withColumn("__far", F.max(end).over(w)).where(F.col(start) < F.col("__far")).drop("__far")
