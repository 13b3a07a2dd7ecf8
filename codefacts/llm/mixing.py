"""Mixing sources to target weights, with a time-varying curriculum.

Targets: each source's share of the wanted total goes by its weight; a target stops at `cap` times the source's size and
the excess is shared again by weight, until none is above (water-filling, solved by one sort of the sources).
Documents of a source stand in a fixed pseudo-random order; the mix takes the source's words in that order, again from
the start when the target is above its size, and stops at the target inside a document.
Curriculum: source s draws a share of its target up to time t of the training that is the integral of a linear weight
schedule; inverting that cumulative demand gives each document the time at which it is read, and the demand of all sources
up to then, in words, is its position in the training stream.

Rows that agree in doc_id, source and size can change places, so they are counted first and told apart only when each gets
its copies: a third of all rows without an id make no group of their own. Running sums are in two levels: buckets of the
order's hash inside a source, then rows inside a bucket, so a source with a third of all rows is spread over many groups.
Only the table of sources (one row each) goes to one task.

Cases: null texts have size 0; null sources are one source, after the others; sources of size 0 get target 0; an empty
table gives no rows; repeated rows, and rows that share a doc_id or have none, are separate documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Hex digits of the order's hash that make a bucket: 16 ** 3 buckets in each source.
BUCKET_DIGITS = 3
#: Equal rows that one row of counts becomes at a time.
BLOCK = 4096


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes (source, source_size) with rank and target, early and late. Sources by code point, null last, weigh `weights` in turn.

    early and late: at time t, all sources together have drawn early * t + late * t * t words.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    # Sources that are full at the smallest level come first. Source k and those before are full while the level, what
    # the full ones leave over the weight of the others, is at or above size * cap / weight.
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("all_size"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("full_size"),
        F.sum("weight").over(after).alias("open_weight"),
    ).withColumn("level", (F.col("all_size") * F.lit(share) - F.col("full_size") * F.lit(cap)) / F.col("open_weight"))
    level = level.withColumn("full", F.col("level") * F.col("weight") >= F.col("source_size") * F.lit(cap))
    # The level of the first source that is not full holds for all from there on.
    open_level = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), F.col("rank"), F.col("level")))).over(everything)
    told = level.withColumn("at", open_level["level"]).select(
        "source", "rank", "source_size", F.when(F.col("full"), F.col("source_size") * F.lit(cap)).otherwise(F.col("at") * F.col("weight")).alias("target")
    )
    whole, start = Window.partitionBy(), schedule_start(F.col("rank"))
    words = F.floor("target").cast("double")
    return told.withColumns({"early": F.sum(words * start).over(whole), "late": F.sum(words * (F.lit(1.0) - start)).over(whole)})


def curriculum_time(part, start):
    """The time in [0, 1] at which a source has drawn `part` of its target, if its weight goes linearly from start to
    2 - start times its mean: the inverse of start * t + (1 - start) * t * t."""
    return (F.sqrt(start * start + F.lit(4.0) * (F.lit(1.0) - start) * part) - start) / (F.lit(2.0) * (F.lit(1.0) - start))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, text: str = "text") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, and what is needed to place each copy:
    rank, start (words of the source before it), goal (words the source gives), early and late."""
    sized = docs.select("doc_id", "source", word_count(F.col(text)).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    h = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))
    sized = cut(sized.withColumn("h", h).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS)), "mix-sizes")
    buckets = sized.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("rows")).alias("bucket_size"))
    in_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(in_source), F.lit(0)))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, cap)
    targets = targets.withColumnRenamed("source", "t_source")
    starts = starts.join(targets, F.col("source").eqNullSafe(F.col("t_source")))
    starts = starts.select(F.col("source").alias("s_source"), F.col("bucket").alias("s_bucket"), "bucket_start", "rank", "source_size", "target", "early", "late")
    placed = sized.join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("bucket") == F.col("s_bucket"))).drop("s_source", "s_bucket")
    in_bucket = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.col("bucket_start") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(in_bucket), F.lit(0)))
    goal = F.floor("target")
    turn = lambda k: F.greatest(F.lit(0), F.least("size", F.col("goal") - F.col("source_size") * k - F.col("start")))
    return one_by_one(placed).withColumn("goal", goal).select(
        "doc_id", "source", "rank", "size", "source_size", "target", "start", "goal", "early", "late",
        sum((turn(k) for k in range(1, int(-(-cap // 1)))), turn(0)).cast("long").alias("taken"),
    )


def one_by_one(placed: DataFrame) -> DataFrame:
    """A row for each of the equal rows that were counted, each starting where the one before ends. Many equal rows become
    blocks first, which are dealt out, so that no task writes them all."""
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / BLOCK)))
    blocks = placed.withColumn("block", first).repartition("doc_id", "size", "block")
    nth = F.explode(F.sequence(F.col("block") * BLOCK, F.least(F.col("rows"), (F.col("block") + 1) * BLOCK) - 1))
    return blocks.withColumn("nth", nth).withColumn("start", F.col("start") + F.col("nth") * F.col("size"))


def schedule_start(rank):
    """The curriculum: sources of even rank fade out (1.5 to 0.5 times their mean weight), the others fade in."""
    return F.when(rank % 2 == 0, F.lit(1.5)).otherwise(F.lit(0.5))


def with_copies(mixed: DataFrame, cap: int = 2) -> DataFrame:
    """mixed with copies: for each time the mix reads the document, copy, words, the time in [0, 1], and the position, the words
    that all sources have drawn by then.

    A copy is read if it starts before its source's goal; a copy of a document without words is read once.
    """

    def one(k: int):
        at = F.col("start") + F.col("source_size") * k
        part = F.least(F.lit(1.0), F.coalesce(F.try_divide(at.cast("double"), F.col("goal").cast("double")), F.lit(0.0)))
        words = F.greatest(F.lit(0), F.least("size", F.col("goal") - at)).cast("long")
        read = (at < F.col("goal")) | ((F.col("size") == 0) & F.lit(k == 0))
        return F.when(read, F.struct(F.lit(k).alias("copy"), words.alias("words"), curriculum_time(part, schedule_start(F.col("rank"))).alias("time")))

    copies = F.filter(F.array(*map(one, range(cap))), lambda c: c.isNotNull())
    drawn = lambda t: F.col("early") * t + F.col("late") * t * t
    return mixed.withColumn("copies", F.transform(copies, lambda c: F.struct(c["copy"].alias("copy"), c["words"].alias("words"), c["time"].alias("time"), drawn(c["time"]).alias("position"))))


def training_order(mixed: DataFrame, cap: int = 2) -> DataFrame:
    """One row per copy of a document that the mix reads: doc_id, size, copy, words, time in [0, 1], position in words."""
    copies = with_copies(mixed, cap).select("doc_id", "size", F.explode("copies").alias("c"))
    return copies.select("doc_id", "size", "c.copy", "c.words", "c.time", "c.position")


def by_position(order: DataFrame) -> DataFrame:
    """training_order's rows, range-sorted by position."""
    return order.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")


def by_first_position(mixed: DataFrame, cap: int = 2) -> DataFrame:
    """One row per document, range-sorted by the position at which it is first read, those never read last; taken is the
    sum of the words of its copies."""
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda sum_, c: sum_ + c["words"])
    read = with_copies(mixed, cap).withColumns({"taken": taken, "first_position": F.try_element_at("copies", F.lit(1))["position"]})
    by = [F.col("first_position").asc_nulls_last(), F.col("doc_id")]
    return read.repartitionByRange(*by).sortWithinPartitions(*by)


def in_training_order(docs: DataFrame, order: DataFrame, text: str = "text") -> DataFrame:
    """The documents' rows once for each copy in order, range-sorted by position. Rows that share a doc_id, or have none, are
    told apart by their size, then numbered: rows of one id and one size meet in one task."""
    a = docs.withColumn("__words", word_count(F.col(text)))
    a = a.withColumn("__nth", F.row_number().over(Window.partitionBy("doc_id", "__words").orderBy(F.xxhash64(text))))
    nth = F.row_number().over(Window.partitionBy("doc_id", "size", "copy").orderBy("position"))
    b = order.select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), nth.alias("__n"), F.col("position").alias("__at"), F.col("copy").alias("__copy"))
    both = a.join(b, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__words") == F.col("__size")) & (F.col("__nth") == F.col("__n")))
    return both.repartitionByRange("__at", "__id").sortWithinPartitions("__at", "__id", "__copy").select(*docs.columns)
