"""Aggregations over findings, calls and layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_by_first_use(calls: DataFrame, name: str, position: str) -> DataFrame:
    return calls.groupBy(name).agg(F.count("*").alias("n"), F.min(position).alias("first_use"))


def frequent(calls: DataFrame, name: str, run: str, least: int = 3) -> DataFrame:
    """Names that occur in at least `least` separate runs."""
    return calls.groupBy(name).agg(F.countDistinct(run).alias("n_runs"), F.count("*").alias("n")).where(F.col("n_runs") >= least)


def outliers(rows: DataFrame, group: list[str], width: str, least: int = 6, floor: float = 5.0) -> DataFrame:
    """Rows whose width lies above the third quartile by more than 1.5 interquartile ranges (at least `floor`); groups of
    fewer than `least` rows have none."""
    q = rows.groupBy(*group).agg(F.percentile(width, F.lit(0.25)).alias("q1"), F.percentile(width, F.lit(0.75)).alias("q3"), F.count("*").alias("n_rows")).where(F.col("n_rows") >= least)
    q = q.withColumn("bound", F.col("q3") + 1.5 * F.greatest(F.col("q3") - F.col("q1"), F.lit(floor)))
    return rows.join(q.select(*group, "bound"), group).where(F.col(width) > F.col("bound"))


def with_example(rows: DataFrame, category: str, example: str, order: str) -> DataFrame:
    return rows.groupBy(category).agg(F.count("*").alias("n"), F.min_by(example, order).alias("example"))


def samples(rows: DataFrame, group: list[str], order: list[Column], n: int = 3) -> DataFrame:
    """At most n rows of each group: a report, whose limit is the feature."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def is_blank(text: str) -> Column:
    """Nothing but white space, tabs included."""
    return F.col(text).rlike("^\\s*$")


def kept_blank_lines(lines: DataFrame, key: str, order: str, text: str, most: int, protected: Column | None = None) -> DataFrame:
    """Lines without those blank ones that follow `most` blank ones, and without blank lines at a file's end. Protected lines
    count as text: they stay, and the count starts anew behind them."""
    w = Window.partitionBy(key).orderBy(order)
    blank = is_blank(text) & ~(protected if protected is not None else F.lit(False))
    island = F.sum(F.when(blank, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = lines.withColumn("__blank", blank).withColumn("__island", island)
    nth = F.row_number().over(Window.partitionBy(key, "__island", "__blank").orderBy(order))
    texts = F.max(F.when(~F.col("__blank"), F.col(order))).over(Window.partitionBy(key))
    marked = marked.withColumn("__nth", nth).withColumn("__last", texts)
    return marked.where((~F.col("__blank") | (F.col("__nth") <= most)) & (F.col(order) <= F.col("__last"))).drop("__blank", "__island", "__nth", "__last")


def alignment_widths(lines: DataFrame, key: str, order: str, text: str, width: Column) -> DataFrame:
    """Per block of lines between blank ones: how many lines, and the widest."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    blank = is_blank(text)
    marked = lines.withColumn("__blank", blank).withColumn("block", F.sum(F.when(blank, 1).otherwise(0)).over(w)).where(~F.col("__blank"))
    return marked.groupBy(key, "block").agg(F.count("*").alias("n_lines"), F.max(width).alias("width"))


def within_budget(rows: DataFrame, order: list[Column], cost: str, budget: float, group: list[str] | None = None) -> DataFrame:
    """The rows whose running cost in order stays within a budget, in each group."""
    w = Window.partitionBy(*(group or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(cost).over(w)).where(F.col("running") <= budget)
