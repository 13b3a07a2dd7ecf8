"""Sorting, limits and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def beyond_newest(rows: DataFrame, context: list[str], sequence: str, keep: int) -> DataFrame:
    """Rows with at least `keep` strictly newer ones in their context (equal sequences count alike)."""
    rank = F.rank().over(Window.partitionBy(*context).orderBy(F.desc(sequence)))
    return rows.withColumn("__rank", rank).where(F.col("__rank") > keep).drop("__rank")


def page_after(rows: DataFrame, key: list[str], after: tuple, n: int) -> DataFrame:
    """The first n rows whose key follows `after`. The first key column is tested alone as well, so the scan can prune."""
    cursor = F.struct(*[F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(key, after, strict=True)])
    return rows.where((F.col(key[0]) >= after[0]) & (F.struct(*key) > cursor)).orderBy(*key).limit(n)


def too_many(rows: DataFrame, n: int) -> bool:
    """Whether there are over n rows, reading no more than needed."""
    return rows.limit(n + 1).count() > n
