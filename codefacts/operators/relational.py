"""Filters, joins and lookups over findings: pure functions from DataFrames to DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without_suppressed(findings: DataFrame, suppressions: DataFrame, on: str, rule: str = "rule") -> DataFrame:
    """Findings no suppression covers. A suppression with a null rule covers every rule at its place.

    One row a place holds its rules (as many as there are rules at most), so one join on an equal key does.
    """
    by_place = suppressions.groupBy(on).agg(F.bool_or(F.col(rule).isNull()).alias("__all"), F.collect_set(rule).alias("__rules"))
    told = findings.join(by_place, on, "left")
    hushed = F.coalesce(F.col("__all"), F.lit(False)) | F.coalesce(F.array_contains("__rules", F.col(rule)), F.lit(False))
    return told.where(~hushed).select(*findings.columns)


def without_baseline(findings: DataFrame, baseline: DataFrame, key: Column) -> DataFrame:
    """Findings whose key isn't in the baseline: a set, so one entry hides all equal findings."""
    keyed = findings.withColumn("__key", key)
    return keyed.join(baseline.select(F.col("key").alias("__key")).distinct(), "__key", "left_anti").drop("__key")


def effective_rules(findings: DataFrame, rules: DataFrame, rule: str = "rule") -> DataFrame:
    """Findings of rules that run, with `severity`: the override if there is one, else the default.

    rules (rule, default_severity, enabled, override): an override `off` stops a rule, any other starts it.
    """
    state = rules.withColumn("severity", F.coalesce("override", "default_severity")).where((F.coalesce("override", F.lit("")) != "off") & (F.col("override").isNotNull() | F.col("enabled")))
    return findings.join(state.select(rule, "severity"), rule)


def reaches_threshold(findings: DataFrame, rank: Column, least: int) -> DataFrame:
    """One row: whether any finding is at least as severe as `least`."""
    return findings.agg(F.coalesce(F.max(rank) >= least, F.lit(False)).alias("failed"))


def missing_members(members: DataFrame, records: DataFrame, key: str, live: Column) -> DataFrame:
    """Members whose record is absent or not live."""
    marked = records.select(key, live.alias("__live"))
    return members.join(marked, key, "left").where(~F.coalesce("__live", F.lit(False))).drop("__live")


def first_known(base: DataFrame, lookups: list[tuple[DataFrame, str, str]], into: str) -> DataFrame:
    """base with `into`: the first value that the lookups, in order of precedence, have. A lookup is (table, key, value)."""
    out, names = base, []
    for k, (table, key, value) in enumerate(lookups):
        names.append(f"__v{k}")
        out = out.join(table.select(F.col(key), F.col(value).alias(names[-1])), key, "left")
    return out.withColumn(into, F.coalesce(*names)).drop(*names)


def best_of(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__nth = 1").drop("__nth")


def matched_multisets(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Per key: rows left, rows right, matched one to one, only left (missed), only right (invented).

    Counting each side first sends one row per key, however often a key is repeated.
    """
    a = left.groupBy(*key).agg(F.count("*").alias("n_left"))
    b = right.groupBy(*key).agg(F.count("*").alias("n_right"))
    both = a.join(b, key, "full").fillna(0, ["n_left", "n_right"])
    matched = F.least("n_left", "n_right")
    return both.select(*key, "n_left", "n_right", matched.alias("matched"), (F.col("n_left") - matched).alias("missed"), (F.col("n_right") - matched).alias("invented"))


def percentage(part: Column, whole: Column) -> Column:
    """part of whole in percent with one decimal, null where whole is 0."""
    return F.round(F.try_divide(F.lit(100.0) * part, whole), 1)


def unreferenced(rows: DataFrame, references: list[tuple[DataFrame, str]], key: str) -> DataFrame:
    """Rows that none of the (table, column) references: the sweep of a garbage collection."""
    out = rows
    for table, column in references:
        out = out.join(table.select(F.col(column).alias(key)).distinct(), key, "left_anti")
    return out
