"""A fact store on Parquet: content-addressed publishing, snapshots, importers, garbage collection.

Each table is a folder of Parquet files. Publishing appends only rows whose digest isn't there yet, so publishing twice
changes nothing; a snapshot is a set of record ids that is sealed when all its records are live.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def digest(domain: str, *columns: str):
    """A digest of columns in a domain: lengths go with the values, so that borders can't be moved."""
    parts = [F.coalesce(F.concat(F.char_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(F.lit(f"{domain}|"), *parts), 256)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self, table: str, like: DataFrame | None = None) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/{table}")
        except AnalysisException:
            return like.limit(0) if like is not None else None

    def publish(self, table: str, rows: DataFrame, key: list[str]) -> DataFrame:
        """Append the rows that aren't stored yet; returns the table."""
        known = self.read(table)
        new = rows.withColumn("digest", digest(table, *key)).dropDuplicates(["digest"])
        if known is not None:
            new = new.join(known.select("digest"), "digest", "left_anti")
        new.write.mode("append").parquet(f"{self.root}/{table}")
        return self.read(table)

    def unsealed(self, members: DataFrame, records: DataFrame) -> DataFrame:
        """Members that keep a snapshot from being sealed."""
        from codefacts.operators.relational import missing_members

        return missing_members(members, records, "record_id", F.col("lifecycle") == 1)


def live_leases(leases: DataFrame, now: int, ttl: int) -> DataFrame:
    return leases.where(F.col("renewed_unix_seconds") >= now - ttl)


def held_snapshots(snapshots: DataFrame, holds: DataFrame, leases: DataFrame, now: int, ttl: int) -> DataFrame:
    """Snapshots that a live lease holds."""
    live = holds.join(live_leases(leases, now, ttl), "lease_id", "left_semi")
    return snapshots.join(live, "snapshot_id", "left_semi")
