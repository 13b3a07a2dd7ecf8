"""Helpers of the llm operators: shared scratch space, lineage cuts, Arrow mapping."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space that separates words: space and the control characters 9 to 13.
WORD = "[^\\x20\\x09-\\x0D]+"


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of our own where that is unset and all runs in one
    process (local tests). On a cluster without that setting there is no such folder, so it must be named."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='codefacts-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: For tables whose rows are large blobs: Parquet's writer would otherwise hold 100 rows before it looks at their size.
BLOBS = {"parquet.block.size": str(1 << 23), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "8", "parquet.enable.dictionary": "false", "compression": "zstd"}


_RECORDS: list[list[DataFrame]] = []


class recorded(list):
    """While open, collects the tables that cut() writes, for a caller who knows when nothing reads them any more."""

    def __enter__(self):
        _RECORDS.append(self)
        return self

    def __exit__(self, *_):
        _RECORDS.remove(self)


def cut(df: DataFrame, name: str = "cut", blobs: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**BLOBS if blobs else {"compression": "zstd"}).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    for r in _RECORDS:
        r.append(back)
    return back


def drop_cut(df: DataFrame) -> None:
    """Delete a table written by cut() that no live plan reads any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def and_fields(schema: StructType, ddl: str) -> StructType:
    """A new schema: schema's fields, then those of ddl. (StructType.add would change the frame's own schema.)"""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


class small_batches:
    """While open, Arrow batches and Parquet's read batches hold few rows: for plans whose rows are blobs of up to a few MB."""

    KEYS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")

    def __init__(self, spark: SparkSession, rows: int = 32):
        self.spark, self.rows = spark, rows

    def __enter__(self):
        self.before = [self.spark.conf.get(k) for k in self.KEYS]
        for k in self.KEYS:
            self.spark.conf.set(k, str(self.rows))

    def __exit__(self, *_):
        for k, v in zip(self.KEYS, self.before, strict=True):
            self.spark.conf.set(k, v)


def text_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Let Arrow batches hold at most `rows` rows in this session: rows of texts are long, and a batch stands in the executor, on
    its way and in the worker at once. A lower setting stays."""
    if int(spark.conf.get(small_batches.KEYS[0])) > rows:
        spark.conf.set(small_batches.KEYS[0], str(rows))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done: it does so when the driver collects its garbage."""
    for _ in range(2):  # what the first round frees may have held more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def input_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text)).cast("long")), F.lit(0))).first()[0]
