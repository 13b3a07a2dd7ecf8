"""The corpus pipeline: from documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. doc_id may be null or repeated: rows are told apart by what
they hold.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.llm import bpe, mixing, quality_classifier, simhash, suffix_dedup
from codefacts.llm.common import cut, drop_cut, recorded, table
from codefacts.llm.queries import vocabulary_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, with all their columns, those too that are named like its results."""
    own = {c: f"__own_{c}" if c in quality_classifier.RESULTS else c for c in docs.columns}
    found = quality_classifier.classify(docs.select(*[F.col(c).alias(n) for c, n in own.items()]), table(spark, sf_dir, "labels"))
    return found.where("kept").select(*[F.col(n).alias(c) for c, n in own.items()])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one of the smallest doc_id, a null one last.

    Rows go through as (no id, doc_id, mark), the mark being a digest of the whole row: rows that share a doc_id, or have
    none, are told apart by it, and only rows equal in every column are one.
    """
    text = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    mark = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(*docs.columns).cast("string"), text)
    named = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), mark.alias("mark")).alias("doc_id"), "text")
    found = simhash.near_duplicates(named)
    first = found.where("doc_id.mark = component_id.mark").select(F.col("doc_id.mark").alias("__mark")).distinct()
    # Equal rows meet in a partial aggregate, so that many of them make no large group.
    single = docs.withColumn("__mark", mark).dropDuplicates(["__mark"])
    return single.join(first, "__mark", "left_semi").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat a smaller document for 50 bytes or more.

    Bytes of a character that is cut in the middle go too. A document without text left stays as an empty one.
    """
    return suffix_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix in training order; a document that is read twice stands twice."""
    mixed = mixing.mix(docs)
    order = mixing.training_order(mixed)
    return mixing.in_training_order(docs, order)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, as packed little-endian 32-bit integers, with their number and digests."""
    return bpe.digests(docs, vocabulary_path(), with_ids=True)


_LEFT: list[DataFrame] = []


def sweeping(stage):
    """The stage, with the scratch of earlier stages deleted first."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _LEFT:
            old = _LEFT.pop()
            if old.sparkSession.sparkContext._jsc is not None:  # a session that has ended took its folder along
                drop_cut(old)
        with recorded() as tables:
            out = stage(spark, docs, sf_dir)
        _LEFT.extend(tables)
        return out

    return run_stage


STAGES = [
    ("quality_classifier", sweeping(keep_quality)),
    ("simhash_near_dedup", sweeping(drop_near_copies)),
    ("suffix_array_dedup", sweeping(cut_repeats)),
    ("mixing", sweeping(mix_sources)),
    ("bpe", sweeping(encode)),
]

#: Trained models, connected components and token merges have no SQL form; a test compares run() with plain Python over whole texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{name}")
    return docs
