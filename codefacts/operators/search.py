"""Name search: tokens, postings, suggestions, symbol lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTIFIER = "[A-Za-z0-9_]+"


def tokens(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, token): maximal runs of identifier characters, without those that a digit leads."""
    runs = F.filter(F.regexp_extract_all(F.col(text), F.lit(IDENTIFIER), F.lit(0)), lambda t: ~t.rlike("^[0-9]"))
    return docs.select(key, F.posexplode(runs).alias("pos", "token"))


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(name, key, n, first_pos): an inverted index with a row for each name and file, so that no name is one huge row."""
    return tokens(docs, key, text).groupBy(F.lower("token").alias("name"), key).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def candidates(index: DataFrame, names: list[str], key: str) -> DataFrame:
    """Files that have every one of the names."""
    wanted = sorted({n.lower() for n in names})
    return index.where(F.col("name").isin(wanted)).groupBy(key).agg(F.countDistinct("name").alias("__n")).where(F.col("__n") == len(wanted)).select(key)


def suggestions(names: DataFrame, name: str, asked: str, tie: str, n: int = 10) -> DataFrame:
    """The n names nearest to `asked` by edit distance, of the whole names or of the last dotted parts of both."""
    low, want = F.lower(F.col(name)), asked.lower()
    distance = F.least(F.levenshtein(low, F.lit(want)), F.levenshtein(F.substring_index(low, ".", -1), F.lit(want.rpartition(".")[2])))
    return names.withColumn("distance", distance).orderBy("distance", tie).limit(n)


def containing(names: DataFrame, name: str, query: str) -> DataFrame:
    """Names with the query in them, letter case aside; an empty query matches all."""
    return names.where(F.lower(F.col(name)).contains(query.lower()))


def dotted_suffixes(name: Column) -> Column:
    """a.b.c to [a.b.c, b.c, c]."""
    parts = F.split(name, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def needles(query: str) -> Column:
    return F.filter(F.split(F.lower(F.lit(query)), "[^a-z0-9_\\x{80}-\\x{10FFFF}]+"), lambda x: x != "")
