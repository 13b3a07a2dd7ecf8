"""Sources and sinks of text: folders, lines, encodings, reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: ** crosses folders, * and ? don't."""
    out, k = "", 0
    while k < len(glob):
        if glob[k : k + 3] == "**/":
            out, k = out + "(?:.*/)?", k + 3
        elif glob[k : k + 2] == "**":
            out, k = out + ".*", k + 2
        else:
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[k], re.escape(glob[k])), k + 1
    return f"^{out}$"


def source_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("pas", "dpr", "dpk"), exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, file_type, content) of the files below a folder, by suffix, letter case aside, without excluded paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    kind = F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1))
    out = files.select("path", kind.alias("file_type"), "content").where(F.col("file_type").isin(*suffixes))
    for glob in exclude:
        out = out.where(~F.col("path").rlike(glob_pattern(glob if glob.startswith("/") else f"**/{glob}")))
    return out


def decoded(content: Column) -> Column:
    """Bytes as text without loss: UTF-8 if they are that, else each byte its code point."""
    body = F.when(F.substring(content, 1, 3) == F.lit(b"\xef\xbb\xbf"), F.substring(content, 4, (1 << 31) - 1)).otherwise(content)
    return F.when(F.is_valid_utf8(body.cast("string")), body.cast("string")).otherwise(F.decode(body, "ISO-8859-1"))


def lines(files: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, line, text): lines from 1; a carriage return before a line break goes."""
    return files.select(key, F.posexplode(F.split(text, "\r?\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def text_report(findings: DataFrame) -> DataFrame:
    """One printed line for each finding (path, line, column, severity, rule, message)."""
    return findings.select("path", "line", "column", F.format_string("%s:%d:%d: %s[%s]: %s", "path", "line", "column", "severity", "rule", "message").alias("text"))


def json_report(findings: DataFrame) -> DataFrame:
    """One JSON document for each file."""
    item = F.struct("line", "column", "rule", "severity", "message")
    return findings.groupBy("path").agg(F.to_json(F.struct(F.first("path").alias("path"), F.array_sort(F.collect_list(item)).alias("diagnostics"))).alias("json"))


def dot_graph(edges: DataFrame, graph: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each graph as DOT text."""
    edge = F.format_string('  "%s" -> "%s";', F.col(src), F.col(dst))
    return edges.groupBy(graph).agg(F.concat(F.lit("digraph {\n"), F.array_join(F.array_sort(F.collect_list(edge)), "\n"), F.lit("\n}")).alias("dot"))


def parsed_messages(rows: DataFrame, text: str) -> DataFrame:
    """Compiler output lines `path(line) CODE message` as columns."""
    get = lambda k: F.regexp_extract(text, r"^(.*?)\((\d+)\)\s+(?:Error:|Warning:|Hint:|Fatal:)?\s*([A-Z]\d{4})?:?\s*(.*)$", k)
    return rows.select("*", get(1).alias("path"), F.try_to_number(get(2), F.lit("999999999")).cast("int").alias("line"), F.nullif(get(3), F.lit("")).alias("code"), get(4).alias("message")).where("path <> ''")
