"""SimHash near-dedup with a byte-position inverted index and count filtering.

Each text gets a 64-bit fingerprint of its 3-word shingles. Fingerprints that differ in at most 3 bits share at least 5
of their 8 bytes at the same positions. The inverted index posts each distinct fingerprint under its positional bytes,
three positions to a key: the eight triples inside the two halves of the fingerprint are chosen so that any five shared
positions hold one of them whole. Postings of single bytes would make pairs in proportion to the square of the corpus
over 256; postings of triples make them over 2 ** 24. Each pair that meets in a posting has its shared positional bytes
tallied, pairs below the guaranteed five go, the others are verified by their differing bits.

A posting above BLOCK fingerprints is cut into blocks by hash and each pair of blocks is a group of its own, so no
group is unbounded and no link is lost; of each group only the links that join two parts are emitted, never all pairs.
Exact copies and equal fingerprints meet before the index. Components come from star contraction in Spark.

Cases: a null or wordless text has fingerprint zero, linked like any other; fewer than three words are one shingle;
repeated rows share a fingerprint; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.operators.graph import connected_components

from .common import cut, text_batches

SEED, BITS, MIN_SHARED = 42, 3, 5
#: Triples of byte positions such that any five positions hold one: five positions put three into one half.
TRIPLES = tuple((a, b, c) for half in (range(4), range(4, 8)) for a in half for b in half for c in half if a < b < c)
BLOCK = 2048
ROWS = 1 << 16
_digest = partial(xxhash.xxh64_digest, seed=SEED)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's lower-cased word shingles, as an unsigned number."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    n = len(words) - shingle + 1
    shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if n > 0 else [b" ".join(words)]
    n = max(n, 1)
    hashes = np.frombuffer(b"".join(map(_digest, shingles)), np.uint8).reshape(-1, 8)
    counts = sum(np.unpackbits(hashes[k : k + ROWS], axis=1).sum(axis=0, dtype=np.int64) for k in range(0, n, ROWS))
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. A narrow map."""
    given = docs.select("doc_id", F.col(text).cast("binary").alias("text"))
    text_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, fp long")


def links_of(fp: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the parts of each group of fingerprints; equal values of group stand together."""
    n = len(fp)
    if n < 2:
        return []
    end = np.searchsorted(group, group, side="right") if np.all(group[:-1] <= group[1:]) else None
    if end is None:
        last = np.flatnonzero(np.append(group[:-1] != group[1:], True))
        end = last[np.searchsorted(last, np.arange(n))] + 1
    parent = list(range(n))
    flat = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, here, step = [], np.arange(n), 0
    while True:
        step += 1
        here = here[end[here] - here > step]
        if not len(here):
            return links
        x = fp[here] ^ fp[here + step]
        shared = (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)  # the tally of positional bytes
        ok = shared >= MIN_SHARED
        a, x = here[ok], x[ok]
        a = a[np.bitwise_count(x) <= BITS]  # verified
        a = a[flat[a] != flat[a + step]]
        for i in a.tolist():
            p, q = find(i), find(i + step)
            if p != q:
                parent[max(p, q)] = min(p, q)
                links.append((i, i + step))
        if len(a):
            flat = np.array([find(i) for i in range(n)]) if n <= 4 * BLOCK else flat


def near_links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (src, dst) between distinct fingerprints of nodes (fp) that join everything within BITS bits."""
    byte = lambda p: F.shiftrightunsigned("fp", 56 - 8 * p).bitwiseAND(F.lit(255))
    key = lambda k, t: sum((byte(p) * (1 << (8 * j)) for j, p in enumerate(t)), F.lit(k << 24))
    entries = nodes.select("fp", F.explode(F.array(*[key(k, t).cast("long") for k, t in enumerate(TRIPLES)])).alias("posting"))
    sizes = entries.groupBy("posting").agg(F.count("*").alias("n")).where("n > 1")
    dealt = entries.join(sizes, "posting").withColumn("blocks", F.ceil(F.col("n") / block))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pairs = dealt.withColumn("own", own).withColumn("other", other)
    pairs = pairs.select("posting", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "fp")
    pairs = pairs.repartition("posting", "b1", "b2").sortWithinPartitions("posting", "b1", "b2", "fp")
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def run(batches):
        rest = None
        for b in batches:
            cols = [c.to_numpy() for c in b.columns]
            if rest is not None:
                cols = [np.concatenate(p) for p in zip(rest, cols, strict=True)]
            change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
            whole = change[-1] if len(change) else 0
            rest = [c[whole:] for c in cols]
            if whole:
                yield emit(cols[3][:whole], change[:-1], whole)
        if rest is not None:
            yield emit(rest[3], np.array([], int), len(rest[3]))

    def emit(fp, starts, n):
        group = np.zeros(n, np.int64)
        group[starts] = 1
        links = np.array(links_of(fp.view(np.uint64), np.cumsum(group)), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(fp[links[:, 0]]), pa.array(fp[links[:, 1]])], schema=schema)

    return pairs.mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of at most BITS bits."""
    marks = cut(fingerprints(docs, text), "simhash")
    nodes = cut(marks.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    parts = connected_components(near_links(nodes.select("fp")))
    joined = nodes.join(parts, nodes["fp"] == parts["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = joined.join(least, "component").select(F.col("fp").alias("n_fp"), "component_id")
    return marks.join(named, F.col("fp") == F.col("n_fp")).select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
