"""Suffix-array dedup, SimHash components and nearest neighbours against brute force."""

import hashlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from codefacts.llm import nn_descent, simhash, suffix_dedup


def brute_repeats(rows):
    """doc_id and text to (bytes, removed, spans, digest), by looking at every 50-byte string."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def test_suffix_dedup(corpus, docs_of):
    rows = [(r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").collect()]
    for chunk_bytes in (suffix_dedup.CHUNK, 500):
        got = sorted(map(tuple, suffix_dedup.digests(corpus.repartition(3), chunk_bytes=chunk_bytes).collect()))
        assert got == brute_repeats(rows)
    assert suffix_dedup.digests(docs_of([])).count() == 0
    kept = suffix_dedup.without_repeats(corpus)
    assert kept.columns == corpus.columns and kept.count() == corpus.count()


def test_suffix_dedup_of_rows_that_share_an_id(docs_of):
    """Rows of one id, or of none, lose their own repeats only, and none of them hides those of larger documents."""
    text = lambda seed, n=60: " ".join(f"{seed}{k * 37 % 101}" for k in range(n))
    a, b, c, d = text("a"), text("b"), text("c"), text("d")
    rows = [(1, a), (2, a), (2, b), (2, c[:150] + a[:90]), (3, b[:200] + d), (None, c), (None, a), (None, d), (None, d), (None, text("e", 9) + b[100:180]), (4, c), (None, None)]
    last = suffix_dedup.NO_ID
    want = brute_repeats([(last if i is None else i, t) for i, t in rows])
    docs = docs_of([(i, t, "en", "s", 0) for i, t in rows])
    for chunk_bytes in (suffix_dedup.CHUNK, 500):
        got = suffix_dedup.digests(docs.repartition(3), chunk_bytes=chunk_bytes).collect()
        assert sorted((last if r[0] is None else r[0], *r[1:]) for r in got) == want
        assert all(r["n_removed"] <= r["n_bytes"] for r in got)


def test_suffix_dedup_of_hard_texts(docs_of):
    """Texts of few letters, strings that differ in one byte at any place, repeats at every shift, and pieces of one document."""
    rng = np.random.default_rng(11)
    word = lambda letters, n: "".join(rng.choice(list(letters), n))
    base = word("abcdefgh", 400)
    rows = [(1, base), (2, "a" * 300), (3, "b" * 49), (4, "a" * 61 + "b" * 55), (5, word("ab", 600)), (6, word("ab", 500))]
    rows += [(10 + k, word("xyz", k) + base[k : k + 50] + word("xyz", 30)) for k in range(13)]
    rows += [(30 + k, base[60 : 60 + k] + "!" + base[61 + k : 180]) for k in range(0, 52, 3)]
    rows += [(60 + k, base[200 + k : 249 + k] + word("uvw", 20)) for k in range(4)]
    rows += [(70, base[:30] * 9), (71, base[:30] * 4 + "é" * 40), (72, "é" * 60)]
    want = brute_repeats(rows)
    docs = docs_of([(i, t, "en", "s", 0) for i, t in rows])
    for chunk_bytes in (100, 1000, suffix_dedup.CHUNK):
        assert sorted(map(tuple, suffix_dedup.digests(docs.repartition(2), chunk_bytes=chunk_bytes).collect())) == want


def test_equal_names_of_different_bytes():
    """Tuples that a hash brought together, though they differ, mark nothing: bytes decide."""
    around = np.zeros((4, 64), np.uint8)
    around[:, :62] = np.arange(62)
    around[:, 62:] = 12
    around[1, 30] = 200  # another tuple
    around[2, 5] = 200  # the same tuple, other bytes before it
    got = suffix_dedup.later_windows(around, np.array([1, 2, 3, 4]))
    assert got.tolist() == [0, 0, (1 << 7) - 1, (1 << 13) - 1]


def test_cover_holds_every_shift():
    cover = suffix_dedup.COVER
    assert {(a - b) % suffix_dedup.MODULUS for a in cover for b in cover} == set(range(suffix_dedup.MODULUS))
    assert suffix_dedup.MODULUS - 1 + suffix_dedup.NAMED <= suffix_dedup.SPAN


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    s = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def test_simhash(corpus, docs_of):
    rows = [(r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").distinct().collect()]
    fp = {i: brute_fingerprint(t) for i, t in rows}
    want = components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    got = simhash.near_duplicates(corpus).withColumn("fp", simhash.hex_fingerprint("fp")).collect()
    assert len(got) == corpus.count()
    for r in got:
        assert (r["fp"], r["component_id"]) == (f"{fp[r['doc_id']]:016x}", want[r["doc_id"]])
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_links_in_blocks(spark):
    """A ball of near fingerprints, cut into blocks, stays one component; far ones stay apart."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(1 << 62))
    ball = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (60, 2))}
    far = {int(x) for x in rng.integers(0, 1 << 62, 40)}
    nodes = spark.createDataFrame([(x,) for x in ball | far], "fp long")
    links = [tuple(r) for r in simhash.near_links(nodes, block=7).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links)
    edges = {frozenset(x) for x in links}
    want = components(sorted(ball | far), lambda a, b: (a ^ b).bit_count() <= 3)
    assert components(sorted(ball | far), lambda a, b: frozenset((a, b)) in edges) == want


def test_triples_meet_every_five_positions():
    from itertools import combinations

    assert all(any(set(t) <= set(five) for t in simhash.TRIPLES) for five in combinations(range(8), 5))


def test_lists_are_kept_by_block(spark, monkeypatch):
    """The rows written each round go with the blocks, not with nodes and their meetings; the lists hold the nearest nodes."""
    written, plain = {}, nn_descent.cut

    def counted(df, name="cut", **more):
        back = plain(df, name, **more)
        written.setdefault(name, []).append(back.count())
        return back

    monkeypatch.setattr(nn_descent, "cut", counted)
    x = np.random.default_rng(5).standard_normal((700, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    lists, n = nn_descent.build(spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "id long, vec binary"), 16)
    assert n == 700 and max(written["nn-lists"]) <= 12
    hit = 0
    for r in lists.collect():
        s = x @ x[r["id"]]
        s[r["id"]] = -np.inf
        hit += len(set(np.frombuffer(r["nbrs"], np.int64).tolist()) & set(np.argsort(-s)[:16].tolist()))
    assert hit >= 0.95 * 700 * 16


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[7], x[40], x[60] = x[3], x[3], 2 * x[60]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(400, None), (420, [0.0] * 8), (440, [1.0, None] + [0.0] * 6), (460, [float("nan")] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    got = nn_descent.nearest(table).collect()
    hit = 0
    for q in range(0, 300, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        best = np.lexsort((np.arange(300), -s))[:20]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-9 for r in own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        hit += len({r["vec_id"] for r in own} & set(best.tolist()))
    assert hit / 300 >= 0.9
    assert {r["query_id"] for r in got} == set(range(0, 300, 20))
    assert nn_descent.nearest(table.limit(0)).count() == 0
