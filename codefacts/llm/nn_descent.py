"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries walk it greedily.

Equal vectors are one node. Lists start from leaves of random hyperplanes: nodes on the same side of all planes of a tree
meet in one leaf, large leaves cut by hash. Each round joins neighbours of neighbours: every node is sent to the nodes it
lists and to those that list it, each such centre compares what it got, pairs with a new member only, and a pair goes back
only if it beats the worst of the list it is for. Rounds end when few lists change. A centre above MEETING members splits
into meetings by a hash that changes each round, so a hub costs pairs in proportion to its degree. For largest inner
products the vectors get one more component that makes their lengths equal (a no-op for unit vectors); the search itself
scores the original vectors in double precision. A query's beam starts from its own node's list; each step scores all
neighbours, in both directions, of the best nodes of the beam that weren't expanded. A query ends when its SETTLED best nodes
(its k, if more) are all expanded, however many steps that takes: no node left to expand stands among its nearest then.

The index holds every vector; recall against brute force is measured in the tests and the README. Memory is bounded by one
leaf, or one block of nodes with what its centres' neighbours send it. Nodes live in blocks of about BLOCK_OF_NODES by a hash of
their id, and blocks send each other packed messages, a row for each two blocks of a task. Cases: vectors that are null, zero or hold null or non-finite components take no part; shorter
vectors count as ending in zeros; equal scores go by vec_id; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, release, small_batches

LIST, LEAF, TREES, MEETING, BEAM, EXPAND, SETTLED = 64, 512, 8, 160, 64, 16, 32
SEED = 20240229
BLOCK_OF_NODES = 2048
LISTS = "id long, nbrs binary, scores binary, fresh binary"
LISTS_ARROW = pa.schema([("id", pa.int64()), ("nbrs", pa.binary()), ("scores", pa.binary()), ("fresh", pa.binary())])
PACKED = "block long, kind int, a binary, b binary, c binary, d binary, e binary"
PACKED_ARROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in "abcde")])
STATE, LISTED, SENT, FOUND = range(4)
ENTRY = np.dtype([("v", np.int64), ("s", np.float32), ("f", np.uint8)])
LINK = np.dtype([("member", np.int64), ("centre", np.int64), ("f", np.uint8)])
PAIR = np.dtype([("q", np.int64), ("id", np.int64)])
SCORED = np.dtype([("q", np.int64), ("id", np.int64), ("s", np.float64), ("x", np.uint8)])


def groups(batches, keys: int):
    """Lists of columns, one for each run of rows with equal first `keys` columns (integers), over batch borders."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if not t.num_rows:
            continue
        k = [t.column(i).to_numpy() for i in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in k], axis=0)) + 1
        for x, y in zip(np.append(0, change[:-1]), change, strict=False) if len(change) else ():
            yield t.slice(x, y - x)
        rest = t.slice(change[-1] if len(change) else 0)
    if rest is not None and rest.num_rows:
        yield rest


def matrix(column, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def best_of(u: np.ndarray, v: np.ndarray, s: np.ndarray, k: int, fresh: np.ndarray | None = None) -> np.ndarray:
    """Where the k best v of each u stand, once each, by u and rank; of equal entries an old one (fresh 0) stays."""
    order = np.lexsort((v, u) if fresh is None else (fresh, v, u))
    x, y = u[order], v[order]
    order = order[np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))] if len(order) else order
    order = order[np.lexsort((v[order], -s[order], u[order]))]
    x = u[order]
    start = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.array([], int)
    rank = np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x))))
    return order[rank < k]


def block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks


def row(block: int, kind: int, *parts: np.ndarray) -> pa.RecordBatch:
    cells = [np.ascontiguousarray(x).tobytes() for x in parts] + [b""] * (5 - len(parts))
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([kind], pa.int32())] + [pa.array([c], pa.binary()) for c in cells], schema=PACKED_ARROW)


def split(at: np.ndarray, *columns: np.ndarray):
    """(block, columns of that block) for each block in at."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    start = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else ()
    for x, y in zip(start, np.append(start[1:], len(at)), strict=True) if len(at) else ():
        yield int(at[x]), [c[order[x:y]] for c in columns]


def found_rows(u: list, v: list, s: list, k: int, blocks: int):
    """Pairs found, as messages to the blocks of their u."""
    u, v, s = np.concatenate(u), np.concatenate(v), np.concatenate(s).astype(np.float32)
    best = best_of(u, v, s, k)
    for to, cols in split(block_of(u[best], blocks), u[best], v[best], s[best]):
        yield row(to, FOUND, *cols)


def cells(g, kind: int, i: int, of) -> np.ndarray:
    """Part i of all rows of a kind in a block's group, as one array."""
    take = g.column(1).to_numpy() == kind
    return np.frombuffer(b"".join(c for c, t in zip(g.column(2 + i).to_pylist(), take, strict=True) if t), of)


def by_block(rows: DataFrame, run, blocks: int) -> DataFrame:
    """Run on each block's rows. Twice as many tasks as blocks, so that few tasks get several blocks."""
    return rows.repartition(2 * blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(run, PACKED)


def packed(halves: DataFrame, blocks: int) -> DataFrame:
    """One row a block: ids, half vectors, and lists (lengths, entries of (nbr, score, fresh)), which are empty yet."""

    def deal(batches):
        for b in batches:
            ids, x = b.column(0).to_numpy(), matrix(b.column(1), np.uint8, len(b.column(1)[0].as_py())) if b.num_rows else None
            for to, cols in split(block_of(ids, blocks), ids, x) if b.num_rows else ():
                yield row(to, STATE, *cols)

    def gather(batches):
        for g in groups(batches, 1):
            ids = cells(g, STATE, 0, np.int64)
            yield row(g.column(0)[0].as_py(), STATE, ids, cells(g, STATE, 1, np.uint8), np.zeros(len(ids), np.int32))

    return by_block(halves.mapInArrow(deal, PACKED), gather, blocks)


def updated(state: DataFrame, found: DataFrame, k: int, blocks: int) -> DataFrame:
    """The blocks with one list of the k best for each node from its old list and what was found; old entries aren't fresh."""

    def run(batches):
        for g in groups(batches, 1):
            ids, n = cells(g, STATE, 0, np.int64), cells(g, STATE, 2, np.int32)
            old = cells(g, STATE, 3, ENTRY)
            order = np.argsort(ids)
            at = order[np.searchsorted(ids, cells(g, FOUND, 0, np.int64), sorter=order)]
            u = np.concatenate([np.repeat(np.arange(len(ids)), n), at])
            v = np.concatenate([old["v"], cells(g, FOUND, 1, np.int64)])
            s = np.concatenate([old["s"], cells(g, FOUND, 2, np.float32)])
            fresh = np.repeat(np.array([0, 1], np.uint8), [len(old), len(at)])
            best = best_of(u, v, s, k, fresh)
            new = np.empty(len(best), ENTRY)
            new["v"], new["s"], new["f"] = v[best], s[best], fresh[best]
            yield row(g.column(0)[0].as_py(), STATE, ids, cells(g, STATE, 1, np.uint8), np.bincount(u[best], minlength=len(ids)).astype(np.int32), new, fresh[best].sum(keepdims=True, dtype=np.int64))

    return by_block(state.unionByName(found), run, blocks)


def clean_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, vec): the vectors that take part, as packed doubles without trailing zeros."""
    given = table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    given = given.where("size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(e, x -> x <> 0)")

    def run(batches):
        for b in batches:
            flat, at = b.column(1).flatten().to_numpy(), np.append(0, np.cumsum(b.column(1).value_lengths().to_numpy()))
            vec = [(np.trim_zeros(flat[x:z], "b") + 0.0).tobytes() for x, z in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vec, pa.binary())], names=["vec_id", "vec"])

    return given.mapInArrow(run, "vec_id long, vec binary")


def prepare(nodes: DataFrame, width: int, longest: float) -> DataFrame:
    """(id, half): padded vectors of equal length as half floats of scale 1, for building the graph."""

    def run(batches):
        for b in batches:
            x = np.zeros((b.num_rows, width + 1))
            for i, v in enumerate(b.column(1).to_pylist()):
                x[i, : len(v) // 8] = np.frombuffer(v)
            x /= longest
            x[:, width] = np.sqrt(np.maximum(1 - (x * x).sum(1), 0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["id", "half"])

    return nodes.select("id", "vec").mapInArrow(run, "id long, half binary")


def first_lists(halves: DataFrame, n: int, width: int, k: int, blocks: int) -> DataFrame:
    """Pairs from the leaves of TREES trees of random hyperplanes, as messages to blocks."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / LEAF)))
    planes = np.random.default_rng(SEED).standard_normal((width, TREES * bits)).astype(np.float32)

    def leaves(batches):
        for b in batches:
            x = matrix(b.column(1), np.float16, width).astype(np.float32)
            x = x - 0  # planes go through the origin
            side = ((x @ planes) > 0).reshape(len(x), TREES, bits)
            leaf = side @ (1 << np.arange(bits, dtype=np.int64)) + (np.arange(TREES, dtype=np.int64) << 40)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(leaf.reshape(len(x), -1).ravel(), 1)), pa.array(np.repeat(b.column(0).to_numpy(), TREES))], names=["leaf", "id"])

    def meet(batches):
        u, v, s, held = [], [], [], 0
        for g in groups(batches, 2):
            ids, x = g.column(2).to_numpy(), matrix(g.column(3), np.float16, width).astype(np.float32)
            m = len(ids)
            if m < 2:
                continue
            score = x @ x.T
            np.fill_diagonal(score, -np.inf)
            best = np.argpartition(-score, min(k, m - 1) - 1, axis=1)[:, : min(k, m - 1)]
            u.append(np.repeat(ids, best.shape[1])), v.append(ids[best].ravel()), s.append(np.take_along_axis(score, best, 1).ravel())
            held += len(u[-1])
            if held > 400_000:
                yield from found_rows(u, v, s, k, blocks)
                u, v, s, held = [], [], [], 0
        if u:
            yield from found_rows(u, v, s, k, blocks)

    dealt = halves.mapInArrow(leaves, "leaf long, id long")
    sizes = dealt.groupBy("leaf").agg(F.ceil(F.count("*") / (2 * LEAF)).alias("parts"))
    dealt = dealt.join(sizes, "leaf").join(halves, "id").select("leaf", F.pmod(F.xxhash64("id", "leaf"), F.col("parts")).alias("part"), "id", "half")
    return dealt.repartition("leaf", "part").sortWithinPartitions("leaf", "part").mapInArrow(meet, PACKED)


def join_round(state: DataFrame, width: int, k: int, turn: int, blocks: int) -> DataFrame:
    """The next lists: neighbours of neighbours meet at their common neighbour.

    Nodes live in blocks, and blocks send each other packed messages: who lists whom, then each node's vector once to each
    block that holds a centre of it, then the pairs found, reduced to the best of each node.
    """

    def listed(batches):
        for g in groups(batches, 1):
            ids, old = cells(g, STATE, 0, np.int64), cells(g, STATE, 3, ENTRY)
            links = np.empty(len(old), LINK)
            links["member"], links["centre"], links["f"] = old["v"], np.repeat(ids, cells(g, STATE, 2, np.int32)), old["f"]
            for to, (some,) in split(block_of(old["v"], blocks), links):
                yield row(to, LISTED, some)

    def send(batches):
        for g in groups(batches, 1):
            ids, n, old, by = cells(g, STATE, 0, np.int64), cells(g, STATE, 2, np.int32), cells(g, STATE, 3, ENTRY), cells(g, LISTED, 0, LINK)
            x = cells(g, STATE, 1, np.float16).reshape(len(ids), width)
            last = np.cumsum(n) - 1
            least = np.full(len(ids), -np.inf, np.float32)
            least[n >= k] = old["s"][last[n >= k]]
            order = np.argsort(ids)
            # A node is a member at those it lists and at those that list it, each once, fresh if either entry is.
            u = np.concatenate([np.repeat(np.arange(len(ids)), n), order[np.searchsorted(ids, by["member"], sorter=order)]])
            c, f = np.concatenate([old["v"], by["centre"]]), np.concatenate([old["f"], by["f"]])
            by_pair = np.lexsort((-f.astype(np.int8), c, u))
            u, c, f = u[by_pair], c[by_pair], f[by_pair]
            once = np.append(True, (u[1:] != u[:-1]) | (c[1:] != c[:-1])) if len(u) else np.array([], bool)
            u, c, f = u[once], c[once], f[once]
            for to, (m, centre, fresh) in split(block_of(c, blocks), u, c, f):
                who = np.unique(m)
                links = np.empty(len(m), LINK)
                links["member"], links["centre"], links["f"] = ids[m], centre, fresh
                yield row(to, SENT, ids[who], x[who], least[who], links)

    def meet(batches):
        for g in groups(batches, 1):
            ids, order = np.unique(cells(g, SENT, 0, np.int64), return_index=True)
            x = cells(g, SENT, 1, np.float16).reshape(-1, width)[order]
            worst, links = cells(g, SENT, 2, np.float32)[order], cells(g, SENT, 3, LINK)
            links = links[np.argsort(links["centre"], kind="stable")]
            member, centre = np.searchsorted(ids, links["member"]), links["centre"]
            start = np.flatnonzero(np.append(True, centre[1:] != centre[:-1]))
            u, v, s, held = [], [], [], 0
            for a, z in zip(start, np.append(start[1:], len(centre)), strict=True):
                parts = -(-int(z - a) // MEETING)
                part = block_of(ids[member[a:z]] + (turn + 1) * 1_000_003, parts) if parts > 1 else None
                for p in range(parts):
                    here, fresh = member[a:z], links["f"][a:z]
                    if part is not None:
                        here, fresh = here[part == p], fresh[part == p]
                    if len(here) < 2 or not fresh.any():
                        continue
                    y = x[here].astype(np.float32)
                    score = y @ y.T
                    ok = (score > worst[here][:, None]) & ((fresh[:, None] | fresh[None, :]) > 0)
                    np.fill_diagonal(ok, False)
                    i, j = np.nonzero(ok)
                    u.append(here[i]), v.append(here[j]), s.append(score[i, j])
                    held += len(i)
                    if held > 1_000_000:
                        best = best_of(u := np.concatenate(u), v := np.concatenate(v), s := np.concatenate(s), k)
                        u, v, s, held = [u[best]], [v[best]], [s[best]], len(best)
                        if held > 500_000:
                            yield from found_rows([ids[u[0]]], [ids[v[0]]], s, k, blocks)
                            u, v, s, held = [], [], [], 0
            if held:
                yield from found_rows([ids[np.concatenate(u)]], [ids[np.concatenate(v)]], s, k, blocks)

    sent = by_block(state.unionByName(state.mapInArrow(listed, PACKED)), send, blocks)
    return updated(state, by_block(sent, meet, blocks), k, blocks)


def build(nodes: DataFrame, k: int = LIST) -> tuple[DataFrame, int]:
    """The neighbour graph over nodes (id, vec): lists (id, nbrs, scores, fresh), and how many nodes there are."""
    n, width, longest = nodes.select("vec", F.octet_length("vec").alias("w")).mapInArrow(_norms, "w long, norm double").agg(F.count("*"), F.coalesce(F.max("w"), F.lit(0)), F.max("norm")).first()
    width, blocks = width // 8, max(12, -(-n // BLOCK_OF_NODES))
    spark = nodes.sparkSession
    halves = cut(prepare(nodes, width, longest or 1.0), "nn-halves")
    pairs = cut(first_lists(halves, n, width + 1, k, blocks), "nn-pairs")

    def plain(batches):
        for g in groups(batches, 1):
            ids, old, end = cells(g, STATE, 0, np.int64), cells(g, STATE, 3, ENTRY), np.cumsum(cells(g, STATE, 2, np.int32))
            rows = [(i, e["v"].tobytes(), e["s"].tobytes(), e["f"].tobytes()) for i, e in zip(ids.tolist(), np.split(old, end[:-1]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), LISTS_ARROW, strict=True)], schema=LISTS_ARROW)

    with small_batches(spark, 16):  # rows hold a block, up to a few MB
        state = cut(updated(packed(halves, blocks), pairs, k, blocks), "nn-lists", blobs=True)
        for turn in itertools.count():  # scores only rise, so the changes run out
            old, state = state, cut(join_round(state, width + 1, k, turn, blocks), "nn-lists", blobs=True)
            drop_cut(old)
            release(spark)
            fresh = [int.from_bytes(r["e"], "little") for r in state.select("e").collect()]  # one number a block
            if sum(fresh) <= 0.005 * n * k:
                break
        return cut(state.mapInArrow(plain, LISTS), "nn-graph-lists"), n


def _norms(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int64()), pa.array([float(np.linalg.norm(np.frombuffer(v))) for v in b.column(0).to_pylist()], pa.float64())], names=["w", "norm"])


def ranks(x: np.ndarray) -> np.ndarray:
    """The place of each entry in its run of equal entries, from 0."""
    start = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.array([], int)
    return np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x))))


def distinct(pairs: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
    """The pairs, once each and sorted, without those seen."""
    old = 0 if seen is None else len(seen)
    pairs = pairs if seen is None else np.append(seen, pairs)
    order = np.lexsort((pairs["id"], pairs["q"]))  # stable: what was seen comes first
    x = pairs[order]
    once = np.append(True, (x["q"][1:] != x["q"][:-1]) | (x["id"][1:] != x["id"][:-1])) if len(x) else np.array([], bool)
    return x[once & (order >= old)]


def walk(nodes: DataFrame, lists: DataFrame, queries: DataFrame, n: int, k: int, beam: int = BEAM, settled: int = SETTLED) -> DataFrame:
    """(q, id, score) for queries (q, own node): the beam's nodes, scored exactly, after greedy steps on the graph.

    Queries with one own node share a walk, which lives in the block of that node; blocks of walks and of nodes send each other
    packed messages: nodes to expand, their neighbours, pairs to score, scores.
    """
    spark = nodes.sparkSession
    settled = max(k, settled)
    beam = max(beam, settled)
    blocks = max(12, -(-n // BLOCK_OF_NODES))
    width = (nodes.agg(F.max(F.octet_length("vec"))).first()[0] or 0) // 8

    def vectors(batches):
        for b in batches:
            ids, x = b.column(0).to_numpy(), np.zeros((b.num_rows, width))
            for i, v in enumerate(b.column(1).to_pylist()):
                x[i, : len(v) // 8] = np.frombuffer(v)
            for to, cols in split(block_of(ids, blocks), ids, x):
                yield row(to, STATE, *cols)

    def whole(batches):
        for g in groups(batches, 1):
            ids = cells(g, STATE, 0, np.int64)
            order = np.argsort(ids)
            yield row(g.column(0)[0].as_py(), STATE, ids[order], cells(g, STATE, 1, np.float64).reshape(len(ids), width)[order])

    def begin(batches):
        for g in groups(batches, 1):
            ids = cells(g, STATE, 0, np.int64)
            pairs = np.empty(len(ids), PAIR)
            pairs["q"] = pairs["id"] = ids
            yield row(g.column(0)[0].as_py(), STATE, ids, cells(g, STATE, 1, np.float64), np.empty(0, SCORED), pairs, pairs)

    def both_ways(batches):
        for b in batches:
            count = [len(x) // 8 for x in b.column(1).to_pylist()]
            pairs = np.empty(2 * sum(count), PAIR)
            u, v = np.repeat(b.column(0).to_numpy(), count), np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
            pairs["q"], pairs["id"] = np.append(u, v), np.append(v, u)
            for to, (some,) in split(block_of(pairs["q"], blocks), pairs):
                yield row(to, LISTED, some)

    def adjacent(batches):
        for g in groups(batches, 1):
            pairs = distinct(cells(g, LISTED, 0, PAIR))
            ids, count = np.unique(pairs["q"], return_counts=True)
            yield row(g.column(0)[0].as_py(), STATE, ids, count.astype(np.int64), pairs["id"])

    def ask(batches):
        for b in batches:
            for go in b.column(6).to_pylist():
                go = np.frombuffer(go, PAIR)
                for to, (some,) in split(block_of(go["id"], blocks), go):
                    yield row(to, SENT, some)

    def expand(batches):
        for g in groups(batches, 1):
            ids, count, flat, asked = cells(g, STATE, 0, np.int64), cells(g, STATE, 1, np.int64), cells(g, STATE, 2, np.int64), cells(g, SENT, 0, PAIR)
            if not len(asked) or not len(ids):
                continue
            at = np.minimum(np.searchsorted(ids, asked["id"]), len(ids) - 1)
            some = np.where(ids[at] == asked["id"], count[at], 0)
            pairs = np.empty(some.sum(), PAIR)
            pairs["q"] = np.repeat(asked["q"], some)
            pairs["id"] = flat[np.repeat((np.cumsum(count) - count)[at] - (np.cumsum(some) - some), some) + np.arange(len(pairs))]
            pairs = distinct(pairs)
            for to, (part,) in split(block_of(pairs["q"], blocks), pairs):
                yield row(to, FOUND, part)

    def wanted(batches):
        for g in groups(batches, 1):
            ids, x, seen = cells(g, STATE, 0, np.int64), cells(g, STATE, 1, np.float64), cells(g, STATE, 3, PAIR)
            new = distinct(cells(g, FOUND, 0, PAIR), seen)
            if not len(cells(g, STATE, 2, SCORED)):
                new = np.append(new, seen)  # the first step scores the own nodes, too
            x = x.reshape(len(ids), width)
            for to, (some,) in split(block_of(new["id"], blocks), new):
                who = np.isin(ids, some["q"])
                yield row(to, SENT, some, ids[who], x[who])

    def score(batches):
        for g in groups(batches, 1):
            ids, x, asked = cells(g, STATE, 0, np.int64), cells(g, STATE, 1, np.float64).reshape(-1, width), cells(g, SENT, 0, PAIR)
            who, first = np.unique(cells(g, SENT, 1, np.int64), return_index=True)
            y = cells(g, SENT, 2, np.float64).reshape(-1, width)[first]
            s = np.empty(len(asked))
            for a in range(0, len(asked), 16384):
                some = asked[a : a + 16384]
                s[a : a + 16384] = np.einsum("ij,ij->i", x[np.searchsorted(ids, some["id"])], y[np.searchsorted(who, some["q"])])
            best = best_of(asked["q"], asked["id"], s, beam)
            told = np.zeros(len(best), SCORED)
            told["q"], told["id"], told["s"] = asked["q"][best], asked["id"][best], s[best]
            for to, (part,) in split(block_of(told["q"], blocks), told):
                yield row(to, FOUND, part)

    def step(batches):
        for g in groups(batches, 1):
            new = cells(g, FOUND, 0, SCORED).copy()
            new["x"] = new["q"] == new["id"]
            seen = cells(g, STATE, 3, PAIR)
            more = np.empty(len(new), PAIR)
            more["q"], more["id"] = new["q"], new["id"]
            all_ = np.append(cells(g, STATE, 2, SCORED), new)
            all_ = all_[best_of(all_["q"], all_["id"], all_["s"], beam)]
            open_ = np.flatnonzero((ranks(all_["q"]) < settled) & (all_["x"] == 0))
            go = open_[ranks(all_["q"][open_]) < EXPAND]
            all_["x"][go] = 1
            front = np.empty(len(go), PAIR)
            front["q"], front["id"] = all_["q"][go], all_["id"][go]
            yield row(g.column(0)[0].as_py(), STATE, cells(g, STATE, 0, np.int64), cells(g, STATE, 1, np.float64), all_, distinct(np.append(seen, more)), front)

    def beams(batches):
        for b in batches:
            for some in b.column(4).to_pylist():
                some = np.frombuffer(some, SCORED)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(some[c])) for c in ("q", "id", "s")], names=["own", "id", "score"])

    with small_batches(spark, 1024):
        held = nodes.select("id", "vec").mapInArrow(vectors, PACKED)
        owns = nodes.select("id", "vec").join(queries.select(F.col("own").alias("id")).distinct(), "id", "left_semi").mapInArrow(vectors, PACKED)
        held, owns = cut(held, "nn-vecs", blobs=True), cut(owns, "nn-queries", blobs=True)
        linked = cut(lists.select("id", "nbrs").mapInArrow(both_ways, PACKED), "nn-links", blobs=True)
    with small_batches(spark, 8):  # rows hold a block, up to a few MB
        held, graph, state = cut(by_block(held, whole, blocks), "nn-blocks", blobs=True), cut(by_block(linked, adjacent, blocks), "nn-graph", blobs=True), cut(by_block(owns, begin, blocks), "nn-walks", blobs=True)
        for turn in itertools.count(1):
            if state.where("octet_length(e) > 0").isEmpty():
                break  # each step expands a node that a walk hasn't yet, so it comes to that
            pairs = by_block(graph.unionByName(state.mapInArrow(ask, PACKED)), expand, blocks)
            asked = by_block(state.unionByName(pairs), wanted, blocks)
            told = by_block(held.unionByName(asked), score, blocks)
            old, state = state, cut(by_block(state.unionByName(told), step, blocks), "nn-walks", blobs=True)
            drop_cut(old)
            if turn % 3 == 0:
                release(spark)
        found = cut(state.mapInArrow(beams, "own long, id long, score double"), "nn-beams")
    return queries.join(found, "own").select("q", "id", "score")


def nearest(table: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id is divisible by `every`."""
    rows = cut(clean_vectors(table).distinct(), "nn-vectors")
    same = rows.groupBy("vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    nodes = cut(same, "nn-nodes")
    lists, n = build(nodes.select("id", "vec"))
    named = rows.join(nodes.select("vec", "id"), "vec")
    asked = named.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("q"), F.col("id").alias("own"))
    found = walk(nodes.select("id", "vec"), lists, asked, n, k)
    # Of equal vectors, the k + 1 smallest vec_ids can appear in an answer at most.
    from pyspark.sql import Window

    small = named.select("id", "vec_id").withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).where(F.col("nth") <= k + 1).drop("nth")
    answers = found.join(small, "id").where("vec_id <> q")
    best = answers.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return best.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
