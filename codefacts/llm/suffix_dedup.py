"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller doc_id go.

The suffix order is needed only as far as its first SPAN bytes, so the difference-cover construction stops there:

1. Sample. Suffixes at positions whose remainder modulo 13 lies in a difference cover of four residues are sampled. Any two
   equal 50-byte strings have, at one shift below 13, a sampled position in both; the 38 bytes from there are equal too.
2. Discard. A sampled suffix is named by a hash of its first 38 bytes. Names that only one document holds are unique, so
   their suffixes need no order. Equal strings have equal names, so this drops nothing that repeats.
3. Sort the sampled tuples. The rest travel with the bytes around them, 12 before the 38 and 12 behind, and are dealt to
   buckets by name; each bucket is sorted by its 38 bytes. Neighbours that agree in all bytes are one group.
4. Merge the remaining suffixes. The thirteen 50-byte strings that hold a sampled tuple start up to 12 bytes before it. Two of
   one group and one shift are equal if the bytes left and right of the tuple are. Groups are sorted by what stands left,
   read backwards, and by what stands right; the lengths of the prefixes that neighbours share rank the strings of all
   thirteen shifts at once.
5. Compare. A string that also starts in a smaller document goes. Only bytes decide here, hashes only bring them together.

Documents with equal texts are found first: all but the smallest go whole, and only the smallest takes part. Texts travel
in pieces that overlap by 49 bytes, so a document of any length is dealt over many chunks. A chunk sends each name, and each
tuple with equal surroundings, once, so a passage in a third of all documents costs one entry for each chunk. Buckets
grow in number with the input, without a limit.

Rows are told apart by doc_id and a digest of their text; doc_id alone says which document is smaller.

Cases: null texts are empty; texts under 50 bytes stay whole; matches never cross documents; documents with one doc_id
are not smaller than each other, and a null doc_id is larger than all others; an empty table gives no rows; columns of
docs that are named like a result give way to it.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import and_fields, cut, drop_cut, release, small_batches, text_batches

SPAN, NAMED = 50, 38
#: A perfect difference set: every remainder modulo 13 is the difference of two of these.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: How far before a sampled tuple a string of SPAN bytes that holds it can start.
REACH = MODULUS - 1
CHUNK, NO_ID = 1 << 20, (1 << 63) - 1
#: Bytes of text for each bucket of names and of tuples.
NAME_BUCKET, TUPLE_BUCKET = 1 << 22, 1 << 21
LAST = (1 << 31) - 1
CHUNK_SCHEMA = "chunk long, docs binary, marks binary, starts binary, lens binary, data binary"
#: Bytes of a text's digest.
MARK = 16
RESULTS = ("kept", "n_bytes", "n_removed", "n_spans")


def packed(x, kind=np.int64) -> bytes:
    return np.asarray(x, kind).tobytes()


def blob(data: bytes) -> bytes:
    """Compressed bytes, their length first."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True) if data else b""


def unblob(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True) if data else b""


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def arrow(**kinds) -> pa.Schema:
    return pa.schema(list(kinds.items()))


def rows_of(batches):
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)
    pa.default_memory_pool().release_unused()  # the worker lives on, in other stages


# ---- pieces and chunks


def in_pieces(docs: DataFrame, piece: int) -> DataFrame:
    """(doc_id, mark, start, data): texts of SPAN bytes and more, cut so that each string of SPAN bytes starts in one piece."""
    cuts = F.sequence(F.lit(0).cast("long"), F.floor((F.octet_length("data") - SPAN) / piece))
    one = lambda k: F.struct((k * piece).alias("start"), F.substring("data", (k * piece + 1).cast("int"), F.lit(piece + SPAN - 1)).alias("data"))
    found = docs.where(F.octet_length("data") >= SPAN).select("doc_id", "mark", F.explode(F.transform(cuts, one)).alias("p"))
    return found.select("doc_id", "mark", "p.start", "p.data")


def pack(pieces: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """Rows (doc_id, mark, start, data) as chunks of about chunk_bytes; a piece is never cut."""
    schema = arrow(chunk=pa.int64(), docs=pa.binary(), marks=pa.binary(), starts=pa.binary(), lens=pa.binary(), data=pa.binary())

    def run(batches):
        at, n = TaskContext.get().partitionId() << 32, 0
        held, size = [], 0

        def chunk():
            docs, marks, starts, data = zip(*held, strict=True)
            return batch(schema, [(at + n, packed(docs), b"".join(marks), packed(starts), packed([len(d) for d in data]), blob(b"".join(data)))])

        for row in rows_of(batches):
            held.append(row)
            size += len(row[3])
            if size >= chunk_bytes:
                yield chunk()
                n += 1
                held, size = [], 0
        if held:
            yield chunk()

    return pieces.select("doc_id", "mark", "start", "data").mapInArrow(run, CHUNK_SCHEMA)


class Chunk:
    """A chunk's pieces in one buffer, and its sampled tuples."""

    def __init__(self, row):
        self.id, docs, marks, starts, lens, data = row
        self.docs, self.starts, self.lens = (np.frombuffer(x, np.int64) for x in (docs, starts, lens))
        self.marks = [marks[k : k + MARK] for k in range(0, len(marks), MARK)]
        # Room for a tuple's surroundings on both sides.
        self.data = np.frombuffer(bytes(REACH) + unblob(data) + bytes(SPAN + 8), np.uint8)
        self.first = np.cumsum(self.lens) - self.lens + REACH
        at = np.concatenate([np.arange(r, int(self.lens.sum()), MODULUS) for r in COVER])
        piece = np.repeat(np.arange(len(self.lens), dtype=np.int32), self.lens)[at]
        inside = at + REACH + NAMED <= (self.first + self.lens)[piece]
        self.at, self.piece = at[inside] + REACH, piece[inside]
        self.name = names(self.data, self.at)
        self.doc = self.docs[self.piece]

    def grouped(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order by name, the group of each place in that order, and where groups start."""
        order = np.argsort(self.name)
        n = self.name[order]
        new = np.append(True, n[1:] != n[:-1])
        return order, np.cumsum(new) - 1, np.flatnonzero(new)


def names(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of the NAMED bytes at each position."""
    words = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    name, by = np.full(len(at), 0x243F6A8885A308D3, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for k in sorted({*range(0, NAMED - 7, 8), NAMED - 8}):
        name ^= words[at + k]
        name *= by
        name ^= name >> np.uint64(29)
    name *= np.uint64(0xBF58476D1CE4E5B9)
    name ^= name >> np.uint64(32)
    return name


def bucket_of(name: np.ndarray, buckets: int) -> np.ndarray:
    """Names dealt to buckets in their own order."""
    return ((name >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def by_bucket(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of runs of equal buckets."""
    if not len(bucket):
        return []
    edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]).tolist()
    return [(int(bucket[a]), a, z) for a, z in zip(edges[:-1], edges[1:], strict=True)]


# ---- names: which of a chunk's are held elsewhere


def own_names(chunk: Chunk):
    """The chunk's names once, in order; whether two of its documents have each; the place of each sampled tuple among them."""
    order, group, start = chunk.grouped()
    doc = chunk.doc[order]
    two = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
    place = np.empty(len(order), np.int64)
    place[order] = group
    return chunk.name[order[start]], two, place


def emit_names(chunks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, names): for each chunk and bucket the low halves of the chunk's names, each once."""
    schema = arrow(bucket=pa.int32(), chunk=pa.int64(), names=pa.binary())

    def run(batches):
        for row in rows_of(batches):
            chunk = Chunk(row)
            if len(chunk.at):
                name, _, _ = own_names(chunk)
                low = name.astype(np.uint32)
                yield batch(schema, [(b, chunk.id, low[x:y].tobytes()) for b, x, y in by_bucket(bucket_of(name, buckets))])

    return chunks.mapInArrow(run, "bucket int, chunk long, names binary")


def shared_names(sent: DataFrame, tasks: int) -> DataFrame:
    """(chunk, step, bucket, bits): for each name of a chunk whether another chunk has it."""
    schema = arrow(chunk=pa.int64(), step=pa.int32(), bucket=pa.int32(), bits=pa.binary())

    def run(batches):
        for bucket, own in groupby(rows_of(batches), key=lambda r: r[0]):
            rows = list(own)
            parts = [np.frombuffer(r[2], np.uint32) for r in rows]
            name = np.concatenate(parts)
            order = np.argsort(name)
            n = name[order]
            same = n[1:] == n[:-1]
            mark = np.empty(len(n), bool)
            mark[order] = np.append(same, False) | np.append(False, same)
            found = np.split(mark, np.cumsum([len(p) for p in parts])[:-1])
            yield batch(schema, [(r[1], 0, bucket, np.packbits(m).tobytes()) for r, m in zip(rows, found, strict=True) if m.any()])

    return sent.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "chunk long, step int, bucket int, bits binary")


# ---- tuples: which strings around them start in a smaller document too


class Tuples:
    """The chunk's tuples whose name is held by another document: each with equal surroundings once, in groups."""

    def __init__(self, chunk: Chunk, buckets: int, told: dict[int, bytes], name_buckets: int):
        name, keep, place = own_names(chunk)
        for b, x, y in by_bucket(bucket_of(name, name_buckets)):
            if b in told:
                keep[x:y] |= np.unpackbits(np.frombuffer(told[b], np.uint8), count=y - x).astype(bool)
        hit = np.flatnonzero(keep[place])
        at, piece = chunk.at[hit], chunk.piece[hit]
        begin = chunk.first[piece]
        left, right = np.minimum(at - begin, REACH), np.minimum(begin + chunk.lens[piece] - at - NAMED, REACH)
        around = np.empty((len(hit), 64), np.uint8)
        for k in range(REACH + SPAN):
            around[:, k] = chunk.data[at + (k - REACH)]
        for k in range(REACH):  # bytes of other pieces don't count
            around[:, k][left < REACH - k] = 0
            around[:, SPAN + k][right <= k] = 0
        around[:, 62], around[:, 63] = left, right
        words = around.view(np.uint64)
        full = chunk.name[hit].copy()
        for k in (0, 1, 6, 7):
            full ^= words[:, k]
            full *= np.uint64(0xD6E8FEB86659FD93)
            full ^= full >> np.uint64(32)
        # By bucket and name, so that the groups of a bucket stand together; inside by all 64 bytes' hash.
        order = np.lexsort((full, chunk.name[hit]))
        new = np.ones(len(order), bool)
        for k in range(8):
            w = words[:, k][order]
            new[1:] &= w[1:] == w[:-1]  # so far: equal to the one before
        new[1:] = ~new[1:]
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        doc = chunk.doc[hit][order]
        self.least = np.minimum.reduceat(doc, start) if len(start) else doc
        self.later = doc > self.least[group]
        self.around, self.at, self.group = around[order[start]], at[order], group
        self.runs = by_bucket(bucket_of(chunk.name[hit][order[start]], buckets))


def windows(around: np.ndarray) -> np.ndarray:
    """Which of the strings that hold a tuple lie in its piece: bit k for the one that starts k bytes before it."""
    left, right = around[:, 62].astype(np.int64), around[:, 63].astype(np.int64)
    k = np.arange(REACH + 1)
    return (((k <= left[:, None]) & (REACH - k <= right[:, None])) << k).sum(axis=1).astype(np.uint16)


def emit_tuples(answered: DataFrame, buckets: int, name_buckets: int) -> DataFrame:
    schema = arrow(bucket=pa.int32(), chunk=pa.int64(), around=pa.binary(), least=pa.binary())

    def run(batches):
        for chunk, told, _ in stream(batches):
            t = Tuples(chunk, buckets, told, name_buckets)
            for k in range(0, len(t.runs), 64):
                yield batch(schema, [(b, chunk.id, blob(t.around[x:y].tobytes()), blob(t.least[x:y].tobytes())) for b, x, y in t.runs[k : k + 64]])

    return answered.mapInArrow(run, "bucket int, chunk long, around binary, least binary")


def big_endian(columns: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as numbers that sort alike, eight bytes each."""
    padded = np.zeros((len(columns), -(-columns.shape[1] // 8) * 8), np.uint8)
    padded[:, : columns.shape[1]] = columns
    return list(padded.view(">u8").astype(np.uint64).T)


def ranks(group: np.ndarray, side: np.ndarray) -> np.ndarray:
    """For each length 0 to REACH, numbers that are equal where the group and that many first bytes of side are."""
    order = np.lexsort((*reversed(big_endian(side)), group))
    g, s = group[order], side[order]
    differs = s[1:] != s[:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), REACH)
    shared[g[1:] != g[:-1]] = -1
    out = np.empty((REACH + 1, len(group)), np.int32)
    for k in range(REACH + 1):
        out[k, order] = np.append(0, np.cumsum(shared < k))
    return out


def later_windows(around: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each tuple the strings around it, as bits, that start in a smaller document's tuple too."""
    out = np.zeros(len(doc), np.uint16)
    core = big_endian(around[:, REACH : REACH + NAMED])
    order = np.lexsort(tuple(reversed(core)))  # by content
    new = np.append(True, np.any([c[order][1:] != c[order][:-1] for c in core], axis=0))
    group = np.empty(len(doc), np.int64)
    group[order] = np.cumsum(new) - 1
    many = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(many):
        return out
    rows, doc, group = around[many], doc[many], group[many]
    valid, found = windows(rows), np.zeros(len(many), np.uint16)
    left, right = ranks(group, rows[:, REACH - 1 :: -1][:, :REACH]), ranks(group, rows[:, REACH + NAMED : REACH + SPAN])
    for k in range(REACH + 1):
        has = np.flatnonzero(valid >> k & 1)
        if not len(has):
            continue
        string = left[k, has].astype(np.int64) * (len(many) + 1) + right[REACH - k, has]
        o = np.argsort(string)
        s = string[o]
        start = np.append(True, s[1:] != s[:-1])
        least = np.minimum.reduceat(doc[has[o]], np.flatnonzero(start))[np.cumsum(start) - 1]
        found[has[o[doc[has[o]] > least]]] |= np.uint16(1 << k)
    out[many] = found
    return out


def judged(sent: DataFrame, tasks: int) -> DataFrame:
    """(chunk, step, bucket, bits): for each tuple of a chunk the strings that start in a smaller document too."""
    schema = arrow(chunk=pa.int64(), step=pa.int32(), bucket=pa.int32(), bits=pa.binary())

    def run(batches):
        for bucket, own in groupby(rows_of(batches), key=lambda r: r[0]):
            rows = [(chunk, np.frombuffer(unblob(around), np.uint8).reshape(-1, 64), np.frombuffer(unblob(least), np.int64)) for _, chunk, around, least in own]
            bits = later_windows(np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]))
            found = np.split(bits, np.cumsum([len(r[2]) for r in rows])[:-1])
            yield batch(schema, [(r[0], 1, bucket, blob(b.tobytes())) for r, b in zip(rows, found, strict=True) if b.any()])

    return sent.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "chunk long, step int, bucket int, bits binary")


def with_answers(chunks: DataFrame, answers: DataFrame, tasks: int) -> DataFrame:
    """Chunks and their answers in one stream: for each chunk the answers, then the chunk itself."""
    none = F.lit(b"")
    a = answers.select("chunk", "step", "bucket", F.col("bits").alias("docs"), none.alias("marks"), none.alias("starts"), none.alias("lens"), none.alias("data"))
    c = chunks.select("chunk", F.lit(2).alias("step"), F.lit(LAST).alias("bucket"), "docs", "marks", "starts", "lens", "data")
    return a.unionByName(c).repartition(tasks, "chunk").sortWithinPartitions("chunk", "step", "bucket")


def stream(batches):
    """(chunk, {bucket: bits of names}, {bucket: bits of tuples}) from with_answers, where a chunk has tuples."""
    told: tuple[dict, dict] = ({}, {})
    of = None
    for id_, step, bucket, docs, *rest in rows_of(batches):
        if of != id_:
            of, told = id_, ({}, {})
        if step < 2:
            told[step][bucket] = docs
        else:
            chunk = Chunk((id_, docs, *rest))
            if len(chunk.at):
                yield chunk, *told


def covered(starts: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Maximal runs [from, to) that strings of span bytes at the sorted starts cover; runs that touch are one."""
    if not len(starts):
        return []
    new = np.append(True, starts[1:] - starts[:-1] > span)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return list(zip(starts[first].tolist(), (starts[last] + span).tolist(), strict=True))


def removed_runs(answered: DataFrame, buckets: int, name_buckets: int) -> DataFrame:
    """(doc_id, mark, runs): packed pairs [from, to) that go, for each piece of a document."""
    schema = arrow(doc_id=pa.int64(), mark=pa.binary(), runs=pa.binary())

    def run(batches):
        for chunk, names_told, told in stream(batches):
            t = Tuples(chunk, buckets, names_told, name_buckets)
            bits = np.zeros(len(t.least), np.uint16)
            for b, x, y in t.runs:
                if b in told:
                    bits[x:y] = np.frombuffer(unblob(told[b]), np.uint16)
            # An equal tuple of a smaller document in this chunk settles all its strings.
            own = np.where(t.later, windows(t.around)[t.group], bits[t.group])
            gone = np.zeros(len(chunk.data), bool)
            for k in range(REACH + 1):
                gone[t.at[(own >> k & 1).astype(bool)] - k] = True
            starts = np.flatnonzero(gone)
            piece = np.searchsorted(chunk.first, starts, side="right") - 1
            rows = [(int(chunk.docs[p]), chunk.marks[p], packed(covered(starts[x:y] - chunk.first[p] + chunk.starts[p], SPAN))) for p, x, y in by_bucket(piece)]
            if rows:
                yield batch(schema, rows)

    return answered.mapInArrow(run, "doc_id long, mark binary, runs binary")


def merge_runs(packed_runs: list[bytes]) -> list[tuple[int, int]]:
    """Sorted, disjoint runs from packed ones; runs that touch are one."""
    if not packed_runs:
        return []
    runs = np.concatenate([np.frombuffer(p, np.int64).reshape(-1, 2) for p in packed_runs])
    out: list[list[int]] = []
    for a, z in runs[np.argsort(runs[:, 0], kind="stable")].tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [tuple(x) for x in out]


def row_key(text: str = "text") -> list:
    """doc_id (null as NO_ID) and the text's digest. Rows that share both lose the same bytes, so they need no other key."""
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.unhex(F.md5(data))]


def repeated_runs(docs: DataFrame, text: str = "text", chunk_bytes: int = CHUNK) -> DataFrame:
    """(k_id, k_mark, copy, runs): texts that lose bytes. copy: the whole text goes; runs: packed runs, an array of parts."""
    spark = docs.sparkSession
    doc_id, mark = row_key(text)
    d = docs.select(doc_id.alias("doc_id"), mark.alias("mark"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("data")).where(F.octet_length("data") >= SPAN)
    whole = cut(d.select("doc_id", "mark", F.octet_length("data").alias("n")), "dedup-digests")
    size = whole.agg(F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0))).first()[0]
    name_buckets, buckets, tasks = (max(12, -(-size // x)) for x in (NAME_BUCKET, TUPLE_BUCKET, 1 << 24))
    least = whole.groupBy("mark", "n").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).where("copies > 1")
    copies = cut(whole.join(least, ["mark", "n"]).where("doc_id > least").select("doc_id", "mark").distinct(), "dedup-copies")
    drop_cut(whole)
    with small_batches(spark):
        chunks = cut(pack(in_pieces(d.join(copies, ["doc_id", "mark"], "left_anti"), chunk_bytes), chunk_bytes), "dedup-chunks", blobs=True)
        release(spark)
        told = cut(shared_names(emit_names(chunks, name_buckets), tasks), "dedup-names", blobs=True)
        release(spark)
        bits = cut(judged(emit_tuples(with_answers(chunks, told, tasks), buckets, name_buckets), tasks), "dedup-tuples", blobs=True)
        release(spark)
        runs = cut(removed_runs(with_answers(chunks, told.unionByName(bits), tasks), buckets, name_buckets), "dedup-runs", blobs=True)
        for x in (chunks, told, bits):
            drop_cut(x)
        del chunks, told, bits
        release(spark)
    # A set: rows repeated with their doc_id bring the same runs again.
    parts = runs.groupBy("doc_id", "mark").agg(F.collect_set("runs").alias("runs"))
    found = parts.select(F.col("doc_id").alias("k_id"), F.col("mark").alias("k_mark"), F.lit(False).alias("copy"), "runs")
    whole_ones = copies.select(F.col("doc_id").alias("k_id"), F.col("mark").alias("k_mark"), F.lit(True).alias("copy"), F.array().cast("array<binary>").alias("runs"))
    return found.unionByName(whole_ones)


def cut_out(data: bytes, copy: bool | None, packed_runs: list[bytes] | None) -> tuple[bytes, list[tuple[int, int]]]:
    """What remains of a text, and the runs that went."""
    if copy:
        return b"", [(0, len(data))] if data else []
    runs = merge_runs(packed_runs or [])
    at, keep = 0, []
    for a, z in runs:
        keep.append(data[at:a])
        at = z
    keep.append(data[at:])
    return b"".join(keep), runs


def with_runs(docs: DataFrame, keep: list[str], text: str, chunk_bytes: int) -> DataFrame:
    """The columns keep of docs, then __data, __copy and __runs: the text's bytes and what goes."""
    runs = repeated_runs(docs, text, chunk_bytes)
    text_batches(docs.sparkSession)
    doc_id, mark = row_key(text)
    joined = docs.join(runs, (doc_id == F.col("k_id")) & (mark == F.col("k_mark")), "left")
    return joined.select(*[docs[c] for c in keep], F.coalesce(docs[text].cast("binary"), F.lit(b"")).alias("__data"), runs["copy"].alias("__copy"), runs["runs"].alias("__runs"))


def cut_batches(batches, keep: int):
    """(batch, texts' bytes, [(what remains, runs)]) of some rows at a time."""
    for whole in batches:
        for b in (whole.slice(k, 256) for k in range(0, whole.num_rows, 256)):
            data, copy, gone = (b.column(keep + k).to_pylist() for k in range(3))
            yield b, data, [cut_out(*x) for x in zip(data, copy, gone, strict=True)]


def dedup(docs: DataFrame, text: str = "text", chunk_bytes: int = CHUNK) -> DataFrame:
    """docs with `kept` (the remaining bytes, as binary), `n_bytes`, `n_removed` and `n_spans` added; all rows stay."""
    keep = [c for c in docs.columns if c not in RESULTS]
    schema = and_fields(docs.select(*keep).schema, "kept binary, n_bytes long, n_removed long, n_spans long")

    def run(batches):
        for b, data, done in cut_batches(batches, len(keep)):
            cols = [pa.array([k for k, _ in done], pa.binary()), pa.array([len(x) for x in data], pa.int64()), pa.array([sum(z - a for a, z in r) for _, r in done], pa.int64()), pa.array([len(r) for _, r in done], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *cols], names=[*keep, *RESULTS])

    return with_runs(docs, keep, text, chunk_bytes).mapInArrow(run, schema)


def digests(docs: DataFrame, text: str = "text", chunk_bytes: int = CHUNK) -> DataFrame:
    narrow = docs.select("doc_id", F.col(text).alias("text"))
    return dedup(narrow, chunk_bytes=chunk_bytes).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, text: str = "text", chunk_bytes: int = CHUNK) -> DataFrame:
    """docs with the remaining bytes as text (a character that is cut goes whole) and n_chars, if there, to match."""
    names = list(docs.columns)
    keep = [c for c in names if c != text]  # the bytes that travel are the text
    given = with_runs(docs.withColumn("__none", F.col(text).isNull()), [*keep, "__none"], text, chunk_bytes)

    def run(batches):
        for b, _, done in cut_batches(batches, len(keep) + 1):
            none = b.column(len(keep)).to_pylist()
            texts = [None if n else k.decode("utf-8", "ignore") for (k, _), n in zip(done, none, strict=True)]
            new = dict(zip(keep, b.columns, strict=False)) | {text: pa.array(texts, pa.string())}
            if "n_chars" in keep:
                new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new[c] for c in names], names=names)

    return given.mapInArrow(run, docs.schema)
