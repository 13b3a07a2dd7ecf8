"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of a piece of text and a landmark counts the landmark's runs of three letters (word borders are letters too) that
the piece holds as subsequences, each discounted by the letters it skips, over all the landmark's runs: 1 for the landmark
itself, little less with letters inserted at one place or at all. A smooth step, never zero, turns it into a weight. The
kernel row of a text is the sum of these weights over its distinct pieces, for each landmark. Pieces are its words, words with
marks inside read as their letters too, runs of single letters as one word, and neighbours that might be one word cut in two.

Landmarks are pieces of the labelled texts: those that speak for label 1 beyond chance (a likelihood ratio test that allows
for the number of words tried), then, against them, the pieces of clean texts that are nearest to those. The rows, whitened
by the landmarks' own kernel matrix (Nystroem), feed a linear support vector machine with squared hinge loss, solved by
Newton steps; a logistic curve turns its margin into a score. As a landmark's features are explicit, a piece is compared with
all landmarks by look-ups, checked letter by letter.

Fitted on at most MAX_LABELLED labelled rows, those of the smallest hash of doc_id, and only on rows outside the
held-out fold; scores read texts alone. Cases: null and empty texts get the score of a text without any near piece; words of
any length are read whole, in overlapping parts; with labels of one class only, or none, every score is that class's (0
without labels); repeated rows are scored alike; other columns of docs are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, text_batches

MAX_LABELLED, LANDMARKS, AGAINST, FOLDS = 20_000, 96, 48, 5
DECAY, MAX_SKIP = 0.93, 4
#: The smooth step: middle and width.
STEP = (0.65, 0.03)
#: Weights below this count as none.
LEAST = 0.01
WIDTH, BITS, CACHE_WORDS, ROWS = 32, 18, 300_000, 1024
#: Neighbours up to this length are joined.
SHORT = 6
#: Skips before the second and the third letter, most skips first.
SKIPS = tuple(sorted(((a, b) for a in range(MAX_SKIP + 1) for b in range(MAX_SKIP + 1 - a)), key=lambda x: -sum(x)))
EDGE, INSIDE = re.compile(r"^[\W_]+|[\W_]+$"), re.compile(r"[\W_]+")


def pieces_of(word: str) -> list[str]:
    """A word with its borders marked, in parts if it is long; with marks inside, also the word of its letters alone."""
    word = EDGE.sub("", word)
    if not word:
        return []
    plain = INSIDE.sub("", word)
    return bordered(word) + (bordered(plain) if plain != word and plain else [])


def bordered(word: str) -> list[str]:
    if len(word) <= WIDTH - 2:
        return [f"^{word}$"]
    step = (WIDTH - 2) // 2
    return [("^" if k == 0 else "") + word[k : k + WIDTH - 2] + ("$" if k + WIDTH - 2 >= len(word) else "") for k in range(0, len(word) - step, step)]


def hashed(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    h = x * np.uint32(0x9E3779B1) ^ (y * np.uint32(0x85EBCA77) + (y << np.uint32(13))) ^ (z * np.uint32(0xC2B2AE3D) + (z << np.uint32(7)))
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)


def letters_of(words: list[str]) -> np.ndarray:
    return np.array(words, dtype=f"U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH)


def subsequences(m: np.ndarray):
    """For each skip pattern: (discount, first, second, third letter) over a matrix of words and places; 0 is no letter."""
    for a, b in SKIPS:
        span = a + b + 3
        yield DECAY ** (a + b), m[:, : WIDTH - span + 1], m[:, a + 1 : WIDTH - span + a + 2], m[:, span - 1 :]


def exact(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Three letters as one number (a code point has 21 bits)."""
    return x.astype(np.uint64) << np.uint64(42) | y.astype(np.uint64) << np.uint64(21) | z


class Kernel:
    """Explicit features of the landmarks, for look-up: from three letters to the landmarks that have them in a row."""

    def __init__(self, landmarks: list[str]):
        words = [f"^{w[: WIDTH - 2]}$" for w in landmarks]
        m = letters_of(words)
        i, j = np.nonzero(m[:, 2:])
        x, y, z = m[i, j], m[i, j + 1], m[i, j + 2]
        self.count = len(words)
        self.keys, feature = np.unique(exact(x, y, z), return_inverse=True)
        self.share = np.zeros((len(self.keys), self.count), np.float32)
        self.share[feature, i] = 1.0
        self.share /= np.maximum(self.share.sum(0), 1.0)
        # Letters whose hash no landmark has are out; the others are compared themselves.
        self.maybe = np.zeros(1 << BITS, bool)
        self.maybe[hashed(x, y, z)] = True
        self.own = self.rows(words)

    def rows(self, words: list[str]) -> np.ndarray:
        """The weight of each piece for each landmark."""
        best = np.zeros((len(words), len(self.keys)), np.float32)
        for discount, x, y, z in subsequences(letters_of(words)):
            i, j = np.nonzero((z != 0) & self.maybe[hashed(x, y, z)])
            key = exact(x[i, j], y[i, j], z[i, j])
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            same = self.keys[at] == key
            best[i[same], at[same]] = discount  # fewer skips come later
        out = np.zeros((len(words), self.count), np.float32)
        some = np.flatnonzero((best > 0).sum(1) > 1)
        out[some] = step(best[some] @ self.share, *STEP)
        return out


def step(x: np.ndarray, middle: float, width: float) -> np.ndarray:
    return 1 / (1 + np.exp((middle - x) / width))


class Reader:
    """Kernel rows of texts, with a bounded cache of words."""

    def __init__(self, kernel: Kernel):
        self.kernel = kernel
        self.clear()

    def clear(self) -> None:
        self.cache: dict[str, int] = {}
        self.near: list[np.ndarray] = []

    def learn(self, words: list[str]) -> np.ndarray:
        """For each word the number of its row among the near ones, or -1."""
        get = self.cache.get
        new = [w for w in words if get(w) is None]
        for k in range(0, len(new), 4_000):
            some = new[k : k + 4_000]
            parts = [(i, p) for i, w in enumerate(some) for p in pieces_of(w)]
            self.cache.update(dict.fromkeys(some, -1))
            if not parts:
                continue
            rows = self.kernel.rows([p for _, p in parts])
            for at in np.flatnonzero(rows.max(1, initial=0) >= LEAST).tolist():
                word = some[parts[at][0]]
                old = self.cache[word]
                if old < 0:
                    self.cache[word] = len(self.near)
                    self.near.append(rows[at])
                else:
                    self.near[old] = np.maximum(self.near[old], rows[at])
        return np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))

    def read(self, texts: pa.Array | list[str | None]) -> np.ndarray:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        return np.concatenate([self.some(texts.slice(k, ROWS)) for k in range(0, len(texts), ROWS)]) if len(texts) else np.zeros((0, self.kernel.count), np.float32)

    def some(self, texts: pa.Array) -> np.ndarray:
        if len(self.cache) > CACHE_WORDS:
            self.clear()
        words = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")))
        coded = words.flatten().dictionary_encode()
        code, doc = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(texts)), words.value_lengths().to_numpy())
        said = coded.dictionary.to_pylist()
        row = self.learn(said)
        hits = [(doc[k], row[code[k]]) for k in [np.flatnonzero(row[code] >= 0)]] if len(said) else []
        joined, where = self.joined(said, code, doc) if len(said) else ([], [])
        if joined:
            distinct, place = np.unique(joined, return_inverse=True)
            row2 = self.learn(distinct.tolist())
            k = np.flatnonzero(row2[place] >= 0)
            hits.append((np.asarray(where)[k], row2[place][k]))
        out = np.zeros((len(texts), self.kernel.count), np.float32)
        if hits:
            d, r = (np.concatenate(x) for x in zip(*hits, strict=True))
            if len(d):
                pair = np.unique(d * len(self.near) + r)
                np.add.at(out, pair // len(self.near), np.stack(self.near)[pair % len(self.near)])
        return out

    def joined(self, said: list[str], code: np.ndarray, doc: np.ndarray) -> tuple[list[str], list[int]]:
        """Neighbours read as one word: runs of single letters, and two short words whose joint is like a landmark's."""
        length = np.fromiter(map(len, said), np.int64, len(said))[code]
        found, where = [], []
        single = (length == 1).astype(np.int8)
        edge = np.diff(np.concatenate([[0], single, [0]]))
        border = np.concatenate([[True], doc[1:] != doc[:-1], [True]])
        for a, z in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            cuts = [a, *(a + 1 + np.flatnonzero(border[a + 1 : z])).tolist(), z]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y - x > 2:
                    found.append("".join(said[c] for c in code[x:y]))
                    where.append(int(doc[x]))
        short = (length <= SHORT) & (length > 1)
        at = np.flatnonzero(short[:-1] & short[1:] & (doc[:-1] == doc[1:]))
        if len(at):
            ends = np.array([(w[-2:].rjust(2, "\0"), w[:2].ljust(2, "\0")) for w in said], dtype="U2").view(np.uint32).reshape(len(said), 4)
            tail, head = ends[code[at], :2], ends[code[at + 1], 2:]
            joint = self.kernel.maybe[hashed(tail[:, 0], tail[:, 1], head[:, 0])] & self.kernel.maybe[hashed(tail[:, 1], head[:, 0], head[:, 1])]
            for k in at[joint].tolist():
                found.append(said[code[k]] + said[code[k + 1]])
                where.append(int(doc[k]))
        return found, where


def in_fold(doc_id):
    """Whether a document is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Machine:
    """The support vector machine on whitened kernel rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, own: np.ndarray, ridge: float = 1.0):
        values, vectors = np.linalg.eigh((own + own.T) / 2)
        self.whiten = vectors / np.sqrt(np.maximum(values, 1e-2)) @ vectors.T
        z, sign = self.map(x), np.where(y > 0, 1.0, -1.0)
        weight = np.where(y > 0, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max(len(y) - y.sum(), 1)))
        w = np.zeros(z.shape[1])
        penalty = np.append(np.full(z.shape[1] - 1, ridge), 1e-6)
        for _ in range(30):
            on = sign * (z @ w) < 1
            a = z[on]
            new = np.linalg.solve(a.T @ (a * weight[on][:, None]) + np.diag(penalty), a.T @ (weight[on] * sign[on]))
            if np.abs(new - w).max() < 1e-7:
                break
            w = new
        self.weights = w
        margin, curve = z @ w, np.array([1.0, 0.0])
        g = np.vstack([margin, np.ones_like(margin)]).T
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(g @ curve, -30, 30)))
            curve = curve - np.linalg.solve(g.T @ (g * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), g.T @ (p - y) + 1e-2 * curve)
        self.curve = curve

    def map(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x @ self.whiten, np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * (self.map(x) @ self.weights) + self.curve[1], -30, 30)))


#: The kernel and the machine, or the score of all texts.
Model = tuple[Kernel, Machine] | float | None


def landmarks_of(rows: DataFrame, n: int, toxic: int, count: int, against: int) -> list[str]:
    """Pieces of the labelled texts (text, y): those that speak for label 1, then the nearest to them that don't."""
    word = F.explode(F.array_distinct(F.transform(F.split(F.lower("text"), "\\s+"), lambda w: F.regexp_replace(w, "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", ""))))
    counts = cut(rows.select("y", word.alias("word")).groupBy("word").agg(F.sum("y").alias("a"), F.count("*").alias("b")).where("b >= 3 and length(word) between 3 and 30"), "toxicity-words")
    tried = counts.count()
    a, b, share = F.col("a").cast("double"), F.col("b").cast("double"), toxic / n
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))
    gain = 2.0 * (term(a, b * share) + term(b - a, b * (1 - share)) + term(toxic - a, toxic * (1 - b / n)) + term(n - toxic - b + a, (n - toxic) * (1 - b / n)))
    # The chance of a gain this large is about exp(-gain / 2) a word; over all words tried it stays below one in twenty.
    best = counts.where(a > b * share).withColumn("gain", F.round(gain, 6)).where(F.col("gain") > 2 * float(np.log(20 * max(tried, 1)))).orderBy(F.desc("gain"), "word").limit(count)
    words = [r["word"] for r in best.collect()]
    if not words:
        return []
    kernel = Kernel(words)

    def nearness(batches):
        for b in batches:
            said = b.column(0).to_pylist()
            rows = [kernel.rows([f"^{w[: WIDTH - 2]}$" for w in said[k : k + 4_000]]).max(1) for k in range(0, len(said), 4_000)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(np.concatenate(rows).astype(np.float64), 6) if rows else [], pa.float64())], names=["word", "near"])

    clean = counts.where(a < b * share).select("word").mapInArrow(nearness, "word string, near double").where(F.col("near") >= LEAST)
    words += [r["word"] for r in clean.orderBy(F.desc("near"), "word").limit(against).collect()]
    drop_cut(counts)
    return words


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, landmarks: int = LANDMARKS, against: int = AGAINST) -> Model:
    """The kernel and the machine; with labels of one class only, that class's score for all texts."""
    some = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"))).select(F.col("doc_id").alias("l_id"), (F.col("toxic") > 0).cast("int").alias("y"))
    some = F.broadcast(some.orderBy(F.xxhash64("l_id"), "l_id", "y").limit(max_labelled))  # a bounded table
    rows = docs.select("doc_id", "text").join(some, F.col("doc_id") == F.col("l_id")).select("text", "y")
    rows = cut(rows, "toxicity-labelled")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not toxic or toxic == n:
        return float(bool(toxic))
    words = landmarks_of(rows, n, toxic, landmarks, against)
    if not words:
        return 0.0
    kernel = Kernel(words)

    def run(batches):
        reader = Reader(kernel)
        for b in batches:
            x = reader.read(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    # Labelled rows may share a doc_id, so their number is bounded again before they come to the driver, and sorted there.
    got = sorted((r["y"], bytes(r["x"])) for r in rows.mapInArrow(run, "y int, x binary").orderBy(F.xxhash64("x"), "x", "y").limit(max_labelled).collect())
    drop_cut(rows)
    x, y = np.array([np.frombuffer(r, np.float32) for _, r in got], np.float64), np.array([r for r, _ in got], np.float64)
    return kernel, Machine(x, y, kernel.own.astype(np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted). A narrow map; the model is a fixed few MB."""
    given = docs.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "text")
    text_batches(docs.sparkSession, 4096)  # a batch's words are looked up once
    fixed = isinstance(model, float) or model is None

    def run(batches):
        reader = None if fixed else Reader(model[0])
        for b in batches:
            s = np.full(b.num_rows, model or 0.0) if fixed else model[1].score(reader.read(b.column("text")).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
