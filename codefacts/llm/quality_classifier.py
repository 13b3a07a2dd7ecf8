"""Quality classifier with hierarchical empirical Bayes.

A logistic classifier reads each text's own evidence. Its probabilities, over all documents, are summed by path and host
(grouped aggregation); each host's good rate is shrunk toward the global rate and each path's toward its host's, by
prior strengths fitted to the spread between the groups (method of moments), so that sparse sites say little. A document's
posterior log odds are its evidence plus its path's log odds, without its own part, less the global ones. Host and path are
columns that the caller names; where documents have no web address, a document's `source` is its host and its `lang` the
path below it.

Texts are read once: the log odds are written to the shared folder with the columns that are asked for, and both the sums
and the scores read them there. The classifier is fitted on at most MAX_LABELLED labelled rows, those of the smallest hash of doc_id; all else covers all
rows. Cases: a null or empty text has its own evidence like any other; null hosts or paths are a site of their own;
without labels of both classes every document is kept with score 0.5; repeated rows are scored alike; columns of docs that
are named like a result give way to it; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import and_fields, cut, small_batches

MAX_LABELLED, ROWS = 20_000, 1024
STRENGTH = (1.0, 1e4)
SYMBOLS, MARKS, DIGITS, UPPER = b"#*$%&|<>{}[]=_~^@\\/", b"!?", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NAMES = ("words", "word_length", "distinct_words", "symbols", "any_symbols", "shouts", "capitals", "digits", "repeated_lines", "line_words", "stops", "follows_itself")


def features(text: bytes | None) -> list[float]:
    text = text or b""
    words = text.split()
    n = max(len(words), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    shouts = len(text) - len(text.translate(None, MARKS))
    upper = len(text) - len(text.translate(None, UPPER))
    digits = len(text) - len(text.translate(None, DIGITS))
    stops = text.count(b".") + text.count(b",")
    same = sum(a == b for a, b in zip(words, words[1:]))
    return [
        np.log1p(len(words)), sum(map(len, words)) / n, len(set(words)) / n * np.log1p(n), min(symbols / n, 4.0), float(symbols * 10 > n), min(shouts / n, 2.0),
        min(upper / n, 6.0), min(digits / n, 4.0), 1 - len(set(lines)) / max(len(lines), 1), np.log1p(n / max(len(lines), 1)), min(stops / n, 1.0), same / n,
    ]


class Model:
    """Logistic regression on standardised features, fitted by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-3)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + np.diag(penalty), z.T @ (p - y) + penalty * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1], -8, 8)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model | None:
    some = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("l_quality"))
    some = F.broadcast(some.orderBy(F.xxhash64("l_id"), "l_id", "l_quality").limit(max_labelled))  # a bounded table
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(some, F.col("doc_id") == F.col("l_id")).select("l_quality", "text")

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column(1).to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in x.T)], names=["y", *NAMES])

    found = rows.mapInArrow(run, "y int, " + ", ".join(f"{n} double" for n in NAMES))
    # Labelled rows may share a doc_id, so their number is bounded again before they come to the driver, and sorted there.
    got = found.orderBy(F.xxhash64("y", *NAMES), "y", *NAMES).limit(max_labelled).toPandas().to_numpy(float)
    got = got[np.lexsort(got.T[::-1])]
    if not len(got) or len(set(got[:, 0] > 0)) < 2:
        return None
    return Model(got[:, 1:], (got[:, 0] > 0).astype(float))


def evidence(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep of docs with the classifier's log odds as __logit. A narrow map that sends each text once."""
    given = docs.select(*keep, F.col(text).alias("__text")) if text not in keep else docs.select(*keep)
    at = given.columns.index("__text" if text not in keep else text)

    def run(batches):
        for whole in batches:
            for b in (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS)):
                texts = b.column(at).cast(pa.binary()).to_pylist()
                logit = model.logit(np.array([features(t) for t in texts]).reshape(-1, len(NAMES)))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(logit, pa.float64())], names=[*keep, "__logit"])

    return given.mapInArrow(run, and_fields(docs.select(*keep).schema, "__logit double"))


def strength(rates: DataFrame, low: float = STRENGTH[0], high: float = STRENGTH[1]) -> float:
    """The prior strength that the spread between groups (n, total) asks for: a binomial's spread within, the rest between."""
    r = rates.where("n > 1").select(F.col("n").cast("double").alias("n"), (F.col("total") / F.col("n")).alias("rate"))
    s = r.agg(F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("rate")), F.sum(F.col("n") * F.col("rate") * F.col("rate")), F.sum(F.col("n") * F.col("n"))).first()
    if not s[0] or s[0] < 2:
        return high
    groups, n, total, squares, n2 = (float(v) for v in s)
    mean = total / n
    within = mean * (1 - mean)
    spread = squares - n * mean * mean - (groups - 1) * within
    between = spread / max(n - n2 / n, 1e-9)
    return float(np.clip(within / between - 1, low, high)) if between > 0 else high


RESULTS = ("score", "evidence", "host_rate", "path_rate", "kept")


def posterior(docs: DataFrame, model: Model | None, host: str = "source", path: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all, if None) with score, evidence, host_rate, path_rate and kept."""
    keep = [c for c in keep or docs.columns if c not in RESULTS]
    even = [*(F.lit(0.5).alias(c) for c in RESULTS[:-1]), F.lit(True).alias("kept")]
    if model is None:
        return docs.select(*keep, *even)
    sited = docs.select(*keep, *[F.col(c).alias(n) for c, n in ((host, "__h"), (path, "__p"))], *([] if "text" in keep else ["text"]))
    with small_batches(docs.sparkSession, ROWS):
        seen = cut(evidence(sited, model, [*keep, "__h", "__p"]), "quality-evidence")
    sites = seen.select(F.col("__h").alias("h"), F.col("__p").alias("p"), (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("__logit")))).alias("good"))
    paths = sites.groupBy("h", "p").agg(F.count("*").alias("n"), F.round(F.sum("good"), 6).alias("total"))
    paths = cut(paths, "quality-sites")
    hosts = paths.groupBy("h").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    n, total = hosts.agg(F.sum("n"), F.sum("total")).first()
    if not n:
        return docs.select(*keep, *even)
    rate = min(max(total / n, 1e-6), 1 - 1e-6)
    of_host, of_path = strength(hosts), strength(paths)
    own = Window.partitionBy("h")
    table = paths.withColumns({"host_n": F.sum("n").over(own), "host_total": F.sum("total").over(own)}).select(
        F.col("h").alias("__th"), F.col("p").alias("__tp"), F.col("n").alias("__n"), F.col("total").alias("__total"), F.col("host_n").alias("__host_n"), F.col("host_total").alias("__host_total")
    )
    joined = seen.join(table, F.col("__h").eqNullSafe(F.col("__th")) & F.col("__p").eqNullSafe(F.col("__tp")), "left")
    good = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("__logit")))
    host_rate = (F.col("__host_total") - F.col("__good") + F.lit(of_host * rate)) / (F.col("__host_n") - 1 + F.lit(of_host))
    path_rate = (F.col("__total") - F.col("__good") + F.lit(of_path) * F.col("__host_rate")) / (F.col("__n") - 1 + F.lit(of_path))
    log_odds = lambda c: F.log(c / (F.lit(1.0) - c))
    inside = lambda c: F.greatest(F.least(c, F.lit(1 - 1e-6)), F.lit(1e-6))
    joined = joined.withColumn("__good", good).withColumn("__host_rate", inside(host_rate)).withColumn("__path_rate", inside(path_rate))
    logit = F.col("__logit") + log_odds(F.col("__path_rate")) - F.lit(float(np.log(rate / (1 - rate))))
    joined = joined.withColumn("__score", F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)))
    named = [F.col(f"__{c}").alias(n) for c, n in (("score", "score"), ("good", "evidence"), ("host_rate", "host_rate"), ("path_rate", "path_rate"))]
    return joined.select(*keep, *named, (F.col("__score") >= 0.5).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return posterior(docs, train(docs, labels), keep=keep)
