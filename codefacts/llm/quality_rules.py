"""Quality rules as a learned decision list, native: DataFrame functions only.

Counts of each text (words, symbols, repeated lines, words in repeated 3-word windows, capitals, marks) are expressions
over its row. The list is learned by sequential covering on labelled statistics: each rule is a conjunction of
thresholds, grown by information gain on one part of the labelled rows, pruned on the other, and kept while it is right
there nine times in ten; the rows it covers leave, and the next rule is learned. The list becomes one ordered CASE
expression. Learning sees at most MAX_LABELLED labelled rows, those of the smallest hash of doc_id, as a bounded table of
numbers on the driver; scoring sees every row.

Cases: a null text has no words and fails the base rule; empty labels, or labels of one class, give an empty list,
which keeps what passes the base rule; null labels are left out; repeated rows are scored alike;
columns of docs that are named like a count don't matter, as only doc_id and the text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

MAX_LABELLED = 20_000
MAX_RULES, MAX_CONDITIONS, THRESHOLDS = 12, 3, 24
#: A rule stays if, on the rows held out for pruning, (right - wrong) / (right + wrong) is at least this.
MIN_WORTH = 0.8
SPACE = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_window_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more, the first included."""

    def covered(sorted_windows: Column) -> Column:
        twice = F.filter(
            sorted_windows,
            lambda w, k: (F.coalesce(F.get(sorted_windows, k - 1)["g"] == w["g"], F.lit(False))) | F.coalesce(F.get(sorted_windows, k + 1)["g"] == w["g"], F.lit(False)),
        )
        return let(
            F.array_sort(F.transform(twice, lambda w: w["i"])),
            lambda at: F.aggregate(F.transform(at, lambda p, k: F.coalesce(F.least(F.lit(3), F.get(at, k + 1) - p), F.lit(3))), F.lit(0), lambda s, x: s + x),
        )

    def counted(windows: Column) -> Column:
        same = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(same, F.lit(0)).otherwise(let(F.sort_array(F.transform(windows, lambda g, i: F.struct(g.alias("g"), i.alias("i")))), covered))

    windows = lambda hashes: F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), counted)))


def text_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and the counts of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_marks."""
    t = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    t = t.select(
        *keep, "__t",
        F.filter(F.split("__t", SPACE), lambda w: w != "").alias("__w"),
        F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("__l"),
    )
    long = lambda c: c.cast("long")
    return t.select(
        *keep,
        long(F.size("__w")).alias("n_words"),
        long(F.char_length(F.array_join("__w", ""))).alias("word_chars"),
        long(F.regexp_count("__t", F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size("__l") - F.size(F.array_distinct("__l"))).alias("n_dup_lines"),
        long(repeated_window_words(F.col("__w"))).alias("n_repeat_words"),
        long(F.size("__l")).alias("n_lines"),
        long(F.regexp_count("__t", F.lit("\\p{Lu}"))).alias("n_capitals"),
        long(F.regexp_count("__t", F.lit("[!?.,;:]"))).alias("n_marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def statistics() -> dict[str, Column]:
    """What rules may test. Values are doubles from exact counts."""
    per = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "symbol_share": per("n_symbols", "word_chars"),
        "duplicate_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "capitals_per_word": per("n_capitals", "n_words"),
        "capital_share": per("n_capitals", "word_chars"),
        "marks_per_word": per("n_marks", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
    }


Condition = tuple[str, str, float]


def learn_list(rows: list[tuple[dict[str, float], bool]]) -> list[list[Condition]]:
    """Rules (conjunctions) that mark bad rows, in order. Row sets are bit masks, so counting is one machine operation a word."""
    if not rows:
        return []
    grow = sum(1 << i for i in range(len(rows)) if i % 3)
    everything = (1 << len(rows)) - 1
    bad = sum(1 << i for i, (_, b) in enumerate(rows) if b)
    masks: dict[Condition, int] = {}
    for name in rows[0][0]:
        order = sorted(range(len(rows)), key=lambda i: rows[i][0][name])
        values = [rows[i][0][name] for i in order]
        below, at = 0, 0
        wrong = [rows[i][0][name] for i in order if bad >> i & 1]
        cuts = sorted({g[len(g) * k // THRESHOLDS] for g in (values, sorted(set(values)), wrong) if g for k in range(THRESHOLDS)})
        for c in cuts:
            while at < len(order) and values[at] < c:
                below |= 1 << order[at]
                at += 1
            masks[name, "<", c], masks[name, ">=", c] = below, everything & ~below
    count = int.bit_count
    found, left = [], everything
    while len(found) < MAX_RULES:
        rule, cover = [], left & grow
        p0, n0 = count(cover & bad), count(cover & ~bad)
        if not p0:
            break
        while n0 and len(rule) < MAX_CONDITIONS:
            def gain(m: int, cover=cover, p0=p0, n0=n0) -> float:
                p, n = count(cover & m & bad), count(cover & m & ~bad)
                return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0

            best = max(masks, key=lambda c: (gain(masks[c]), c))
            if gain(masks[best]) <= 1e-9:
                break
            rule.append(best)
            cover &= masks[best]
            p0, n0 = count(cover & bad), count(cover & ~bad)
        if not rule:
            break
        held = left & ~grow & everything

        def worth(conditions: list[Condition], held=held) -> float:
            m = held
            for c in conditions:
                m &= masks[c]
            p, n = count(m & bad), count(m & ~bad)
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        if worth(rule) < MIN_WORTH:
            break
        m = left
        for c in rule:
            m &= masks[c]
        found.append(rule)
        left &= ~m
    return found


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one ordered CASE: true keeps."""
    stats, case = statistics(), F.when(F.lit(False), F.lit(True))
    for rule in rules:
        test = F.lit(True)
        for name, sign, value in rule:
            test = test & ((stats[name] < F.lit(value)) if sign == "<" else (stats[name] >= F.lit(value)))
        case = case.when(test, F.lit(False))
    return case.otherwise(F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[list[Condition]]:
    """The decision list from at most max_labelled labelled rows (doc_id, quality)."""
    some = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("l_quality"))
    some = F.broadcast(some.orderBy(F.xxhash64("l_id"), "l_id", "l_quality").limit(max_labelled))  # a bounded table
    # Written first: else the counts of every document would be taken below the join, to learn from a few of them.
    joined = cut(docs.select("doc_id", "text").join(some, F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "l_quality"), "rules-labelled")
    counted = text_counts(joined, keep=("doc_id", "l_quality")).where(~base_failed())
    stats = statistics()
    rows = counted.select("doc_id", "l_quality", *[c.alias(n) for n, c in stats.items()]).orderBy(F.xxhash64("doc_id"), "doc_id", "l_quality", "words").limit(2 * max_labelled).collect()
    drop_cut(joined)
    return learn_list([({n: r[n] for n in stats}, r["l_quality"] == 0) for r in rows])


def apply_rules(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    failed = base_failed()
    return text_counts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
