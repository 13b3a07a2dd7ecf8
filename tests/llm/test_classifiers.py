"""Quality rules, quality classifier and toxicity: counts against brute force, models against held-out rows."""

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from codefacts.llm import quality_classifier, quality_rules, toxicity


def brute_counts(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_counts(corpus):
    rows = corpus.unionByName(corpus.limit(3).withColumn("text", F.lit("a b c\n\na b c\na b c x <>|\x0b b c x\n \n")))
    got = quality_rules.text_counts(rows, keep=("doc_id", "text")).collect()
    assert len(got) == rows.count()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_counts(r["text"])


@pytest.fixture(scope="module")
def labelled(docs_of, spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    docs, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rng.randint(60, 120))]
        bad, toxic = i % 5 == 0, i % 7 == 0
        if bad:
            words = [w + "%%" for w in words]
        if toxic:
            words[rng.randrange(60)] = rng.choice(["scoundrel", "numbskull"])
        docs.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(1000, None, None, None, 0), (1001, "", "en", "s1", 0)]
    return docs_of(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_decision_list(labelled):
    docs, labels = labelled
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, quality_rules.learn(docs, labels)).collect()}
    wrong = sum(got[i]["kept"] != (i % 5 != 0) for i in range(400))
    assert wrong <= 4
    assert got[1000]["base_failed"] and not got[1000]["kept"] and got[1001]["base_failed"]
    assert quality_rules.learn(docs, labels.limit(0)) == []
    assert quality_rules.apply_rules(docs.limit(0).withColumn("n_words", F.lit("x")), []).count() == 0


def test_decision_list_by_hand():
    """Rules cover rows in order: each one's own rows are judged by the first rule that covers them."""
    rng = random.Random(9)
    rows = []
    for _ in range(900):
        x = {"a": rng.random(), "b": rng.random(), "c": rng.random()}
        rows.append((x, x["a"] > 0.8 or (x["b"] < 0.2 and x["c"] >= 0.5)))
    rules = quality_rules.learn_list(rows)
    covers = lambda rule, x: all(x[n] < v if sign == "<" else x[n] >= v for n, sign, v in rule)
    assert 2 <= len(rules) <= quality_rules.MAX_RULES and all(1 <= len(r) <= quality_rules.MAX_CONDITIONS for r in rules)
    left = rows
    for rule in rules:
        held = [bad for i, (x, bad) in enumerate(rows) if i % 3 == 0 and (x, bad) in left and covers(rule, x)]
        assert held and (2 * sum(held) - len(held)) / len(held) >= quality_rules.MIN_WORTH
        left = [r for r in left if not covers(rule, r[0])]
    wrong = sum(any(covers(r, x) for r in rules) != bad for x, bad in rows)
    assert wrong <= 0.06 * len(rows)


def test_quality_classifier(labelled):
    docs, labels = labelled
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs, labels).collect()}
    assert len(got) == 402
    assert sum(got[i]["kept"] != (i % 5 != 0) for i in range(400)) <= 4
    assert all(r["kept"] for r in quality_classifier.classify(docs, labels.limit(0)).collect())
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0
    # Columns named like a result give way to it; repeated rows are scored alike.
    clash = docs.withColumn("score", F.lit("x")).withColumn("kept", F.lit(7))
    both = quality_classifier.classify(clash.unionByName(clash), labels)
    assert sorted(both.columns) == sorted([*docs.columns, *quality_classifier.RESULTS])
    assert Counter((r["doc_id"], r["kept"]) for r in both.collect()).most_common()[-1][1] == 2
    assert quality_classifier.classify(clash, labels.limit(0)).columns == both.columns


def test_posterior_by_hand(labelled, spark):
    """Sums, shrinkage and posterior odds against plain Python over the same log odds."""
    docs, labels = labelled
    model = quality_classifier.train(docs, labels)
    rows = docs.collect()
    logit = {r["doc_id"]: float(model.logit(np.array([quality_classifier.features((r["text"] or "").encode())]))[0]) for r in rows}
    good = {i: 1 / (1 + np.exp(-v)) for i, v in logit.items()}
    sites, hosts = {}, {}
    for r in rows:
        for table, key in ((sites, (r["source"], r["lang"])), (hosts, r["source"])):
            n, total = table.get(key, (0, 0.0))
            table[key] = n + 1, total + good[r["doc_id"]]
    rate = sum(good.values()) / len(good)
    of_host, of_path = (quality_classifier.strength(spark.createDataFrame([(n, round(float(t), 6)) for n, t in x.values()], "n long, total double")) for x in (hosts, sites))
    for r in quality_classifier.classify(docs, labels).collect():
        g, (hn, ht), (pn, pt) = good[r["doc_id"]], hosts[r["source"]], sites[r["source"], r["lang"]]
        host = min(max((ht - g + of_host * rate) / (hn - 1 + of_host), 1e-6), 1 - 1e-6)
        path = min(max((pt - g + of_path * host) / (pn - 1 + of_path), 1e-6), 1 - 1e-6)
        odds = logit[r["doc_id"]] + np.log(path / (1 - path)) - np.log(rate / (1 - rate))
        assert abs(r["score"] - 1 / (1 + np.exp(-odds))) < 1e-4 and r["kept"] == (r["score"] >= 0.5)


def test_shrinkage(spark):
    """Few rows of a site move its rate little, many move it to their own."""
    rates = spark.createDataFrame([(100, 50.0), (100, 90.0), (100, 10.0), (100, 60.0)], "n long, total double")
    assert 1 <= quality_classifier.strength(rates) < 20
    same = spark.createDataFrame([(100, 50.0)] * 5, "n long, total double")
    assert quality_classifier.strength(same) == quality_classifier.STRENGTH[1]


def test_toxicity(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 402 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 400]
    assert held and sum(r["predicted"] != (r["doc_id"] % 7 == 0) for r in held) <= 0.05 * len(held)
    read = toxicity.Reader(model[0])
    near = ["you scoundrel", "you scoun-drel", "you scoundrrel", "n.u.m.b.s.k.u.l.l", "n u m b s k u l l", None, "", "sound drill", "x" * 5000]
    s = model[1].score(read.read(near).astype(float))
    assert (s[:5] >= 0.5).all() and (s[5:] < 0.5).all()
    assert all(r["score"] == 0 for r in toxicity.score(docs, None).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0
    twice = toxicity.score(docs.limit(5).unionByName(docs.limit(5)).withColumn("score", F.lit("x")), model).collect()
    assert len(twice) == 10 and len({(r["doc_id"], r["score"]) for r in twice}) == len({r["doc_id"] for r in twice})


def test_toxicity_of_one_class(labelled):
    """Labels of one class give that class's score to all texts; no labels give 0."""
    docs, labels = labelled
    for some, want in ((labels.where("toxic = 1"), 1.0), (labels.where("toxic = 0"), 0.0), (labels.limit(0), 0.0), (labels.withColumn("toxic", F.lit(None).cast("int")), 0.0)):
        assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, some)).collect()} == {want}


def test_kernel_by_hand():
    """Weights against a plain count of the landmark's runs in all subsequences of the piece."""
    landmarks = ["loser", "scum", "aab"]
    kernel = toxicity.Kernel(landmarks)
    for word in ("loser", "lloosseerr", "closet", "s.c.u.m", "sxcxuxm", "aaab", "a", "", "é" * 40):
        for piece in toxicity.pieces_of(word):
            got = kernel.rows([piece])[0]
            for k, z in enumerate(f"^{w}$" for w in landmarks):
                runs = {z[i : i + 3] for i in range(len(z) - 2)}
                n = len(piece)
                best = {u: max([toxicity.DECAY ** (c - a - 2) for a in range(n) for b in range(a + 1, n) for c in range(b + 1, n) if c - a - 2 <= toxicity.MAX_SKIP and piece[a] + piece[b] + piece[c] == u], default=0.0) for u in runs}
                want = toxicity.step(np.float64(sum(best.values()) / len(runs)), *toxicity.STEP) if sum(v > 0 for v in best.values()) > 1 else 0.0
                assert abs(got[k] - want) < 1e-5, (piece, z)


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no tables here")
def test_toxicity_of_held_out_rows(spark):
    """Held-out labels of the tables: some marked texts hold no sign of it at all, so recall stays below 1."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out").join(labels.where("toxic is not null"), "doc_id").select("score", "toxic").collect()
    s, y = np.array([r["score"] for r in got]), np.array([r["toxic"] for r in got])
    pairs = s[y == 1][:, None] - s[y == 0][None, :]
    auc = ((pairs > 0) + 0.5 * (pairs == 0)).mean()
    print(f"held out: {len(y)} rows, {y.sum()} toxic, AUC {auc:.4f}, accuracy {((s >= 0.5) == y).mean():.4f}, recall {(s[y == 1] >= 0.5).mean():.4f}, false alarms {(s[y == 0] >= 0.5).mean():.4f}")
    assert auc > 0.97 and ((s >= 0.5) == y).mean() > 0.975 and (s[y == 0] >= 0.5).mean() < 0.01


def test_toxicity_of_words_with_inserted_letters(labelled):
    """One letter or digit inserted at every place, alone and at all places at once; some ordinary words stay clean."""
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    reader = toxicity.Reader(model[0])
    score = lambda texts: model[1].score(reader.read(texts).astype(float))
    planted = []
    for word in ("scoundrel", "numbskull"):
        for extra in "xq7":
            planted += [word[:k] + extra + word[k:] for k in range(1, len(word))] + [extra.join(word)]
        planted.append("".join(c + str(k) for k, c in enumerate(word))[:-1])
    got = score([f"you {w} there" for w in planted])
    assert (got >= 0.5).all(), [(w, round(float(g), 2)) for w, g in zip(planted, got, strict=True) if g < 0.5]
    assert (score(["a sound drill", "round numbers", "ground floor"]) < 0.5).all()
    kernel = toxicity.Kernel(["idiot", "scum", "loser"])
    for k, w in enumerate(["ixdxixoxt", "sxcxuxm", "lxoxser"]):
        assert kernel.rows([f"^{w}$"])[0, k] > 0.8
