"""The pipeline's stages on a small corpus: columns, what each keeps, and the end against a plain version."""

import pytest


@pytest.fixture(scope="module")
def small(tmp_path_factory, docs_of, spark):
    at = tmp_path_factory.mktemp("sf")
    clean = [(i, " ".join(f"w{i}x{k * (i + 3) % 211}" for k in range(80)), "en", f"s{i % 3}", 0) for i in range(60)]
    junk = [(100 + i, " ".join(f"w{i}y{k}%%%" for k in range(80)), "en", f"s{i % 3}", 0) for i in range(20)]
    copies = [(200 + i, clean[i][1], "en", "s0", 0) for i in range(5)]
    odd = [(300, None, None, None, None), (301, "", "en", "s1", 0)]
    docs_of(clean + junk + copies + odd).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 100), 0) for r in clean + junk], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    from codefacts.llm.common import cut

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = cut(stage(spark, docs, small))
        seen[name] = docs.collect()
        if k < 4:
            assert docs.columns == columns
    ids = lambda name: {r["doc_id"] for r in seen[name]}
    assert set(range(60)) <= ids("quality_classifier") and not ids("quality_classifier") & set(range(100, 120))
    assert set(range(60)) <= ids("simhash_near_dedup") and not ids("simhash_near_dedup") & set(range(200, 205))
    assert ids("suffix_array_dedup") == ids("simhash_near_dedup")
    assert len(seen["bpe"]) == len(seen["mixing"])
    run = pipeline.run(spark, small)
    digest = lambda rows: sorted((r["doc_id"], r["ids_sha256"]) for r in rows)
    assert digest(run.collect()) == digest(seen["bpe"])


def test_run_equals_plain_python(spark, small):
    """The whole pipeline against a plain version over whole texts; only the classifier's verdict is taken from it."""
    import hashlib
    from array import array

    pipeline = pytest.importorskip("corpus_pipeline")
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    from codefacts.llm import mixing, quality_classifier
    from tests.llm.test_duplicates_and_neighbours import brute_fingerprint, components

    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    good = {r["doc_id"] for r in quality_classifier.classify(docs, labels).where("kept").collect()}
    rows = {r["doc_id"]: r.asDict() for r in docs.collect() if r["doc_id"] in good}
    fp = {i: brute_fingerprint(r["text"]) for i, r in rows.items()}
    group = components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    rows = {i: r for i, r in rows.items() if group[i] == i}
    first = {}
    for i in sorted(rows):
        data = (rows[i]["text"] or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if first.setdefault(data[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        rows[i]["text"] = None if rows[i]["text"] is None else bytes(c for c, g in zip(data, gone) if not g).decode("utf-8", "ignore")
    words = {i: len((r["text"] or "").split()) for i, r in rows.items()}
    sources = sorted({r["source"] for r in rows.values()}, key=lambda s: (s is None, s or ""))
    size = {s: sum(words[i] for i, r in rows.items() if r["source"] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    left, full, target = 1.5 * sum(size.values()), set(), {}
    while True:
        level = left / max(sum(weight[s] for s in sources if s not in full), 1e-9)
        new = {s for s in sources if s not in full and level * weight[s] >= 2 * size[s]}
        if not new:
            break
        for s in new:
            target[s] = 2.0 * size[s]
            left -= target[s]
        full |= new
    target |= {s: level * weight[s] for s in sources if s not in full}
    tokenizer = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want = []
    for s in sources:
        start, goal = 0, int(target[s])
        for i in sorted((i for i, r in rows.items() if r["source"] == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            ids = tokenizer.encode(rows[i]["text"] or "", add_special_tokens=False).ids
            digest = hashlib.sha256(array("I", ids).tobytes()).hexdigest()
            want += [(i, len(ids), digest)] * sum(start + k * size[s] < goal or (words[i] == 0 and k == 0) for k in range(2))
            start += words[i]
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in pipeline.run(spark, small).collect()]
    assert sorted(got) == sorted(want)


def test_stages_of_an_empty_table_and_clashing_columns(spark, small, docs_of):
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    from codefacts.llm.common import cut

    odd = spark.read.parquet(f"{small}/documents.parquet").selectExpr("*", "'k' AS kept", "1 AS size", "2 AS score", "'t' AS taken", "3 AS component_id", "'f' AS fp", "4 AS position")
    for docs in (odd.limit(0), odd):
        for k, (name, stage) in enumerate(pipeline.STAGES):
            after = cut(stage(spark, docs, small))
            if k < 4:
                assert after.columns == docs.columns, name
                assert docs.isEmpty() == after.isEmpty() and {(r["kept"], r["position"]) for r in after.collect()} <= {("k", 4)}
                docs = after


def test_near_copies_of_rows_that_share_an_id(spark, docs_of):
    """Different texts under one doc_id, or under none, all stay; of each group of near copies one row does."""
    pipeline = pytest.importorskip("corpus_pipeline")
    text = lambda k: " ".join(f"v{k}z{j * (k + 3) % 211}" for j in range(80))
    row = lambda i, t: (i, t, "en", "s0", 0)
    none = [row(None, text(k)) for k in range(6)]
    shared = [row(7, text(k)) for k in range(10, 15)]
    copies = [row(None, text(10)), row(9, text(0)), row(9, text(0)), row(None, text(20)), row(None, text(20)), row(7, text(14))]
    got = pipeline.drop_near_copies(spark, docs_of(none + shared + copies).repartition(3), "").collect()
    want = [(9, text(0)), *((None, text(k)) for k in (1, 2, 3, 4, 5, 20)), *((7, text(k)) for k in range(10, 15))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=key) == sorted(want, key=key)
