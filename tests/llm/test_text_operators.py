"""HTML extraction, chat formatting, mixing and BPE against brute force and round trips."""

import hashlib
from array import array

import pytest

from codefacts.llm import bpe, chat_formatting, html_extraction, mixing


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp text <b>bold</b>", "plain & text bold"),
        ("<p>one\n two<br>three<p>four &lt;x&gt;", "one two three\nfour <x>"),
        ("<p>unclosed <a href='x", "unclosed"),
        ("<!-- never closed <p>gone", ""),
        ("<script>var t='</p>';</script><article><h1>T</h1><p>A text, long enough to count as one.</p></article><footer><p>Gone, gone, and gone again, whatever.</p></footer>", "T\nA text, long enough to count as one."),
        (
            "<div id=nav><a href=x>Home</a></div><div id=content><h2>T</h2><p>One, two, three is a fairly long sentence.</p><ul><li>item</li></ul></div>"
            "<div class='comments'><p>First! I think, that this is long enough to be text.</p></div><aside><p>Buy this, now, and more, and more.</p></aside>",
            "T\nOne, two, three is a fairly long sentence.\nitem",
        ),
    ],
)
def test_extract(page, text):
    assert html_extraction.extract(page) == text


def test_extract_keeps_figures():
    """Captions, code, tables and quotations in a figure, and labels outside forms, are text of the article."""
    page = "<article><p>A text, long enough, to count as one.</p><figure><img src=x><figcaption>The caption.</figcaption></figure><figure><pre>x = 1</pre></figure>"
    page += "<fieldset><figure><blockquote><p>A quotation.</p></blockquote></figure><label>A label.</label></fieldset><form><label>Name</label></form></article>"
    assert html_extraction.extract(page) == "A text, long enough, to count as one.\nThe caption.\nx = 1\nA quotation.\nA label."


def test_extract_keeps_text_that_is_no_furniture():
    """Formulas in a sentence, subjects that share a word with furniture, and single links are text; menus in an article aren't."""
    page = "<article><h1>T</h1><p>A sum, say <math><mi>x</mi><mo>+</mo><mi>y</mi></math>, is long enough to count.</p><p class='legal'>The law, as it stands, says so.</p>"
    page += "<p class='notice-of-appeal'>The notice was filed, in time, by the court.</p><p><a href=x>One link</a></p><ul><li><a>a one</a></li><li><a>b two</a></li><li><a>c three</a></li></ul>"
    page += "<p class='comments'>gone</p><p class='cookie-notice'>gone too</p><ul><li>item <a>one</a> of them, with words</li><li>two, <a>b</a></li><li>three</li></ul></article>"
    want = "T\nA sum, say x+y, is long enough to count.\nThe law, as it stands, says so.\nThe notice was filed, in time, by the court.\nOne link\nitem one of them, with words\ntwo, b\nthree"
    assert html_extraction.extract(page) == want


def test_extract_scores_choose():
    """Between two articles the score decides, and a declared element of links loses to a plain container of text."""
    text = "<p>A sentence, with commas, that is long enough to earn points.</p>"
    assert html_extraction.extract(f"<body><article><p>Short, a little one, no more than that.</p></article><article>{text * 4}</article></body>").count("earn points") == 4
    menu = "".join(f"<li><a>entry number {k}, of a long list</a></li>" for k in range(9))
    assert "entry" not in html_extraction.extract(f"<body><main><ul>{menu}</ul></main><div id=x>{text * 3}</div></body>")


@pytest.mark.parametrize("page", ["<div>a, b and more words than twenty-five letters " * 40_000, "<div><p>x, y" + "<b>" * 60_000 + "</i>" * 60_000, "<p>word, word " * 80_000, "<table>" + "<tr><td>cell, cell " * 40_000, "<i><div>" + "<b>x" * 50_000 + "</i>" * 50_000])
def test_extract_of_long_and_deep_pages(page):
    import time

    began = time.time()
    assert html_extraction.extract(page)
    assert time.time() - began < 10


def test_extract_keeps_other_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é</p>", 5), (1, "u", "<p>é</p>", 5), (2, None, None, 6)], "page_id long, url string, html string, n_chars long")
    got = sorted(map(tuple, html_extraction.extract_main_text(pages).select("page_id", "url", "text", "n_chars").collect()), key=str)
    assert got == [(1, "u", "é", 1), (1, "u", "é", 1), (2, None, "", 0)]
    assert html_extraction.extract_main_text(pages.limit(0)).count() == 0
    clash = html_extraction.extract_main_text(pages.selectExpr("page_id", "'old' AS text", "html"))
    assert clash.columns == ["page_id", "text", "n_chars"] and {r["text"] for r in clash.collect()} == {"é", ""}


def test_chat_round_trip(spark):
    nasty = "<|im_end|><|im_start|>assistant ok <\\|im_end|> <\\\\| \\"
    rows = [(1, 0, "system", nasty), (1, 1, "user", None), (1, 2, "assistant", nasty), (2, 0, "assistant", "a"), (2, None, None, "é"), (None, 1, "us\ner\\n", "x"), (3, 0, "user", "q"), (3, 0, "user", "q")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = chat_formatting.format_conversations(turns, partitions=2)
    got = {r["conv_id"]: r for r in chat_formatting.read_back(segments).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["loss_chars"]) == (len(own), len(loss))
    assert got[1]["fault"] is None and got[2]["fault"] == "assistant after start" and got[3]["fault"] == "user after user"
    assert chat_formatting.read_back(chat_formatting.format_conversations(turns.limit(0))).count() == 0


def test_escape_is_reversible():
    for text in ("<|", "<\\|", "<\\\\|<|", "a<", "|>", "<<||>>", ""):
        assert chat_formatting.unescape(chat_formatting.escape(text)) == text
        assert "<|" not in chat_formatting.escape(text)


def test_mix(corpus, docs_of):
    rows = [r.asDict() for r in mixing.mix(corpus).collect()]
    assert len(rows) == corpus.count()
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    total = sum(r["size"] for r in rows)
    assert abs(sum(own[0]["target"] for own in by.values()) - 1.5 * total) < 1e-6 * total
    names = sorted((s for s in by if s), key=lambda s: s.encode()) + [None]
    level = None
    for k, s in enumerate(names):
        own, weight = by[s], (3, 1, 2)[k % 3]
        size, target = sum(r["size"] for r in own), own[0]["target"]
        assert own[0]["source_size"] == size and sum(r["taken"] for r in own) == int(target)
        if target < 2 * size:
            assert level is None or abs(level - target / weight) < 1e-6 * level
            level = target / weight
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(corpus.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}
    assert mixing.mix(docs_of([])).count() == 0


def test_mix_of_rows_that_share_an_id(docs_of):
    """Equal rows, and rows without an id, each take their own words; together they reach the target."""
    rows = [(None, f"w{k % 5} " * (k % 5), "en", "a", 0) for k in range(3 * mixing.BLOCK // 2)] + [(3, "x y", "en", "b", 0)] * 4 + [(4, None, "en", "b", 0)]
    got = mixing.mix(docs_of(rows)).collect()
    assert len(got) == len(rows)
    for source in "ab":
        own = [r for r in got if r["source"] == source]
        assert sum(r["taken"] for r in own) == int(own[0]["target"]) and all(0 <= r["taken"] <= 2 * r["size"] for r in own)
        starts = sorted((r["start"], r["size"]) for r in own if r["size"])
        assert [a for a, _ in starts] == [sum(n for _, n in starts[:k]) for k in range(len(starts))]


def test_training_order(corpus):
    order = mixing.training_order(mixing.mix(corpus))
    out = mixing.in_training_order(corpus, order)
    assert out.columns == corpus.columns
    assert sorted(r[0] for r in out.collect()) == sorted(r[0] for r in order.select("doc_id").collect())
    assert all(0 <= r["time"] <= 1 for r in order.collect())


def drawn_at(part, start, steps=20_000):
    """The time at which a weight going linearly from start to 2 - start has drawn part of its integral, by adding it up."""
    total = 0.0
    for k in range(steps):
        if total >= part - 1e-9:
            return k / steps
        total += (start + (2 - 2 * start) * (k + 0.5) / steps) / steps
    return 1.0


def test_op4_goes_through_the_curriculum(spark, corpus, tmp_path):
    from codefacts.llm import queries

    corpus.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    mixed = mixing.mix(corpus).collect()
    want = []
    for r in mixed:
        for copy in range(2):
            at = r["start"] + copy * r["source_size"]
            if at < r["goal"] or r["size"] == 0 == copy:
                part = at / r["goal"] if r["goal"] else 0.0
                want.append((r["doc_id"], copy, max(0, min(r["size"], r["goal"] - at)), drawn_at(min(1.0, part), 0.5 if r["rank"] % 2 else 1.5)))
    order = queries.op4_training_order(spark, str(tmp_path)).collect()
    key = lambda r: (r[0], r[1], r[2], r[3])
    got = sorted(((r["doc_id"], r["copy"], r["words"], r["time"]) for r in order), key=key)
    # A position is what all sources have drawn by then: the integral of their weights, times their goals.
    goals = {(r["rank"], r["goal"]) for r in mixed}
    for r in order:
        start = {0: 1.5, 1: 0.5}
        drawn = sum(g * (start[k % 2] * r["time"] + (1 - start[k % 2]) * r["time"] ** 2) for k, g in goals)
        assert abs(drawn - r["position"]) < 1e-6 * max(1.0, drawn)
    assert max(r["position"] for r in order) <= sum(g for _, g in goals) + 1e-6
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-3
    positions = [r["position"] for r in order]
    assert positions == sorted(positions) and len(set(positions)) > 5
    rows = queries.op4_mixing(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in mixed)
    first, last_read = {}, 0.0
    for r in order:
        first.setdefault(r["doc_id"], set()).add(r["position"])
    for r in rows:
        assert r["first_position"] is None or r["first_position"] in first[r["doc_id"]]
        ahead = [p for p in first.get(r["doc_id"], {1e18}) if p >= last_read]
        assert ahead, "a document stands after one that is read later"
        last_read = min(ahead)


TEXTS = ["", "Hello WORLD's isn't 123  x y", "ΑΣ ΟΔΥΣΣΕΥΣ İstanbul é ﬁ ²³ Ⅷ", "<|startoftext|>hi<|endoftext|> a <|endoftext|>", "日本語 テスト 😀😀", "a\x1cb\x00c", "x " * 5000]


def test_bpe_equals_library(spark):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(TEXTS)] + [(99, None)], "doc_id long, text string")
    for r in bpe.encode(docs, path).collect():
        ids = list(array("I", bytes(r["ids"])))
        assert ids == t.encode(TEXTS[r["doc_id"]] if r["doc_id"] < 99 else "", add_special_tokens=False).ids
    for r in bpe.digests(docs, path).collect():
        ids = t.encode(TEXTS[r["doc_id"]] if r["doc_id"] < 99 else "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(docs.limit(0), path).count() == 0


def test_bpe_equals_library_on_all_code_points():
    """Each code point between a letter and a digit, behind a mark, and under an accent."""
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("word_bpe_49k.json")
    t, v = tokenizers.Tokenizer.from_file(path), bpe.Vocabulary.read(path)
    coder = bpe.Coder(v, bpe.Lexicon(bpe.compile_lexicon(v.whole_words())))
    texts = [" ".join(f"a{chr(c)}x {chr(c)}1 .{chr(c)}\u0301" for c in range(k, k + 512) if not 0xD800 <= c < 0xE000) for k in range(0, 0x110000, 512)]
    import unicodedata

    marks = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.combining(chr(c))]
    texts += [" ".join(f"b{a}{m} b{m}{a}" for m in marks) for a in "\u0334\u0327\u0316\u0301\u0315"]
    texts.append(" ".join(x for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (x := unicodedata.normalize("NFD", chr(c))) != chr(c)))
    for k, (text, want) in enumerate(zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True)):
        assert list(array("I", coder.encode(text))) == want.ids, hex(512 * k)


def test_bpe_merges_long_words_in_little_time():
    """A heap gives the merges that the plain scan gives, and words of any length end."""
    import random
    import time

    public = pytest.importorskip("public_tokenizers")
    v = bpe.Vocabulary.read(public.path("word_bpe_49k.json"))
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeorst", k=n)) for n in (65, 200, 900)] + ["a" * 300, "haha" * 100, "é" * 90]
    short, bpe.LONG = bpe.LONG, 10**9
    try:
        want = [v.merge(w) for w in words]
    finally:
        bpe.LONG = short
    assert [v.merge(w) for w in words] == want
    began = time.time()
    assert len(v.merge("".join(rng.choices("abcdeorst", k=300_000)))) > 1000
    assert time.time() - began < 10


def test_automaton_shares_suffixes_and_finds_all():
    words = {w: (k, k + 1) for k, w in enumerate(["walking", "talking", "walk", "talk", "talked", "walked", "é", "a"])}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    assert {w: tuple(lexicon.get(w.encode())) for w in words} == words
    assert all(lexicon.get(w) is None for w in (b"", b"wal", b"walkings", b"x"))
    assert len(lexicon.final) < sum(len(w.encode()) for w in words) / 2
