"""Core operators on small frames, against hand-made results and metamorphic checks."""

import pytest
from pyspark.sql import functions as F

from codefacts.functions import logic, naming
from codefacts.operators import aggregates, graph, intervals, paging, relational, search
from codefacts.sources import store, text
from codefacts.streaming import coalesce


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_suppression_with_wildcard(spark):
    f = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "b")], "line int, rule string")
    s = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "line int, rule string")
    assert rows(relational.without_suppressed(f, s, "line")) == [(1, "b"), (3, "b")]
    assert "BroadcastNestedLoopJoin" not in relational.without_suppressed(f, s, "line")._jdf.queryExecution().toString()


def test_multisets_and_percentages(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "k string")
    b = spark.createDataFrame([("x",), ("z",), ("z",)], "k string")
    assert rows(relational.matched_multisets(a, b, ["k"])) == [("x", 2, 1, 1, 1, 0), ("y", 1, 0, 0, 1, 0), ("z", 0, 2, 0, 0, 2)]
    assert spark.range(1).select(relational.percentage(F.lit(1), F.lit(0)), relational.percentage(F.lit(1), F.lit(3))).first() == (None, 33.3)


def test_innermost_with_and_without_buckets(spark):
    r = spark.createDataFrame([("f", 1, 100, "outer"), ("f", 10, 20, "inner"), ("f", 10, 15, "later"), ("g", 1, 5, "other")], "path string, start int, end int, name string")
    p = spark.createDataFrame([("f", 12), ("f", 18), ("f", 50), ("f", 200), ("g", 3)], "path string, at int")
    plain = rows(intervals.innermost(p, r, "path", "at", ["path", "at"]))
    assert plain == rows(intervals.innermost(p, r, "path", "at", ["path", "at"], bucket=7))
    assert dict((x[1], x[2]) for x in plain if x[0] == "f") == {12: "inner", 18: "inner", 50: "outer", 200: None}


def test_as_of_state(spark):
    c = spark.createDataFrame([("f", 5, "on"), ("f", 9, "off")], "path string, at int, state string")
    p = spark.createDataFrame([("f", 4, 1), ("f", 5, 2), ("f", 100, 3), ("g", 1, 4)], "path string, at int, id int")
    assert {r["id"]: r["state"] for r in intervals.state_as_of(p, c, "path", "at", "state", F.lit("default"), ["id"]).collect()} == {1: "default", 2: "on", 3: "off", 4: "default"}


def test_pages_make_the_whole(spark):
    df = spark.range(50).select((F.col("id") % 7).alias("a"), "id")
    seen, after = [], (-1, -1)
    while page := [tuple(r) for r in paging.page_after(df, ["a", "id"], after, 8).collect()]:
        seen += page
        after = page[-1]
    assert seen == sorted(map(tuple, df.collect()))


def test_retire_counts_strictly_newer(spark):
    df = spark.createDataFrame([("c", 5), ("c", 5), ("c", 4), ("c", 3)], "context string, seq int")
    assert rows(paging.beyond_newest(df, ["context"], "seq", 2)) == [("c", 3), ("c", 4)]


def test_search(spark):
    d = spark.createDataFrame([(1, "Foo bar foo_1 9x"), (2, "bar"), (3, None)], "doc_id long, text string")
    index = search.postings(d, "doc_id")
    assert ("foo", 1, 1, 0) in rows(index) and not [r for r in rows(index) if r[0] in ("x", "9x")]
    assert rows(search.candidates(index, ["BAR"], "doc_id")) == [(1,), (2,)]
    assert spark.range(1).select(search.dotted_suffixes(F.lit("a.b.c"))).first()[0] == ["a.b.c", "b.c", "c"]
    assert spark.range(1).select(search.needles("Foo.bar(É)")).first()[0] == ["foo", "bar", "é"]


@pytest.mark.parametrize("name, snake, pascal", [("HTTPPort", "HTTP_PORT", "HTTPPort"), ("fooBar2Baz", "FOO_BAR2_BAZ", "FooBar2Baz"), ("_max_len", "_MAX_LEN", "_MaxLen"), ("MAX_LEN", "MAX_LEN", "MaxLen")])
def test_names(spark, name, snake, pascal):
    assert spark.range(1).select(naming.upper_snake(F.lit(name)), naming.pascal(F.lit(name))).first() == (snake, pascal)


def test_more_names(spark):
    get = lambda *c: tuple(spark.range(1).select(*c).first())
    assert get(naming.camel(F.lit("FooBar")), naming.camel(F.lit("_X"))) == ("fooBar", "_x")
    assert get(naming.breaks_style(F.lit("Foo"), "camelCase"), naming.breaks_style(F.lit("I"), "camelCase")) == (True, False)
    assert get(naming.align_up(F.lit(13), F.lit(8)), naming.align_up(F.lit(13), F.lit(6))) == (16, None)
    assert get(naming.align_up(F.lit((1 << 60) + 1), F.lit(16)), naming.align_up(F.lit((1 << 63) - 2), F.lit(16))) == ((1 << 60) + 16, None)
    assert get(naming.breaks_style(F.lit("Éa"), "camelCase"), naming.camel(F.lit("1Éa"))) == (True, "1éa")
    assert get(naming.rule_of_comment(F.lit("a—b -- c"))) == ("a—b",)
    assert get(naming.rule_of_comment(F.lit(" some-rule -- why")), naming.rule_of_comment(F.lit(" -- why"))) == ("some-rule", None)


def test_checked_arithmetic(spark):
    big = F.lit((1 << 63) - 1)
    got = spark.range(1).select(logic.checked("+", big, F.lit(1)), logic.checked("div", F.lit(-7), F.lit(2)), logic.checked("div", F.lit(7), F.lit(0)), logic.checked("shl", F.lit(1), F.lit(64)), logic.checked("mod", F.lit(-7), F.lit(2))).first()
    assert tuple(got) == (None, -3, None, None, -1)


def test_unknown_absorbs_but_null_truth_does_not(spark):
    no, null, unknown, error = logic.truth(F.lit(False)), logic.truth(F.lit(None).cast("boolean")), logic.value(F.lit("unknown")), logic.value(F.lit("error"))
    got = spark.range(1).select(logic.both(no, null)["truth"], logic.both(no, unknown)["tag"], logic.either(error, unknown)["tag"]).first()
    assert tuple(got) == (False, "unknown", "error")


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (1, 4)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "start long")
    assert rows(graph.reachable(e, start)) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 1)]
    assert rows(graph.connected_components(e)) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5)]
    assert rows(graph.dominators(e, 1)) == [(2, 1), (3, 1), (3, 2), (4, 1)]
    assert rows(graph.must_pass(e, 1, 3)) == [(2,), (3,)]
    assert rows(graph.spread(e, spark.createDataFrame([(6,)], "node long"))) == [(5,), (6,)]
    assert graph.connected_components(e.limit(0)).count() == 0


def test_long_chain_of_components(spark):
    e = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.connected_components(e).select("component").distinct().collect()[0][0] == 0


def test_layout(spark):
    lines = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(["a", "", "", "", "bb", "", "ccc", "d", "", ""])], "f int, line int, text string")
    assert [r[1] for r in sorted(aggregates.kept_blank_lines(lines, "f", "line", "text", 1).collect())] == [1, 2, 5, 6, 7, 8]
    assert [r[2:] for r in sorted(map(tuple, aggregates.alignment_widths(lines, "f", "line", "text", F.char_length("text")).collect()))] == [(1, 1), (1, 2), (2, 3)]


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "A.PAS").write_bytes(b"unit A;\r\n// x\r\n")
    (tmp_path / "sub/b.pas").write_bytes(b"caf\xe9")
    (tmp_path / "sub/c.txt").write_bytes(b"no")
    files = text.source_files(spark, str(tmp_path))
    assert files.count() == 2 and text.source_files(spark, str(tmp_path), exclude=("sub/*",)).count() == 1
    got = {r["path"][-5:]: r["t"] for r in files.select("path", text.decoded(F.col("content")).alias("t")).collect()}
    assert got["b.pas"] == "café"
    assert [r["text"] for r in text.lines(files.where("path like '%A.PAS'").select("path", text.decoded(F.col("content")).alias("t")), "path", F.col("t")).orderBy("line").collect()] == ["unit A;", "// x", ""]


def test_publish_twice(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    facts = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    assert s.publish("facts", facts, ["k", "v"]).count() == 2
    assert s.publish("facts", facts.unionByName(spark.createDataFrame([("c", 3)], facts.schema)), ["k", "v"]).count() == 3


def test_stream_coalescer(spark, tmp_path):
    events = spark.createDataFrame([("p", "modified", 1), ("p", "changed", 2), ("q", "modified", 3)], "path string, kind string, seq long")
    events.coalesce(1).write.json(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(events.schema).json(str(tmp_path / "in"))
    coalesce.run_coalescer(stream, str(tmp_path / "c1"), lambda df, n: got.extend(map(tuple, df.collect()))).awaitTermination(60)
    assert sorted(got) == [("p", "changed", 1, 2), ("q", "modified", 3, 1)]
    over = []
    coalesce.run_coalescer(stream, str(tmp_path / "c2"), lambda df, n: over.extend(r["kind"] for r in df.collect()), limit=1).awaitTermination(60)
    assert over == ["overflow"]


def test_overlapping_edits_of_one_start_and_end(spark):
    o = spark.createDataFrame([(1, n, 100, 200) for n in (9, 2, 7, 5)] + [(2, 4, 0, 50), (2, 3, 60, 90)], "k long, n long, start long, end long")
    for order in ("n", F.desc("n")):  # the order of the rows must not decide
        assert rows(intervals.overlapping_edits(o.orderBy(order), "k", "start", "end", "n").select("k", "n")) == [(1, 5), (1, 7), (1, 9)]


def test_must_pass_against_brute_force(spark):
    import random

    for seed in (4,):
        rng = random.Random(seed)
        n = 8
        edges = [(i, i + rng.choice([1, 1, 1, 2, 3])) for i in range(n)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(seed)] + [(3, None), (4, 4)]

        def reach(avoid=None, edges=edges):
            seen, todo = {0}, [0]
            while todo:
                at = todo.pop()
                new = {y for x, y in edges if x == at and y is not None and y != avoid} - seen
                seen |= new
                todo += new
            return seen

        e = spark.createDataFrame(edges, "src long, dst long")
        for target in (n - 2, n):
            want = [(d,) for d in reach() if d != 0 and target in reach() and target not in reach(d)]
            assert rows(graph.must_pass(e, 0, target)) == sorted(want, key=str), (seed, target)
    assert rows(graph.must_pass(e, 3, 3)) == []


def test_must_pass_writes_rows_by_edges_not_pairs(spark, monkeypatch):
    written, plain = [], graph.materialize

    def counted(df):
        back = plain(df)
        written.append(back.count())
        return back

    monkeypatch.setattr(graph, "materialize", counted)
    wide = [(0, x) for x in range(1, 301)] + [(x, y) for x in range(1, 301) for y in (301, 1 + x % 300)] + [(301, 302)]
    assert rows(graph.must_pass(spark.createDataFrame(wide, "src long, dst long"), 0, 302)) == [(301,), (302,)]
    assert sum(written) < 10 * len(wide)
