"""Queries of the catalogue over small tables in code, whose SQL lists the rows that must come out, and over the store's shape of the
driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.functions import naming
from codefacts.operators import flow, graph, paging, relational, rules, search, store_queries, symbols
from codefacts.plans.catalogue import query, small
from codefacts.session import table
from codefacts.sources import conditional, pascal, text

SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE"}


def literal(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def rows_sql(ddl: str, rows: list[tuple]) -> str:
    """SQL for a list of rows."""
    fields = [f.split() for f in ddl.split(", ")]
    casts = ", ".join(f'CAST("{n}" AS {SQL_TYPES[t]}) AS "{n}"' for n, t in fields)
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT {casts} FROM (VALUES {values}) v({', '.join(chr(34) + n + chr(34) for n, _ in fields)})"


def golden(ddl: str, rows: list[tuple]):
    return query(rows_sql(ddl, rows))


# ---- the store: members, records, targets, rows and observations read from the driver's tables

STORE_SQL = """members AS (SELECT 'k' || o_orderkey AS source_key, o_orderkey AS record_id, o_custkey AS snapshot_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ordinal FROM orders),
records AS (SELECT o_orderkey AS record_id, o_custkey AS artifact_ref, o_custkey % 100 AS evidence_ref, CASE o_orderstatus WHEN 'F' THEN 2 ELSE 1 END AS lifecycle FROM orders WHERE o_orderkey % 11 <> 0),
targets AS (SELECT l_orderkey AS record_id, l_partkey AS target_key, 1 + l_linenumber % 3 AS dependency FROM lineitem),
rows_ AS (SELECT event_id % 500 AS artifact_ref, event_id AS ordinal, 1 + event_id % 5 AS row_kind, event_type || user_id AS index_key, props AS payload FROM events),
observed AS (SELECT event_id % 100 AS evidence_ref, event_id AS ordinal, user_id % 40 AS observation FROM events),
content AS (SELECT c_custkey AS observation, lower(c_mktsegment) || '/' || c_custkey AS path FROM customer)"""


def members(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.lit("k"), "o_orderkey").alias("source_key"), F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("snapshot_id"))
    return o.withColumn("ordinal", F.expr("row_number() OVER (PARTITION BY snapshot_id ORDER BY record_id)"))


def records(spark, sf):
    o = table(spark, sf, "orders").where("o_orderkey % 11 <> 0")
    return o.select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("artifact_ref"), (F.col("o_custkey") % 100).alias("evidence_ref"), F.expr("CASE o_orderstatus WHEN 'F' THEN 2 ELSE 1 END").alias("lifecycle"))


def targets(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("target_key"), (1 + F.col("l_linenumber") % 3).alias("dependency"))


def fact_table(spark, sf):
    return table(spark, sf, "events").select((F.col("event_id") % 500).alias("artifact_ref"), F.col("event_id").alias("ordinal"), (1 + F.col("event_id") % 5).alias("row_kind"), F.concat("event_type", "user_id").alias("index_key"), F.col("props").alias("payload"))


def observed(spark, sf):
    return table(spark, sf, "events").select((F.col("event_id") % 100).alias("evidence_ref"), F.col("event_id").alias("ordinal"), (F.col("user_id") % 40).alias("observation"))


def content(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("observation"), F.concat(F.lower("c_mktsegment"), F.lit("/"), "c_custkey").alias("path"))


@query(f"WITH {STORE_SQL} SELECT m.source_key, m.record_id, artifact_ref, evidence_ref FROM members m JOIN records r ON m.record_id = r.record_id WHERE lifecycle = 1")
def q55_member_records(spark, sf):
    return store_queries.member_records(members(spark, sf), records(spark, sf), ["artifact_ref", "evidence_ref"])


@query(f"WITH {STORE_SQL} SELECT m.source_key, m.record_id, artifact_ref FROM members m JOIN records r ON m.record_id = r.record_id WHERE lifecycle = 1 AND m.source_key IN ('k1', 'k2', 'k3', 'k4', 'k5', 'k6', 'k7') AND m.source_key = (SELECT min(source_key) FROM members JOIN records USING (record_id) WHERE lifecycle = 1 AND source_key IN ('k1', 'k2', 'k3', 'k4', 'k5', 'k6', 'k7'))")
def q56_find_member(spark, sf):
    m, r = members(spark, sf), records(spark, sf)
    first = store_queries.member_records(m, r, []).where(F.col("source_key").isin(*[f"k{k}" for k in range(1, 8)])).agg(F.min("source_key")).first()[0]
    return store_queries.member_records(m, r, ["artifact_ref"], first)


@query(f"""WITH {STORE_SQL}, p AS (SELECT record_id, min(CASE WHEN dependency = 3 THEN 2 ELSE 1 END) AS phase FROM targets WHERE target_key = 77 AND dependency < 3 OR dependency = 3 GROUP BY record_id)
SELECT min(phase) AS phase, source_key FROM members JOIN p USING (record_id) GROUP BY source_key HAVING (min(phase), source_key) > (1, 'k5') ORDER BY phase, source_key LIMIT 256""")
def q57_importers_in_two_phases(spark, sf):
    return store_queries.importers(members(spark, sf), targets(spark, sf), 77, (1, "k5"))


@query(f"""WITH {STORE_SQL} SELECT DISTINCT source_key FROM members JOIN records USING (record_id) JOIN rows_ USING (artifact_ref)
WHERE lifecycle = 1 AND row_kind IN (1, 3) AND (instr(index_key, 'click1') > 0 OR strlen(index_key) <> length(index_key))""")
def q58_members_with_fact_rows(spark, sf):
    return store_queries.members_with_rows(members(spark, sf), records(spark, sf), fact_table(spark, sf), (1, 3), store_queries.key_contains("index_key", "click1"))


@query(f"WITH {STORE_SQL} SELECT source_key FROM members JOIN records USING (record_id) WHERE lifecycle = 1 AND artifact_ref = 7")
def q59_members_of_artifact(spark, sf):
    return store_queries.members_of_artifact(members(spark, sf), records(spark, sf), 7)


@query(f"""WITH {STORE_SQL} SELECT DISTINCT source_key FROM members JOIN records USING (record_id) JOIN observed USING (evidence_ref) JOIN content USING (observation)
WHERE lifecycle = 1 AND path = (SELECT path FROM content WHERE observation = 3)""")
def q60_members_observing(spark, sf):
    path = content(spark, sf).where("observation = 3").first()["path"]
    return store_queries.members_observing(members(spark, sf), records(spark, sf), observed(spark, sf), content(spark, sf), path)


@query(f"""WITH {STORE_SQL}, live AS (SELECT DISTINCT artifact_ref FROM records WHERE lifecycle = 1) SELECT index_key, artifact_ref, ordinal FROM rows_ JOIN live USING (artifact_ref)
WHERE index_key IN ('click1', 'view2', 'error3') AND (index_key, artifact_ref, ordinal) > ('click1', 20, 0) ORDER BY ALL LIMIT 257""")
def q61_live_index_hits(spark, sf):
    live = records(spark, sf).groupBy("artifact_ref").agg(F.min("lifecycle").alias("lifecycle"))
    return store_queries.live_hits(fact_table(spark, sf), live, ["click1", "view2", "error3"], ("click1", 20, 0), 257)


@query(f"WITH {STORE_SQL} SELECT *, sha256(ordinal || '|' || row_kind || '|' || index_key || '|' || payload) AS checksum FROM rows_ WHERE artifact_ref = 42 AND ordinal >= 100 ORDER BY ordinal LIMIT 50")
def q62_fact_rows(spark, sf):
    return store_queries.fact_rows(fact_table(spark, sf), 42, 100, 50)


@query(f"WITH {STORE_SQL} SELECT ordinal, observation, path FROM observed JOIN content USING (observation) WHERE evidence_ref = 7")
def q63_observations(spark, sf):
    return store_queries.observations_of(observed(spark, sf), content(spark, sf), 7)


@query(f"WITH {STORE_SQL} SELECT record_id, target_key, dependency FROM targets WHERE record_id NOT IN (SELECT record_id FROM records WHERE lifecycle = 2)")
def q64_children_of_retired(spark, sf):
    return store_queries.without_retired(targets(spark, sf), records(spark, sf), "record_id", F.col("lifecycle") == 2).select("record_id", "target_key", "dependency")


@query(f"""WITH {STORE_SQL} SELECT m.ordinal, m.source_key, CASE lifecycle WHEN 2 THEN 1 WHEN 1 THEN 2 END AS state FROM members m LEFT JOIN records r ON m.record_id = r.record_id
WHERE snapshot_id = 1 AND m.ordinal >= 2 ORDER BY ordinal LIMIT 100""")
def q65_snapshot_members(spark, sf):
    return store_queries.snapshot_members(members(spark, sf), records(spark, sf), 1, 2, 100)


@query("""SELECT (SELECT count(*) FROM nation) AS namespaces, (SELECT count(*) FROM region) AS retired, (SELECT count(*) FROM supplier WHERE CAST(floor(s_acctbal) AS BIGINT) >= 4000) AS live_leases""")
def q66_store_status(spark, sf):
    leases = table(spark, sf, "supplier").select(F.floor("s_acctbal").alias("renewed_unix_seconds"))
    return store_queries.store_status(table(spark, sf, "nation"), table(spark, sf, "region"), leases, 5000, 1000)


@query("""WITH l AS (SELECT 'u' || user_id AS path, event_id AS generation FROM events), n AS (SELECT max(event_id) AS top FROM events)
SELECT path, max(generation) AS generation FROM l, n WHERE generation > top - 900 GROUP BY path""")
def q67_changes_since(spark, sf):
    log = table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("event_id").alias("generation"))
    return store_queries.changes_since(log, log.agg(F.max("generation")).first()[0] - 900)


@query("WITH l AS (SELECT event_id FROM events) SELECT CAST(NULL AS VARCHAR) AS path, CAST(NULL AS BIGINT) AS generation")
def q68_changes_beyond_the_log(spark, sf):
    log = table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("event_id").alias("generation"))
    return store_queries.changes_since(log, 0, keep=100).where("path IS NULL")


@query("SELECT o_custkey, count(*) AS n, sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY CAST(o_orderkey AS VARCHAR))) AS digest FROM orders GROUP BY o_custkey")
def q69_ordered_digest(spark, sf):
    return store_queries.ordered_digest(table(spark, sf, "orders"), "o_custkey", "o_orderkey")


STATES_SQL = "m AS (SELECT event_id AS ordinal, CASE event_type WHEN 'error' THEN 'refused' WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'deferred' ELSE 'fresh' END AS state, CASE WHEN event_type = 'error' THEN 'user ' || user_id END AS reason FROM events)"


def member_states(spark, sf):
    state = F.expr("CASE event_type WHEN 'error' THEN 'refused' WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'deferred' ELSE 'fresh' END")
    return table(spark, sf, "events").select(F.col("event_id").alias("ordinal"), state.alias("state"), F.when(F.col("event_type") == "error", F.concat(F.lit("user "), "user_id")).alias("reason"))


@query(f"""WITH {STATES_SQL} SELECT count(*) AS members, count(*) FILTER (state = 'fresh') AS fresh, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'refused') AS refused,
count(*) FILTER (state = 'deferred') AS deferred, arg_min(reason, ordinal) FILTER (reason IS NOT NULL) AS first_reason FROM m""")
def q70_index_coverage(spark, sf):
    return store_queries.coverage(member_states(spark, sf))


@query(f"""WITH {STATES_SQL}, g AS (SELECT reason AS gap, min(ordinal) AS o FROM m WHERE reason IS NOT NULL GROUP BY reason), r AS (SELECT gap, row_number() OVER (ORDER BY o, gap) AS nth, count(*) OVER () AS n FROM g)
SELECT gap, CAST(nth AS INTEGER) AS nth, greatest(n - 32, 0) AS n_more FROM r WHERE nth <= 32""")
def q71_coverage_gaps(spark, sf):
    return store_queries.gaps(member_states(spark, sf).where("reason IS NOT NULL").select(F.col("reason").alias("gap"), "ordinal"))


@query("SELECT c_custkey, c_nationkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 256")
def q72_recent_namespaces(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("namespace_id"), F.col("c_acctbal").alias("last_used"), "c_nationkey")
    return store_queries.recent_namespaces(c).select(F.col("namespace_id").alias("c_custkey"), "c_nationkey")


@golden("member string, verdict string", [("a", "selected"), ("b", "excluded"), ("c", "unverified"), ("d", "refused"), ("Target", "selected"), ("e", "excluded")])
def q73_candidate_partition(spark, sf):
    m = small(spark, "member string, state string", [("a", "fresh"), ("b", "fresh"), ("c", "pending"), ("d", "refused"), ("Target", "fresh"), ("e", "fresh")])
    p = small(spark, "member string, name string", [("a", "Foo"), ("a", "BAR"), ("b", "foo"), ("c", "foo"), ("Target", "foo"), ("Target", "bar"), ("e", "foo"), ("e", "bar")])
    i = small(spark, "member string, uses string", [("a", "TARGET"), ("b", "target"), ("e", "other")])
    return store_queries.partitioned_candidates(m, p, i, ["foo", "Bar"], "target")


# ---- graphs

DIAMOND = [(1, 2, "next"), (2, 3, "true"), (2, 4, "false"), (3, 5, "next"), (4, 5, "next"), (5, 6, "next"), (5, 2, "back"), (4, 7, "exception"), (8, 9, "next")]


def diamond(spark):
    return small(spark, "src long, dst long, kind string", DIAMOND)


@golden("step int, node long", [(0, 1), (1, 2), (2, 4), (3, 5), (4, 6)])
def q74_path_avoiding(spark, sf):
    return graph.path_avoiding(diamond(spark), 1, 6, small(spark, "node long", [(3,)]))


@golden("step int, node long", [(0, 5), (1, 2), (2, 3), (3, 5)])
def q75_shortest_cycle(spark, sf):
    return graph.path_avoiding(diamond(spark), 5, 5)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem), f(node) AS (SELECT 5::BIGINT UNION SELECT dst FROM f JOIN e ON node = src), b(node) AS (SELECT 9::BIGINT UNION SELECT src FROM b JOIN e ON node = dst)
SELECT node FROM f WHERE node IN (SELECT node FROM b)""")
def q76_blocks_between(spark, sf):
    return graph.blocks_between(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct(), 5, 9)


@golden("nodes string, all_paths boolean", [("3,4", True), ("3", False), ("5", True), ("8", False)])
def q77_must_pass_any(spark, sf):
    sets = {"3,4": [3, 4], "3": [3], "5": [5], "8": [8]}
    return small(spark, "nodes string, all_paths boolean", [(k, graph.must_pass_any(diamond(spark), 1, 6, small(spark, "node long", [(x,) for x in v]))) for k, v in sets.items()])


@golden("unit string, uses string, known boolean", [("a", "b,c", True), ("b", "c", True), ("c", "", True), ("d", None, False), ("e", "f", True), ("f", "e", True)])
def q78_uses_closure(spark, sf):
    i = small(spark, "unit string, uses string", [("a", "b"), ("b", "c"), ("d", "a"), ("d", "missing"), ("e", "f"), ("f", "e")])
    got = graph.uses_closure(i, small(spark, "unit string", [(x,) for x in "abcdef"]))
    return got.select("unit", F.array_join("uses", ",").alias("uses"), "known")


@golden("proc string, can boolean", [("main", True), ("a", True), ("b", True), ("c", False), ("loop1", True), ("loop2", True), ("alone", False)])
def q79_bottom_up_summaries(spark, sf):
    calls = small(spark, "caller string, callee string", [("main", "a"), ("a", "b"), ("a", "b"), ("main", "c"), ("loop1", "loop2"), ("loop2", "loop1"), ("loop2", "b"), ("b", "c")])
    own = small(spark, "proc string, can boolean", [("main", False), ("a", False), ("b", True), ("c", False), ("loop1", False), ("loop2", False), ("alone", False)])
    return graph.bottom_up(calls, own)


@golden("block int, assigned boolean", [(1, False), (2, False), (3, False), (4, False), (5, True), (6, False)])
def q80_definite_assignment(spark, sf):
    blocks = small(spark, "block int, assigns boolean", [(1, False), (2, False), (3, True), (4, True), (5, False), (6, False)])
    edges = small(spark, "src int, dst int, kind string", [(1, 2, "next"), (2, 3, "true"), (2, 4, "false"), (3, 5, "next"), (4, 5, "next"), (3, 6, "exception"), (5, 6, "next")])
    return graph.definite_assignment(blocks, edges, 1)


CLASSES = [("TAnimal", None), ("TDog", "TAnimal"), ("TPuppy", "tdog"), ("TStray", "TUnknown"), ("TRock", None), ("TLoopA", "TLoopB"), ("TLoopB", "TLoopA")]


@golden("name string, base string, descends boolean", [("TPuppy", "TAnimal", True), ("TDog", "TPuppy", False), ("TRock", "TAnimal", False), ("TStray", "TAnimal", None), ("TNobody", "TAnimal", None), ("TDog", "TDOG", True), ("TLoopA", "TLoopB", True), ("TLoopA", "TDog", False)])
def q81_class_ancestry(spark, sf):
    pairs = small(spark, "name string, base string", [("TPuppy", "TAnimal"), ("TDog", "TPuppy"), ("TRock", "TAnimal"), ("TStray", "TAnimal"), ("TNobody", "TAnimal"), ("TDog", "TDOG"), ("TLoopA", "TLoopB"), ("TLoopA", "TDog")])
    return graph.descends(pairs, small(spark, "name string, parent string", CLASSES))


@golden("block int, name string, state int", [(1, "x", 0), (2, "x", 0), (3, "x", 0), (4, "x", 1), (5, "x", 0)])
def q82_must_analysis(spark, sf):
    edges = small(spark, "src int, dst int", [(1, 2), (1, 3), (2, 4), (4, 5), (3, 5)])
    return graph.lattice_states(edges, small(spark, "block int, name string, sets int", [(2, "x", 1)]), 1, join="must")


# ---- symbols

DECLARATIONS = [
    ("a.pas", 1, None, "Alpha", "unit", 0, 900, 0), ("a.pas", 2, None, "TDog", "type", 10, 200, 1), ("a.pas", 3, 2, "Bark", "method", 20, 30, 2), ("a.pas", 4, 2, "FDogs", "field", 40, 50, 3),
    ("a.pas", 5, None, "Dogma", "constant", 210, 220, 4), ("a.pas", 6, 3, "DogCount", "variable", 22, 28, 5), ("a.pas", 7, None, "TDog", "type", 10, 200, 6), ("b.pas", 1, None, "Beta", "unit", 0, 100, 0),
    ("b.pas", 2, None, "Hotdog", "routine", 5, 60, 1), ("b.pas", 3, None, "Cat", "label", 70, 80, 2),
]


def declarations(spark):
    return small(spark, "path string, id int, parent int, name string, kind string, start int, end int, ord int", DECLARATIONS)


@golden("path string, name string, kind string, container string, start int, end int", [("a.pas", "TDog", "type", "Alpha", 10, 200), ("a.pas", "FDogs", "field", "TDog", 40, 50), ("a.pas", "Dogma", "constant", "Alpha", 210, 220), ("b.pas", "Hotdog", "routine", "Beta", 5, 60)])
def q83_workspace_symbols(spark, sf):
    return symbols.workspace_symbols(declarations(spark), "dOg")


@golden("level int, outline string, name string, kind string, start int, end int", [(0, "0000000000", "Beta", "unit", 0, 100), (0, "0000000005", "Hotdog", "routine", 5, 60), ])
def q84_document_symbols(spark, sf):
    return symbols.document_symbols(declarations(spark), "b.pas")


OCCURRENCES = [("a.pas", "Bark", 20, 24, 3), ("a.pas", "bark", 300, 304, 20), ("b.pas", "Bark", 15, 19, 2), ("c.pas", "Bark", 9, 13, 1), ("c.pas", "Bark", 50, 54, 4)]
BINDINGS = [("a.pas", 20, "TDog.Bark"), ("a.pas", 300, "TDog.Bark"), ("b.pas", 15, "TTree.Bark"), ("c.pas", 9, "TDog.Bark"), ("c.pas", 50, "TDog.Bark")]


def occurrences(spark):
    return small(spark, "path string, name string, start int, end int, line int", OCCURRENCES), small(spark, "path string, start int, symbol string", BINDINGS)


@golden("path string, start int, end int", [("a.pas", 20, 24), ("a.pas", 300, 304)])
def q85_references(spark, sf):
    o, b = occurrences(spark)
    return symbols.references(o, b, "TDog.Bark", withheld=small(spark, "path string", [("c.pas",)]))


@golden("path string, start int, end int", [("c.pas", 9, 13), ("c.pas", 50, 54)])
def q86_highlights(spark, sf):
    o, b = occurrences(spark)
    return symbols.references(o, b, "TDog.Bark", path="c.pas")


@query("SELECT doc_id, len(list_intersect(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x : lower(x)), ['the', 'idiot'])) = 0 AS none FROM documents")
def q87_lexical_absence(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", symbols.absent(d, ["The", "idiot"]).alias("none"))


CALLS = [("A.Run", "B.Go", 10, 14), ("A.Run", "b.go", 30, 34), ("C.Main", "B.Go", 5, 9), ("C.Main", "A.Run", 20, 25), ("A.Run", "B.Go", 10, 14)]


def calls(spark):
    return small(spark, "caller string, callee string, start int, end int", CALLS)


def spelled(ranges):
    return F.array_join(F.transform(ranges, lambda r: F.concat_ws("-", r["start"], r["end"])), ",")


@golden("caller string, n long, ranges string", [("A.Run", 2, "10-14,30-34"), ("C.Main", 1, "5-9")])
def q88_incoming_calls(spark, sf):
    return symbols.incoming_calls(calls(spark), "B.GO").select("caller", "n", spelled(F.col("ranges")).alias("ranges"))


@golden("callee string, n long, ranges string", [("B.Go", 1, "5-9"), ("A.Run", 1, "20-25")])
def q89_outgoing_calls(spark, sf):
    return symbols.outgoing_calls(calls(spark), "c.main").select("callee", "n", spelled(F.col("ranges")).alias("ranges"))


@golden("side string, name string", [("callee", "B.Go"), ("callee", "b.go"), ("callee", "B.Go"), ("caller", "C.Main")])
def q90_call_graph_neighbours(spark, sf):
    c = calls(spark)
    return symbols.callees(c, "A.Run").select(F.lit("callee").alias("side"), F.col("callee").alias("name")).unionByName(symbols.callers(c, "A.Run").select(F.lit("caller").alias("side"), F.col("caller").alias("name")))


@golden("path string, at int, routine string", [("f", 15, "inner"), ("f", 90, "outer"), ("f", 500, None), ("f", 30, "late")])
def q91_enclosing_caller(spark, sf):
    r = small(spark, "path string, name string, start int, end int", [("f", "outer", 0, 100), ("f", "inner", 10, 20), ("f", "early", 25, 35), ("f", "late", 28, 38)])
    return symbols.enclosing_caller(small(spark, "path string, at int", [("f", 15), ("f", 90), ("f", 500), ("f", 30)]), r, ["path", "at"])


@golden("path string, at int, block int", [("f", 12, 3), ("f", 12, 9), ("f", 50, 1)])
def q92_innermost_blocks(spark, sf):
    s = small(spark, "path string, block int, start int, end int", [("f", 1, 0, 100), ("f", 2, 10, 30), ("f", 3, 10, 20), ("f", 9, 10, 20)])
    return symbols.innermost_blocks(small(spark, "path string, at int", [("f", 12), ("f", 50), ("f", 200)]), s, ["path", "at"])


@golden("side string, name string", [("super", "TAnimal"), ("sub", "TPuppy")])
def q93_type_hierarchy(spark, sf):
    t = small(spark, "name string, parent string", CLASSES)
    return symbols.supertypes(t, "tdog").select(F.lit("super").alias("side"), "name").unionByName(symbols.subtypes(t, "TDOG").select(F.lit("sub").alias("side"), "name"))


@golden("name string, start int, rank int", [("Go", 50, 1), ("go", 90, 2), ("Go", 10, 3), ("Stop", 5, 1)])
def q94_overload_ranking(spark, sf):
    r = small(spark, "name string, is_definition boolean, section string, start int", [("Go", True, "implementation", 10), ("Go", False, "interface", 50), ("go", False, "implementation", 90), ("Stop", True, "other", 5)])
    return symbols.ranked_overloads(r).select("name", "start", "rank")


@golden("path string, start_line int, end_line int, kind string", [("f", 1, 50, "class"), ("f", 5, 20, "routine"), ("f", 30, 50, "region")])
def q95_folding(spark, sf):
    folds = small(spark, "path string, start_line int, end_line int, kind string, preference int", [("f", 1, 50, "class", 1), ("f", 5, 20, "routine", 1), ("f", 5, 40, "comment", 2), ("f", 30, 70, "region", 1), ("f", 8, 8, "x", 1), ("f", 10, 12, "if", 1)])
    return symbols.folding_ranges(folds, 3)


# ---- compiler checks


@golden("scope string, name string, start int", [("s", "FOO", 20), ("s", "foo", 30)])
def q96_duplicate_declarations(spark, sf):
    return symbols.duplicates(small(spark, "scope string, name string, start int", [("s", "Foo", 10), ("s", "FOO", 20), ("s", "foo", 30), ("t", "foo", 5), ("s", "bar", 7)]), ["scope"])


@golden("code string, name string", [("E2065", "go"), ("E2037", "run")])
def q97_declarations_and_definitions(spark, sf):
    d = small(spark, "name string, signature string", [("go", "()"), ("run", "(a: Integer)"), ("stop", "()")])
    i = small(spark, "name string, signature string", [("run", "(a: Byte)"), ("stop", "()"), ("extra", "()")])
    return symbols.without_definition(d, i, ["name"]).select(F.lit("E2065").alias("code"), "name").unionByName(symbols.differing_definitions(d, i, ["name"], "signature").select(F.lit("E2037").alias("code"), "name"))


@golden("path string, name string, start int", [("a", "FUnused", 10), ("b", "FUsed", 4)])
def q98_never_referenced(spark, sf):
    m = small(spark, "path string, name string, start int", [("a", "FUnused", 10), ("a", "FUsed", 20), ("b", "FUsed", 4)])
    return symbols.never_referenced(m, small(spark, "path string, name string, start int", [("a", "FUnused", 10), ("a", "FUsed", 20), ("a", "fused", 90), ("b", "FUsed", 4)]))


@golden("type_name string, member string, base string, code string", [("TDog", "Speak", "TAnimal", "W1010"), ("TPuppy", "Count", "TAnimal", "W1009"), ("TPuppy", "speak", "TDog", "W1009")])
def q99_hidden_members(spark, sf):
    m = small(spark, "type_name string, member string, is_virtual boolean, overrides boolean", [("TAnimal", "Speak", True, False), ("TAnimal", "Eat", True, False), ("TAnimal", "Count", False, False), ("TDog", "Speak", False, False), ("TDog", "Eat", True, True), ("TPuppy", "Count", False, False), ("TPuppy", "speak", False, False), ("TRock", "Speak", False, False)])
    return symbols.hidden_members(m, small(spark, "name string, parent string", CLASSES))


@golden("path string, line int, name string, code string", [("a", 3, "OldWay", "W1000"), ("a", 4, "WinOnly", "W1002")])
def q100_hint_directives(spark, sf):
    return symbols.marked_uses(small(spark, "path string, line int, name string", [("a", 3, "OldWay"), ("a", 4, "WinOnly"), ("a", 5, "Fine")]), small(spark, "name string, directive string", [("oldway", "deprecated"), ("WINONLY", "platform"), ("new", "experimental")]))


@golden("path string, at int, code string, severity string", [("f", 5, "W1", "warning"), ("f", 30, "W1", "error"), ("f", 15, "W2", "warning"), ("g", 15, "W1", "warning")])
def q101_warning_switches(spark, sf):
    f = small(spark, "path string, at int, code string, severity string", [("f", 5, "W1", "warning"), ("f", 15, "W1", "warning"), ("f", 30, "W1", "warning"), ("f", 15, "W2", "warning"), ("g", 15, "W1", "warning")])
    return symbols.switched(f, small(spark, "path string, at int, code string, state string", [("f", 10, "W1", "off"), ("f", 20, "W1", "error")])).select("path", "at", "code", "severity")


@golden("path string, unit string", [("a", "Spare")])
def q102_unused_units(spark, sf):
    i = small(spark, "path string, unit string", [("a", "Used"), ("a", "Spare"), ("a", "Registers")])
    e = small(spark, "unit string, name string", [("Used", "DoIt"), ("Spare", "Nothing"), ("Registers", "Quiet")])
    return symbols.unused_imports(i, small(spark, "path string, name string", [("a", "doit"), ("b", "nothing")]), e, small(spark, "unit string", [("Registers",)]))


# ---- Pascal sources

UNIT = """unit Demo;
interface
type
  TThing = class(TObject)
    FList: TStringList;
    constructor Create;
    destructor Destroy; override;
  end;
  Point2 = record
    A: Integer;
  end;
const
  MaxLen = 5;
implementation
constructor TThing.Create;
begin
  FList := TStringList.Create;
  inherited Create;
end;
destructor TThing.Destroy;
begin
  raise Exception.Create('x');
end;
procedure Work(const aName: string);
var
  List: TStringList;
begin
  List := TStringList.Create;
  List.Add('x');
  try
    with List do // check:ignore with-statement
      Clear;
  finally
    List.Free;
  end;
  try
    Work('b');
  except
  end;
end;
end.
"""

FLOW = """procedure A(L: TList; C: Boolean);
begin
  L.Free;
  L.Add(1);
  L := TList.Create;
  FreeAndNil(L);
  if Assigned(L) then
    L.Add(3);
  if C then
    L.Free
  else
    FreeAndNil(L);
  if L <> nil then Exit;
end;
procedure B(P: TThing);
var
  Q: TThing;
begin
  P.Go;
  if P = nil then
    Exit;
  P.Go;
  try
    Q := Find;
    Q.Go;
  finally
    Q.Stop;
  end;
  while Q <> nil do
    Q.Go;
  Q := nil;
  Q.Go;
end;
type TThing = class end;
"""

TRANSACTIONS = """procedure A;
begin
  Db.StartTransaction;
  try
    Db.Commit;
  except
    Db.Rollback;
    raise;
  end;
end;
procedure B;
begin
  Db.StartTransaction;
  Db.StartTransaction;
  Work;
end;
procedure C;
begin
  if not Db.InTransaction then
    Db.StartTransaction;
  try
    Work;
    Db.Commit;
  except
    Db.Rollback;
  end;
end;
"""

SWITCHES = """{$DEFINE FAST}
{$IFDEF FAST}
a
{$ELSE}
b
{$ENDIF}
{$IF CompilerVersion >= 31}
{$IFNDEF SLOW} c {$ENDIF}
{$ELSEIF 1 div 0 = 1}
d
{$IFEND}
{$IF Missing + 1 = 2} e {$ENDIF}
// {$IFDEF comment}
{$UNDEF FAST}
{$IFDEF FAST}
f
"""


def source(spark, *named):
    return small(spark, "path string, text string", list(named))


@golden("ord int, kind string, text string, start int, line int, column int", [(0, "name", "x", 0, 1, 1), (1, "symbol", ":=", 2, 1, 3), (2, "string", "'it''s // no'", 5, 1, 6), (3, "symbol", ";", 18, 1, 19), (4, "comment", "// yes", 20, 1, 21), (5, "number", "$1F", 27, 2, 1), (6, "symbol", "<>", 31, 2, 5), (7, "number", "1.5e3", 34, 2, 8), (8, "directive", "{$R+}", 40, 2, 14), (9, "comment", "{ a\nb }", 46, 2, 20), (10, "name", "&end", 54, 3, 5)])
def q103_tokens(spark, sf):
    return pascal.tokens(source(spark, ("t", "x := 'it''s // no'; // yes\n$1F <> 1.5e3 {$R+} { a\nb } &end"))).select("ord", "kind", "text", "start", "line", "column")


RULE_ROWS = [
    ("constant-naming", "hint", 13), ("empty-except", "warning", 38), ("field-not-freed", "warning", 17), ("inherited-missing", "hint", 20), ("inherited-order", "hint", 18), ("local-variable-naming", "hint", 24),
    ("raise-in-destructor", "warning", 22), ("resource-leak-unprotected", "error", 29), ("type-prefix", "hint", 9), ("with-statement", "warning", 31),
]


@golden("rule string, severity string, line int", RULE_ROWS)
def q104_rules(spark, sf):
    return rules.check(pascal.nodes(source(spark, ("demo.pas", UNIT)))).select("rule", "severity", "line")


@golden("line int, column int, rule string, severity string, scope string", [(9, 3, "type-prefix", "warning", None), (17, 3, "field-not-freed", "warning", "TThing.Create"), (18, 3, "inherited-order", "hint", "TThing.Create"), (20, 1, "inherited-missing", "hint", "TThing.Destroy"), (22, 3, "raise-in-destructor", "warning", "TThing.Destroy"), (24, 22, "local-variable-naming", "hint", "Work"), (29, 3, "resource-leak-unprotected", "error", "Work"), (38, 3, "empty-except", "warning", "Work")])
def q105_lint_pipeline(spark, sf):
    """Parse, rules, overrides, scopes, suppressions, order: one plan."""
    overrides = small(spark, "rule string, override string", [("constant-naming", "off"), ("type-prefix", "warning")])
    return rules.lint(source(spark, ("demo.pas", UNIT)), "check", overrides).select("line", "column", "rule", "severity", "scope")


@golden("line int, column int, message string", [(4, 3, "use after free: l"), (10, 5, "double free: l"), (12, 5, "double free: l"), (13, 3, "use after free: l")])
def q106_use_after_free(spark, sf):
    return flow.use_after_free(source(spark, ("flow.pas", FLOW))).select("line", "column", "message")


@golden("line int, column int, message string", [(19, 3, "p may be nil"), (32, 3, "q may be nil")])
def q107_unchecked_nil(spark, sf):
    return flow.unchecked_nil(source(spark, ("flow.pas", FLOW))).select("line", "column", "message")


@golden("line int, rule string, severity string", [(13, "transaction-no-rollback", "error"), (14, "transaction-no-rollback", "error"), (13, "transaction-no-commit", "warning"), (14, "transaction-nested-start", "warning"), (23, "transaction-ownership-violation", "error"), (25, "transaction-ownership-violation", "error")])
def q108_transactions(spark, sf):
    return flow.transactions(flow.operations(source(spark, ("trx.pas", TRANSACTIONS)))).select("line", "rule", "severity")


@golden("directive string, start_line int, end_line int, activity string", [("ifdef", 2, 4, "active"), ("else", 4, 6, "inactive"), ("if", 7, 9, "active"), ("ifndef", 8, 8, "active"), ("elseif", 9, 11, "inactive"), ("if", 12, 12, "unknown"), ("ifdef", 15, 17, "inactive")])
def q109_directive_activity(spark, sf):
    env = conditional.Environment(constants={"compilerversion": ("version", (35, 0))})
    return conditional.activity(source(spark, ("s.pas", SWITCHES)), env).select("directive", "start_line", "end_line", "activity")


@golden("expression string, kind string, value string", [("1 + 2 * 3 = 7", "truth", "true"), ("-7 div 2", "number", "-3"), ("7 mod 0", "error", None), ("1 shl 64", "error", None), ("Foo + 1", "unknown", None), ("Foo * 1", "error", None), ("defined(A) and not defined(B)", "truth", "true"), ("false and Foo", "unknown", None), ("'a' + 'b' = 'ab'", "truth", "true"), ("CompilerVersion >= 31", "truth", "true"), ("6 xor 3", "number", "5"), ("sizeof(Int64) > sizeof(Integer)", "truth", "true"), ("length('four')", "number", "4"), ("declared(Nothing)", "truth", None), ("1 = 'a'", "error", None), ("(1 + 2", "error", None), ("35.0 > 34.5", "truth", "true")])
def q110_expressions(spark, sf):
    texts = ["1 + 2 * 3 = 7", "-7 div 2", "7 mod 0", "1 shl 64", "Foo + 1", "Foo * 1", "defined(A) and not defined(B)", "false and Foo", "'a' + 'b' = 'ab'", "CompilerVersion >= 31", "6 xor 3", "sizeof(Int64) > sizeof(Integer)", "length('four')", "declared(Nothing)", "1 = 'a'", "(1 + 2", "35.0 > 34.5"]
    env = conditional.Environment({"a"}, {"compilerversion": ("version", (35, 0))})
    return conditional.expressions(source(spark, ("e.pas", "".join(f"{{$IF {t}}}{{$ENDIF}}\n" for t in texts))), env).select("expression", "kind", "value")


@golden("routine string, src int, dst int, kind string", [("T", 0, 2, "next"), ("T", 2, 3, "true"), ("T", 2, 4, "false"), ("T", 3, 1, "exit"), ("T", 4, 5, "next"), ("T", 5, 6, "exception"), ("T", 6, 1, "exception"), ("T", 5, 7, "next"), ("T", 7, 1, "next")])
def q111_control_flow(spark, sf):
    from codefacts.sources import cfg

    return cfg.edges(source(spark, ("t.pas", "procedure T; begin if a then exit; try b; finally c; end; end;"))).select("routine", "src", "dst", "kind")


# ---- functions, sources and sinks


@golden("name string, snake string, camel string, pascal string, last string", [("HTTPPort", "HTTP_PORT", "hTTPPort", "HTTPPort", "HTTPPort"), ("MAX_LEN", "MAX_LEN", "mAX_LEN", "MaxLen", "MAX_LEN"), ("_max_len", "_MAX_LEN", "_max_len", "_MaxLen", "_max_len"), ("a.fooBar", "A.FOO_BAR", "a.fooBar", "A.fooBar", "fooBar")])
def q112_names(spark, sf):
    n = small(spark, "name string", [("HTTPPort",), ("MAX_LEN",), ("_max_len",), ("a.fooBar",)])
    c = F.col("name")
    return n.select("name", naming.upper_snake(c).alias("snake"), naming.camel(c).alias("camel"), naming.pascal(c).alias("pascal"), naming.last_part(c).alias("last"))


@golden("name string, style string, wrong boolean", [("Foo", "camelCase", True), ("foo", "camelCase", False), ("foo", "PascalCase", True), ("I", "camelCase", False), ("_9Été", "camelCase", True)])
def q113_naming_styles(spark, sf):
    n = small(spark, "name string, style string", [("Foo", "camelCase"), ("foo", "camelCase"), ("foo", "PascalCase"), ("I", "camelCase"), ("_9Été", "camelCase")])
    wrong = F.when(F.col("style") == "camelCase", naming.breaks_style(F.col("name"), "camelCase")).otherwise(naming.breaks_style(F.col("name"), "PascalCase"))
    return n.select("name", "style", wrong.alias("wrong"))


@golden("value long, to long, aligned long", [(13, 8, 16), (16, 8, 16), (13, 6, None), (65537, 16, 65552), (0, 4, 0)])
def q114_align_up(spark, sf):
    v = small(spark, "value long, to long", [(13, 8), (16, 8), (13, 6), (65537, 16), (0, 4)])
    return v.select("value", "to", naming.align_up(F.col("value"), F.col("to")).alias("aligned"))


@golden("tail string, rule string", [(" a-rule -- why", "a-rule"), (" -- why", None), ("b — since", "b"), ("a—b -- c", "a—b"), ("", None)])
def q115_rule_of_comment(spark, sf):
    t = small(spark, "tail string", [(" a-rule -- why",), (" -- why",), ("b — since",), ("a—b -- c",), ("",)])
    return t.select("tail", naming.rule_of_comment(F.col("tail")).alias("rule"))


@golden("text string, squeezed string, ending string", [("a  b\n c", "a b c", "lf"), ("one two three four", "one two t…", "lf"), ("x\r\ny", "x y", "crlf")])
def q116_text_scalars(spark, sf):
    t = small(spark, "text string", [("a  b\n c",), ("one two three four",), ("x\r\ny",)])
    return t.select("text", naming.squeeze(F.col("text"), 10).alias("squeezed"), naming.line_ending(F.col("text")).alias("ending"))


@golden("id int, text string", [(1, "café"), (2, "café"), (3, "plain"), (4, "")])
def q117_decoded_bytes(spark, sf):
    b = small(spark, "id int, content binary", [(1, b"caf\xe9"), (2, b"\xef\xbb\xbfcaf\xc3\xa9"), (3, b"plain"), (4, b"")])
    return b.select("id", text.decoded(F.col("content")).alias("text"))


@golden("path string, line int, code string, message string", [("C:\\src\\a.pas", 12, "E2003", "Undeclared identifier: 'x'"), ("b.pas", 3, "W1010", "hides"), ("c.pas", 7, None, "odd text")])
def q118_compiler_messages(spark, sf):
    t = small(spark, "text string", [("C:\\src\\a.pas(12) Error: E2003 Undeclared identifier: 'x'",), ("b.pas(3) Warning: W1010 hides",), ("c.pas(7) odd text",), ("no message",)])
    return text.parsed_messages(t, "text").select("path", "line", "code", "message")


@golden("path string, text string", [("a.pas", "a.pas:3:1: warning[with-statement]: with hides where names come from")])
def q119_text_report(spark, sf):
    f = small(spark, "path string, line int, column int, severity string, rule string, message string", [("a.pas", 3, 1, "warning", "with-statement", "with hides where names come from")])
    return text.text_report(f).select("path", "text")


@golden("path string, json string", [("a.pas", '{"path":"a.pas","diagnostics":[{"line":3,"column":1,"rule":"r1","severity":"hint","message":"m"},{"line":9,"column":2,"rule":"r0","severity":"error","message":"n"}]}')])
def q120_json_report(spark, sf):
    f = small(spark, "path string, line int, column int, severity string, rule string, message string", [("a.pas", 9, 2, "error", "r0", "n"), ("a.pas", 3, 1, "hint", "r1", "m")])
    return text.json_report(f)


@golden("graph string, dot string", [("g", 'digraph {\n  "1" -> "2";\n  "2" -> "3";\n}')])
def q121_dot_graph(spark, sf):
    return text.dot_graph(small(spark, "graph string, src int, dst int", [("g", 2, 3), ("g", 1, 2)]), "graph")


@golden("needle string", [("foo",), ("bar",), ("é9",)])
def q122_needles(spark, sf):
    return spark.range(1).select(F.explode(search.needles("Foo.bar(É9)")).alias("needle"))


@golden("over boolean", [(True,)])
def q123_over_limit(spark, sf):
    return small(spark, "over boolean", [(paging.too_many(table(spark, sf, "orders"), 100),)])


@query("""SELECT DISTINCT c_custkey FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 3)
INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""")
def q124_set_operations(spark, sf):
    """Importers that are live and not refused: intersect and difference, each by a join on the key."""
    parts = table(spark, sf, "part").where("p_size = 3").select(F.col("p_partkey").alias("l_partkey"))
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    hit = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").join(parts, "l_partkey", "left_semi").select("o_orderkey").distinct()
    found = o.join(hit, "o_orderkey", "left_semi").select("c_custkey").distinct()
    live = found.join(table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey"), "c_custkey", "left_semi")
    return relational.unreferenced(live, [(o.where("o_orderpriority = '1-URGENT'"), "c_custkey")], "c_custkey")
