"""The catalogue of queries over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.functions import logic, naming
from codefacts.operators import aggregates, graph, intervals, paging, relational, search
from codefacts.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def small(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def micros(c: str):
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({c} AS TIMESTAMP_NTZ))")


# ---- rules and findings

LINES_SQL = """lines AS (SELECT doc_id, i AS line, parts[i] AS text FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"""


def document_lines(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


@query(f"""WITH {LINES_SQL},
f AS (SELECT doc_id, line, 'long-line' AS rule, 'warning' AS severity, text FROM lines WHERE length(text) > 400
      UNION ALL SELECT doc_id, line, 'shouting', 'error', text FROM lines WHERE length(text) > 20 AND text = upper(text)
      UNION ALL SELECT doc_id, line, 'pipe-table', 'hint', text FROM lines WHERE contains(text, ' | ')),
k AS (SELECT * FROM f WHERE NOT (doc_id % 10 = 0 AND rule = 'long-line') AND doc_id % 17 <> 3)
SELECT doc_id, rule, severity, count(*) AS n, min(line) AS first_line FROM k GROUP BY doc_id, rule, severity""")
def q01_line_diagnostics(spark, sf):
    hit = lambda rule, severity, test: F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))
    hits = F.array_compact(F.array(
        hit("long-line", "warning", F.char_length("text") > 400),
        hit("shouting", "error", (F.char_length("text") > 20) & (F.col("text") == F.upper("text"))),
        hit("pipe-table", "hint", F.contains(F.col("text"), F.lit(" | "))),
    ))
    f = document_lines(spark, sf).select("doc_id", "line", F.explode(hits).alias("h")).select("doc_id", "line", "h.rule", "h.severity")
    hushed = F.array_compact(F.array(F.when(F.expr("doc_id % 10 = 0"), F.struct(F.lit("long-line").alias("rule"))), F.when(F.expr("doc_id % 17 = 3"), F.struct(F.lit(None).cast("string").alias("rule")))))
    hush = table(spark, sf, "documents").select("doc_id", F.explode(hushed).alias("h")).select("doc_id", "h.rule")
    kept = relational.without_suppressed(f, hush, "doc_id")
    return kept.groupBy("doc_id", "rule", "severity").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


@query("""WITH s(user_id, rule) AS (VALUES (1, NULL), (2, 'click'), (3, 'view'), (3, 'error'))
SELECT event_id, user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = e.user_id AND (s.rule IS NULL OR s.rule = e.event_type))""")
def q02_null_wildcard_anti(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("rule"))
    s = small(spark, "user_id long, rule string", [(1, None), (2, "click"), (3, "view"), (3, "error")])
    return relational.without_suppressed(e, s, "user_id").select("event_id", "user_id", F.col("rule").alias("event_type"))


@query("""SELECT o_orderkey, o_orderstatus FROM orders o WHERE NOT EXISTS (
  SELECT 1 FROM orders b WHERE b.o_orderkey % 7 = 0 AND b.o_orderstatus || ':' || b.o_orderpriority || ':' || b.o_custkey = o.o_orderstatus || ':' || o.o_orderpriority || ':' || o.o_custkey)""")
def q03_baseline_anti(spark, sf):
    key = F.concat_ws(":", "o_orderstatus", "o_orderpriority", "o_custkey")
    o = table(spark, sf, "orders")
    return relational.without_baseline(o, o.where("o_orderkey % 7 = 0").select(key.alias("key")), key).select("o_orderkey", "o_orderstatus")


RULES_SQL = """r(rule, default_severity, enabled, override) AS (VALUES ('1-URGENT', 'error', true, NULL), ('2-HIGH', 'warning', true, 'off'), ('3-MEDIUM', 'hint', false, 'warning'), ('4-NOT SPECIFIED', 'hint', false, NULL), ('5-LOW', 'hint', true, 'error'))"""


@query(f"""WITH {RULES_SQL} SELECT o_orderkey, rule, coalesce(override, default_severity) AS severity FROM orders JOIN r ON o_orderpriority = rule
WHERE coalesce(override, '') <> 'off' AND (override IS NOT NULL OR enabled)""")
def q04_severity_override(spark, sf):
    rules = small(spark, "rule string, default_severity string, enabled boolean, override string", [("1-URGENT", "error", True, None), ("2-HIGH", "warning", True, "off"), ("3-MEDIUM", "hint", False, "warning"), ("4-NOT SPECIFIED", "hint", False, None), ("5-LOW", "hint", True, "error")])
    return relational.effective_rules(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("rule")), rules).select("o_orderkey", "rule", "severity")


@query("SELECT coalesce(max(CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) >= 2, false) AS failed FROM events")
def q05_threshold(spark, sf):
    rank = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    return relational.reaches_threshold(table(spark, sf, "events"), rank, 2)


# ---- joins


@query("""SELECT l_orderkey, l_linenumber, c_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment = 'BUILDING' AND l_quantity > 45""")
def q06_importers(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    x = table(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber")
    return x.join(o, x.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "l_linenumber", "c_custkey")


@query("""SELECT DISTINCT c_custkey FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size > 45""")
def q07_members_with_rows(spark, sf):
    p = table(spark, sf, "part").where("p_size > 45").select("p_partkey")
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(x, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return table(spark, sf, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").distinct()


@query("""SELECT c_custkey, c_name FROM customer LEFT JOIN (SELECT o_custkey, bool_or(o_orderstatus = 'O') AS live FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey WHERE NOT coalesce(live, false)""")
def q08_left_missing(spark, sf):
    r = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "O").alias("live"))
    return relational.missing_members(table(spark, sf, "customer").select("c_custkey", "c_name"), r, "c_custkey", F.col("live"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 49)")
def q09_semi_exists(spark, sf):
    x = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf, "supplier").select("s_suppkey", "s_name").join(x, "s_suppkey", "left_semi")


@query("""SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40)
AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = p_partkey AND s_acctbal < 0) AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = p_partkey AND c_mktsegment = 'MACHINERY')""")
def q10_anti_chain(spark, sf):
    refs = [(table(spark, sf, "lineitem").where("l_quantity > 40"), "l_partkey"), (table(spark, sf, "supplier").where("s_acctbal < 0"), "s_suppkey"), (table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'"), "c_custkey")]
    return relational.unreferenced(table(spark, sf, "part").select("p_partkey"), refs, "p_partkey")


@query("""SELECT c_custkey, coalesce(s_name, n_name, r_name) AS found FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) n ON n.n_nationkey = c_nationkey LEFT JOIN nation m ON m.n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = m.n_regionkey""".replace("n_name, r_name", "n.n_name, r_name"))
def q11_precedence_lookup(spark, sf):
    n = table(spark, sf, "nation")
    c = table(spark, sf, "customer").join(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey", "left")
    c = c.select(F.col("c_custkey").alias("s_suppkey"), F.col("c_nationkey").alias("n_nationkey"), F.col("n_regionkey").alias("r_regionkey"))
    looks = [(table(spark, sf, "supplier"), "s_suppkey", "s_name"), (n.where("n_nationkey % 2 = 0"), "n_nationkey", "n_name"), (table(spark, sf, "region"), "r_regionkey", "r_name")]
    return relational.first_known(c, looks, "found").select(F.col("s_suppkey").alias("c_custkey"), "found")


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def q12_last_import_wins(spark, sf):
    return relational.best_of(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("""WITH a AS (SELECT user_id, event_type, count(*) AS n_left FROM events WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS n_right FROM events WHERE event_id % 2 = 1 GROUP BY ALL),
j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type)
SELECT *, least(n_left, n_right) AS matched, n_left - least(n_left, n_right) AS missed, n_right - least(n_left, n_right) AS invented FROM j""")
def q13_multiset_match(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return relational.matched_multisets(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"])


@query("""SELECT quality, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS n_toxic, round(100.0::DOUBLE * count(*) FILTER (WHERE toxic = 1) / nullif(count(*), 0), 1) AS toxic_share FROM labels GROUP BY quality""")
def q14_precision_recall(spark, sf):
    g = table(spark, sf, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))
    return g.withColumn("toxic_share", relational.percentage(F.col("n_toxic"), F.col("n")))


# ---- intervals


@query("""WITH r AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + 86400000000 * (1 + event_id % 5) AS e, event_type || event_id AS name, event_id AS o FROM events WHERE event_type IN ('signup', 'error')),
p AS (SELECT user_id, event_id, epoch_us(ts) AS at FROM events WHERE event_type = 'purchase')
SELECT p.event_id, arg_max(r.name, (r.s, -r.o)) AS in_name FROM p LEFT JOIN r ON p.user_id = r.user_id AND p.at BETWEEN r.s AND r.e GROUP BY p.event_id""")
def q15_innermost_scope(spark, sf):
    e = table(spark, sf, "events").withColumn("at", micros("ts"))
    r = e.where("event_type IN ('signup', 'error')").select("user_id", F.col("at").alias("start"), (F.col("at") + 86400000000 * (1 + F.col("event_id") % 5)).alias("end"), F.concat("event_type", "event_id").alias("name"), F.col("event_id").alias("ord"))
    p = e.where("event_type = 'purchase'").select("user_id", "event_id", "at")
    return intervals.innermost(p, r, "user_id", "at", ["event_id"], bucket=5 * 86400000000, ordinal="ord").select("event_id", "in_name")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS a, epoch_us(o_orderdate) + 86400000000 * 30 AS z FROM orders),
g(k, s_start, s_end) AS (VALUES (0, 694224000000000, 757382400000000), (1, 757382400000000, 820454400000000), (2, 820454400000000, 4000000000000000))
SELECT o_orderkey, k, greatest(a, s_start) AS clip_start, least(z, s_end) AS clip_end FROM s JOIN g ON o_custkey % 3 = k AND a < s_end AND s_start < z""")
def q16_source_map_clip(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 3).alias("k"), "o_orderkey", micros("o_orderdate").alias("start")).withColumn("end", F.col("start") + 86400000000 * 30)
    g = small(spark, "k long, s_start long, s_end long", [(0, 694224000000000, 757382400000000), (1, 757382400000000, 820454400000000), (2, 820454400000000, 4000000000000000)])
    return intervals.clipped(o, g, "k").select("o_orderkey", "k", "clip_start", "clip_end")


@query("""WITH p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts, max(event_type || ':' || (event_id % 3)) AS state FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id, ts)
SELECT p.event_id, coalesce(c.state, 'default') AS state FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def q17_asof_state(spark, sf):
    e = table(spark, sf, "events")
    c = e.where("event_type IN ('signup', 'error')").groupBy("user_id", "ts").agg(F.max(F.concat("event_type", F.lit(":"), F.col("event_id") % 3)).alias("state"))
    p = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    return intervals.state_as_of(p, c, "user_id", "ts", "state", F.lit("default"), ["event_id"]).select("event_id", "state")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type IS DISTINCT FROM b""")
def q18_state_changes(spark, sf):
    return intervals.changes_only(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("""SELECT doc_id, k * 100 AS char_offset, length(before) - length(replace(before, chr(10), '')) + 1 AS line, k * 100 - coalesce(nullif(length(before) - length(split_part(before, chr(10), -1)), 0), 0) + 1 AS "column"
FROM (SELECT doc_id, k, substr(text, 1, k * 100) AS before FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 100.0) AS BIGINT))) AS k FROM documents))""")
def q19_offset_to_line(spark, sf):
    d = table(spark, sf, "documents")
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.char_length("text") / 100) - 1))
    offsets = d.where("char_length(text) > 0").select("doc_id", steps.alias("k")).select("doc_id", (F.col("k") * 100).alias("char_offset"))
    return intervals.positions(offsets, d, "doc_id", "char_offset")


@query("""WITH c AS (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events),
m AS (SELECT user_id, event_id AS line, event_type = 'error' AS off FROM events WHERE event_type IN ('error', 'signup')),
x AS (SELECT *, lag(off) OVER (PARTITION BY user_id ORDER BY line) AS lo FROM m), y AS (SELECT *, lead(line) OVER (PARTITION BY user_id ORDER BY line) AS e FROM x WHERE coalesce(lo, false) IS DISTINCT FROM off)
SELECT user_id, line AS start_line, coalesce(e, 1000000) AS end_line FROM y WHERE off""")
def q20_format_regions(spark, sf):
    m = table(spark, sf, "events").where("event_type IN ('error', 'signup')").select("user_id", F.col("event_id").alias("line"), "event_type", F.lit(1000000).cast("long").alias("last"))
    return intervals.paired_regions(m, "user_id", "line", F.col("event_type") == "error", "last")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS s, epoch_us(o_orderdate) + 86400000000 * (10 + o_orderkey % 40) AS e FROM orders)
QUALIFY s < max(e) OVER (PARTITION BY o_custkey ORDER BY s, e, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def q21_overlapping_edits(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", micros("o_orderdate").alias("start")).withColumn("end", F.col("start") + 86400000000 * (10 + F.col("o_orderkey") % 40))
    return intervals.overlapping_edits(o, "o_custkey", "start", "end", "o_orderkey").select("o_custkey", "o_orderkey")


# ---- aggregation


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_use FROM events GROUP BY event_type")
def q22_call_counts_first_use(spark, sf):
    return aggregates.counts_by_first_use(table(spark, sf, "events"), "event_type", "event_id")


@query("SELECT p_brand, count(DISTINCT p_size) AS n_runs, count(*) AS n FROM part GROUP BY p_brand HAVING count(DISTINCT p_size) >= 3")
def q23_frequent_having(spark, sf):
    return aggregates.frequent(table(spark, sf, "part"), "p_brand", "p_size")


@query("""SELECT o_custkey, bool_or(o_orderstatus = 'F') AS any_done, bool_or(o_orderpriority = '1-URGENT') AS any_urgent, count(*) FILTER (WHERE o_totalprice > 200000) AS n_large FROM orders GROUP BY o_custkey""")
def q24_markers(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("any_done"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("any_urgent"), F.count_if(F.col("o_totalprice") > 200000).alias("n_large"))


@query("""WITH w AS (SELECT doc_id, source, length(text) AS width FROM documents),
q AS (SELECT source, quantile_cont(width, 0.25) AS q1, quantile_cont(width, 0.75) AS q3 FROM w GROUP BY source HAVING count(*) >= 6)
SELECT doc_id, w.source, width FROM w JOIN q ON w.source = q.source WHERE width > q3 + 1.5 * greatest(q3 - q1, 5)""")
def q25_iqr_outliers(spark, sf):
    w = table(spark, sf, "documents").select("doc_id", "source", F.char_length("text").cast("long").alias("width"))
    return aggregates.outliers(w, ["source"], "width").select("doc_id", "source", "width")


@query("SELECT user_id, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3 FROM events GROUP BY user_id")
def q26_quartiles(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.percentile("value", F.lit(0.25)), 6).alias("q1"), F.round(F.percentile("value", F.lit(0.75)), 6).alias("q3"))


@query("SELECT event_type, count(*) AS n, arg_min(props, event_id) AS example FROM events GROUP BY event_type")
def q27_category_example(spark, sf):
    return aggregates.with_example(table(spark, sf, "events"), "event_type", "props", "event_id")


@query("SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders QUALIFY nth <= 3")
def q28_samples_per_group(spark, sf):
    return aggregates.samples(table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderpriority", "o_orderkey", "nth")


# ---- order and pages


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 8")
def q29_newest(spark, sf):
    return paging.newest(table(spark, sf, "orders"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 8).select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) > 8")
def q30_retire_beyond(spark, sf):
    return paging.beyond_newest(table(spark, sf, "orders"), ["o_custkey"], "o_orderdate", 8).select("o_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber, l_partkey) > (100, 2, 4611686018427387904) ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 257")
def q31_keyset_page(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return paging.page_after(x, ["l_orderkey", "l_linenumber", "l_partkey"], (100, 2, 1 << 62), 257)


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY sum(CAST(o_totalprice * 100 AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) <= 50000000")
def q32_budget(spark, sf):
    o = table(spark, sf, "orders").withColumn("cost", F.round(F.col("o_totalprice") * 100).cast("long"))
    return aggregates.within_budget(o, [F.desc("o_orderdate"), F.asc("o_orderkey")], "cost", 50000000, ["o_custkey"]).select("o_custkey", "o_orderkey")


# ---- search


@query("""SELECT p_partkey, name, least(levenshtein(lower(name), 'brand#3.red gears'), levenshtein(split_part(lower(name), '.', -1), 'red gears')) AS distance
FROM (SELECT p_partkey, p_brand || '.' || p_name AS name FROM part) ORDER BY distance, p_partkey LIMIT 10""")
def q33_suggest(spark, sf):
    names = table(spark, sf, "part").select("p_partkey", F.concat_ws(".", "p_brand", "p_name").alias("name"))
    return search.suggestions(names, "name", "Brand#3.Red gears", "p_partkey").withColumn("distance", F.col("distance").cast("long"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'd gea')")
def q34_substring_search(spark, sf):
    return search.containing(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "D Gea")


TOKENS_SQL = "t AS (SELECT doc_id, lower(tok[i]) AS name, i - 1 AS pos FROM (SELECT doc_id, tok, unnest(range(1, len(tok) + 1)) AS i FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x : NOT regexp_matches(x, '^[0-9]')) AS tok FROM documents)))"


@query(f"WITH {TOKENS_SQL} SELECT name, doc_id, count(*) AS n, min(pos) AS first_pos FROM t GROUP BY name, doc_id")
def q35_postings(spark, sf):
    return search.postings(table(spark, sf, "documents"), "doc_id")


@query(f"WITH {TOKENS_SQL} SELECT doc_id FROM t WHERE name IN ('the', 'with', 'from') GROUP BY doc_id HAVING count(DISTINCT name) = 3")
def q36_candidates(spark, sf):
    return search.candidates(search.postings(table(spark, sf, "documents"), "doc_id"), ["The", "with", "from"], "doc_id")


@query("SELECT doc_id, list_aggregate([array_to_string(list_slice(p, k, len(p)), '.') FOR k IN range(1, len(p) + 1)], 'string_agg', ';') AS suffixes FROM (SELECT doc_id, string_split(lang || '.' || source || '.' || doc_id, '.') AS p FROM documents)")
def q37_dotted_suffixes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws(".", "lang", "source", "doc_id").alias("name"))
    return d.select("doc_id", F.array_join(search.dotted_suffixes(F.col("name")), ";").alias("suffixes"))


# ---- scalar functions


@query("""SELECT p_partkey, upper(regexp_replace(regexp_replace(p_type || p_brand, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')) AS snake,
lower(substr(p_type, 1, 1)) || substr(p_type, 2) AS camel FROM part""")
def q38_case_conversion(spark, sf):
    return table(spark, sf, "part").select("p_partkey", naming.upper_snake(F.concat("p_type", "p_brand")).alias("snake"), naming.camel(F.col("p_type")).alias("camel"))


@query("""SELECT grp, count(*) AS n, string_agg(p_brand, ',' ORDER BY p_brand) AS brands FROM (SELECT DISTINCT CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'core' WHEN p_size > 40 THEN 'external' ELSE 'project' END AS grp, p_brand FROM part) GROUP BY grp""")
def q39_unit_classify(spark, sf):
    grp = F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), "core").when(F.col("p_size") > 40, "external").otherwise("project")
    d = table(spark, sf, "part").select(grp.alias("grp"), "p_brand").distinct()
    return d.groupBy("grp").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("p_brand")), ",").alias("brands"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber - 3 = 0 THEN NULL ELSE l_orderkey // (l_linenumber - 3) END AS d, CASE WHEN l_linenumber - 3 = 0 THEN NULL ELSE l_orderkey % (l_linenumber - 3) END AS m,
CASE WHEN l_partkey * 4000000000000000::HUGEINT BETWEEN -9223372036854775808 AND 9223372036854775807 THEN l_partkey * 4000000000000000 END AS big FROM lineitem""")
def q40_checked_arithmetic(spark, sf):
    a, b = F.col("l_orderkey"), (F.col("l_linenumber") - 3).cast("long")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", logic.checked("div", a, b).alias("d"), logic.checked("mod", a, b).alias("m"), logic.checked("*", F.col("l_partkey"), F.lit(4000000000000000)).alias("big"))


@query("""WITH v AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 3 = 1 END AS a, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 = 1 END AS b, event_id % 11 = 0 AS unk FROM events)
SELECT event_id, CASE WHEN unk THEN 'unknown' ELSE 'truth' END AS and_tag, CASE WHEN NOT unk THEN a AND b END AS and_truth, CASE WHEN NOT unk THEN a OR b END AS or_truth, NOT a AS not_truth FROM v""")
def q41_kleene(spark, sf):
    three = lambda c: logic.truth(F.when(c % 3 == 0, F.lit(None).cast("boolean")).otherwise(c % 3 == 1))
    e = table(spark, sf, "events").select("event_id", three(F.col("user_id")).alias("a"), F.when(F.col("event_id") % 11 == 0, logic.value(F.lit("unknown"))).otherwise(three(F.col("event_id"))).alias("b"))
    both, either = logic.both(F.col("a"), F.col("b")), logic.either(F.col("a"), F.col("b"))
    return e.select("event_id", both["tag"].alias("and_tag"), both["truth"].alias("and_truth"), either["truth"].alias("or_truth"), logic.negated(F.col("a"))["truth"].alias("not_truth"))


# ---- graphs: every row of lineitem, part and supplier numbers as they are

WHOLE_SQL = "e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem)"
WHOLE_DOMS_SQL = f"""{WHOLE_SQL}, r(node) AS (SELECT 1::BIGINT UNION SELECT e.dst FROM r JOIN e ON r.node = e.src),
a(avoid, node) AS (SELECT node, 1::BIGINT FROM r WHERE node <> 1 UNION SELECT a.avoid, e.dst FROM a JOIN e ON a.node = e.src WHERE e.dst <> a.avoid)"""


def whole_edges(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


@query(f"WITH RECURSIVE {WHOLE_SQL}, r(start, node) AS (SELECT src, src FROM (SELECT DISTINCT src FROM e WHERE src < 5) UNION SELECT r.start, e.dst FROM r JOIN e ON r.node = e.src) SELECT start, node FROM r")
def q42_reachability(spark, sf):
    e = whole_edges(spark, sf)
    return graph.reachable(e, e.where("src < 5").select(F.col("src").alias("start"))).select("start", "node")


@query(f"WITH RECURSIVE {WHOLE_SQL}, r(node, hops) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, hops + 1 FROM r JOIN e ON r.node = e.src WHERE hops < 60) SELECT node, min(hops) AS hops FROM r GROUP BY node")
def q43_shortest_path(spark, sf):
    return graph.reachable(whole_edges(spark, sf), small(spark, "start long", [(1,)])).select("node", "hops")


@query(f"WITH RECURSIVE {WHOLE_DOMS_SQL} SELECT n.node, d.node AS dominator FROM r n JOIN r d ON n.node <> d.node WHERE d.node = 1 OR NOT EXISTS (SELECT 1 FROM a WHERE a.avoid = d.node AND a.node = n.node)")
def q44_dominators(spark, sf):
    return graph.dominators(whole_edges(spark, sf), 1)


@query(f"WITH RECURSIVE {WHOLE_DOMS_SQL} SELECT d.node FROM r d WHERE d.node <> 1 AND EXISTS (SELECT 1 FROM r WHERE node = 9) AND NOT EXISTS (SELECT 1 FROM a WHERE a.avoid = d.node AND a.node = 9)")
def q45_must_pass(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return graph.must_pass(lines, 1, 9)


@query(f"WITH RECURSIVE {WHOLE_SQL}, k(node, hop) AS (SELECT 7::BIGINT, 0 UNION SELECT e.src, hop + 1 FROM k JOIN e ON e.dst = k.node WHERE hop < 20) SELECT DISTINCT node FROM k")
def q46_spread(spark, sf):
    return graph.spread(whole_edges(spark, sf), small(spark, "node long", [(7,)]))


@query(f"""WITH RECURSIVE {WHOLE_SQL}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
r(n, m) AS (SELECT a, a FROM u UNION SELECT r.n, u.b FROM r JOIN u ON r.m = u.a) SELECT n AS node, min(m) AS component FROM r WHERE EXISTS (SELECT 1 FROM u WHERE a = n AND b <> n) GROUP BY n""")
def q47_components(spark, sf):
    return graph.connected_components(whole_edges(spark, sf))


@query(f"""WITH RECURSIVE {WHOLE_DOMS_SQL}, w(b) AS (SELECT e.dst FROM e JOIN r ON e.src = r.node WHERE e.src % 6 = 0 AND e.src % 4 <> 0
  UNION SELECT e.dst FROM w JOIN e ON e.src = w.b WHERE NOT (e.src % 4 = 0)) SELECT r.node AS block, CAST(EXISTS (SELECT 1 FROM w WHERE w.b = r.node) AS INTEGER) AS state FROM r""")
def q48_may_analysis(spark, sf):
    e = whole_edges(spark, sf)
    nodes = e.select(F.col("src").alias("block")).distinct()
    effects = nodes.select("block", F.lit("x").alias("name"), F.when(F.col("block") % 4 == 0, 0).when(F.col("block") % 6 == 0, 1).alias("sets")).where("sets IS NOT NULL")
    return graph.lattice_states(e, effects, 1).select("block", "state")


# ---- layout and streams


@query(f"""WITH {LINES_SQL}, v AS (SELECT doc_id, line, CASE WHEN (line * 7 + doc_id) % 5 < 2 THEN '' ELSE text END AS text FROM lines),
i AS (SELECT *, regexp_full_match(text, '\\s*') AS blank, sum(CASE WHEN regexp_full_match(text, '\\s*') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS island, max(CASE WHEN NOT regexp_full_match(text, '\\s*') THEN line END) OVER (PARTITION BY doc_id) AS lst FROM v),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island, blank ORDER BY line) AS nth FROM i)
SELECT doc_id, line FROM n WHERE (NOT blank OR nth <= 1) AND line <= lst""")
def q49_blank_runs(spark, sf):
    lines = document_lines(spark, sf).withColumn("text", F.when((F.col("line") * 7 + F.col("doc_id")) % 5 < 2, "").otherwise(F.col("text")))
    return aggregates.kept_blank_lines(lines, "doc_id", "line", "text", 1).select("doc_id", "line")


@query(f"""WITH {LINES_SQL}, v AS (SELECT doc_id, line, CASE WHEN (line + doc_id) % 4 = 0 THEN '' ELSE text END AS text FROM lines),
b AS (SELECT *, sum(CASE WHEN regexp_full_match(text, '\\s*') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM v)
SELECT doc_id, CAST(block AS BIGINT) AS block, count(*) AS n_lines, max(length(text)) AS width FROM b WHERE NOT regexp_full_match(text, '\\s*') GROUP BY doc_id, block""")
def q50_align_groups(spark, sf):
    lines = document_lines(spark, sf).withColumn("text", F.when((F.col("line") + F.col("doc_id")) % 4 == 0, "").otherwise(F.col("text")))
    return aggregates.alignment_widths(lines, "doc_id", "line", "text", F.char_length("text").cast("long"))


@query("""SELECT 'u' || user_id AS path, CASE WHEN bool_or(event_type = 'error') THEN 'changed' ELSE 'modified' END AS kind, min(event_id) AS first_seq, count(*) AS n FROM events GROUP BY user_id""")
def q51_coalesced_changes(spark, sf):
    from codefacts.streaming.coalesce import coalesced

    kind = F.when(F.col("event_type") == "error", "changed").otherwise("modified")
    return coalesced(table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("path"), kind.alias("kind"), F.col("event_id").alias("seq")))


@query("SELECT p_brand, p_type, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand, p_type")
def q52_publish_idempotent(spark, sf):
    from codefacts.operators.graph import shared_folder
    from codefacts.sources.store import Store
    import uuid

    p = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("p_partkey"))
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    store.publish("facts", p, ["p_brand", "p_type"])
    return store.publish("facts", p, ["p_brand", "p_type"]).select("p_brand", "p_type", "p_partkey")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def q53_tumbling_windows(spark, sf):
    from codefacts.streaming.coalesce import tumbling

    return tumbling(table(spark, sf, "events"), "ts", "1 day", "1 hour", ["event_type"]).select(micros("window.start").alias("start_us"), "event_type", "n")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_quantity < 30 GROUP BY ALL")
def q54_totals(spark, sf):
    x = table(spark, sf, "lineitem").where("l_quantity < 30")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
