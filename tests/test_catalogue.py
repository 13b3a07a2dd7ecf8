"""Each catalogue query has SQL; a cross-section is compared with it at the smallest scale."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from codefacts.plans import catalogue, golden

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE)
    assert set(catalogue.QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
@pytest.mark.parametrize("name", ["q01_line_diagnostics", "q02_null_wildcard_anti", "q15_innermost_scope", "q19_offset_to_line", "q33_suggest", "q34_substring_search", "q35_postings", "q04_severity_override", "q08_left_missing", "q13_multiset_match", "q17_asof_state", "q25_iqr_outliers", "q31_keyset_page", "q36_candidates", "q41_kleene", "q49_blank_runs"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.compare import TABLES, rows

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(catalogue.ORACLE[name]).df())


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if hasattr(golden, n)])
def test_golden_rows(spark, name):
    """Queries over tables in code, or over the store's shape of the tables: all of them, with rows."""
    duckdb = pytest.importorskip("duckdb")
    from tools.compare import TABLES, rows

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = rows(con.execute(catalogue.ORACLE[name]).df())
    assert want and rows(catalogue.QUERIES[name](spark, SF).toPandas()) == want


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
def test_whole_graph(spark):
    """The graph queries read every row of lineitem with its own part and supplier numbers; brute force on the smallest scale."""
    e = {(r[0], r[1]) for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()}
    assert {tuple(r) for r in catalogue.whole_edges(spark, SF).collect()} == e
    nodes = {x for pair in e for x in pair}
    assert len(nodes) > 60

    def reach(start, links, avoid=None):
        seen, front = {start}, [start]
        while front:
            front = [b for a, b in links if a in set(front) and b not in seen and b != avoid]
            seen.update(front)
        return seen

    got = lambda name: {tuple(r) for r in catalogue.QUERIES[name](spark, SF).collect()}
    starts = {a for a, _ in e if a < 5}
    assert got("q42_reachability") == {(s, n) for s in starts for n in reach(s, e)}
    inside = reach(1, e)
    assert got("q44_dominators") == {(n, d) for d in inside for n in inside - {d} if d == 1 or n not in reach(1, e, d)}
    both = e | {(b, a) for a, b in e}
    assert got("q47_components") == {(n, min(reach(n, both))) for n in nodes if any(n in p and p[0] != p[1] for p in e)}
