import duckdb
import pytest

import __spark_entry__ as entry
from lexigrove.jobs.oracles import ORACLE_SQL as BASE_SQL
from lexigrove.jobs.oracles_index import INDEX_SQL
from lexigrove.jobs.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


ORACLE_SQL = BASE_SQL | INDEX_SQL


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["tokenize_terms", "classify_role_index", "scan_coverage", "edge_counts", "used_by_grouped", "blast_risk", "cosine_topk", "eval_percentiles", "eval_validate", "bm25_topk", "find_with_signals", "line_contexts", "symbol_ref_contexts", "import_edges", "binding_refs", "manifest_edges", "file_risk", "test_edges", "scan_pruned"])
def test_sql_agrees(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    norm = lambda df: df[columns].astype(str).replace({"None": "nan"}).sort_values(columns).reset_index(drop=True)
    assert norm(got).equals(norm(want))
