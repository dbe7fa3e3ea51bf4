"""A spread of registered queries against DuckDB on the smallest tables; tools/compare.py runs them all."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

NAMES = [
    "j1_match", "c6_policies", "a1_decisions_sdk", "s1_obligations", "s3_inventory", "s6_lineage_extract", "s7_canonical_audit", "g1a_kpis", "g2_sync_plan",
    "g6_policy_diff", "l3_graph_nodes", "l7_analysis", "h2_seal_blocks", "h4_proofs", "h5_verify_proofs", "h6_verify_ledger", "p3_deep_page", "g8_diff_report", "e5_mask_noise", "e8_value_filter", "e11_binding_plan", "d2_chunks", "d3_vector_topk",
    "d9_merged_obligations", "x1_glob", "x5_uuid5", "x6_type_names",
]


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    from workload.tables import BASE

    con = duckdb.connect()
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, duck, name):
    from __spark_entry__ import oracle_sql, queries
    from compare import rows_of

    df = queries()[name](spark, sf_dir)
    cursor = duck.execute(oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_every_statement_has_a_query():
    from workload.all_queries import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == set()
