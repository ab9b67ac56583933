"""The driver's contract."""

import duckdb
import pytest

import __spark_entry__
from matchloom.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def compared(spark, query, sql):
    """Rows of a query and of its SQL, columns by name."""
    df = query(spark, SF)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    con.execute(sql)
    names = [d[0] for d in con.description]
    assert sorted(names) == columns
    rows = con.fetchall()
    at = [names.index(c) for c in columns]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr), sorted((tuple(r[i] for i in at) for r in rows), key=repr)


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["catalogue_identifiers", "catalogue_hints", "catalogue_dimensions", "join_partial", "join_relaxed", "spec_counts", "build_report", "match_decisions", "evidence_entries", "result_search", "result_decisions", "result_candidates", "capped_candidates", "capped_routes", "catalogue_installation", "route_per_item", "spec_search", "candidate_scores"])
def test_against_sql(spark, name):
    got, want = compared(spark, QUERIES[name], ORACLES[name])
    assert got == want
