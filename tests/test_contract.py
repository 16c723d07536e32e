"""Every query with SQL gives what DuckDB gives on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from cladeforge.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(str([plain(r[i]) for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    expected = con.execute(ORACLES[name])
    names = [d[0] for d in expected.description]
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_and_registry(spark):
    assert entry_point.entry(spark).columns == ["seq_id", "cluster_id", "d", "is_assigned"]
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
