"""The registered queries, and those with SQL against DuckDB."""

import re

import duckdb
import pytest

import __spark_entry__ as entry_point
from cladeforge.llm.queries import ORACLES, QUERIES

from ..test_contract import TABLES, rows


def test_one_query_for_each_operator_and_the_pipeline():
    names = set(entry_point.queries())
    assert sorted(int(m[1]) for n in QUERIES if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= names and set(ORACLES) <= set(entry_point.oracle_sql())


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
