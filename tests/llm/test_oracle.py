"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from coursebeacon.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, small, name):
    with duckdb.connect() as con:
        for table in ("documents", "pages", "benchmark", "labels", "conversations"):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(small, table)}.parquet'")
        relation = con.sql(queries.oracle_sql()[name])
        columns = sorted(relation.columns)
        expected = [tuple(row[relation.columns.index(c)] for c in columns) for row in relation.fetchall()]
    found = queries.QUERIES[name](spark, small)
    assert sorted(found.columns) == columns
    rows = [tuple(r[c] for c in columns) for r in found.collect()]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
