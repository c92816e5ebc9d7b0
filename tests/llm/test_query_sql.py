"""Queries of operators 11 to 13 against their SQL in DuckDB."""

import duckdb
import pytest

from hazeworks.llm import queries


@pytest.mark.parametrize("sf", ["sf0.001"])
@pytest.mark.parametrize("name", ["op11_vectors", "op12_merkle", "op13_repeats"])
def test_against_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/{sf}/{t}.parquet')")
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    got = queries.queries()[name](spark, f"/root/testdata/{sf}")
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)
