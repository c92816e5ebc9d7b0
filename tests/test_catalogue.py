"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import datetime
import importlib
import os
import sys

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()

import __spark_entry__ as entry  # noqa: E402
from hazeworks.plans import catalogue  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        f = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{f}/*.parquet' )" if os.path.isdir(f) else f"create view {t} as select * from read_parquet('{f}')")
    return con


def canonical(rows, order):
    def value(v):
        if isinstance(v, float):
            return None if v != v else float(f"{v:.9g}")
        if isinstance(v, datetime.datetime):
            return v.replace(tzinfo=None).isoformat()
        return v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    found = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    ours = canonical([tuple(r) for r in df.collect()], [df.columns.index(c) for c in sorted(columns)])
    assert ours == canonical(found.fetchall(), [columns.index(c) for c in sorted(columns)])


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["event_type", "hour", "value"] and not found.isEmpty()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_subpackage(monkeypatch):
    """The driver may delete that subpackage and the pipeline."""
    for name in [n for n in sys.modules if n.startswith("hazeworks.llm")] + ["hazeworks.llm", "corpus_pipeline"]:
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.delattr("hazeworks.llm", raising=False)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    alone = importlib.import_module("__spark_entry__")
    assert set(alone.queries()) == set(catalogue.queries())
    assert set(alone.oracle_sql()) == set(catalogue.oracle_sql())
    monkeypatch.undo()
    sys.modules["__spark_entry__"] = entry


def test_leave_one_out_of_stations_in_one_place(spark, tmp_path):
    """Keys 40,000 apart share a place: infinite weights in the SQL, whose quotient is NaN, not the other station's value."""
    con = duckdb.connect()
    con.execute(f"copy (select s.* replace (s_suppkey + i * 40000 as s_suppkey) from '{SF}/supplier.parquet' s, range(3) r(i) where i = 0 or s_nationkey % 2 = 0) to '{tmp_path}/supplier.parquet'")
    con.execute(f"copy (from '{SF}/part.parquet') to '{tmp_path}/part.parquet'")
    for t in ("supplier", "part"):
        con.execute(f"create view {t} as from '{tmp_path}/{t}.parquet'")
    # Fewer than three stations have no row, those in one place NaN.
    rows = con.execute(catalogue.oracle_sql()["leave_one_out_errors"])
    names, want = [c[0] for c in rows.description], rows.fetchall()
    got = [tuple(r) for r in catalogue.queries()["leave_one_out_errors"](spark, str(tmp_path)).select(*names).collect()]
    nan = lambda rows: sorted(r[0] for r in rows if r[2] is not None and r[2] != r[2])
    assert nan(got) == nan(want) != []
    assert sorted(r[:2] for r in got) == sorted(r[:2] for r in want)
