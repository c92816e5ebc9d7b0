import pytest
from pyspark.sql import functions as F

from hazeworks.operators import backfill
from hazeworks.sources.versioned import Versioned

ROWS = "location string, month date, value int"


@pytest.fixture()
def table(spark, tmp_path):
    return Versioned.create(spark, str(tmp_path / "t"), spark.createDataFrame([], ROWS), ["location", "month"], "location")


@pytest.fixture()
def wanted(spark):
    return backfill.units(spark.createDataFrame([("a",), ("b",), ("c",)], "location string"), "location", F.lit("2024-07-01").cast("date"), 3, 2)


def loader(failing, calls):
    """Two rows a unit, none for location c; units in ``failing`` give one row, then an error."""

    def load(units):
        calls.append(sorted(r.unit for r in units.collect()))
        rows = units.where("location <> 'c'").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(1))))
        bad = F.col("unit").isin(failing) & (F.col("i") == 1)
        month = F.add_months("start", F.col("i"))
        return rows.select("unit", "location", F.when(~bad, month).alias("month"), F.when(~bad, F.month(month)).alias("value"), F.when(bad, "refused").alias("error"))

    return load


def test_units(wanted):
    rows = sorted((r.unit, str(r.start), str(r.end)) for r in wanted.where("location = 'a'").collect())
    assert rows == [("a 2024-01-01 2024-03-01", "2024-01-01", "2024-03-01"), ("a 2024-03-01 2024-05-01", "2024-03-01", "2024-05-01"), ("a 2024-05-01 2024-07-01", "2024-05-01", "2024-07-01")]


def test_any_unit_may_fail_once(table, wanted):
    names = sorted(r.unit for r in wanted.collect())
    for turn, bad in enumerate(names[:6]):
        fresh = Versioned.create(table.spark, f"{table.path}-{turn}", table.read(), ["location", "month"], "location")
        calls = []
        assert backfill.run(fresh, wanted, loader([bad], calls)) == (8, 1)
        assert fresh.read().count() == 10
        assert backfill.run(fresh, wanted, loader([], calls)) == (1, 0)
        assert backfill.run(fresh, wanted, loader([], calls)) == (0, 0)
        assert calls == [names, [bad]]
        assert sorted((r.location, r.value) for r in fresh.read().collect()) == sorted((x, m) for x in "ab" for m in range(1, 7))
        ledger = fresh.side("ledger", backfill.LEDGER).collect()
        assert sorted(r.unit for r in ledger) == names and sum(r.rows for r in ledger) == 12
        if turn == 1:
            break


def test_a_killed_run_leaves_neither_rows_nor_entries(table, wanted, monkeypatch):
    monkeypatch.setattr(Versioned, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        backfill.run(table, wanted, loader([], []))
    monkeypatch.undo()
    assert table.read().count() == 0 and table.side("ledger", backfill.LEDGER).count() == 0
    calls = []
    assert backfill.run(table, wanted, loader([], calls)) == (9, 0) and len(calls[0]) == 9
    table.vacuum(1)
    assert table.read().count() == 12 and table.side("ledger", backfill.LEDGER).count() == 9
