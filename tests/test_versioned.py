import json

import pytest
from pyspark.sql import functions as F

from hazeworks.sources import sinks
from hazeworks.sources.versioned import Conflict, Versioned

KEYS = ["city", "latitude", "longitude", "day"]
SCHEMA = "city string, latitude double, longitude double, day string, v int, made int"


@pytest.fixture()
def table(spark, tmp_path):
    rows = [("a b/c=d", 1.0, 2.0, "2024-01-01", 1, 10), ("q", 1.0, 2.0, "2024-01-02", 2, 10), ("q", 1.5, 2.0, "2024-01-02", 3, 10), ("é", 1.0, 2.0, "2024-01-03", 4, 10)]
    return Versioned.create(spark, f"file://{tmp_path}/t", spark.createDataFrame(rows, SCHEMA), KEYS, "concat(day, ' ', city)")


def values(df):
    return sorted((r.city, r.latitude, r.day, r.v, r.made) for r in df.collect())


def change(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_merge_rewrites_touched_partitions_only(spark, table):
    before = table.manifest()
    new = change(spark, ("q", 1.0, 2.0, "2024-01-02", None, 20), ("q", 1.5, 2.0, "2024-01-02", 7, 20), ("q", 9.0, 2.0, "2024-01-02", 8, 20), ("z", 1.0, 2.0, "2024-01-04", 9, 20))
    assert table.merge(new, first=["made"], now={"seen": F.lit("now")}) == 1
    after = table.manifest()
    changed = {"2024-01-02 q", "2024-01-04 z"}
    assert {p for p, d in after["parts"].items() if before["parts"].get(p) != d} == changed
    assert values(table.read(0)) == [("a b/c=d", 1.0, "2024-01-01", 1, 10), ("q", 1.0, "2024-01-02", 2, 10), ("q", 1.5, "2024-01-02", 3, 10), ("é", 1.0, "2024-01-03", 4, 10)]
    assert values(table.read()) == [("a b/c=d", 1.0, "2024-01-01", 1, 10), ("q", 1.0, "2024-01-02", 2, 10), ("q", 1.5, "2024-01-02", 7, 10), ("q", 9.0, "2024-01-02", 8, 20), ("z", 1.0, "2024-01-04", 9, 20), ("é", 1.0, "2024-01-03", 4, 10)]
    assert {r.city: r.seen for r in table.read().select("city", "seen").collect()} == {"a b/c=d": None, "q": "now", "z": "now", "é": None}
    assert values(table.read(partitions=["2024-01-03 é"])) == [("é", 1.0, "2024-01-03", 4, 10)]
    assert table.merge(new.limit(0)) == 1
    table.merge(change(spark, ("é", 1.0, 2.0, "2024-01-03", None, 5)), "overwrite")
    assert values(table.read(partitions=["2024-01-03 é"])) == [("é", 1.0, "2024-01-03", None, 5)]


def test_a_reader_keeps_its_version(spark, table):
    reader = table.read()
    table.merge(change(spark, ("q", 1.0, 2.0, "2024-01-02", 5, 20)))
    assert [r[3] for r in values(reader)] == [1, 2, 3, 4]
    assert [r[3] for r in values(Versioned(spark, table.path).read())] == [1, 5, 3, 4]


@pytest.mark.parametrize("step", ["_store", "_commit"])
def test_killed_at_any_step(spark, table, monkeypatch, step):
    """A merge that ends before or after its data, or its draft of a manifest, leaves the version before."""
    plain = getattr(Versioned, step)

    def killed(self, *args):
        if step == "_store":
            plain(self, *args)
        else:
            self._fs.create(self._file("versions/.draft-1"), False).close()
        raise KeyboardInterrupt

    monkeypatch.setattr(Versioned, step, killed)
    with pytest.raises(KeyboardInterrupt):
        table.merge(change(spark, ("q", 1.0, 2.0, "2024-01-02", 5, 20)))
    monkeypatch.undo()
    assert table.versions() == [0] and [r[3] for r in values(table.read())] == [1, 2, 3, 4]
    assert table.merge(change(spark, ("q", 1.0, 2.0, "2024-01-02", 6, 20))) == 1
    assert [r[3] for r in values(table.read())] == [1, 6, 3, 4]
    assert len(table.vacuum(1)) >= 1 + (step == "_store")
    assert [r[3] for r in values(table.read())] == [1, 6, 3, 4] and table.versions() == [1]


def test_of_two_writers_one_fails(spark, table):
    stale = table.manifest()
    other = Versioned(spark, table.path)
    other.merge(change(spark, ("q", 1.0, 2.0, "2024-01-02", 5, 20)))
    with pytest.raises(Conflict):
        table._commit(stale["version"] + 1, {k: stale[k] for k in ("keys", "partition", "schema", "parts")})
    assert [r[3] for r in values(table.read())] == [1, 5, 3, 4]


def test_replace_and_state(spark, table, tmp_path):
    table.replace(table.read().where("v > 1"))
    assert [r[3] for r in values(table.read())] == [2, 3, 4]
    path = str(tmp_path / "state")
    for done in (["a"], ["a", "b"]):
        state = sinks.save_state(spark.createDataFrame([(x,) for x in done], "scene string"), path)
        assert sorted(r.scene for r in state.collect()) == done
    assert sorted(r.scene for r in sinks.load_state(spark, path).collect()) == ["a", "b"]
    assert json.loads((tmp_path / "state" / "versions" / "000000000001.json").read_text())["partition"] == "'all'"
    with pytest.raises(FileNotFoundError):
        Versioned(spark, str(tmp_path / "none")).read()
