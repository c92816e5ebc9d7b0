"""Tables of versions: merges rewrite the partitions they touch, and one new manifest file makes a version the current one.

A table's folder has ``data`` (Parquet, a folder for each partition of each write, never changed once written) and ``versions``: for each
version a manifest, JSON that names the folders that make up the table. Readers take the manifest of highest number and see that version
until they ask again. A commit writes its manifest under another name and renames it to the next number, which fails if that exists: so a
version is whole or not there, whatever step a writer is killed at, and of two writers one gets ``Conflict`` and may try again.

A row's partition follows from its key by an SQL expression that is kept in the manifest. A manifest has one entry a partition, whatever the rows; the driver
handles those, as it does the listing of any partitioned table, and no rows. A manifest may name side tables as well, to which a merge adds rows in the same
commit as its data: a ledger of what has been loaded can't run ahead of the rows, or lag behind.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from py4j.protocol import Py4JJavaError

from hazeworks.operators.merge import upsert

#: Name of the partition column in data folders, and of the partition of rows whose expression is null.
PARTITION, NONE = "_partition", "__none__"


class Conflict(Exception):
    """Another writer has committed this version."""


class Versioned:
    """A table of versions at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._file("").getFileSystem(self._conf)

    @classmethod
    def create(cls, spark: SparkSession, path: str, df: DataFrame, keys: list[str], partition: str) -> Versioned:
        """A new table of the rows of ``df``, which are unique by ``keys``; ``partition`` is an SQL expression over the keys."""
        table = cls(spark, path)
        kind = StructType([f for f in df.schema.fields])
        for f in kind.fields:
            f.nullable = True
        table._commit(0, {"keys": keys, "partition": partition, "schema": json.loads(kind.json()), "parts": table._store(df, partition)})
        return table

    # Versions

    def versions(self) -> list[int]:
        """Numbers of the versions that are there, ascending."""
        folder = self._file("versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """A version's manifest, with its number; the current one's unless given."""
        if version is None:
            there = self.versions()
            if not there:
                raise FileNotFoundError(f"no table at {self.path}")
            version = there[-1]
        text = self.spark.read.text(f"{self.path}/versions/{version:012d}.json", wholetext=True).first()
        return json.loads(text.value) | {"version": version}

    def read(self, version: int | None = None, partitions: list[str] | None = None) -> DataFrame:
        """The table's rows at a version; only those of some partitions if these are given."""
        return self._read(self.manifest(version), partitions)

    def side(self, name: str, schema: str) -> DataFrame:
        """Rows of a side table at the current version; empty if nothing was ever added."""
        folders = self.manifest().get("sides", {}).get(name, [])
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{d}" for d in folders)) if folders else self.spark.createDataFrame([], schema)

    # Changes

    def merge(self, new: DataFrame, mode: str = "coalesce", first: list[str] = [], now: dict[str, Column] | None = None, newest: list[Column] | None = None, sides: dict[str, DataFrame] | None = None) -> int:  # noqa: B006
        """Upsert ``new`` (see ``merge.upsert``) into the current version; returns the new version. Other partitions keep their files. ``sides``: rows to add to side tables."""
        at = self.manifest()
        placed = new.withColumn(PARTITION, _partition(at["partition"]))
        touched = [r[0] for r in placed.select(PARTITION).distinct().collect()]
        if not touched and not sides:
            return at["version"]
        merged = upsert(self._read(at, touched), new, at["keys"], mode, first, now, newest)
        schema = StructType.fromJson(at["schema"])
        if more := [f for f in merged.schema.fields if f.name not in schema.names]:
            for f in more:
                f.nullable = True
                schema.add(f)
        parts = {p: d for p, d in at["parts"].items() if p not in touched} | (self._store(merged, at["partition"]) if touched else {})
        beside = dict(at.get("sides", {}))
        for name, rows in (sides or {}).items():
            beside[name] = [*beside.get(name, []), f"data/{uuid.uuid4().hex}"]
            rows.write.parquet(f"{self.path}/{beside[name][-1]}")
        return self._commit(at["version"] + 1, {"keys": at["keys"], "partition": at["partition"], "schema": json.loads(schema.json()), "parts": parts, "sides": beside})

    def replace(self, df: DataFrame) -> int:
        """Make the rows of ``df``, which may read the table, its new version."""
        at = self.manifest()
        return self._commit(at["version"] + 1, {"keys": at["keys"], "partition": at["partition"], "schema": json.loads(df.schema.json()), "parts": self._store(df, at["partition"]), "sides": at.get("sides", {})})

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete all but the last ``keep`` versions, and data folders that none of these names; returns the folders. Not while a merge runs."""
        there = self.versions()
        for version in there[:-keep]:
            self._fs.delete(self._file(f"versions/{version:012d}.json"), False)
        kept = {d for v in there[-keep:] for m in [self.manifest(v)] for d in [*m["parts"].values(), *(d for side in m.get("sides", {}).values() for d in side)]}
        used = {d.split("/")[1] for d in kept}
        writes = [s.getPath().getName() for s in self._fs.listStatus(self._file("data"))]
        gone = [w for w in writes if w not in used]
        # Partitions that a later write replaced leave their folder, not the whole write.
        gone += [f"{w}/{s.getPath().getName()}" for w in writes if w in used for s in self._fs.listStatus(self._file(f"data/{w}")) if s.isDirectory() and f"data/{w}" not in kept and f"data/{w}/{s.getPath().getName()}" not in kept]
        for name in gone:
            self._fs.delete(self._file(f"data/{name}"), True)
        return gone

    # Files

    def _file(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _read(self, at: dict, partitions: list[str] | None) -> DataFrame:
        folders = [d for p, d in at["parts"].items() if partitions is None or p in partitions]
        schema = StructType.fromJson(at["schema"])
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{d}" for d in folders)) if folders else self.spark.createDataFrame([], schema)

    def _store(self, df: DataFrame, partition: str) -> dict[str, str]:
        """Write rows as a folder for each partition; partition -> folder."""
        write = f"data/{uuid.uuid4().hex}"
        df.withColumn(PARTITION, _partition(partition)).write.partitionBy(PARTITION).parquet(f"{self.path}/{write}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._file(write)) if s.isDirectory()]
        return {unquote(n.removeprefix(f"{PARTITION}=")): f"{write}/{n}" for n in names if n.startswith(f"{PARTITION}=")}

    def _commit(self, version: int, manifest: dict) -> int:
        draft, final = self._file(f"versions/.draft-{uuid.uuid4().hex}"), self._file(f"versions/{version:012d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), options)
        except (Py4JJavaError, PySparkException) as e:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise Conflict(f"version {version} of {self.path} is there already") from e
            raise
        return version


def _partition(expression: str) -> Column:
    return F.coalesce(F.expr(expression).cast("string"), F.lit(NONE))
