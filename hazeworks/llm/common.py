"""Small helpers the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and the control characters 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or, in a session within one process only, one of our own where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='hazeworks-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: a lineage cut that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Jobs within run under this setting."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def arrow_rows(spark: SparkSession, most: int) -> AbstractContextManager[None]:
    """Jobs within send at most so many rows to Python at a time; for rows that are large."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(most))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it as often as wanted in ``body``, inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Elements that one step of ``running`` folds by itself.
FOLD = 256


def running(values: Column, join: Callable[[Column, Column], Column], zero: Column) -> Column:
    """Running fold of an array, each element included: of ``FOLD`` at a time, then over these parts. Growing an array copies it, so
    a single fold would cost the square of its size."""
    last = lambda a: F.element_at(a, -1)
    grown = lambda a, x: F.concat(a, F.array(join(last(a), x)))

    def folded(v: Column) -> Column:
        part = lambda b: F.slice(F.aggregate(F.slice(v, b * FOLD + 1, FOLD), F.array(zero), grown), 2, FOLD)
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / FOLD).cast("int")), part)
        joined = lambda ps: F.flatten(F.zip_with(F.slice(F.aggregate(ps, F.array(zero), lambda a, p: grown(a, last(p))), 1, F.size(ps)), ps, lambda o, p: F.transform(p, lambda x: join(o, x))))
        return F.when(F.size(v) > 0, bind(parts, joined)).otherwise(F.slice(F.array(zero), 1, 0))

    return bind(values, folded)


def quoted(name: str) -> Column:
    """The column of this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def set_aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns of these names (in any case), and of such as need quotes, renamed, and what brings ``docs``'s own columns back from a result."""
    taken = {n.lower() for n in names}
    renamed = {c: f"_{uuid.uuid4().hex}" for c in docs.columns if c.lower() in taken or not c.isidentifier()}
    columns = docs.columns
    return docs.withColumnsRenamed(renamed), lambda out: out.select(*(quoted(renamed.get(c, c)).alias(c) for c in columns))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and blank texts give an empty one."""
    bare = F.trim(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " +"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that no slice holds more than about ``most_bytes`` of ``column`` (one row at least)."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        start = held = 0
        for row, value in enumerate(values):
            size = len(value.as_buffer()) if value.is_valid else 0
            if held and held + size > most_bytes:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def even_keys(spark: SparkSession, partitions: int) -> list[int]:
    """Key number i goes to a partition of its own under ``repartition(partitions, key)``: one key for each partition."""
    found: dict[int, int] = {}
    span = 8 * partitions
    while len(found) < partitions:
        ids = spark.range(span).select("id", F.pmod(F.hash("id"), F.lit(partitions)).alias("p"))
        found = {r["p"]: r["id"] for r in ids.groupBy("p").agg(F.min("id").alias("id")).collect()}
        span *= 2
    return [found[i] for i in range(partitions)]
