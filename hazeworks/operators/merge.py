"""Upserts as a rebuild: full outer join of the stored and the new rows by key, then an overwrite of the table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeworks.operators.series import first_per_key


def upsert(old: DataFrame, new: DataFrame, keys: list[str], mode: str = "coalesce", first: list[str] = [], now: dict[str, Column] | None = None, newest: list[Column] | None = None) -> DataFrame:  # noqa: B006
    """Rows of both by key.

    ``coalesce`` keeps a stored value where the new one is null; ``overwrite`` takes the whole new row. Columns in ``first``
    keep the stored value of a known key. ``now`` are columns set on inserted and updated rows. New rows are made unique by
    key before, by ``newest``; unless that is given the row of largest values, column by column, is taken. Columns that only one side has are null on the other.
    """
    new = first_per_key(new, keys, newest or [F.col(c).desc_nulls_last() for c in new.columns if c not in keys] or [F.lit(1)])
    columns = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    o = old.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in old.columns if c not in keys), F.lit(True).alias("_old"))
    n = new.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys), F.lit(True).alias("_new"))
    both = o.join(n, keys, "full_outer")

    def side(c: str, prefix: str, df: DataFrame) -> Column:
        return F.col(f"{prefix}{c}") if c in df.columns else F.lit(None)

    out = []
    for c in columns:
        stored, given = side(c, "_o_", old), side(c, "_n_", new)
        if c in first:
            value = F.when(F.col("_old"), stored).otherwise(given)
        elif mode == "overwrite":
            value = F.when(F.col("_new"), given).otherwise(stored)
        else:
            value = F.coalesce(given, stored)
        if now and c in now:
            value = F.when(F.col("_new"), now[c]).otherwise(stored)
        out.append(value.alias(c))
    out += [F.when(F.col("_new"), value).alias(c) for c, value in (now or {}).items() if c not in columns]
    return both.select(*keys, *out)


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df``, which may read the table at ``path``, beside it, and move it there once it is whole.

    The old table is moved aside before and deleted last, so at every moment a whole table, old or new, is there; after an interruption
    between the two moves ``recovered_table`` puts the old one back.
    """
    spark = df.sparkSession
    place = path.rstrip("/")
    aside = f"{place}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, source, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (place, aside, f"{place}-old"))
    fs = target.getFileSystem(conf)
    df.write.parquet(aside)
    if fs.exists(target):
        fs.delete(old, True)
        if not fs.rename(target, old):
            raise OSError(f"can't move {path} aside")
    if not fs.rename(source, target):
        raise OSError(f"can't move {aside} to {path}")
    fs.delete(old, True)
    return spark.read.schema(df.schema).parquet(path)


def recovered_table(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``; where ``replace_table`` was interrupted between its moves, the old one is put back first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path.rstrip("/"), f"{path.rstrip('/')}-old"))
    fs = target.getFileSystem(conf)
    if not fs.exists(target) and fs.exists(old):
        fs.rename(old, target)
    return spark.read.parquet(path)
