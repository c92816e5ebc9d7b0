"""Splits for machine learning: by time, by left-out stations, by country."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(df: DataFrame, ts: str, tie: str, keys: list[str] = [], bucket: str = "day") -> DataFrame:  # noqa: B006
    """Adds _pos (0-based, by ts then tie) and _n per group of ``keys``, without one task for a whole group.

    Rows are numbered within time buckets; a table of bucket counts (one row per group and bucket) gives the offsets.
    """
    rows = df.withColumn("_bucket", F.date_trunc(bucket, ts))
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_c").over(w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"), F.sum("_c").over(w).alias("_n"))
    numbered = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(ts, tie)))
    placed = numbered.join(offsets.withColumnsRenamed({k: f"_k_{k}" for k in keys} | {"_bucket": "_b"}), [F.col("_bucket").eqNullSafe(F.col("_b")), *(F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys)])
    return placed.withColumn("_pos", F.col("_offset") + F.col("_i") - 1).select(*df.columns, "_pos", "_n")


def chronological(df: DataFrame, ts: str, tie: str, train: float = 0.70, validation: float = 0.15, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds ``split``: the first rows train, the next validate, the last test; fractions round down."""
    p = positions(df, ts, tie, keys)
    a, b = F.floor(F.col("_n") * F.lit(float(train))), F.floor(F.col("_n") * F.lit(float(train) + float(validation)))
    return p.withColumn("split", F.when(F.col("_pos") < a, "train").when(F.col("_pos") < b, "validation").otherwise("test")).drop("_pos", "_n")


def permuted(keys: list[str], seed: int = 42) -> list[str]:
    """Seeded permutation of a station list; it is short and lives on the driver."""
    return [keys[i] for i in np.random.RandomState(seed).permutation(len(keys))]


def leave_stations_out(df: DataFrame, key: str, test: int = 3, validation: int = 3, order: Column | None = None) -> DataFrame:
    """Adds ``split`` by station: the first stations in hash order test, the next validate, the rest train.

    ``order`` ranks stations (md5 of the key by default, which any SQL engine reproduces). There is one row per station in the
    ranking; Spark broadcasts it where it is small.
    """
    stations = df.select(key).distinct().withColumn("_o", F.md5(F.col(key).cast("string").cast("binary")) if order is None else order)
    # Only the first test + validation stations matter: a top-k, not a global window.
    chosen = stations.orderBy("_o", key).limit(test + validation)
    ranked = chosen.withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_o", key)))
    marked = df.join(ranked.select(F.col(key).alias("_k"), "_r"), F.col(key) == F.col("_k"), "left")
    return marked.withColumn("split", F.when(F.col("_r") <= test, "test").when(F.col("_r").isNotNull(), "validation").otherwise("train")).drop("_k", "_r", "_o")


def transfer(df: DataFrame, country: str, key: str, ts: str, target: str, held_out: DataFrame, early: float = 0.4, late: float = 0.6) -> DataFrame:
    """Adds ``split`` for transfer learning.

    Other countries train a base model. Of the target country, held-out stations test; of the rest, rows before the ``early``
    share of that country's time order fine-tune, rows before ``late`` validate, later ones are tested as the later period.
    """
    p = positions(df, ts, key, [country])
    marked = p.join(held_out.select(F.col(key).alias("_h")).distinct(), F.col(key) == F.col("_h"), "left")
    a, b = F.floor(F.col("_n") * F.lit(early)), F.floor(F.col("_n") * F.lit(late))
    split = F.when(~F.col(country).eqNullSafe(F.lit(target)), "base").when(F.col("_h").isNotNull(), "test_stations").when(F.col("_pos") < a, "fine_tune").when(F.col("_pos") < b, "validation").otherwise("test_later")
    return marked.withColumn("split", split).drop("_h", "_pos", "_n")


def at_places(df: DataFrame, places: DataFrame, key: str = "location_key") -> DataFrame:
    """Rows whose key is among ``places``, which may repeat it; null keys are among none."""
    return df.join(places.select(key), key, "left_semi")
