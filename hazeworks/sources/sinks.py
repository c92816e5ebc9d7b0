"""Sinks: CSV, surfaces with their statistics, state tables, DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeworks.functions.scalar import nan_to_null
from hazeworks.operators.series import band_statistics
from hazeworks.sources.versioned import Versioned


def without_nan(df: DataFrame) -> DataFrame:
    """NaN cells of floating columns as nulls."""
    return df.withColumns({c: nan_to_null(F.col(f"`{c}`")).alias(c) for c, kind in df.dtypes if kind in ("double", "float")})


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one file per partition."""
    without_nan(df).write.mode("overwrite").option("header", True).csv(path)


def write_surfaces(df: DataFrame, path: str, layers: list[str], value: str = "estimate") -> DataFrame:
    """Raster cells as Parquet partitioned by layer (hour, band, kind), and their statistics beside them; returns the statistics."""
    rows = without_nan(df)
    rows.repartition(*layers).write.mode("overwrite").partitionBy(*layers).parquet(f"{path}/cells")
    band_statistics(df.sparkSession.read.schema(rows.schema).parquet(f"{path}/cells"), layers, value).write.mode("overwrite").parquet(f"{path}/statistics")
    return df.sparkSession.read.parquet(f"{path}/statistics")


def as_layers(surface: DataFrame, keys: list[str], cell_keys: list[str], kinds: list[str] = ["estimate", "variance"]) -> DataFrame:  # noqa: B006
    """A surface's columns as layers: rows (keys, cell_keys, ``kind``, ``value``), as ``write_surfaces`` takes them with layers [*keys, "kind"]."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds))).alias("l")
    return surface.select(*keys, *cell_keys, each).select(*keys, *cell_keys, "l.*")


def save_state(done: DataFrame, path: str) -> DataFrame:
    """Replace a state table after its work succeeded: a new version, so that a reader finds a whole one at any moment."""
    table = Versioned(done.sparkSession, path)
    if table.versions():
        table.replace(done)
    else:
        Versioned.create(done.sparkSession, path, done, done.columns, "'all'")
    return table.read()


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """The state table's current version."""
    return Versioned(spark, path).read()


#: Table -> columns.
TABLES = {
    "locations": "location_key STRING, source STRING, external_id STRING, name STRING, locality STRING, country_iso STRING, owner_name STRING, provider_name STRING, is_monitor BOOLEAN, is_mobile BOOLEAN,"
    " latitude DOUBLE, longitude DOUBLE, geom STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "measurements": "location_key STRING, timestamp_utc TIMESTAMP, pm25 DOUBLE, temperature_c DOUBLE, humidity_pct DOUBLE, pm1 DOUBLE, pm10 DOUBLE, co2 DOUBLE, tvoc DOUBLE, has_pm1 BOOLEAN, has_pm10 BOOLEAN,"
    " has_co2 BOOLEAN, has_tvoc BOOLEAN, source STRING, raw_payload STRING, inserted_at TIMESTAMP",
    "measurements_clean": "location_key STRING, timestamp_utc TIMESTAMP, pm25 DOUBLE, pm10 DOUBLE, temperature_c DOUBLE, humidity_pct DOUBLE, inserted_at TIMESTAMP",
    "meteo_hourly_grid": "city STRING, latitude DOUBLE, longitude DOUBLE, timestamp_utc TIMESTAMP, temperature_2m DOUBLE, relative_humidity_2m DOUBLE, wind_speed_10m DOUBLE, wind_gusts_10m DOUBLE,"
    " wind_direction_10m DOUBLE, surface_pressure DOUBLE, precipitation DOUBLE, boundary_layer_height DOUBLE, source STRING, inserted_at TIMESTAMP",
    "openmeteo_pm10_grid": "grid_key STRING, latitude DOUBLE, longitude DOUBLE, timestamp_utc TIMESTAMP, pm10 DOUBLE, source STRING, inserted_at TIMESTAMP",
}


def create_tables(spark: SparkSession, names: list[str] | None = None) -> None:
    for name in names or TABLES:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({TABLES[name]}) USING parquet")
