"""Feature views: measurements with their location, local time and city."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeworks.functions.scalar import CITIES, ZONES, by_country, local_hour, local_weekday


def training_hourly(measurements: DataFrame, locations: DataFrame) -> DataFrame:
    """Measurements joined to locations; the city falls back to locality, country, then ``unknown``."""
    city = by_country(F.col("country_iso"), CITIES, F.coalesce("locality", "country_iso", F.lit("unknown")))
    return measurements.join(locations, "location_key").withColumn("city", city)


def training_clean(clean: DataFrame, locations: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    """Clean measurements with city, local hour and weekday (0 is Sunday); null for countries without a zone."""
    zone = by_country(F.col("country_iso"), ZONES)
    joined = clean.join(locations, "location_key")
    return joined.withColumns({"city": by_country(F.col("country_iso"), CITIES), "local_hour": local_hour(F.col(ts), zone), "local_dow": local_weekday(F.col(ts), zone)})


def register(name: str, df: DataFrame) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df
