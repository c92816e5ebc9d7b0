"""Reshaping and aggregating series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalized_measurements(rows: DataFrame, aliases: dict[str, str], location: str = "location_key") -> DataFrame:
    """Raw JSON measurements (``json`` and a location) to (location, hour, parameter column, value); what can't be read leaves."""
    from hazeworks.functions.scalar import first_text, hour_floor, measured_at, parameter_name

    known = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    value = first_text(F.col("json"), "$.value").try_cast("double")
    out = rows.select(location, hour_floor(F.try_to_timestamp(measured_at(F.col("json")))).alias("timestamp_utc"), F.try_element_at(known, parameter_name(F.col("json"))).alias("parameter"), F.when(~F.isnan(value), value).alias("value"))
    return out.na.drop(how="any", subset=["timestamp_utc", "parameter", "value"])


def pivot_mean(df: DataFrame, keys: list[str], parameter: str, value: str, parameters: list[str]) -> DataFrame:
    """One column of means per listed parameter: the schema doesn't depend on the data."""
    return df.groupBy(*keys).agg(*(F.avg(F.when(F.col(parameter) == p, F.col(value))).alias(p) for p in parameters))


def with_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """has_<column> for each column."""
    return df.withColumns({f"has_{c}": F.col(c).isNotNull() for c in columns})


def hourly_mean(df: DataFrame, keys: list[str], ts: str, values: list[str], least: int = 1, others: list[str] = []) -> DataFrame:  # noqa: B006
    """Means per series and hour, of hours with ``least`` rows or more; of other columns the first value that isn't null."""
    grouped = df.groupBy(*keys, F.date_trunc("hour", ts).alias("hour"))
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in others]
    out = grouped.agg(F.count(ts).alias("_n"), *(F.avg(c).alias(c) for c in values), *first)
    return out.where(F.col("_n") >= least).drop("_n")


def hours_with(df: DataFrame, keys: list[str], ts: str, least: int = 5) -> DataFrame:
    """Rows of hours that hold ``least`` rows or more."""
    w = Window.partitionBy(*keys, F.date_trunc("hour", ts))
    return df.withColumn("_n", F.count(ts).over(w)).where(F.col("_n") >= least).drop("_n")


def active_hours(df: DataFrame, hour: str, value: str, least: int) -> DataFrame:
    """Rows of hours in which ``least`` rows or more have a value."""
    return df.withColumn("_n", F.count(value).over(Window.partitionBy(hour))).where(F.col("_n") >= least).drop("_n")


def hourly_spine(df: DataFrame, entities: DataFrame, keys: list[str], ts: str, start: Column, end: Column) -> DataFrame:
    """Every entity at every hour from start to end (both included), with its values or nulls."""
    spine = entities.select(*keys).distinct().withColumn(ts, F.explode(F.sequence(start, end, F.expr("INTERVAL 1 HOUR"))))
    return spine.join(df, [*keys, ts], "left")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def merged_sources(sources: list[tuple[int, DataFrame]], keys: list[str]) -> DataFrame:
    """Union of sources by name, one row per key: that of the source of highest priority."""
    out = None
    for priority, df in sources:
        one = df.withColumn("_p", F.lit(priority))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return first_per_key(out, keys, [F.desc("_p")]).drop("_p")


def band_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Minimum, maximum, mean, population deviation and percentage of valid cells."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"), (100.0 * F.count(v) / F.count("*")).alias("valid_percent"))


def histogram(df: DataFrame, keys: list[str], value: str, buckets: int) -> DataFrame:
    """Counts in equal buckets between a group's minimum and maximum, which is in the last bucket."""
    span = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = F.least(F.lit(buckets - 1), F.coalesce(F.floor(F.try_divide((F.col(value) - F.col("_lo")) * buckets, F.col("_hi") - F.col("_lo"))), F.lit(0)))
    return df.join(span, keys).where(F.col(value).isNotNull()).groupBy(*keys, at.cast("int").alias("bucket")).count().withColumnRenamed("count", "n")


def units_checked(units: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected units (variable, unit) whose metadata is missing or differs."""
    return expected.join(units.select("variable", F.col("unit").alias("found")), "variable", "left").where(~F.col("unit").eqNullSafe(F.col("found")))


def require_units(df: DataFrame, units: DataFrame, expected: DataFrame) -> DataFrame:
    """``df``, or an error that names the variables whose unit isn't as expected."""
    bad = [r["variable"] for r in units_checked(units, expected).limit(100).collect()]
    if bad:
        raise ValueError(f"unexpected units: {', '.join(sorted(bad))}")
    return df


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_unique_columns(df: DataFrame) -> DataFrame:
    """The first column of each name; works on frames whose names repeat, which name-based access can't."""
    first = [df.columns.index(c) for c in dict.fromkeys(df.columns)]
    return df.toDF(*(f"_{i}" for i in range(len(df.columns)))).select(*(F.col(f"_{i}").alias(df.columns[i]) for i in first))


def backfilled(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with every column of name -> type, null where it was missing: the schema is constant."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns})
