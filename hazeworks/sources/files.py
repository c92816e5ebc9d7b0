"""File sources: sensor CSVs with damaged headers, nested JSON, columnar JSON blocks, landed granules."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeworks.functions import headers
from hazeworks.functions.scalar import ewkt_point, field_or_default, nan_to_null, text_or_unknown

SENSOR_VALUES = ["pm1", "pm25", "pm10", "co2", "tvoc", "temperature_c", "humidity_pct"]


def file_stem(path: Column) -> Column:
    """Name of a file without folders and extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _separator(line: str | None) -> str:
    try:
        return csv.Sniffer().sniff(line, ",;\t|").delimiter if line else ","
    except csv.Error:
        return ","


def sniffed_separator(spark: SparkSession, path: str) -> str:
    """Separator of a CSV, from its first line."""
    line = spark.read.text(path).first()
    return _separator(line[0] if line else None)


def header_groups(spark: SparkSession, paths: str | list[str]) -> list[tuple[str, list[str]]]:
    """(header line, files) of files, folders or globs, found in one job; files without a line are left out.

    What reaches the driver is what listing the files holds anyway: their names, and their distinct headers.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value"), F.monotonically_increasing_id().alias("n"), F.col("_metadata.file_block_start").alias("at"))
    first = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "n").alias("header"))
    groups = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    return [(g.header, g.files) for g in groups]


def sensor_csv(spark: SparkSession, path: str | list[str], separator: str = ",") -> DataFrame:
    """One sensor file, or several of equal header: timestamp (UTC) and every known value column, null where the file lacks it.

    Undecodable bytes in headers are replaced; values are read as text and cast, so damage in a cell costs the cell only.
    """
    raw = spark.read.option("header", True).option("sep", separator).csv(path)
    known = headers.sensor_columns(raw.columns)
    if "timestamp" not in known:
        raise ValueError(f"no timestamp column in {path}: {raw.columns}")
    value = lambda c: nan_to_null(F.col(f"`{known[c]}`").try_cast("double")) if c in known else F.lit(None).cast("double")
    return raw.select(F.try_to_timestamp(F.col(f"`{known['timestamp']}`")).alias("timestamp_utc"), *(value(c).alias(c) for c in SENSOR_VALUES), file_stem(F.input_file_name()).alias("stem"))


def sensor_csvs(spark: SparkSession, paths: str | list[str], separator: str | None = None) -> DataFrame:
    """Files, folders or globs of sensor files, one scan per distinct header. Unless given, each header's separator is sniffed.

    The station is what precedes the first ``-`` and ``_`` of a stem.
    """
    groups = header_groups(spark, paths) if paths else []
    if not groups:
        raise ValueError("no sensor files")
    rows = reduce(DataFrame.unionByName, (sensor_csv(spark, found, separator or _separator(header)) for header, found in groups))
    return rows.withColumn("station", F.split(F.split("stem", "-")[0], "_")[0])


def placed_sensors(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Readings of configured stations with their coordinates; unknown stations leave. Spark broadcasts stations if small."""
    return readings.join(stations, "station", "inner")


LOCATION_PAGE = (
    "results array<struct<id:long,name:string,locality:string,timezone:string,country:struct<id:long,code:string,name:string>,owner:struct<id:long,name:string>,provider:struct<id:long,name:string>,"
    "isMobile:boolean,isMonitor:boolean,sensors:array<struct<id:long,name:string,parameter:struct<id:long,name:string,units:string,displayName:string>>>,"
    "coordinates:struct<latitude:double,longitude:double>,datetimeFirst:struct<utc:string,local:string>,datetimeLast:struct<utc:string,local:string>>>"
)


def location_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per location of landed API pages."""
    return spark.read.schema(LOCATION_PAGE).option("multiLine", True).json(path).select(F.explode("results").alias("r")).select("r.*")


def flat_locations(documents: DataFrame) -> DataFrame:
    """The columns of the locations table."""
    return documents.select(
        F.concat(F.lit("openaq:"), F.col("id").cast("string")).alias("location_key"), F.lit("openaq").alias("source"), F.col("id").cast("string").alias("external_id"), "name", "locality",
        F.col("country.code").alias("country_iso"), F.col("owner.name").alias("owner_name"), F.col("provider.name").alias("provider_name"),
        F.coalesce("isMonitor", F.lit(False)).alias("is_monitor"), F.coalesce("isMobile", F.lit(False)).alias("is_mobile"),
        F.col("coordinates.latitude").alias("latitude"), F.col("coordinates.longitude").alias("longitude"), ewkt_point(F.col("coordinates.longitude"), F.col("coordinates.latitude")).alias("geom"),
    )


#: The columns of training tables that aren't numbers.
TRAINING_TEXTS = ["location_key", "location_name", "city", "country", "provider", "timezone"]


def training_tables(spark: SparkSession, measurements: str | list[str], locations: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Measurements and locations of a model's input from CSVs with headers; keys and names are texts, all other columns numbers.

    Cells that can't be read are null, NaN as well. A time that can't be read is an error once its row is used: a split by time would
    lose the row. Files of one path are read by the first one's header, and an error ends the scan where another differs.
    """

    def read(path: str | list[str], needed: list[str]) -> DataFrame:
        raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
        missing = [c for c in needed if c not in raw.columns]
        if missing:
            raise ValueError(f"no {', '.join(missing)} in {path}: {raw.columns}")
        kinds = {"timestamp_utc": lambda c: c.cast("timestamp")} | {t: lambda c: c for t in TRAINING_TEXTS}
        number = lambda c: nan_to_null(c.try_cast("double"))
        return raw.select(*(kinds.get(c, number)(F.col(f"`{c}`")).alias(c) for c in raw.columns))

    return read(measurements, ["location_key", "timestamp_utc"]), read(locations, ["location_key"])


def location_sensors(documents: DataFrame) -> DataFrame:
    """One row per sensor of each location, with its parameter and the location's first instant."""
    rows = documents.select(F.col("id").alias("location_id"), F.col("datetimeFirst.utc").alias("first_seen"), F.explode("sensors").alias("s"))
    return rows.select("location_id", "first_seen", F.col("s.id").alias("sensor_id"), F.lower("s.parameter.name").alias("parameter"))


def measurement_rows(spark: SparkSession, path: str, location: Column | None = None) -> DataFrame:
    """Measurements as raw JSON texts (``json``): their fields are objects or texts, so no schema is inferred.

    With ``location`` there is a ``location_key`` too (see ``located``).
    """
    rows = spark.read.text(path).select(F.col("value").alias("json"))
    return rows if location is None else located(rows, location)


def located(rows: DataFrame, location: Column) -> DataFrame:
    """Adds ``location_key``: a measurement's own ``locationId``, ``location`` where it has none, ``unknown`` where what it has is null."""
    return rows.withColumn("location_key", text_or_unknown(field_or_default(F.col("json"), "locationId", location)))


def hourly_block(blocks: DataFrame, variables: list[str], block: str = "hourly") -> DataFrame:
    """Parallel arrays ``block.time`` and ``block.<variable>`` to rows of time and variables; other columns are kept.

    Arrays that are shorter than ``time`` give nulls.
    """
    others = [c for c in blocks.columns if c != block]
    zipped = F.arrays_zip(F.col(f"{block}.time").alias("time"), *(F.col(f"{block}.{v}").alias(v) for v in variables))
    rows = blocks.select(*others, F.explode(zipped).alias("z"))
    return rows.select(*others, F.try_to_timestamp(F.col("z.time")).alias("timestamp_utc"), *(F.col(f"z.{v}").alias(v) for v in variables)).where("timestamp_utc is not null")


def grid_blocks(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """Landed grid-cell documents: a file holds one object or an array of them."""
    arrays = ", ".join(f"{v}:array<double>" for v in variables)
    return spark.read.schema(f"latitude double, longitude double, hourly struct<time:array<string>, {arrays}>").option("multiLine", True).json(path)


def landed_granules(spark: SparkSession, path: str, suffix: str, tile: str, least_bytes: int = 100_000) -> DataFrame:
    """Listing of landed files with a suffix and a tile in their name, too small ones left out; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return files.withColumn("granule", name).where(name.endswith(suffix) & name.contains(tile) & (F.col("length") >= least_bytes))


def state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table, or an empty one where nothing was written yet."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
