"""Incremental loading: high-water marks, chunked ranges, processed sets, filters of what to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def watermarks(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Latest time of each key."""
    return df.groupBy(*keys).agg(F.max(ts).alias("watermark"))


def pending(sensors: DataFrame, marks: DataFrame, keys: list[str], fallback: Column, end: Column, first_seen: str | None = None) -> DataFrame:
    """Sensors with something to fetch: start = mark, else the later of fallback and first seen; keys without a mark first."""
    begun = F.greatest(fallback, F.coalesce(F.col(first_seen), fallback)) if first_seen else fallback
    jobs = sensors.join(marks, keys, "left").withColumn("start", F.coalesce("watermark", begun)).withColumn("end", end)
    return jobs.where("start < end").withColumn("priority", F.when(F.col("watermark").isNull(), 0).otherwise(1))


def chunks(jobs: DataFrame, days: int = 365, start: str = "start", end: str = "end") -> DataFrame:
    """[chunk_start, chunk_end) ranges of at most ``days``; an empty range has none."""
    step = F.expr(f"INTERVAL {days} DAYS")
    rows = jobs.where(F.col(start) < F.col(end)).withColumn("chunk_start", F.explode(F.sequence(start, end, step))).where(F.col("chunk_start") < F.col(end))
    return rows.withColumn("chunk_end", F.least(F.col("chunk_start") + step, F.col(end)))


def unprocessed(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items that aren't in the state yet."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Keys of ``rows`` that ``parents`` lack, null among them, with the number of their rows: what a load must not bring in."""
    return rows.join(parents.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))


def require_parents(rows: DataFrame, parents: DataFrame, key: str, named: int = 10) -> DataFrame:
    """``rows``, if every one has a parent; else an error that names some of the keys without."""
    missing = orphans(rows, parents, key).orderBy(F.desc("n"), key).limit(named).collect()
    if missing:
        raise ValueError(f"rows without a parent by {key}: {', '.join(f'{r[key]} ({r.n})' for r in missing)}")
    return rows


def processed(done: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """The state after ``items``."""
    return done.select(key).union(items.select(key)).distinct()


def look_back(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    return df.where(F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS"))


def from_providers(df: DataFrame, provider: Column, allowed: list[str]) -> DataFrame:
    """Rows of the allowed providers, in any case; no provider listed allows all."""
    return df.where(F.lower(F.coalesce(provider, F.lit(""))).isin([p.lower() for p in allowed])) if allowed else df


def in_box(df: DataFrame, lon: Column, lat: Column, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows inside west, south, east, north, edges included; without coordinates a row leaves."""
    west, south, east, north = box
    return df.where(lon.between(west, east) & lat.between(south, north))


def in_places(df: DataFrame, locality: Column, name: Column, cities: list[str], keywords: list[str]) -> DataFrame:
    """Rows of a known locality must be in ``cities``; others need a keyword in their name."""
    named = F.exists(F.array(*(F.lit(k.lower()) for k in keywords)), lambda k: F.contains(F.lower(F.coalesce(name, F.lit(""))), k)) if keywords else F.lit(False)
    known = F.coalesce(locality, F.lit("")) != ""
    return df.where(F.when(known, F.lower(locality).isin([c.lower() for c in cities])).otherwise(named))


def node_share(df: DataFrame, key: str, nodes: int, node: int) -> DataFrame:
    """Rows of one of ``nodes`` machines; one machine takes all."""
    return df if nodes <= 1 else df.where(F.pmod(F.col(key), F.lit(nodes)) == node)


def known_parameters(df: DataFrame, parameter: Column, aliases: dict[str, str]) -> DataFrame:
    return df.where(F.lower(parameter).isin(list(aliases)))


def archive_or_forecast(df: DataFrame, day: str, today: Column) -> DataFrame:
    """Days up to today come from the archive, later ones from the forecast."""
    return df.withColumn("endpoint", F.when(F.col(day) <= today, "archive").otherwise("forecast"))


def endpoint_ranges(df: DataFrame, start: str, end: str, today: Column) -> DataFrame:
    """Each range of days as up to two: days up to today from the archive, later ones from the forecast. Empty ranges leave."""
    past = F.struct(F.lit("archive").alias("endpoint"), F.col(start).alias("a"), F.least(F.col(end), today).alias("b"))
    ahead = F.struct(F.lit("forecast").alias("endpoint"), F.greatest(F.col(start), F.date_add(today, 1)).alias("a"), F.col(end).alias("b"))
    parts = df.withColumn("_part", F.explode(F.array(past, ahead))).where("_part.a <= _part.b")
    return parts.withColumns({"endpoint": F.col("_part.endpoint"), start: F.col("_part.a"), end: F.col("_part.b")}).drop("_part")


def new_granules(listing: DataFrame, done: DataFrame, tag: str, since: Column, name: str = "granule", ts: str = "sensed_at") -> DataFrame:
    """Catalogue entries whose name holds ``tag``, sensed since a time, that aren't in the state."""
    return unprocessed(listing.where(F.col(name).contains(tag) & (F.col(ts) >= since)), done, name)


def clear_enough(scenes: DataFrame, cover: str = "cloud_cover", most: float = 80.0) -> DataFrame:
    """Scenes of at most ``most`` percent clouds; unknown cover leaves."""
    return scenes.where(F.col(cover) <= most)


def by_priority(jobs: DataFrame) -> DataFrame:
    """Jobs of keys never loaded before first, oldest start first."""
    return jobs.orderBy("priority", "start")
