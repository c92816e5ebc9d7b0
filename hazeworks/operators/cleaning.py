"""Cleaning of time series: bounds, flat lines, rolling outliers. Windows run within segments of series (see ``segments``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeworks.functions.scalar import round2
from hazeworks.operators import segments

#: Inclusive limits of plausible readings.
BOUNDS = {"pm25": (0.0, 500.0), "pm10": (0.0, 600.0), "temperature_c": (-10.0, 60.0), "humidity_pct": (0.0, 100.0)}


def bounded(df: DataFrame, limits: dict[str, tuple[float, float]], mode: str = "null") -> DataFrame:
    """Cells outside inclusive limits become null (``null``), or rows that hold one leave (``drop``); nulls stay either way."""
    if mode == "drop":
        for c, (low, high) in limits.items():
            df = df.where(F.col(c).isNull() | F.col(c).between(low, high))
        return df
    return df.withColumns({c: F.when(F.col(c).between(low, high), F.col(c)) for c, (low, high) in limits.items()})


def _dropped(df: DataFrame, order: list[str], column: str, max_run: int, rounded: Column | None = None) -> DataFrame:
    value = round2(F.col(column)) if rounded is None else rounded
    return segments.run_lengths(df, order, {"_len": value}, skip_nulls=False).where(F.col("_len") < max_run).drop("_len")


def _nulled(df: DataFrame, order: list[str], values: dict[str, Column], max_run: int) -> DataFrame:
    lengths = segments.run_lengths(df, order, {f"_len_{c}": F.when(F.col(c).isNotNull(), v) for c, v in values.items()}, skip_nulls=True)
    return lengths.withColumns({c: F.when(F.col(f"_len_{c}") < max_run, F.col(c)) for c in values}).drop(*(f"_len_{c}" for c in values))


def _rolled(df: DataFrame, order: list[str], column: str, window: int, z_max: float, least: int, rows: int | None) -> DataFrame:
    c = F.col(column)
    found = lambda w: {"_n": F.count(c).over(w), "_med": F.percentile(c, F.lit(0.5)).over(w), "_sd": F.stddev_samp(c).over(w)}
    stats = segments.framed(df, order, window // 2, (window - 1) // 2, found, rows)
    off = (F.col("_n") >= least) & (F.try_divide(F.abs(c - F.col("_med")), F.col("_sd")) > z_max)
    return stats.where(c.isNotNull() & ~F.coalesce(off, F.lit(False))).drop("_n", "_med", "_sd")


def drop_flatlines(df: DataFrame, keys: list[str], order: list[str], column: str, max_run: int = 4, rounded: Column | None = None, rows: int | None = None) -> DataFrame:
    """Rows of runs of ``max_run`` or more equal values leave. Nulls stay and end a run. ``rows``: of a segment (see ``segments``)."""
    return segments.plain(_dropped(segments.segmented(df, keys, order, rows), order, column, max_run, rounded))


def null_flatlines(df: DataFrame, keys: list[str], order: list[str], column: str, max_run: int = 3, rounded: Column | None = None, rows: int | None = None) -> DataFrame:
    """Cells of runs of ``max_run`` or more equal values become null. Nulls are skipped: a run goes on across them."""
    value = round2(F.col(column)) if rounded is None else rounded
    return segments.plain(_nulled(segments.segmented(df, keys, order, rows), order, {column: value}, max_run))


def rolling_outliers(df: DataFrame, keys: list[str], order: list[str], column: str, window: int = 12, z_max: float = 3.0, least: int = 6, rows: int | None = None) -> DataFrame:
    """Rows whose value is null, or over ``z_max`` sample deviations off the centred rolling median, leave.

    An even window reaches one row further back than ahead. With fewer than ``least`` values, or no deviation, a row stays.
    """
    return segments.plain(_rolled(segments.segmented(df, keys, order, rows), order, column, window, z_max, least, rows))


def clean_ten_minute(df: DataFrame, keys: list[str], ts: str, limits: dict[str, tuple[float, float]], flat: list[str], rolled: list[str], rows: int | None = None) -> DataFrame:
    """Bounds, then flat lines column by column, then rolling outliers column by column, each on the rows that are left."""
    passes = [lambda d, c=c: _dropped(d, [ts], c, 4) for c in flat] + [lambda d, c=c: _rolled(d, [ts], c, 12, 3.0, 6, rows) for c in rolled]
    return _in_turn(bounded(df, limits, "drop"), keys, ts, passes, rows)


def clean_hourly(df: DataFrame, keys: list[str], ts: str, limits: dict[str, tuple[float, float]], flat: list[str], rows: int | None = None) -> DataFrame:
    """Bounds and flat lines of hourly data, rows dropped."""
    return _in_turn(bounded(df, limits, "drop"), keys, ts, [lambda d, c=c: _dropped(d, [ts], c, 3) for c in flat], rows)


def _in_turn(df: DataFrame, keys: list[str], ts: str, passes: list[Callable[[DataFrame], DataFrame]], rows: int | None) -> DataFrame:
    """Passes one after the other over one segmented table; what each leaves is written for the next."""
    if not passes:
        return df
    held = segments.segmented(df, keys, [ts], rows)
    for step in passes[:-1]:
        held = segments.settled(step(held), keys)
    return segments.plain(passes[-1](held))


def clean_stored(df: DataFrame, keys: list[str] = ["location_key"], ts: str = "timestamp_utc", limits: dict[str, tuple[float, float]] = BOUNDS, rows: int | None = None) -> DataFrame:  # noqa: B006
    """Bounds and flat lines of stored measurements, cells nulled; all columns in one pass, as nulling one doesn't move another's runs."""
    held = segments.segmented(bounded(df, limits), keys, [ts], rows)
    return segments.plain(_nulled(held, [ts], {c: round2(F.col(c)) for c in limits}, 3))


def nulled_cells(raw: DataFrame, clean: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """Per series and parameter, the cells that cleaning nulled; parameters without any are left out."""
    both = raw.alias("r").join(clean.alias("c"), [*keys, ts])
    counts = both.groupBy(*keys).agg(*(F.count_if(F.col(f"r.{c}").isNotNull() & F.col(f"c.{c}").isNull()).alias(c) for c in columns))
    return counts.unpivot(keys, columns, "parameter", "nulled").where("nulled > 0")


def nulled_totals(cells: DataFrame) -> DataFrame:
    """Totals per parameter, and over all of them (parameter null)."""
    return cells.rollup("parameter").agg(F.sum("nulled").alias("nulled"))


def report(cells: DataFrame, keys: list[str], most: int = 1000) -> str:
    """Text report of nulled cells per series and in total; series beyond ``most`` are counted in the totals only."""
    shown = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("parameter", "nulled"))).alias("p")).orderBy(*keys).limit(most).collect()
    lines = [f"{' '.join(str(r[k]) for k in keys)}: {', '.join(f'{x.parameter}={x.nulled}' for x in r.p)}" for r in shown]
    totals = {r.parameter: r.nulled for r in nulled_totals(cells).collect()}
    grand = totals.pop(None, 0) or 0
    return "\n".join([*lines, f"total: {grand} cells", *(f"  {p}: {n}" for p, n in sorted(totals.items()))])
