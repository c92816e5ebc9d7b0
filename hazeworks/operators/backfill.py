"""Back-fills: units of work (a location and a window of time), each loaded once, whatever fails on the way.

The ledger of loaded units is a side table of the table they are loaded into, and grows in the same commit as the rows: a run that is killed leaves both as they
were, and the next run does the units that the ledger lacks, no others. A unit that fails leaves no row and no entry; the rest of its run is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeworks.functions.scalar import month_windows
from hazeworks.shared import written
from hazeworks.sources.versioned import Versioned

LEDGER = "unit string, rows long, loaded_at timestamp"


def units(locations: DataFrame, key: str, first_month: Column, windows: int, months: int) -> DataFrame:
    """Locations with their ``windows`` windows of ``months`` months going back from ``first_month``: unit (its name), start, end and the location's columns."""
    each = locations.withColumn("_w", F.explode(month_windows(first_month, windows, months)))
    name = F.concat_ws(" ", F.col(key).cast("string"), F.date_format("_w.start", "yyyy-MM-dd"), F.date_format("_w.end", "yyyy-MM-dd"))
    return each.select(*locations.columns, name.alias("unit"), F.col("_w.start").alias("start"), F.col("_w.end").alias("end"))


def pending(table: Versioned, wanted: DataFrame) -> DataFrame:
    """Units that the ledger lacks."""
    return wanted.join(table.side("ledger", LEDGER).select("unit"), "unit", "left_anti")


def run(table: Versioned, wanted: DataFrame, load: Callable[[DataFrame], DataFrame], mode: str = "coalesce", newest: list[Column] | None = None) -> tuple[int, int]:
    """Load what is pending; (units done, units failed).

    ``load`` makes of units the table's rows, with ``unit`` and ``error``: a row with an error, in place of values, says that its unit has failed.
    A unit without any row has nothing to give and is done.
    """
    todo = written(pending(table, wanted), "units")
    if todo.isEmpty():
        return 0, 0
    loaded = written(load(todo), "loaded")
    failed = loaded.where("error is not null").select("unit").distinct()
    done = todo.select("unit").distinct().join(failed, "unit", "left_anti")
    counts = loaded.groupBy("unit").agg(F.count("*").alias("rows"))
    ledger = written(done.join(counts, "unit", "left").select("unit", F.coalesce("rows", F.lit(0)).alias("rows"), F.current_timestamp().alias("loaded_at")), "ledger")
    number = ledger.count()
    if number:
        rows = loaded.join(ledger.select("unit"), "unit", "left_semi").drop("unit", "error")
        table.merge(rows, mode, newest=newest, sides={"ledger": ledger})
    return number, failed.count()
