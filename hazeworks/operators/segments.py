"""Long series in segments: what a window over a whole series would give, in as many tasks as the series has segments.

``segmented`` range-partitions rows by series and order and writes them down with the number of their partition, ``_seg``. All windows then
run within (series, segment). What crosses borders is stitched:

* Runs of equal values (``run_lengths``): each segment sends a row with the value and length of its first and its last run; over these
  rows, two a segment, runs are joined to islands, and the segments' first and last runs get the length of their island.
* Frames of so many rows before and behind (``framed``): counts per segment give rows their place in the series; blocks of places get, beside
  their own rows, copies of those that their frames reach into (the halo), and forget them afterwards.

Passes may follow each other: rows may leave, segments may become empty; the order of segments is that of rows. Null keys are a series. Rows of
equal order have no defined order, but stay in one segment.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeworks.shared import written

#: Rows of a block of frames unless given.
BLOCK = 1 << 18


def segmented(df: DataFrame, keys: list[str], order: list[str], rows: int | None = None) -> DataFrame:
    """``df`` with ``_series`` (its keys) and ``_seg``, about ``rows`` rows each; unless given, partitions are as large as the session's settings have them."""
    parts = () if rows is None else (max(1, -(-df.count() // rows)),)
    ranged = df.repartitionByRange(*parts, *keys, *order)
    held = written(ranged.withColumn("_seg", F.spark_partition_id()), "segments")
    return held.withColumn("_series", F.struct(*keys) if keys else F.struct(F.lit(0)))


def plain(df: DataFrame) -> DataFrame:
    """Without the segments' columns."""
    return df.drop("_series", "_seg")


def settled(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` written, before another pass reads it twice."""
    return written(df.drop("_series"), "pass").withColumn("_series", F.struct(*keys) if keys else F.struct(F.lit(0)))


def run_lengths(df: DataFrame, order: list[str], values: dict[str, Column], skip_nulls: bool) -> DataFrame:
    """Adds for each name the length of the row's run of equal values in its series.

    With ``skip_nulls`` runs go on across nulls, which have no length; else a null ends a run and is one of length 1. All values have one type.
    """
    w = Window.partitionBy("_series", "_seg").orderBy(*order)
    until = w.rowsBetween(Window.unboundedPreceding, 0)
    names = {n: f"_{i}" for i, n in enumerate(values)}
    rows = df.withColumns({f"_v{c}": values[n] for n, c in names.items()})
    before = lambda v: F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) if skip_nulls else F.lag(v).over(w)
    starts = lambda v: F.when(v == before(v), 0).when(v.isNull() & F.lit(skip_nulls), 0).otherwise(1)
    rows = rows.withColumns({f"_b{c}": starts(F.col(f"_v{c}")) for c in names.values()})
    rows = rows.withColumns({f"_r{c}": F.sum(f"_b{c}").over(until) for c in names.values()})
    counted = F.count if skip_nulls else lambda v: F.count(F.lit(1))
    rows = rows.withColumns({f"_n{c}": counted(F.col(f"_v{c}")).over(Window.partitionBy("_series", "_seg", f"_r{c}")) for c in names.values()})

    # One row a segment: the last run's number, and the first and last runs' values and lengths.
    real = lambda c: F.col(f"_v{c}").isNotNull() | F.lit(not skip_nulls)
    run = lambda c: F.struct(F.col(f"_v{c}").alias("v"), F.col(f"_n{c}").alias("n"))
    ends = []
    for c in names.values():
        number = F.when(real(c), F.col(f"_r{c}"))
        ends += [F.max(number).alias(f"_l{c}"), F.min_by(run(c), number).alias(f"_h{c}"), F.max_by(run(c), number).alias(f"_t{c}")]
    edges = rows.groupBy("_series", "_seg").agg(*ends)
    entry = lambda c, side, head, tail: F.struct(F.lit(c).alias("c"), F.lit(side).alias("side"), F.lit(head).alias("head"), F.lit(tail).alias("tail"), F.col(f"_{'h' if head else 't'}{c}").alias("run"))
    each = [F.when(F.col(f"_l{c}") == 1, F.array(entry(c, 0, True, True))).when(F.col(f"_l{c}") > 1, F.array(entry(c, 0, True, False), entry(c, 1, False, True))) for c in names.values()]
    listed = edges.select("_series", "_seg", F.explode(F.flatten(F.array_compact(F.array(*each)))).alias("e")).select("_series", "_seg", "e.*")
    along = Window.partitionBy("_series", "c").orderBy("_seg", "side")
    joined = F.col("head") & F.lag("tail").over(along) & (F.col("run.v") == F.lag("run.v").over(along))
    islands = listed.withColumn("_new", F.when(joined, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.withColumn("_whole", F.sum("run.n").over(Window.partitionBy("_series", "c", "_island")))
    of = lambda c, side: F.max(F.when((F.col("c") == c) & F.col(side), F.col("_whole")))
    last = lambda c: F.max(F.when((F.col("c") == c) & F.col("tail"), F.col("side"))) + 1
    stitched = whole.groupBy("_series", "_seg").agg(*(x for c in names.values() for x in (of(c, "head").alias(f"_h{c}"), of(c, "tail").alias(f"_t{c}"), last(c).alias(f"_several{c}"))))
    most = edges.select("_series", "_seg", *(f"_l{c}" for c in names.values()))
    known = rows.join(stitched.join(most, ["_series", "_seg"]), ["_series", "_seg"], "left")
    length = lambda c: F.when(F.col(f"_r{c}") == 1, F.col(f"_h{c}")).when(F.col(f"_r{c}") == F.col(f"_l{c}"), F.col(f"_t{c}")).otherwise(F.col(f"_n{c}"))
    out = known.withColumns({n: F.when(real(c), length(c)) for n, c in names.items()})
    return out.select(*df.columns, *values)


def framed(df: DataFrame, order: list[str], back: int, ahead: int, values: Callable[[object], dict[str, Column]], rows: int | None = None) -> DataFrame:
    """Adds ``values`` of a window of ``back`` rows before each row to ``ahead`` rows behind it in its series."""
    size = rows or BLOCK
    counts = df.groupBy("_series", "_seg").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_series").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_series", "_seg", before.alias("_before"))
    numbered = df.withColumn("_r", F.row_number().over(Window.partitionBy("_series", "_seg").orderBy(*order)))
    placed = numbered.join(starts, ["_series", "_seg"]).withColumn("_at", F.col("_before") + F.col("_r") - 1)
    blocks = F.sequence(F.greatest(F.lit(0), F.expr(f"(_at - {ahead}) div {size}")), F.expr(f"(_at + {back}) div {size}"))
    copied = placed.withColumn("_block", F.explode(blocks))
    w = Window.partitionBy("_series", "_block").orderBy("_at").rowsBetween(-back, ahead)
    found = values(w)
    return copied.withColumns(found).where(F.expr(f"_at div {size} = _block")).select(*df.columns, *found)
