"""Sharding by a hierarchical weighted hash tree.

Every key descends from the root through regions and racks to a shard. On each level the children of the chosen node draw
``-ln(u) / weight`` from a hash of key and child name; the smallest draw wins, so a child is chosen in proportion to its
weight and a change of one weight moves keys only into or out of the subtree that carries it.

Growth keeps that confinement exact: a shard added to a tree becomes a region of its own (one rack, one shard). No inner
weight of the old regions changes, hence rows move only into the new shard.

Nulls: a null key is hashed like any value and has a fixed shard; a null text has 0 bytes and crc32 0. Repeated rows share a
shard and take different slots. An empty table gives an empty result. Only named input columns are read, so extra columns
cannot clash.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: region -> rack -> shard number -> weight
Tree = dict[str, dict[str, dict[int, float]]]


def planned_tree(shards: int, planned: int, racks: int = 2, per_rack: int = 4) -> Tree:
    """Shards below ``planned`` fill regions of ``racks`` racks; each later one opens a region of its own."""
    tree: Tree = {}
    for shard in range(shards):
        if shard < planned:
            region, rack = f"region{shard // (racks * per_rack)}", f"rack{shard // per_rack}"
        else:
            region, rack = f"added{shard}", f"rack-added{shard}"
        tree.setdefault(region, {}).setdefault(rack, {})[shard] = 1.0
    return tree


def _nodes(names: list[tuple[str, float]]) -> Column:
    """Children as a literal array of (index, seed, weight); the seed depends on the name alone."""
    return F.array(*(F.struct(F.lit(i).alias("i"), F.lit(zlib.crc32(n.encode())).alias("seed"), F.lit(float(w)).alias("w")) for i, (n, w) in enumerate(names)))


def _draw(key: list[Column], children: Column) -> Column:
    def score(c: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(*key, c["seed"]), 11) + F.lit(0.5)) * F.lit(2.0**-53)
        return F.struct((-F.log(u) / c["w"]).alias("score"), c["i"].alias("i"))

    return F.array_min(F.transform(children, score))["i"]


def shard_of(key: list[Column], tree: Tree) -> Column:
    """Shard number of a key; children of weight 0 or less never win and are left out."""
    regions = [(r, {k: {s: w for s, w in ss.items() if w > 0} for k, ss in racks.items()}) for r, racks in tree.items()]
    regions = [(r, {k: ss for k, ss in racks.items() if ss}) for r, racks in regions]
    regions = [(r, racks) for r, racks in regions if racks]
    if not regions:
        raise ValueError("a shard tree needs a shard of positive weight")
    weight = lambda racks: sum(sum(ss.values()) for ss in racks.values())
    region = _draw(key, _nodes([(r, weight(racks)) for r, racks in regions]))
    rack_nodes = F.array(*(_nodes([(f"{r}/{k}", sum(ss.values())) for k, ss in racks.items()]) for r, racks in regions))
    shard_nodes = F.array(*(F.array(*(_nodes([(f"{r}/{k}/{s}", w) for s, w in ss.items()]) for k, ss in racks.items())) for r, racks in regions))
    numbers = F.array(*(F.array(*(F.array(*(F.lit(s) for s in ss)) for ss in racks.values())) for _, racks in regions))
    at = F.struct(region.alias("r"))
    at = F.transform(F.array(at), lambda x: F.struct(x["r"].alias("r"), _draw(key, F.get(rack_nodes, x["r"])).alias("k")))
    at = F.transform(at, lambda x: F.struct(x["r"].alias("r"), x["k"].alias("k"), _draw(key, F.get(F.get(shard_nodes, x["r"]), x["k"])).alias("s")))
    return F.element_at(F.transform(at, lambda x: F.get(F.get(F.get(numbers, x["r"]), x["k"]), x["s"])), 1)


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", rows_per_bucket: int = 50_000, most_buckets: int = 4096) -> DataFrame:
    """Place rows into shards with gapless slots.

    Slots need no global sort and no task per shard: rows of a shard are dealt into hash buckets, a small table of bucket
    counts (at most ``shards * most_buckets`` rows, hence broadcast) gives each bucket its offset, and rows are numbered
    within their bucket.
    """
    tree, grown = planned_tree(shards, shards), planned_tree(shards + 1, shards)
    k = F.col(key)
    buckets = min(most_buckets, max(8, math.ceil(docs.count() / (shards * rows_per_bucket))))
    # Rows without a key share a shard; their texts deal them out over its buckets.
    apart = F.when(k.isNull(), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    placed = [k.alias("doc_id"), shard_of([k], tree).alias("shard"), F.pmod(F.xxhash64(k, apart, F.lit("slot")), F.lit(buckets)).alias("bucket")]
    counts = docs.select(*placed).groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    t = F.col(text)
    rows = docs.select(
        *placed,
        (F.coalesce(F.octet_length(t), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
        shard_of([k], grown).alias("grown_shard"),
    )
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")))
    return numbered.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("n") - 1).cast("long").alias("slot"), "grown_shard"
    )
