import math
import struct
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from hazeworks.llm import sharding


def draw(key, nodes):
    """Number of the winning child of (name, weight) nodes, as the engine's hash of key and seed chooses it."""
    best = None
    for i, (name, weight) in enumerate(nodes):
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<q", zlib.crc32(name.encode())), h)
        score = -math.log(((h >> 11) + 0.5) * 2.0**-53) / weight
        best = min(best or (score, i), (score, i))
    return best[1]


def place(key, tree):
    regions = list(tree)
    r = regions[draw(key, [(r, sum(w for k in tree[r].values() for w in k.values())) for r in regions])]
    racks = list(tree[r])
    k = racks[draw(key, [(f"{r}/{k}", sum(tree[r][k].values())) for k in racks])]
    shards = list(tree[r][k])
    return shards[draw(key, [(f"{r}/{k}/{s}", tree[r][k][s]) for s in shards])]


def test_placement_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard_documents(docs).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    now, grown = sharding.planned_tree(24, 24), sharding.planned_tree(25, 24)
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id]
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (place(r.doc_id, now), place(r.doc_id, grown))
        assert r.grown_shard in (r.shard, 24)
    for shard, n in Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    assert sum(r.grown_shard == 24 for r in rows) > 10


def test_weights_confine_movement(spark):
    """Raising a shard's weight moves rows only into its region, from other regions, or into it, inside its region's rack."""
    tree = sharding.planned_tree(24, 24)
    more = sharding.planned_tree(24, 24)
    more["region1"]["rack2"][9] = 3.0
    rows = spark.range(30_000).select(sharding.shard_of([F.col("id")], tree).alias("a"), sharding.shard_of([F.col("id")], more).alias("b")).collect()
    counts = Counter(r.a for r in rows)
    assert max(counts.values()) < 1.15 * 30_000 / 24 and min(counts.values()) > 0.85 * 30_000 / 24
    moved = [r for r in rows if r.a != r.b]
    assert moved and all(8 <= r.b < 16 for r in moved)
    assert 2.4 < sum(r.b == 9 for r in rows) / counts[9] < 3.6
    assert sharding.shard_of([F.lit(1)], {"r": {"k": {0: 1.0, 1: 0.0}}, "z": {"k": {2: 0.0}}}) is not None


def test_edges(spark, edge_docs):
    twice = edge_docs.unionByName(edge_docs).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id"))).withColumn("shard", F.lit("clash"))
    rows = sharding.shard_documents(twice, shards=3).collect()
    assert len(rows) == twice.count() and sharding.shard_documents(edge_docs.limit(0)).count() == 0
    for shard, n in Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
