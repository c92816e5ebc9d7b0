"""MinHash near-duplicates with odd sketches.

1. ``profile``: one pass over the texts gives each document's number of word shingles, a digest of its word sequence, ``bands``
   of MinHash values and an odd sketch (all MinHash samples folded into a parity bitmap). Documents of equal digest have equal
   sets; only the one of smallest id goes on.
2. Documents that share a band are candidates. Within a bucket every member is compared with the bucket's leader only, the
   member that shares most buckets; the bitmaps' XOR population count estimates the similarity, and pairs far below the threshold go no further.
3. The others are confirmed on their full shingle sets, which are made for documents in shared buckets alone.
4. Components of these links leave outsiders: members of a bucket outside its leader's component. They choose a leader among
   themselves and are compared with it, up to ``elections`` times and while that finds links.
5. Outsiders that are left are searched exactly, by how they differ from their leader L. With D(x) the shingles that only one of
   x and L has, two sets differ in ``|D(x)| + |D(y)| - 2 |D(x) & D(y)|`` shingles, and the threshold allows a fixed share of
   their sizes. As an outsider differs from L by more than that, it is linked only with texts that share a good part of its
   differences: with the shingles of D ordered from the rarest on, both must have one of them within a prefix whose length follows
   from sizes (prefix and position filter). Edits that are a copy's own are never shared, so of a group of n copies around one text
   few pairs are left to confirm, though all of them lie close to the threshold.

Step 5 needs ``|D(x)|`` beyond the allowed share for outsiders. An outsider that the sketches of step 2 missed may be nearer; it is
linked to its leader there and then.

With 40 bands of 5, a pair of similarity 0.8 shares no band with probability (1 - 0.8^5)^40 < 2e-7; the estimate of steps 2 and 4
drops such a pair with about the same probability (its limit lies five deviations or more below 0.8). Links are confirmed exactly, up to 64-bit hash collisions of shingles.

Nulls: null, empty and blank texts have an empty set and are linked with nothing; each is its own component. A null id takes
part in no link. Rows of equal id count as one document: what links one links all. Very long texts are hashed in chunks.
An empty table gives an empty result. Only key and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeworks.llm.common import SPACE_RUN, materialize, slices
from hazeworks.llm.components import components


@dataclass(frozen=True)
class Settings:
    """``threshold`` in percent; pairs whose estimated similarity is below ``floor`` are not confirmed; ``elections`` bounds step 4."""

    width: int = 5
    threshold: int = 80
    bands: int = 40
    rows: int = 5
    sketch_bits: int = 512
    floor: float = 0.6
    seed: int = 7
    elections: int = 4


def most_flipped(samples: int, bits: int, floor: float) -> int:
    """Population count of the XOR of two sketches whose estimated similarity is ``floor``."""
    return math.ceil(bits / 2 * (1 - math.exp(-4 * samples * (1 - floor) / bits)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of all texts and the offsets of each text's words."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), SPACE_RUN)
    words, offsets = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
    coded = words.dictionary_encode()
    unique = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    real = np.asarray(pc.binary_length(words)) > 0
    kept = np.concatenate([[0], np.cumsum(real)])
    return (unique[np.asarray(coded.indices)] if len(unique) else np.zeros(0, np.uint64))[real], kept[offsets]


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text: its words' hashes and the sorted distinct hashes of its shingles."""
    hashes, offsets = word_hashes(texts)
    for begin, end in zip(offsets[:-1], offsets[1:]):
        w = hashes[begin:end]
        n = min(width, len(w))
        rolled = np.full(len(w) - n + 1 if n else 0, n, np.uint64)
        for i in range(n):
            rolled = _mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i])
        yield w, np.unique(rolled)


def signature(shingles: np.ndarray, multipliers: np.ndarray, addends: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set, in chunks of bounded memory."""
    low = (shingles >> np.uint64(16)).astype(np.uint32)
    least = np.full(len(multipliers), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(least, (low[at : at + 1024, None] * multipliers + addends).min(axis=0), out=least)
    return least


def hash_family(samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of ``samples`` hash functions."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, samples, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, samples, np.uint32)


def odd_sketches(signatures: np.ndarray, bits: int) -> np.ndarray:
    """Per signature (row) the parity bitmap of its samples, as longs."""
    places = _mixed(np.arange(1, signatures.shape[1] + 1, dtype=np.uint64))
    at = (_mixed(signatures + places) % np.uint64(bits)).astype(np.int64) + np.arange(len(signatures))[:, None] * bits
    odd = (np.bincount(at.ravel(), minlength=len(signatures) * bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


PROFILE = "doc_id long, digest binary, n_shingles long, bands array<long>, sketch array<long>"
_PROFILE = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])


def _profile_task(s: Settings) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = s.bands * s.rows
        multipliers, addends = hash_family(samples, s.seed)
        for part in slices(batches, "text", 2 << 20):
            digests, counts, signatures = [], [], []
            for w, shingles in shingle_sets(part.column(1), s.width):
                digests.append(xxhash.xxh3_128_digest(w.tobytes()))
                counts.append(len(shingles))
                if len(shingles):
                    signatures.append(signature(shingles, multipliers, addends))
            full = np.asarray(counts, np.int64) > 0
            sig = np.asarray(signatures, np.uint64).reshape(-1, samples)
            bands = np.broadcast_to(np.arange(s.bands, dtype=np.uint64), (len(sig), s.bands)).copy()
            for r in range(s.rows):
                bands = _mixed(bands * np.uint64(0x9E3779B97F4A7C15) + sig[:, r :: s.rows])
            sketch = odd_sketches(sig, s.sketch_bits)
            ends = np.concatenate([[0], np.cumsum(full)])
            lists = lambda values, each: pa.ListArray.from_arrays(pa.array(ends * each, pa.int32()), pa.array(values.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), lists(bands, s.bands), lists(sketch, s.sketch_bits // 64)], schema=_PROFILE)

    return run


def _sets_task(width: int) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            sets = [x.view(np.int64) for _, x in shingle_sets(part.column(1), width)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    return run


def flipped(a: Column, b: Column, bits: int) -> Column:
    """Population count of the XOR of two sketches."""
    words = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(bits // 64)]
    return sum(words[1:], words[0])


def _confirm(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) of similarity ``threshold`` or more, on full sets."""
    with_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= s.threshold * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _near(a: str, b: str, s: Settings) -> Column:
    """Whether two sketches don't rule out the threshold."""
    return flipped(F.col(a), F.col(b), s.sketch_bits) <= most_flipped(s.bands * s.rows, s.sketch_bits, s.floor)


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _first(*columns: str) -> Column:
    """These columns of the row of greatest weight, of such the one of smallest rep."""
    return F.max_by(F.struct(*columns), F.struct("weight", -F.col("rep")))


def _owners(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets of three or more with their own component and that of the bucket's leader."""
    return (
        buckets.where("members > 2")
        .join(found.select(F.col("node").alias("rep"), F.col("component").alias("own")), "rep", "left")
        .join(found.select(F.col("node").alias("leader"), F.col("component").alias("led")), "leader", "left")
        .select("band", "rep", "weight", "sketch", "leader", F.coalesce("own", "rep").alias("own"), F.coalesce("led", "leader").alias("led"))
    )


def _elected(owners: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) of members outside their leader's component: each bucket's choose a leader among themselves."""
    outside = owners.where("own != led").select("band", "rep", "weight", "sketch", "own")
    ahead = outside.groupBy("band").agg(_first("rep", "own", "sketch").alias("next"), F.min("own").alias("o1"), F.max("own").alias("o2")).where("o1 < o2").select("band", "next")
    return outside.join(ahead, "band").where((F.col("own") != F.col("next.own")) & _near("next.sketch", "sketch", s)).select(*_ordered("next.rep", "rep")).distinct()


def _joined(found: DataFrame, more: DataFrame) -> DataFrame:
    """Components ``found``, joined by further links."""
    return components(found.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more))


def _differences(owners: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Members of clusters (all buckets of one leader) that have an outsider, with the shingles ``d`` that they or their leader have alone.

    ``w`` stands for how far rep is from the leader; where ``beyond`` isn't positive, the two are linked.
    """
    clusters = owners.groupBy("leader", "rep").agg(F.first("own").alias("own"), F.first("led").alias("led")).where("rep != leader")
    mixed = clusters.join(clusters.where("own != led").select("leader").distinct(), "leader", "left_semi")
    own_set = sets.select(F.col("doc_id").alias("rep"), F.col("shingles").alias("sr"))
    led_set = sets.select(F.col("doc_id").alias("leader"), F.col("shingles").alias("sl"))
    apart = F.concat(F.array_except("sr", "sl"), F.array_except("sl", "sr"))
    rows = mixed.join(own_set, "rep").join(led_set, "leader").withColumn("d", apart)
    # Two sets of n and m shingles reach the threshold t if they differ in (n + m) * (1 - t) / (1 + t) of them at most.
    size = lambda c: F.size(c).cast("long")
    reach, part = 100 + s.threshold, 100 - s.threshold
    w = reach * size("d") - part * size("sr")
    return rows.select("leader", "rep", "own", (F.col("own") != F.col("led")).alias("outside"), w.alias("w"), (w - part * size("sl")).alias("beyond"), "d")


def _rarest_first(differences: DataFrame) -> DataFrame:
    """Rows (leader, e, rep, own, outside, w, c, i, low_all, low_out): e is the i-th, from the rarest on, of the c differences of rep
    that can be in a wanted pair's common part; low_all and low_out are the least w of all members and of the outsiders."""
    each = differences.select("leader", "rep", "own", "outside", "w", F.explode("d").alias("e"))
    # A difference that one component has alone, or no outsider, is in no wanted pair's common part.
    counted = each.groupBy("leader", "e").agg(F.count("*").alias("f"), F.min("own").alias("o1"), F.max("own").alias("o2"), F.max("outside").alias("met"))
    useful = counted.where("met and o1 < o2").select("leader", "e", "f")
    least = differences.groupBy("leader").agg(F.min("w").alias("low_all"), F.min(F.when(F.col("outside"), F.col("w"))).alias("low_out"))
    listed = each.join(useful, ["leader", "e"]).groupBy("leader", "rep", "own", "outside", "w").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("es"))
    ranked = listed.join(least, "leader").select("leader", "rep", "own", "outside", "w", "low_all", "low_out", F.size("es").alias("c"), F.posexplode("es").alias("i", "x"))
    return ranked.select("leader", F.col("x.e").alias("e"), "rep", "own", "outside", "w", "c", (F.col("i") + 1).alias("i"), "low_all", "low_out")


def _outsiders(owners: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) to confirm: members outside their leader's component, each with members of other components."""
    differences = materialize(_differences(owners, sets, s), "differences")
    need = lambda w: F.greatest(F.lit(1), F.ceil(w / (2 * (100 + s.threshold))))
    prefix = lambda low: F.col("i") <= F.col("c") - need(F.col("w") + F.col(low)) + 1
    entries = materialize(_rarest_first(differences).where(prefix("low_all") | prefix("low_out")), "entries")
    u, v = entries.where(F.col("outside") & prefix("low_all")).alias("u"), entries.where(prefix("low_out")).alias("v")
    most = F.least(F.col("u.c") - F.col("u.i"), F.col("v.c") - F.col("v.i")) + 1
    once = ~F.col("v.outside") | (F.col("u.rep") < F.col("v.rep"))
    wanted = (F.col("u.own") != F.col("v.own")) & once & (need(F.col("u.w") + F.col("v.w")) <= most)
    pairs = u.join(v, (F.col("u.leader") == F.col("v.leader")) & (F.col("u.e") == F.col("v.e")) & wanted).select(*_ordered("u.rep", "v.rep"))
    return pairs.union(differences.where("outside and beyond <= 0").select(*_ordered("leader", "rep"))).distinct()


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept (doc_id = component_id) of every row."""
    s = settings
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    profiles = materialize(narrow.mapInArrow(_profile_task(s), PROFILE), "profiles")
    texts = profiles.where("n_shingles > 0 and doc_id is not null")
    firsts = texts.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    ahead = F.col("doc_id") == F.col("rep")
    placed = materialize(texts.join(firsts, "digest").select("doc_id", "n_shingles", "rep", *(F.when(ahead, F.col(c)).alias(c) for c in ("bands", "sketch"))), "placed")
    reps = placed.where(ahead)

    banded = reps.select("rep", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    # A text from which a group was copied shares more buckets than its copies, which differ twice as much among themselves.
    weights = banded.join(sizes, "band").groupBy("rep").agg(F.sum("members").alias("weight"), F.collect_set(F.struct("band", "members")).alias("shared"))
    weighed = materialize(weights.join(reps.select("rep", "sketch"), "rep"), "shared-bands")
    entries = weighed.select("rep", "weight", "sketch", F.inline("shared"))
    leaders = entries.groupBy("band").agg(_first("rep", "sketch").alias("lead"))
    buckets = materialize(entries.join(leaders, "band").select("band", "rep", "members", "weight", "sketch", F.col("lead.rep").alias("leader"), _near("lead.sketch", "sketch", s).alias("near")), "buckets")
    wanted = weighed.select(F.col("rep").alias("doc_id"))
    sets = materialize(narrow.join(wanted, "doc_id", "left_semi").mapInArrow(_sets_task(s.width), "doc_id long, shingles array<long>"), "shingles")

    stars = buckets.where("near and rep != leader").select(*_ordered("leader", "rep")).distinct()
    # Texts of one id, which is linked with the first of each.
    several = placed.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z"), F.collect_set("rep").alias("all")).where("a < z").select("a", F.explode("all").alias("b"))
    found = components(_confirm(stars, sets, s).union(several))
    # Members outside their leader's component choose a leader among themselves, while that finds links.
    for left in reversed(range(s.elections + 1)):
        owners = materialize(_owners(buckets, found), "owners")
        more = materialize(_confirm(_elected(owners, s), sets, s), "links") if left else None
        if more is None or more.isEmpty():
            break
        found = _joined(found, more)
    if not owners.where("own != led").isEmpty():
        more = materialize(_confirm(_outsiders(owners, sets, s), sets, s), "links")
        if not more.isEmpty():
            found = _joined(found, more)

    out = ["doc_id", "n_shingles", "component_id"]
    owned = placed.select("doc_id", "n_shingles", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    alone = profiles.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    both = owned.withColumn("component_id", F.coalesce("component", "rep")).select(out).union(alone)
    return both.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
