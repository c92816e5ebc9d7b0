"""Mixing sources to target weights by Poisson replication.

A source with target share ``w`` and ``size`` bytes of a corpus of ``total`` bytes has the mean repetition rate
``w * total / size``. A document's count inverts the Poisson distribution of that mean at a uniform number hashed from seed and
document id; the document is exploded into that many copies, and all copies are dealt out by a hash of (seed, id, copy) and
sorted by it within partitions: a global shuffle that a lost executor reproduces exactly.

Without ``weights`` the shares follow ``size ** temperature``. Sources absent from ``weights`` have weight 0 and leave.
Nulls: a null source is a source of its own; a null or empty text weighs one byte, like every text's terminator; a row without an
id is hashed by its text. Repeated rows get the same count. An empty table gives an empty result. All input columns are kept in
``mix``; the four added ones replace input columns of their names, other names don't matter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeworks.llm.common import materialize, quoted

#: Up to this many sources, the table of rates (some 100 bytes a row plus its CDF) is broadcast; beyond it, joined with salt.
BROADCAST_SOURCES = 10_000
SALTS = 32
#: Columns that ``mix`` adds.
ADDED = ["mix_rate", "mix_copies", "mix_copy", "mix_order"]
#: A larger mean is drawn as the sum of several Poisson numbers of at most this mean.
PART_RATE = 200.0


def _uniform(*parts: Column) -> Column:
    """In (0, 1), from the first 12 hex digits of an md5: the same number in any SQL engine."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(2.0**48)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, source: str = "source", text: str = "text") -> DataFrame:
    """One row per source: mix_source, mix_rate, mix_parts and mix_cdf: the Poisson CDF of mean mix_rate / mix_parts at 0, 1, 2, ..."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1
    per_source = docs.groupBy(F.col(source).alias("mix_source")).agg(F.sum(size).cast("double").alias("size"))
    if weights is None:
        share = F.pow("size", F.lit(temperature))
    else:
        share = F.coalesce(*(F.when(F.col("mix_source") == F.lit(s), F.lit(float(w))) for s, w in weights.items()), F.lit(0.0))
    per_source = materialize(per_source.withColumn("share", share), "mix-sources")
    total = per_source.agg(F.sum("size").alias("size"), F.sum("share").alias("share")).first()
    rate = F.try_divide(F.col("share") * F.lit(total["size"]), F.col("size") * F.lit(total["share"]))
    out = per_source.select("mix_source", F.coalesce(rate, F.lit(0.0)).alias("mix_rate"))
    out = out.withColumn("mix_parts", F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / PART_RATE)).cast("int"))
    r = F.col("mix_rate") / F.col("mix_parts")
    top = F.ceil(r + 12 * F.sqrt(r) + 24).cast("int")
    first = F.array(F.struct(F.exp(-r).alias("p"), F.exp(-r).alias("c")))

    def step(done: Column, k: Column) -> Column:
        last = F.element_at(done, -1)
        p = last["p"] * r / k
        return F.concat(done, F.array(F.struct(p.alias("p"), (last["c"] + p).alias("c"))))

    cdf = F.aggregate(F.sequence(F.lit(1), top), first, step)
    return out.withColumn("mix_cdf", F.transform(cdf, lambda x: x["c"]))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, seed: int = 17, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed corpus: the input's columns plus mix_rate, mix_copies, mix_copy and mix_order, globally shuffled."""
    kept = [quoted(c) for c in docs.columns if c not in ADDED]
    own = lambda name: f"_{name}_{uuid.uuid4().hex}"
    table = rates(docs, weights, temperature, source, text)
    names = {c: own(c) for c in table.columns}
    table = table.withColumnsRenamed(names)
    of, rate, parts, cdf = (F.col(names[c]) for c in ("mix_source", "mix_rate", "mix_parts", "mix_cdf"))
    rows = docs.select(*kept)
    if len(table.head(BROADCAST_SOURCES + 1)) <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(table), F.col(source).eqNullSafe(of))
    else:
        salted, salt = own("salted"), own("salt")
        spread = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        number = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(SALTS)).cast("int")
        joined = rows.withColumn(salted, number).join(spread, F.col(source).eqNullSafe(of) & (F.col(salted) == F.col(salt)))
    # A row without an id goes by its text.
    id_text = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("#"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    below = lambda u: F.size(F.filter(cdf, lambda c: c < u))
    more = F.aggregate(F.sequence(F.lit(2), F.greatest(parts, F.lit(2))), F.lit(0), lambda a, j: a + below(_uniform(F.lit(str(seed)), id_text, F.lit("part"), j.cast("string"))))
    count = below(_uniform(F.lit(str(seed)), id_text)) + F.when(parts > 1, more).otherwise(0)
    counted = joined.select(*kept, rate.alias("mix_rate"), count.alias("mix_copies")).where("mix_copies > 0")
    copies = counted.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), id_text, F.col("mix_copy").cast("string")).cast("binary"))
    return copies.withColumn("mix_order", order).repartition("mix_order").sortWithinPartitions("mix_order")
