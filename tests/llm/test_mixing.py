import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from hazeworks.llm import mixing


def uniform(*parts):
    return (int(hashlib.md5("|".join(parts).encode()).hexdigest()[:12], 16) + 0.5) / 2.0**48


def poisson(mean, u):
    """Smallest count whose Poisson CDF reaches u."""
    k, p = 0, math.exp(-mean)
    c = p
    while c < u:
        k += 1
        p *= mean / k
        c += p
    return k


def brute(rows, rate_of):
    out = Counter()
    for doc_id, source, text in rows:
        rate = rate_of(source)
        parts = max(1, math.ceil(rate / mixing.PART_RATE))
        name = str(doc_id) if doc_id is not None else "#" + hashlib.md5((text or "").encode()).hexdigest()
        n = poisson(rate / parts, uniform("17", name)) + sum(poisson(rate / parts, uniform("17", name, "part", str(j))) for j in range(2, parts + 1))
        if n:
            out[doc_id, source, text] += n
    return out


ROWS = [(i, f"s{i % 3}" if i % 7 else None, "x" * (i % 50) if i % 11 else None) for i in range(400)] + [(None, "s1", "a"), (None, "s1", "b"), (None, None, None), (5, "s2", "xxxxx"), (5, "s2", "xxxxx"), (800, "rare", "")]


def rate(source):
    size = Counter()
    for _, s, t in ROWS:
        size[s] += len(t or "") + 1
    shares = {s: n**0.7 for s, n in size.items()}
    return shares[source] / sum(shares.values()) * sum(size.values()) / size[source]


def test_counts_are_the_inverted_distribution(spark):
    """Null sources, ids and texts, repeated rows, and every salted or broadcast form of the join."""
    docs = spark.createDataFrame(ROWS, "doc_id long, source string, text string")
    for limit in (10_000, 1):
        mixing.BROADCAST_SOURCES, before = limit, mixing.BROADCAST_SOURCES
        rows = mixing.mix(docs).collect()
        mixing.BROADCAST_SOURCES = before
        assert Counter((r.doc_id, r.source, r.text) for r in rows) == brute(ROWS, rate)
        assert all(1 <= r.mix_copy <= r.mix_copies for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_weights_and_rates_beyond_one_part(spark):
    rows = [(i, "big" if i else "tiny", "x" * 999) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = mixing.mix(docs, {"tiny": 0.5, "big": 0.5, "absent": 1.0}).collect()
    assert Counter((r.doc_id, r.source, r.text) for r in found) == brute(rows, lambda s: 0.5 * 3000 / (1 if s == "tiny" else 2999))
    assert sum(r.source == "tiny" for r in found) > 1300


def test_columns_of_other_names_stay(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, source string, text string").withColumns({c: F.lit(c) for c in ("mix_source", "mix_cdf", "mix_parts", "size", "share", "mix_copy")})
    rows = mixing.mix(docs).collect()
    assert rows and all(r.mix_source == "mix_source" and r.mix_cdf == "mix_cdf" and r.mix_parts == "mix_parts" and r["size"] == "size" and r.mix_copy != "mix_copy" for r in rows)
