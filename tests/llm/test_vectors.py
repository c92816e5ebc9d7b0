import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from hazeworks.llm import queries, vectors


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    """The contract in plain whole numbers."""
    sound = [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sound.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(scale * x) for x in v] for _, v, _ in sound]
    if not ints:
        return []
    w = len(ints[0]) // parts
    cut = [[tuple(v[p * w : (p + 1) * w]) for p in range(parts)] for v in ints]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda x, book: min(range(len(book)), key=lambda j: (apart(x, book[j]), j))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for v in cut:
                groups[best(v[p], books[p])].append(v[p])
            books[p] = [tuple(sum(c) // len(c) for c in zip(*groups[j])) if j in groups else e for j, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    codes = [[best(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(apart(v[p], books[p][c[p]]) for p in range(parts)) for v, c in zip(cut, codes)]
    labels = defaultdict(int)
    for (_, _, l), e in zip(sound, errors):
        labels[l] += e
    return sorted(((i, "".join(f"{x:02x}" for x in c), e, labels[l], digest) for (i, _, l), c, e in zip(sound, codes, errors)), key=repr)


def check(spark, rows, path, schema="vec_id long, embedding array<float>, label int"):
    df = spark.createDataFrame(rows, schema).repartition(3)
    df.write.parquet(f"{path}/embeddings.parquet")
    got = sorted((tuple(r) for r in queries.op11_vectors(spark, str(path)).collect()), key=repr)
    assert got == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    return got


def test_contract(spark, tmp_path):
    rng = random.Random(1)
    vector = lambda spread: [rng.gauss(0, spread) for _ in range(32)]
    rows = [(i * 3 % 301, vector(rng.choice([0.01, 1, 500])), rng.choice([None, 1, 2])) for i in range(300)]
    rows += [(-1, None, 1), (-2, [0.5] * 31 + [None], 1), (-3, [0.5] * 31 + [float("nan")], 2), (-4, [float("-inf")] + [0.5] * 31, None), (None, vector(1), 2), (None, None, 2), (None, vector(1), 3)]
    rows += [(7000, rows[0][1], 9), (7001, rows[0][1], 9), (5, rows[1][1], 2), (5, vector(1), 2), (8000, [0.0] * 32, None)]
    check(spark, rows, tmp_path)


def test_few_and_none(spark, tmp_path):
    check(spark, [(2, [1.0, -1.0] * 8, None), (1, [0.3, 0.1] * 8, None), (3, [0.3, 0.1] * 8, 4)], tmp_path / "few")
    assert check(spark, [(2, None, 1)], tmp_path / "unsound") == []
    assert check(spark, [], tmp_path / "none") == []


def test_crowded(spark, tmp_path):
    """Few distinct values: most distances tie."""
    rng = random.Random(3)
    check(spark, [(i, [rng.choice([0.0, 0.004, -0.004]) for _ in range(16)], i % 2) for i in range(200)], tmp_path)


def test_refusals(spark):
    docs = lambda *rows: spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").selectExpr("*", "1 as label")
    with pytest.raises(ValueError, match="one length"):
        vectors.quantize(docs([0.0] * 16, [0.0] * 32))
    with pytest.raises(ValueError, match="one length"):
        vectors.quantize(docs([0.0] * 15))
    with pytest.raises(Exception, match="beyond"):
        vectors.quantize(docs([1e9] * 16))


@pytest.mark.parametrize("magnitude", [3, 200, 1 << 20, vectors.LARGEST])
def test_nearest_is_exact(magnitude):
    rng = np.random.default_rng(magnitude)
    for width in (1, 4, 16):
        entries = rng.integers(-magnitude, magnitude + 1, (64, width))
        entries[40:50] = entries[10:20]
        near = entries[rng.integers(0, 64, 500)] + rng.integers(-1, 2, (500, width))
        halfway = (entries[rng.integers(0, 64, 500)] + entries[rng.integers(0, 64, 500)]) // 2
        x = np.clip(np.concatenate([near, halfway, rng.integers(-magnitude, magnitude + 1, (500, width))]), -magnitude, magnitude)
        exact = ((x[:, None, :].astype(object) - entries[None]) ** 2).sum(axis=2)
        assert (vectors.nearest(x, entries) == [min(range(64), key=lambda j: (row[j], j)) for row in exact]).all()


def test_clashing_columns_and_driver_table(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    extra = table.selectExpr("*", "1 as v", "2 as code", "3 as of", "4 as `a b.c`")
    extra.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((tuple(r) for r in queries.op11_vectors(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute([(r.vec_id, r.embedding, r.label) for r in table.collect()])
