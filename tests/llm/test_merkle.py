import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hazeworks.llm import merkle, queries

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def proofs(nodes, fanout):
    """The last node of a list, and of each node the siblings level by level: (left, right)."""
    above, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        grown, merged = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            for j in range(len(run)):
                for i in owners[at + j]:
                    above[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            grown.append(sha(*run))
            merged.append([i for o in owners[at : at + fanout] for i in o])
        nodes, owners = grown, merged
    return nodes[0] if nodes else None, above


def brute(rows, fanout=16):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows with distinct ids in a source."""
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: proofs([leaf(r) for r in by[s]], fanout) for s in names}
    root, upper = proofs([trees[s][0] for s in names], fanout)
    out = []
    for n, s in enumerate(names):
        for r, own in zip(by[s], trees[s][1]):
            path, tampered = own + upper[n], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            text = r[4] if r[4] is None or not tampered else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            node = leaf([*r[:4], text])
            for left, right in path:
                node = sha(left, node, right)
            out.append((r[0], leaf(r), trees[s][0], root, sha(*(x for p in path for x in p)), node, node == root))
    return sorted(out, key=repr)


def result(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in queries.op12_merkle(spark, str(tmp_path)).collect()), key=repr)


def rows_of(docs):
    return [tuple(r[c] for c in COLUMNS) for r in docs.collect()]


def test_edges(spark, edge_docs, tmp_path):
    extra = edge_docs.withColumns({"g": F.lit(1), "h": F.lit("x"), "a b.c": F.lit(2), "part": F.lit(0)})
    for name, docs in (("one", extra), ("none", extra.limit(0)), ("lone", extra.where("doc_id = 5")), ("null", extra.withColumn("doc_id", F.when(F.col("doc_id") != 7, F.col("doc_id"))))):
        assert result(spark, docs, tmp_path / name) == brute(rows_of(docs))


def test_levels(spark, tmp_path):
    """A hot source of three levels, sources of 1, 16, 17 and 256 rows, many lone ones, in shuffled order."""
    rng = random.Random(2)
    sizes = {"hot": 700, "one": 1, "é": 16, "Z": 17, None: 257, "z": 256} | {f"s{i}": 1 for i in range(30)}
    rows = [(s, c) for s, n in sizes.items() for c in range(n)]
    rng.shuffle(rows)
    rows = [(i * 7 - 300, s, rng.choice(["en", None]), rng.randrange(99), rng.choice([None, "", f"Text {i} AÉ", "same"])) for i, (s, _) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    got = result(spark, docs, tmp_path)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


def test_repeated_rows_have_places_of_their_own(spark):
    rows = [(1, "a", "x")] * 40 + [(1, "a", "y"), (None, "a", "x")]
    docs = spark.createDataFrame(rows, "`k.1` long, s string, t string")
    got = merkle.verified(merkle.manifest(docs, ["k.1", "t"], "s", "k.1", fanout=3)).collect()
    assert sorted(r.place for r in got) == list(range(42)) and all(r.verified for r in got)
    assert len({str(r.proof) for r in got}) == 42
    assert len({r.root for r in got}) == 1


@pytest.mark.parametrize("fanout", [2, 5])
def test_any_other_leaf_fails(spark, fanout):
    docs = spark.range(100).selectExpr("id", "'g' || id % 3 as s", "'text ' || id as t")
    rows = merkle.manifest(docs, ["id", "t"], "s", "id", fanout, carried={"id.text": F.col("t")})
    assert all(r.verified for r in merkle.verified(rows).collect())
    other = merkle.verified(rows.withColumn("leaf", merkle.leaf(F.col("key"), F.concat("`id.text`", F.lit("!")))))
    assert not any(r.verified for r in other.collect())


def test_driver_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(spark, docs, tmp_path) == brute(rows_of(docs))
