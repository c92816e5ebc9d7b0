import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeworks.llm import repeats
from hazeworks.llm.repeats import WINDOW


def brute(rows):
    """Per row (id, words, removed words, digest of the rest); rows of one id and one word sequence are one document."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    key = lambda i, w: (i is None, i or 0, hashlib.sha256(b" ".join(w)).hexdigest())
    first = {}
    for i, w in split:
        for p in range(len(w) - WINDOW + 1):
            x = tuple(w[p : p + WINDOW])
            here = (key(i, w), p)
            first[x] = min(first.get(x, here), here)
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - WINDOW + 1):
            if first[tuple(w[p : p + WINDOW])] < (key(i, w), p):
                gone.update(range(p, p + WINDOW))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def check(docs):
    got = repeats.remove_repeats(docs).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == brute([(r.doc_id, r.text) for r in docs.collect()])
    for r in got:
        assert r.kept is None or hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
        assert sum(s.end - s.begin for s in r.spans or []) == r.n_removed
    return got


def test_edges(spark, edge_docs):
    check(edge_docs)
    check(edge_docs.withColumns({"doc_id": F.when(F.col("doc_id") != 9, F.col("doc_id")), "a b.c": F.lit(1), "id": F.lit(2), "slice": F.lit(3)}))
    assert repeats.remove_repeats(edge_docs.limit(0)).count() == 0
    assert repeats.remove_repeats(edge_docs.where("doc_id < 3")).count() == 3


def planted(seed, words="abcdefgh"):
    rng = random.Random(seed)
    prose = lambda n: [rng.choice(words) + str(rng.randrange(3)) for _ in range(n)]
    passages = [prose(50), ["x"] * 45, ["y", "z"] * 30, prose(20), prose(19), prose(300)]
    texts = []
    for i in range(120):
        parts = prose(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += (p[a:] if rng.random() < 0.5 else p[: len(p) - a]) + prose(rng.randrange(15))
        texts.append(rng.choice([" ", "\n", " \t "]).join(parts))
    return texts + [texts[3], texts[3] + " !", " ".join(texts[4].split()[5:]), " ".join([texts[0]] * 3), "word " * 500]


def test_planted_passages(spark):
    for seed in (1, 2):
        rows = [(1000 - i if i % 2 else i, t) for i, t in enumerate(planted(seed))]
        got = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
        assert any(r.n_removed for r in got)


def test_small_slices_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STRETCH", 37)
    names = np.random.default_rng(1).integers(0, 6, 400).astype(np.uint64)
    counts = np.asarray([0, 150, 5, 120, 0, 125])
    whole = repeats.Windows(names, counts, 8, repeats.Powers(repeats._BASE))
    monkeypatch.setattr(repeats, "STRETCH", 1 << 18)
    one = repeats.Windows(names, counts, 8, repeats.Powers(repeats._BASE))
    assert (whole.at == one.at).all() and (whole.keys == one.keys).all() and (whole.key == one.key).all()


def test_null_and_repeated_ids(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(n))
    a, b, c, passage = prose(60), prose(60), prose(60), prose(30)
    rows = [(1, a), (None, a), (None, b), (None, passage + " " + c), (2, passage), (2, c), (3, b), (3, b), (3, "q " + b), (None, a), (7, prose(5))]
    rows += [(rng.choice([None, 5, i]), prose(rng.randrange(40)) + " " + rng.choice([a, passage, ""])) for i in range(40)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


@pytest.mark.parametrize("alphabet", [1, 2, 3, 30])
def test_equal_windows_have_equal_anchors(alphabet):
    """An anchor depends on its window alone, wherever that stands."""
    rng = np.random.default_rng(alphabet)
    symbols = repeats._mixed(np.arange(100, dtype=np.uint64))
    text = symbols[rng.integers(0, alphabet, 3000)]
    begin, end = repeats.anchors(text)
    assert (begin >= np.arange(len(begin))).all() and (end <= np.arange(len(begin)) + WINDOW).all() and (begin < end).all()
    for start in rng.integers(0, len(begin), 200):
        around = np.concatenate([symbols[rng.integers(0, alphabet, rng.integers(0, 30))], text[start : start + WINDOW], symbols[rng.integers(0, alphabet, rng.integers(0, 30))]])
        b, e = repeats.anchors(around)
        seen = {around[p : p + WINDOW].tobytes(): (b[p] - p, e[p] - p) for p in range(len(b))}
        assert seen[text[start : start + WINDOW].tobytes()] == (begin[start] - start, end[start] - start)


def test_rounds_give_equal_substrings_equal_symbols():
    rng = np.random.default_rng(5)
    core = repeats._mixed(rng.integers(0, 50, 400).astype(np.uint64))
    runs = []
    for seed in (1, 2):
        edge = np.random.default_rng(seed)
        names = np.concatenate([repeats._mixed(edge.integers(0, 50, 40 + seed).astype(np.uint64)), core, repeats._mixed(edge.integers(0, 50, 60).astype(np.uint64))])
        for level in range(12):
            names = repeats.compressed(names, level)[0]
        runs.append(set(names.tolist()))
    assert len(runs[0] & runs[1]) >= 5  # of some 20 symbols


def test_driver_documents(spark):
    rows = check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert any(r.n_removed for r in rows)
