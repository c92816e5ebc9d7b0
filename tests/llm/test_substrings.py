import numpy as np
import hashlib
import random

from pyspark.sql import functions as F

from hazeworks.llm import substrings
from hazeworks.llm.substrings import WINDOW


def brute(rows):
    """Rows in order of id; a window counts where an equal one starts strictly earlier in (id, position)."""
    first = {}
    raws = [(i if i is not None else substrings.NO_ID, (t or "").encode()) for i, t in rows]
    for i, raw in sorted(raws, key=lambda x: x[0]):
        for p in range(len(raw) - WINDOW + 1):
            w = raw[p : p + WINDOW]
            first[w] = min(first.get(w, (i, p)), (i, p))
    out = []
    for i, raw in raws:
        spans = substrings.merged_runs([(p, p + WINDOW) for p in range(len(raw) - WINDOW + 1) if first[raw[p : p + WINDOW]] < (i, p)], len(raw))
        kept = bytearray(raw)
        for b, e in reversed(spans):
            del kept[b:e]
        out.append((None if i == substrings.NO_ID else i, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def check(docs):
    got = substrings.remove_repeats(docs).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)
    return got


def test_edges(spark, edge_docs):
    check(edge_docs)
    check(edge_docs.withColumn("doc_id", F.when(F.col("doc_id") == 9, None).otherwise(F.col("doc_id"))))
    assert substrings.remove_repeats(edge_docs.limit(0)).count() == 0


def test_planted_passages(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(40), "x" * 150, "ab" * 120, prose(16), prose(200), "é" * 60]
    texts = []
    for i in range(150):
        parts = [prose(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += [p[a:] if rng.random() < 0.5 else p[: len(p) - a], prose(rng.randrange(0, 20))]
        texts.append(rng.choice(["", " "]).join(parts))
    texts += [texts[3], texts[3] + "!", texts[4][5:], texts[0] * 3]
    check(spark.createDataFrame([(1000 - i if i % 2 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5))


def test_heavy_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HEAVY_LEAST", 3)
    monkeypatch.setattr(substrings, "HEAVY_SHARE", 30)
    monkeypatch.setattr(substrings, "SHARE", 300)
    test_planted_passages(spark)


def test_shares():
    """Windows sorted in shares give the same runs as at once."""
    import numpy as np

    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 99, 130, np.uint8)) for _ in range(20)]
    picked = [texts[i] for i in rng.integers(0, 20, 60)]
    data, size = np.frombuffer(b"".join(picked), np.uint8), np.full(60, 130)
    runs = substrings._near_runs(data, np.arange(60), np.zeros(60, np.int64), size)
    seen = {}
    assert [tuple(r) for r in runs] == [(i, 0, 130) for i, t in enumerate(picked) if seen.setdefault(t, i) != i]


def test_pieces(monkeypatch):
    """Cutting a text into small pieces gives the same windows and anchors as the whole text."""
    rng = random.Random(2)
    raw = bytes(rng.choice(b"abc ") for _ in range(3000))
    prints = substrings.Fingerprints()
    whole = substrings.Slice([(1, 0, raw)])
    want = dict(zip(whole.starts(), whole.anchors(prints, prints.sums(whole.data))[1]))
    got = {}
    for offset in range(0, len(raw) - WINDOW + 1, 128):
        part = substrings.Slice([(1, offset, raw[offset : offset + 128 + WINDOW - 1])])
        got |= {s + offset: a + offset for s, a in zip(part.starts(), part.anchors(prints, prints.sums(part.data))[1])}
    assert got == want


def test_driver_documents(spark):
    rows = check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert any(r.n_removed for r in rows)


def ranked(rows):
    """``brute`` over rows numbered in order of id (nulls last) and digest; rows that repeat id and text share a number."""
    place = lambda i, t: (i is None, i or 0, hashlib.md5(t.encode()).hexdigest())
    places = sorted({place(*r) for r in rows})
    ids = {places.index(place(*r)): r[0] for r in rows}
    return sorted(((ids[n], *rest) for n, *rest in brute([(places.index(place(*r)), r[1]) for r in rows])), key=repr)


def test_null_and_repeated_ids(spark):
    """Texts without an id, or of one id, are apart: a copy among them takes nothing from the others."""
    rng = random.Random(4)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b, c, d, passage = prose(300), prose(300), prose(300), prose(300), prose(150)
    rows = [(1, a), (None, a), (None, b), (None, passage + c), (None, "short"), (None, passage[:99]), (2, passage), (2, d), (2, d + passage), (3, b), (3, b), (3, prose(200) + b[:120]), (-5, d[40:])]
    rows += [(rng.choice([None, None, 7, i]), prose(rng.randrange(150)) + rng.choice([a, passage, ""])) for i in range(60)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == ranked(rows)
    one = substrings.remove_repeats(spark.createDataFrame([(1, a), (None, a), (None, b)], "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in one if r.doc_id is None) == [0, 300]


def test_different_windows_of_one_fingerprint_are_told_apart(spark, monkeypatch):
    """With fingerprints of windows cut to three bits nearly all collide; the result is the same."""
    plain = substrings.Fingerprints.at
    monkeypatch.setattr(substrings.Fingerprints, "at", lambda self, sums, starts, length: plain(self, sums, starts, length) & np.uint64(7))
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcd "), 150)) for _ in range(6)]
    pieces = [(i, 0, (t + texts[i - 1][:120] + t[20:140]).encode()) for i, t in enumerate(texts)]
    part = substrings.Slice(pieces)
    start = part.starts()
    prints = substrings.Fingerprints()
    first = substrings._first(prints.at(prints.sums(part.data), start, substrings.WINDOW), part.data, start)
    seen = {}
    for w, s in enumerate(start):
        assert first[w] == seen.setdefault(part.data[s : s + substrings.WINDOW].tobytes(), w)
