import random
import re

import pytest
from pyspark.sql import functions as F

from hazeworks.llm import neardup
from hazeworks.llm.components import components
from hazeworks.llm.neardup import Settings


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(texts, width, threshold=80):
    """doc_id -> (set size, smallest reachable id), by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= threshold * large and root(a) != root(b):
                both = len(sets[a] & sets[b])
                if 100 * both >= threshold * (small + large - both):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def check(docs, width=2):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = neardup.near_duplicates(docs, Settings(width=width)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and len(rows) == len(texts)
    return rows


def test_edges(spark, edge_docs):
    check(edge_docs)
    check(edge_docs, 5)
    assert neardup.near_duplicates(edge_docs.limit(0)).count() == 0
    twice = edge_docs.unionByName(edge_docs).withColumn("doc_id", F.when(F.col("doc_id") == 3, None).otherwise(F.col("doc_id")))
    assert neardup.near_duplicates(twice).count() == twice.count()


@pytest.mark.parametrize("width", [2, 5])
def test_chains_and_borderline_groups(spark, width):
    """Copies of copies: neighbours are close, ends are not; groups whose smallest member is the outlier."""
    rng = random.Random(width)
    texts = []
    for _ in range(12):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([12, 60, 300]))]
        for _ in range(25):
            texts.append(" ".join(w))
            w = list(w) if rng.random() < 0.5 else list(texts[-1].split())
            for _ in range(rng.randrange(1, max(2, len(w) // 12))):
                w[rng.randrange(len(w))] = f"w{rng.randrange(5000)}"
    rng.shuffle(texts)
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width)


def test_driver_documents(spark):
    rows = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert sum(not r.kept for r in rows) > 50


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(2, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(7, 7), (None, 3)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == {i: root(i) for i in list(parent)}
    assert components(df.limit(0)).count() == 0


def test_components_with_two_hubs_that_share_a_member(spark):
    """After the first round nobody is both child and parent, but node 3 still has two parents."""
    df = spark.createDataFrame([(4, 3), (4, 1), (5, 3), (5, 2)], "a long, b long")
    rows = components(df).collect()
    assert len(rows) == 5
    assert {r.node: r.component for r in rows} == dict.fromkeys(range(1, 6), 1)


def test_large_group_of_near_copies_close_to_the_threshold(spark):
    """2000 copies of one text whose similarities lie around 0.6 to 0.9, with some copies of copies."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(160)]
    texts = [" ".join(base)]
    for _ in range(2000):
        w = list(base) if rng.random() < 0.9 else texts[rng.randrange(len(texts))].split()
        for _ in range(rng.randrange(1, 28)):
            at, kind = rng.randrange(len(w)), rng.random()
            if kind < 0.6:
                w[at] = f"x{rng.randrange(100_000)}" if rng.random() < 0.8 else base[rng.randrange(160)]
            elif kind < 0.8:
                w.insert(at, base[rng.randrange(160)])
            else:
                del w[at]
        texts.append(" ".join(w))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(docs)


@pytest.mark.parametrize("seed", range(3))
def test_families_of_copies_in_one_bucket(spark, seed):
    """Families whose members are alike, and families alike enough to share buckets but not to be linked."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(6):
        root = [w if rng.random() > 0.12 else f"f{rng.randrange(10_000)}" for w in base]
        for _ in range(40):
            texts.append(" ".join(w if rng.random() > 0.04 else f"g{rng.randrange(10_000)}" for w in root))
    rng.shuffle(texts)
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2 + seed)


@pytest.mark.parametrize("seed", range(4))
def test_components_of_one_small_graph(spark, seed):
    """Paths, trees and cycles alone, in random numberings: no other component forces further rounds."""
    rng = random.Random(seed)
    n = rng.randrange(5, 14)
    names = rng.sample(range(100), n)
    graph = {0: [(i, i + 1) for i in range(n - 1)], 1: [(rng.randrange(i), i) for i in range(1, n)], 2: [(i, (i + 1) % n) for i in range(n)], 3: [(i, i % 2 + n - 2) for i in range(n - 2)] + [(n - 2, n - 1)]}[seed]
    rows = components(spark.createDataFrame([(names[a], names[b]) for a, b in graph], "a long, b long")).collect()
    assert len(rows) == n and {r.component for r in rows} == {min(names)}


def test_components_of_a_path_that_once_stopped_early(spark):
    rows = components(spark.createDataFrame([(5, 6), (6, 10), (10, 20), (8, 20), (1, 8)], "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in rows) == [(i, 1) for i in (1, 5, 6, 8, 10, 20)]


def test_texts_of_one_id_are_linked(spark):
    """Ids 5 and 8 have several texts each, of which others are copies."""
    rows = [(1, "a b c"), (2, "d e f"), (5, "a b c"), (5, "d e f"), (7, "g h i"), (8, "g h i"), (8, "j k l"), (9, "j k l"), (6, "m n o")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Settings(width=2)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (5, 1), (7, 7), (8, 7), (9, 7), (6, 6)}


def test_stages_of_a_run_are_few(spark):
    """Each stage costs a task a partition, whatever the rows: sketches travel with buckets instead of being joined."""
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(0, 100, 3)] + ["other words of one text"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.sparkContext.setJobGroup("neardup-stages", "")
    try:
        rows = neardup.near_duplicates(docs, Settings(width=2)).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted({r.component_id for r in rows}) == [0, 34]
    tracker = spark.sparkContext.statusTracker()
    ran = [tracker.getStageInfo(i) for j in tracker.getJobIdsForGroup("neardup-stages") for i in tracker.getJobInfo(j).stageIds]
    assert sum(i is not None and i.numCompletedTasks > 0 for i in ran) <= 50
