import re
from collections import Counter

from pyspark.sql import functions as F

from hazeworks.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def check(docs):
    rows = quality.rate_documents(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r[n] for n in NAMES) == brute(r.text)
        assert not (r.base_failed and r.kept)
    return rows


def test_driver_documents(spark):
    rows = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed)


def test_edges(spark, edge_docs):
    texts = ["a b c " * 40, "a b c a b c", "x y " * 30, " ".join(str(i) for i in range(60)) + " 1 2 3", "a\n" * 10]
    clash = edge_docs.withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit(1))
    for docs in (edge_docs, clash, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")):
        check(docs)
    assert quality.rate_documents(edge_docs.limit(0)).count() == 0


def test_order_changes_nothing_and_filters_stay_above(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rules = quality.default_rules()
    forward = {r.doc_id for r in quality.measures(docs).where(quality.verdict(rules).isNull()).select("doc_id").collect()}
    backward = {r.doc_id for r in quality.measures(docs).where(quality.verdict(rules[::-1]).isNull()).select("doc_id").collect()}
    assert forward == backward and {r.name for r in quality.plan_cascade(docs, rules)} == {r.name for r in rules}
