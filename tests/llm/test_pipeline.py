import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from hazeworks.llm import bpe, mixing, quality
from hazeworks.llm.common import materialize
from tests.llm.test_neardup import brute
from tests.llm.test_pii import brute as spans


def test_stages_on_driver_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(materialize(stage(spark, steps[-1], "/root/testdata/sf0.001"), "stage"))
        assert len(steps) > 5 or steps[-1].columns == docs.columns
    rated, unique, clean, mixed, tokens = steps[1:]
    texts = {r.doc_id: r.text for r in rated.collect()}
    assert 0 < len(texts) < docs.count()
    assert sorted(r.doc_id for r in unique.collect()) == sorted(i for i, (_, c) in brute(texts, 5).items() if i == c)
    for r in clean.collect():
        assert not any(spans(r.text).values())
        if not any(spans(texts[r.doc_id]).values()):
            assert "IBAN" in r.text or r.text == texts[r.doc_id]
    enc = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((r.doc_id, len(enc.encode_ordinary(r.text))) for r in mixed.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in tokens.collect()) == want


CLASHING = ["kept", "n_words", "rejected_by", "mix_copy", "mix_source", "mix_cdf", "mix_order", "pii_note", "pii_email", "component_id", "digest", "band", "ids", "_w", "_p", "a b.c", "tick`"]


def test_stages_take_edges_and_nothing(spark, edge_docs):
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, edge_docs, "").collect()
        assert not stage(spark, edge_docs.limit(0), "").collect(), name


def test_extra_columns_of_any_name_come_back_as_they_were(spark, edge_docs):
    prose = " ".join(f"word{i} and" for i in range(60))
    docs = edge_docs.unionByName(spark.createDataFrame([(90, prose, "en", "src0", 1)], edge_docs.schema))
    extra = docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id")) for c in CLASHING})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, "")
        assert out.dtypes == extra.dtypes, name
        rows = out.collect()
        assert any(r.doc_id == 90 for r in rows) and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in CLASHING), name
    assert corpus_pipeline.STAGES[-1][1](spark, extra, "").count() == extra.count()


def test_the_quality_stage_keeps_what_the_operator_keeps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id for r in quality.rate_documents(docs).where("kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, "").collect()} == want


def test_mix_counts(spark):
    """Expected copies follow the target shares; a hot source doesn't change how single documents draw."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("0123456789").alias("text"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    for weights in (None, {"hot": 1.0, "s1": 1.0, "s2": 2.0}):
        rows = mixing.mix(docs, weights).groupBy("source").agg(F.count("*").alias("n"), F.first("mix_rate").alias("r")).collect()
        have = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}
        for r in rows:
            assert abs(r.n - r.r * have[r.source]) < 6 * (r.r * have[r.source]) ** 0.5
        if weights:
            total = sum(r.n for r in rows)
            assert {r.source: round(r.n / total * 4) for r in rows} == {"hot": 1, "s1": 1, "s2": 2}


def test_null_ids_stay_in_near_duplicates(spark, edge_docs):
    """Every row but those whose id has no kept row: null ids take part in no link."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long, "en", "src0", 1), (None, "another text without an id", "en", None, 1), (50, long, "en", "src0", 1), (51, long, "en", "src0", 1)]
    docs = edge_docs.unionByName(spark.createDataFrame(rows, edge_docs.schema))
    left = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()
    assert sorted(r.text for r in left if r.doc_id is None) == sorted(r[1] for r in rows[:2])
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == [*range(6), *range(7, 12), 50]
