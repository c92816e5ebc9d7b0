import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from hazeworks.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = bpe.read_ranks(PATH)
PLAIN = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.mark.parametrize("leaf,window", [(1, 1), (2, 1), (5, 3), (64, 8)])
def test_tree_equals_plain(leaf, window):
    codec = bpe.TreeCodec(RANKS, PATTERN, leaf, window)
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice(["'", "re", "'ve", "s", " ", "  ", "\n", "\t", "word", "12", "!", "é", "漢", "😀", "'ll", "d"]) for _ in range(rng.randrange(30)))
        ids = codec.encode(text)
        assert ids == PLAIN.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    codec = bpe.TreeCodec(RANKS, PATTERN, 4, 2)
    assert codec.encode(text) == PLAIN.encode_ordinary(text)


def test_long_single_pieces():
    codec = bpe.TreeCodec(RANKS, PATTERN, 64, 8)
    for text in ("a" * 3000, " " * 3000 + "x", "x" + "\n" * 2000, "!" * 1000 + "?"):
        assert codec.encode(text) == PLAIN.encode_ordinary(text)


def check(rows, texts):
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = PLAIN.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_edges_and_driver_documents(spark, edge_docs):
    for docs in (edge_docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        rows = bpe.round_trip(docs, PATH, PATTERN).collect()
        texts = {r.doc_id: r.text for r in docs.collect()}
        assert len(rows) == docs.count()
        check(rows, texts)
    assert bpe.round_trip(edge_docs.limit(0), PATH, PATTERN).count() == 0
    assert [r.ids for r in bpe.encode_documents(edge_docs.where("doc_id = 5"), PATH, PATTERN).collect()] == [PLAIN.encode_ordinary("one two three")]


def test_cache_in_generations():
    asked = []
    recent = bpe.Recent(lambda piece: asked.append(piece) or (len(piece),), 2)
    assert [recent[p] for p in ["a", "bb", "ccc", "a", "bb", "dd", "ccc"]] == [(1,), (2,), (3,), (1,), (2,), (2,), (3,)]
    assert asked == ["a", "bb", "ccc", "dd"]  # entries came back from the older generation
    assert recent["a"] == (1,) and asked[-1] == "a"  # two generations later it is gone
    long = "x" * (bpe.CACHE_CHARS + 1)
    assert recent[long] == (len(long),) and long not in recent
