import hashlib
import re
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from hazeworks.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


CHECKS = {
    "email": lambda m: True,
    "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
    "card": luhn,
    "phone": lambda m: 8 <= sum(c.isdigit() for c in m) <= 15,
}


def brute(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = [(m.start(), m.end()) for m in re.finditer(pattern, text or "") if CHECKS[kind](m.group())]
    return out


TEXTS = [
    None, "", "plain words", "mail bob.x@example.com, 😀 é ann@b.co.uk now", "a@b.co_x@y.zz and @x.y a@b", "x@@y.com p@q..r", "ip 10.0.0.255 and 10.0.0.256 1.2.3.4.5.6.7.8 0001.002.03.4",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111111111", "pay 5500005555555559 4111 1111 1111 1111 22", "call +49 (170) 1234-567 or +1 2 or +1-800-555-0199x +1234567890123456", "+1 +2 555 123 4567 8",
    "iban DE89370400440532013000 bank GB82 WEST 1234 5698 7654 32. XX00 0000 0000 0000", "x" * 30000, "1 " * 5000, "a@b.c" * 300, "+1" + " " * 3000,
]


def check(rows):
    for r in rows:
        want = brute(r.text)
        for kind in PATTERNS:
            assert getattr(r, f"n_{kind}") == len(want[kind]), (kind, r.text[:80])
        base = ",".join(f"{k}:{s}:{e}" for k in PATTERNS for s, e in want[k])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if not x.startswith("iban")] == (base.split(",") if base or r.spans == "" else [])


def test_against_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    check(pii.report(docs).join(docs, "doc_id").collect())


def test_driver_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    check(pii.report(docs).join(docs, "doc_id").collect())


def test_iban_is_added(spark):
    docs = spark.createDataFrame([(1, TEXTS[11])], "doc_id long, text string")
    row = pii.report(docs).first()
    found = [TEXTS[11][int(s.split(":")[1]) : int(s.split(":")[2])] for s in row.spans.split(",") if s.startswith("iban")]
    assert "DE89370400440532013000" in found and "GB82 WEST 1234 5698 7654 32" in found


def test_redaction_covers_every_base_span(spark, edge_docs):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("pii_email", F.lit(1))
    for r, t in zip(sorted(pii.redact(docs).collect(), key=lambda r: r.doc_id), TEXTS):
        spans = sorted((s, e) for v in brute(t).values() for s, e in v)
        for s, e in spans:
            assert t[s:e] not in r.text or t.count(t[s:e]) > len(spans)
        if t is None:
            assert r.text is None
    assert pii.redact(edge_docs).columns == edge_docs.columns
    assert pii.redact(edge_docs).exceptAll(edge_docs).count() == 0


@pytest.mark.parametrize("empty", [True])
def test_empty(spark, edge_docs, empty):
    assert pii.report(edge_docs.limit(0)).count() == 0


def test_very_many_matches_in_one_text(spark):
    """Spans and replacements are right, and time per match doesn't grow with their number."""
    seconds = []
    for n in (10_000, 40_000):
        text = " ".join(f"x{i}@mail.org" if i % 3 else f"10.0.0.{i % 300}" for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        row = pii.report(docs).first()
        clean = pii.redact(docs).first().text
        seconds.append(time.perf_counter() - began)
        check([Row(text=text, **row.asDict())])
        assert clean == re.sub(r"10\.0\.0\.(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?= |$)", "[IP]", re.sub(r"\S+@\S+", "[EMAIL]", text))
    assert seconds[1] < 12 * seconds[0] and seconds[1] < 60


def test_overlapping_spans_become_one(spark):
    texts = ["+4111111111111111 1 x", "a@10.0.0.1.2 and 1.1.1.1@b.cc", "IP 10.0.0.1", "😀" * 300 + "a@b.cc" + "é" * 600 + "c@d.ee"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.redact(docs).collect():
        covered = sorted((s, e) for v in brute(texts[r.doc_id]).values() for s, e in v)
        kept, at = [], 0
        for s, e in covered:
            if s >= at:
                kept.append(texts[r.doc_id][at:s])
            at = max(at, e)
        kept.append(texts[r.doc_id][at:])
        assert re.sub(r"\[[A-Z]+\]", "\0", r.text).split("\0") == kept


def test_clashing_columns_keep_their_values(spark):
    docs = spark.createDataFrame([(1, "a@b.cc", "note", 5)], "doc_id long, text string, pii_note string, pii_email int")
    assert pii.redact(docs).collect() == [Row(doc_id=1, text="[EMAIL]", pii_note="note", pii_email=5)]
    assert pii.report(docs).first().n_email == 1
