import re

from hazeworks.llm import licenses
from hazeworks.llm.licenses import TEMPLATES, THRESHOLD, bigrams

PLACES = {}
for name, bigram, place in licenses.anchors(TEMPLATES, THRESHOLD):
    PLACES.setdefault((name, bigram), []).append(place)


def brute(text):
    parts = [("line", i, s) for i, s in enumerate((text or "").split("\n"))]
    parts += [("paragraph", i, s) for i, s in enumerate(re.split(r"\n[\x20\x09\r]*\n", text or ""))] + [("text", 0, text or "")]
    out = []
    for kind, i, s in parts:
        own = bigrams(s)
        rated = [(-2 * len(own & t) / (len(own) + len(t)), n) for n, t in ((n, bigrams(b)) for n, b in TEMPLATES.items()) if 200 * len(own & t) >= THRESHOLD * (len(own) + len(t))]
        if own and rated:
            out.append((kind, i, min(rated)[1], len(own & bigrams(TEMPLATES[min(rated)[1]])), min(rated)[0]))
    words = re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).split()
    for name in sorted(TEMPLATES):
        own, n = bigrams(TEMPLATES[name]), licenses.length(TEMPLATES[name])
        starts = {max(i - o, 0) for i, x in enumerate(zip(words, words[1:])) for o in PLACES.get((name, " ".join(x)), ())}
        near = [(-2 * len(w & own) / (len(w) + len(own)), i, len(w & own)) for i in starts for w in [bigrams(" ".join(words[i : i + n + 1]))] if 200 * len(w & own) >= THRESHOLD * (len(w) + len(own))]
        if near:
            d, i, shared = min(near)
            out.append(("window", i, name, shared, d))
    return out


def check(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert [tuple(m.split(":")[:3]) for m in r.matches.split(",") if m] == [(k, str(i), n) for k, i, n, _, _ in want], texts[r.doc_id][:200]
        assert r.n_matches == len(want)
        best = min(((len(bigrams(TEMPLATES[n])) - 2 * shared, d, n) for _, _, n, shared, d in want), default=(0, None, None))
        assert (r.license, r.dice) == (best[2], best[1] and round(-best[1], 4))
    return rows


def test_templates_match_themselves(spark):
    docs = spark.createDataFrame([(i, b) for i, b in enumerate(TEMPLATES.values())], "doc_id long, text string")
    assert {r.doc_id: r.license for r in check(docs)} == dict(enumerate(TEMPLATES))


def test_edges_and_variants(spark, edge_docs):
    check(edge_docs)
    texts = ["Hello world.\nReleased under the MIT License\nbye", "is released under the MIT License", TEMPLATES["ISC"].replace("fee", "charge") + "\n\nprose", "licensed UNDER cc-by-nc 4.0", "license " * 2000]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert licenses.scan(edge_docs.limit(0)).count() == 0


def test_published_layouts_and_notices_in_prose(spark):
    gpl, bsd = TEMPLATES["GPL-3.0-header"].replace(" This program is distributed", "\n\n    This program is distributed"), TEMPLATES["BSD-2-Clause"]
    bsd = bsd.replace("1. Redis", "\n\n1. Redis").replace("2. Redis", "\n\n2. Redis")
    code = "\n\nint main(void) {\n  return 0;\n}\n" * 40
    assert "\n\n" in bsd
    texts = {
        1: ("GPL-3.0-header", f"Copyright 2020 Someone\n\n{gpl.replace('. See', '.' + chr(10) * 2 + 'See')}{code}"),
        2: ("BSD-2-Clause", f"Copyright 2020 Someone\n\n{bsd}{code}"),
        3: ("MIT", "This long sentence talks of many things. The text ends here. Released under the MIT License. And then it goes on for a while."),
        4: ("CC-BY-4.0", "The essays which the author wrote over many years, and this work is licensed under a Creative Commons Attribution 4.0 International License, so copy it."),
        5: (None, "He was released under the terms of the court, with a driving license that nobody had seen since the redistribution of source material."),
    }
    rows = check(spark.createDataFrame([(i, t) for i, (_, t) in texts.items()], "doc_id long, text string"))
    assert {r.doc_id: r.license for r in rows} == {i: n for i, (n, _) in texts.items()}


def test_families_are_told_apart(spark):
    """Names of holders differ, prose and code surround the notice, and shorter templates are part of longer ones."""
    around = "Copyright (c) 2020 Someone\n\n{}\n\nimport os  # derived from older work without permission notice of any kind\n" + "x = 1\n" * 30
    changed = {n: TEMPLATES[n].replace("the copyright holder nor", "Some Company Ltd. nor").replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS") for n in TEMPLATES}
    names = [n for n in TEMPLATES for _ in range(2)]
    texts = [around.format(body) for n in TEMPLATES for body in (TEMPLATES[n], changed[n])]
    rows = check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.license for r in rows} == dict(enumerate(names))


def test_repeated_notices_stay_linear(spark):
    check(spark.createDataFrame([(1, (TEMPLATES["MIT-text"] + "\n") * 20), (2, "license software " * 3000)], "doc_id long, text string"))


def test_driver_documents(spark):
    rows = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert any(r.license for r in rows)


def test_no_templates(spark, edge_docs):
    rows = licenses.scan(edge_docs, templates={}).collect()
    assert len(rows) == edge_docs.count() and {(r.license, r.dice, r.n_matches, r.matches) for r in rows} == {(None, None, 0, "")}
