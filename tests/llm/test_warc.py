import hashlib
import os

import zstandard

from hazeworks.llm import warc


def brute(rows):
    groups = {}
    for r in rows:
        body = (r.html or "").encode()
        if len(body) >= 1000 and r.page_id is not None:
            groups[body] = max(groups.get(body, r.page_id), r.page_id)
    out = []
    for r in rows:
        body = (r.html or "").encode()
        keeper = groups.get(body)
        revisit = keeper is not None and keeper != r.page_id
        out.append((r.page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=repr)


def trip(spark, pages, path):
    warc.write_archives(pages, path)
    rows = warc.read_archives(spark, path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr) == brute(pages.collect())
    return rows


def test_edges(spark, tmp_path):
    html = [None, "", "x" * 999, "x" * 999, "y" * 1000, "y" * 1000, "y" * 1000, "z" * 400_000, "é" * 500, "é" * 500, "line\r\n\r\nline"]
    rows = [(i, None if i == 3 else f"http://a.b/ü\n{i}", h, "extra") for i, h in enumerate(html)] + [(None, "u", "y" * 1000, "extra"), (6, "again", "y" * 1000, "extra")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    back = trip(spark, pages, str(tmp_path / "a"))
    assert {r.page_id: bytes(r.payload).decode() for r in back if r.record_type == "response" and r.page_id == 7} == {7: "z" * 400_000}
    warc.write_archives(pages.limit(0), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).count() == 0


def test_driver_pages_and_plain_zstd_readers(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    trip(spark, pages.unionByName(pages.withColumn("page_id", pages.page_id + 100_000)), str(tmp_path / "a"))
    names = [n for n in os.listdir(tmp_path / "a") if n.startswith("part-")]
    data = (tmp_path / "a" / names[0]).read_bytes()
    assert data[:4] == bytes.fromhex("5d2a4d18")
    size = int.from_bytes(data[4:8], "little")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).stream_reader(data[8 + size :], read_across_frames=True)
    assert reader.read().count(b"WARC/1.1\r\n") == sum(1 for _ in warc._frames(memoryview(data)))
