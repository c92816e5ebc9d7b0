"""Dictionary-compressed web archives (WARC in Zstandard): written by Spark's own file writer, read back record by record.

An archive is a leading skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary, then one frame per record, so
any record can be read alone. The dictionary is trained once on a bounded sample of the records and is broadcast (at most
``DICTIONARY_BYTES``). One Spark partition becomes one archive; its size follows the partition size, which AQE keeps near
``spark.sql.adaptive.advisoryPartitionSizeInBytes``. Files go through Spark's commit protocol, so a lost executor leaves no
broken archive, and to any file system Spark can write. Spark ends each written row with a line feed; every row closes with
the header of a one-byte skippable frame, whose content is that line feed, so the stream stays valid Zstandard.

Records of equal payload (by SHA-1 and length) of at least ``REVISIT_BYTES`` become one response, that of the largest page id,
and revisits that refer to it and repeat its HTTP headers, with the full length, but no payload.

Nulls: a null html is an empty payload; a null url becomes ``urn:unknown``; a null page id is written as ``null`` and read back
as null, and is never the response of a group that has an id. Rows that repeat the largest page id are all responses. Very
long payloads are single records. An empty table writes no record. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeworks.llm.common import slices

DICTIONARY_MAGIC, FILLER_MAGIC = 0x184D2A5D, 0x184D2A50
#: Ends every written row: a skippable frame of one byte, which the writer's line feed fills.
FILLER = struct.pack("<II", FILLER_MAGIC, 1)
REVISIT_BYTES = 1000
#: Most bytes of the dictionary; records, and bytes of them, it is trained on (expected; twice the bytes at most).
DICTIONARY_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES = 65_536, 1000, 8 << 20
LEVEL = 3
URN = "urn:page:"


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, length: int, date: str) -> bytes:
    """One WARC record; a revisit if ``refers_to`` is given."""
    head = http_head(length)
    block = head if refers_to is not None else head + payload
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else "urn:unknown"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{URN}{'null' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from sample records; the last of them, raw, where there are too few to train on; empty for none."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 20)), samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, length and refers_to (null for responses)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "length": F.octet_length("payload").cast("long")})
    groups = rows.where(F.col("length") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
    shared = groups.where("copies > 1").select(F.col("digest").alias("group"), "keeper")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    # Short payloads, however often one occurs, have keys of their own.
    group = F.when(F.col("length") >= REVISIT_BYTES, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit(""))))
    return rows.withColumn("group", group).join(shared, "group", "left").select("page_id", "url", "payload", "digest", "length", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", level: int = LEVEL) -> None:
    """Write all ``pages`` (page_id, url, html) as archives into the folder ``path``."""
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    sizes = pages.agg(F.count("*").alias("n"), F.sum(F.octet_length(html)).alias("bytes")).first()
    # Rows are chosen by hash where they lie, so no task gathers candidates.
    share = min(1.0, SAMPLE_RECORDS / max(1, sizes["n"]), SAMPLE_BYTES / max(1, sizes["bytes"] or 0))
    chosen = F.pmod(F.xxhash64("page_id", F.octet_length(html)), F.lit(1 << 40)) < math.ceil(share * (1 << 40))
    sample = pages.select("page_id", "url", html.alias("html")).where(chosen)
    samples, held = [], 0
    for r in sample.toLocalIterator():
        body = r.html.encode()
        samples.append(record(r.page_id, r.url, body, hashlib.sha1(body).hexdigest(), None, len(body), date))
        held += len(body)
        if held > 2 * SAMPLE_BYTES:
            break
    raw = spark.sparkContext.broadcast(train(samples))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(raw.value), write_content_size=True).compress
        begun = False
        for part in slices(batches, "payload", 4 << 20):
            frames = [] if begun or not raw.value else [struct.pack("<II", DICTIONARY_MAGIC, len(raw.value)) + raw.value + FILLER]
            begun = True
            for page_id, url, payload, digest, length, refers_to in zip(*(c.to_pylist() for c in part.columns)):
                frames.append(compress(record(page_id, url, payload, digest, refers_to, length, date)) + FILLER)
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    # The text writer puts a string's bytes down as they are; the cast keeps them.
    frames = _planned(pages).mapInArrow(archive, "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("compression", "none").text(path)


def _frames(data: memoryview) -> Iterator[bytes]:
    """Decompressed records of one archive."""
    at, decompressor = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == FILLER_MAGIC:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if magic == DICTIONARY_MAGIC:
                decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(bytes(data[at + 8 : at + 8 + size])))
            at += 8 + size
        else:
            one = decompressor.decompressobj()
            parts, begin = [], at
            while not one.eof:
                if at >= len(data):
                    raise ValueError(f"archive ends inside the frame at {begin}")
                chunk = bytes(data[at : at + 65_536])
                parts.append(one.decompress(chunk))
                at += len(chunk) - (len(one.unused_data) if one.eof else 0)
            yield b"".join(parts)


def _page_number(text: str) -> int | None:
    number = text.strip("<>").removeprefix(URN)
    return None if number == "null" else int(number)


def parse(data: bytes) -> dict:
    """A record's page_id, url, record_type, refers_to, payload (null for revisits), and length and digest of the full payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        digest, said = hashlib.sha1(payload).hexdigest(), digest
        if digest != said or length != len(payload):
            raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest and length")
    refers_to = fields.get("WARC-Refers-To")
    return {
        "page_id": _page_number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": kind, "refers_to": _page_number(refers_to) if refers_to else None,
        "payload_bytes": length, "payload_digest": digest, "payload": payload if kind == "response" else None,
    }


READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def read_archives(spark: SparkSession, path: str, payloads: bool = True, batch_bytes: int = 4 << 20) -> DataFrame:
    """All records of the archives in a folder; payloads are checked, and left out (null) unless asked for."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for value in batch.column(0):
                for data in _frames(memoryview(value.as_buffer())):
                    row = parse(data)
                    rows.append(row if payloads else row | {"payload": None})
                    held += len(data)
                    if held > batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, READ_SCHEMA)
