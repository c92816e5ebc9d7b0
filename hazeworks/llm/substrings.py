"""Exact repeated substrings: bytes covered by a window of ``WINDOW`` bytes that also starts earlier are removed.

The suffixes that are sorted are anchored ones. In every window the k-gram of least fingerprint (the right-most on ties) is
its anchor; equal windows have equal anchors, at the same offset. So all comparisons happen between suffixes that begin at
anchors, some 3 % of all positions:

1. Every task finds the anchors of its texts. Sampled splitters of the suffixes' leading 8 bytes range-partition them; each
   bucket sorts its suffixes by fingerprint of the leading k-gram. Anchors whose k-gram stands alone are dropped: no window
   around them can repeat.
2. Around the others, the windows' bytes go to the bucket of their anchor's leading bytes. Buckets sort all windows and compare
   equal ones byte by byte; all but the first of equal windows are flagged. Every key lies in one bucket, so there is nothing
   to compare across boundaries but what step 3 sends elsewhere.
3. Skew: tasks combine first. Of windows that are equal within a task's slice all but the first are flagged at once and only
   the first travels, so a passage costs a bucket at most one entry per slice. Anchors with over 1/10,000 of all shared
   anchors (hence at most 10,000 of them, a bounded broadcast) spread their windows one by one by window fingerprint.
4. Flagged runs are joined to the texts and cut out.

Copies of a whole text are found by digest first and need none of this: all of a copy is covered by the first one's windows.

A full suffix array of all positions would shuffle 100 bytes or more for every input byte; see the README.

Nulls: a null text counts as empty. Texts under ``WINDOW`` bytes keep everything. Very long texts are processed in pieces that
overlap by a window. A null id sorts after all others. Rows that repeat id and text (null ids too) are one document in two
rows: neither is the other's earlier copy. Different texts of one id, or without any, are documents of their own, ordered by
digest. An empty table gives an empty result. Only key and text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeworks.llm.common import even_keys, materialize

WINDOW, GRAM = 100, 32
#: K-grams in a window, and how far before and after its anchor a window's bytes can lie.
SPAN = WINDOW - GRAM + 1
#: Bytes of a slice that is processed at once, and of a piece of a long text.
SLICE, PIECE = 2 << 20, 1 << 20
#: Bytes of windows that a bucket's task sorts at once.
SHARE = 1 << 20
#: Bytes of text for each bucket, or less.
BUCKET_BYTES = 12 << 20
#: Documents sampled for the splitters.
SAMPLE_DOCS = 500
#: An anchor's k-gram is heavy from this many occurrences and from this share of all shared anchors.
HEAVY_LEAST, HEAVY_SHARE = 1000, 10_000
#: The key of rows without an id, where they hold one text of a window or more at most.
NO_ID = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Fingerprints:
    """Fingerprints of all substrings of given lengths: a polynomial modulo 2^64 over mixed bytes, then mixed."""

    def __init__(self):
        self.inverse = pow(_BASE, -1, 1 << 64)
        self.values = _mixed(np.arange(1, 257, dtype=np.uint64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            full = lambda base: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])
            self.powers, self.inverses = full(_BASE), full(self.inverse)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._reach(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=out[1:])
        return out

    def at(self, sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        return _mixed((sums[starts + length] - sums[starts]) * self.inverses[starts])

    def all(self, sums: np.ndarray, length: int) -> np.ndarray:
        n = max(0, len(sums) - length)
        return _mixed((sums[length:] - sums[:n]) * self.inverses[:n])


class Slice:
    """Pieces of texts laid end to end: per piece its document, offset in it, begin in ``data`` and number of windows."""

    def __init__(self, pieces: list[tuple[int, int, bytes]]):
        pieces.sort(key=lambda p: p[:2])
        self.data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        size = np.asarray([len(p[2]) for p in pieces], np.int64)
        self.docs = np.asarray([p[0] for p in pieces], np.int64)
        self.offsets = np.asarray([p[1] for p in pieces], np.int64)
        self.begins = np.cumsum(size) - size
        self.windows = np.maximum(size - WINDOW + 1, 0)

    def starts(self) -> np.ndarray:
        """All window starts in ``data``, in order of document and position."""
        total = int(self.windows.sum())
        shift = np.repeat(self.begins - (np.cumsum(self.windows) - self.windows), self.windows)
        return np.arange(total, dtype=np.int64) + shift

    def piece(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, at, "right") - 1

    def anchors(self, prints: Fingerprints, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """K-gram fingerprints of all positions, and of each window start the position of its anchor."""
        grams = prints.all(sums, GRAM)
        least, place = grams, np.arange(len(grams), dtype=np.int32)
        step = 1
        while 2 * step <= SPAN:
            least, place = _lesser(least, place, step)
            step *= 2
        if SPAN > step:
            least, place = _lesser(least, place, SPAN - step)
        return grams, place[self.starts()]


def _lesser(least: np.ndarray, place: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The smaller of each position and the one ``step`` ahead; the right one on ties."""
    right = least[step:] <= least[:-step]
    return np.where(right, least[step:], least[:-step]), np.where(right, place[step:], place[:-step])


def cut(batches: Iterator[pa.RecordBatch], with_places: bool = False) -> Iterator[tuple[Slice, dict[int, np.ndarray]]]:
    """Slices of (id, text[, places]) batches; long texts in pieces, whose windows do not overlap."""
    pieces: list[tuple[int, int, bytes]] = []
    places: dict[int, np.ndarray] = {}
    held = 0
    for batch in batches:
        for row in range(batch.num_rows):
            text = batch.column(1)[row]
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            if len(raw) < WINDOW:
                continue
            doc = batch.column(0)[row].as_py()
            if with_places:
                places[doc] = np.sort(batch.column(2)[row].values.to_numpy())
            for offset in range(0, len(raw) - WINDOW + 1, PIECE):
                pieces.append((doc, offset, raw[offset : offset + PIECE + WINDOW - 1]))
                held += len(pieces[-1][2])
                if held >= SLICE:
                    yield Slice(pieces), places
                    pieces, held = [], 0
                    places = {doc: places[doc]} if with_places else {}
    if pieces:
        yield Slice(pieces), places


def _leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a big-endian number."""
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | data[at + i].astype(np.uint64)
    return out


def _packed(*columns: np.ndarray) -> bytes:
    """Columns one after the other, each byte plane by byte plane: equal high bytes then compress well."""
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)


def _unpacked(raw: memoryview, rows: int, *types) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        width = np.dtype(t).itemsize
        planes = np.frombuffer(raw, np.uint8, rows * width, at).reshape(width, rows)
        out.append(np.ascontiguousarray(planes.T).view(t).reshape(rows))
        at += rows * width
    return out


BLOCK = "bucket long, kind int, n int, body binary, bytes binary"
_BLOCK = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("body", pa.binary()), ("bytes", pa.binary())])


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _BLOCK)] if rows else [pa.array([], f.type) for f in _BLOCK], schema=_BLOCK)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    ends = np.flatnonzero(np.diff(bucket[order], append=-1))
    begin = 0
    for end in ends:
        yield int(bucket[order[begin]]), order[begin : end + 1]
        begin = end + 1


#: Kinds of blocks: entries to compare, entries known to be shared, windows with their bytes, windows by fingerprint, flagged runs.
COMPARE, KNOWN, NEAR, SPREAD, RUNS = range(5)


def _anchor_task(splitters: np.ndarray, keys: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints()
        for part, _ in cut(batches):
            grams, chosen = part.anchors(prints, prints.sums(part.data))
            at = np.unique(chosen).astype(np.int64)
            print_, piece = grams[at], part.piece(at)
            doc, place = part.docs[piece], (part.offsets[piece] + at - part.begins[piece])
            _, first, count = np.unique(print_, return_index=True, return_counts=True)
            rest = np.ones(len(at), bool)
            rest[first] = False
            known = np.concatenate([np.flatnonzero(rest), first[count > 1]])
            bucket = np.searchsorted(splitters, _leading(part.data, at[first]), "right")
            rows = []
            for b, of in _by_bucket(bucket):
                e = first[of]
                rows.append((keys[b], COMPARE, len(e), _packed(print_[e], doc[e], place[e], (count[of] > 1).astype(np.uint8)), None))
            if len(known):
                # Dealt evenly, by the slice's first document.
                rows.append((keys[int(part.docs[0] * 2654435761 % len(keys))], KNOWN, len(known), _packed(print_[known], doc[known], place[known]), None))
            yield _blocks(rows)

    return run


_SHARED = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("print", pa.int64())])


def _shared_batches(doc: np.ndarray, place: np.ndarray, print_: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(doc), 100_000):
        s = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array(place[s]), pa.array(print_[s].view(np.int64))], schema=_SHARED)


def _shared_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's buckets, the anchors whose k-gram occurs more than once."""
    parts = []
    for batch in batches:
        for kind, n, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            if kind == KNOWN:
                print_, doc, place = _unpacked(body.as_buffer(), n, np.uint64, np.int64, np.int64)
                yield from _shared_batches(doc, place, print_)
            else:
                parts.append(_unpacked(body.as_buffer(), n, np.uint64, np.int64, np.int64, np.uint8))
    if not parts:
        return
    print_, doc, place, many = (np.concatenate(c) for c in zip(*parts))
    del parts
    order = np.argsort(print_)
    print_ = print_[order]
    same = print_[1:] == print_[:-1]
    shared = np.zeros(len(print_), bool)
    shared[1:] |= same
    shared[:-1] |= same
    shared &= many[order] == 0  # the others are known already
    of = order[shared]
    yield from _shared_batches(doc[of], place[of], print_[shared])


def _runs(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Flagged window starts, ordered by document, as rows (doc, begin, end) of covered bytes."""
    if not len(doc):
        return np.zeros((0, 3), np.int64)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + WINDOW)])
    last = np.concatenate([new[1:], [True]])
    return np.stack([doc[new], start[new], start[last] + WINDOW], axis=1)


def _window_task(splitters: np.ndarray, keys: list[int], heavy: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints()
        for part, places in cut(batches, with_places=True):
            sums = prints.sums(part.data)
            grams, chosen = part.anchors(prints, sums)
            start = part.starts()
            wanted = np.zeros(len(part.data), bool)
            for doc, offset, begin, windows in zip(part.docs, part.offsets, part.begins, part.windows):
                p = places[int(doc)] - offset
                p = p[(p >= 0) & (p < windows + SPAN - 1)]
                wanted[begin + p] = True
            of = np.flatnonzero(wanted[chosen])
            start, anchor = start[of], chosen[of].astype(np.int64)
            if not len(start):
                continue
            piece = part.piece(start)
            doc, place = part.docs[piece], part.offsets[piece] + start - part.begins[piece]
            print_ = prints.at(sums, start, WINDOW)
            first = _first(print_, part.data, start)
            earlier = (doc > doc[first]) | (place > place[first])
            rows = []
            runs = _runs(doc[earlier], place[earlier])
            if len(runs):
                rows.append((keys[int(part.docs[0] * 2654435761 % len(keys))], RUNS, len(runs), _packed(*runs.T), None))
            left = ~earlier
            start, anchor, doc, place, print_ = start[left], anchor[left], doc[left], place[left], print_[left]
            spread = np.isin(grams[anchor], heavy)
            for b, e in _by_bucket((print_[spread] % np.uint64(len(keys))).astype(np.int64)):
                text = b"".join(part.data[i : i + WINDOW].tobytes() for i in start[spread][e])
                rows.append((keys[b], SPREAD, len(e), _packed(print_[spread][e], doc[spread][e], place[spread][e]), text))
            start, anchor, doc, place = start[~spread], anchor[~spread], doc[~spread], place[~spread]
            if len(start):
                # Windows of one anchor follow each other (its piece may repeat it); a gap that the local comparison left is filled.
                new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
                last = np.concatenate([new[1:], [True]])
                low, high, doc, place, anchor = start[new], start[last] + WINDOW, doc[new], place[new], anchor[new]
                ahead = (anchor - low).astype(np.uint8)
                for b, e in _by_bucket(np.searchsorted(splitters, _leading(part.data, anchor), "right")):
                    text = b"".join(part.data[low[i] : high[i]].tobytes() for i in e)
                    rows.append((keys[b], NEAR, len(e), _packed(doc[e], place[e], (high - low)[e], ahead[e]), text))
            yield _blocks(rows)

    return run


RUN = "doc_id long, begin long, end long"
_RUN = pa.schema([("doc_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])


def _run_batches(runs: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(runs), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in runs[i : i + 100_000].T], schema=_RUN)


def _first(print_: np.ndarray, data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each of some windows of ``data``, in order of (doc, place), the number of the first equal one."""
    order = np.argsort(print_, kind="stable")
    sorted_ = print_[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    first = np.empty(len(order), np.int64)
    first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    # Equal fingerprints are confirmed byte by byte, in words of eight.
    rest = np.flatnonzero(first != np.arange(len(first)))
    other = np.zeros(len(rest), bool)
    for i in [*range(0, WINDOW - 8, 8), WINDOW - 8]:
        other |= _leading(data, start[rest] + i) != _leading(data, start[first[rest]] + i)
    if other.any():
        # Different windows of one fingerprint: told apart by their bytes.
        seen: dict[bytes, int] = {}
        for w in np.flatnonzero(np.isin(print_, print_[rest[other]])):
            first[w] = seen.setdefault(data[start[w] : start[w] + WINDOW].tobytes(), int(w))
    return first


def _near_runs(data: np.ndarray, doc: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Flagged runs of stretches of bytes ``data``, laid end to end, each in ``doc`` at ``place``."""
    begin = np.cumsum(size) - size
    order = np.lexsort((place, doc))
    doc, place, begin, windows = doc[order], place[order], begin[order], size[order] - WINDOW + 1
    each = np.repeat(np.arange(len(begin)), windows)
    offset = np.arange(len(each)) - np.repeat(np.cumsum(windows) - windows, windows)
    start, doc, place = begin[each] + offset, doc[each], place[each] + offset
    prints = Fingerprints()
    first = _first(prints.at(prints.sums(data), start, WINDOW), data, start)
    flagged = np.flatnonzero((doc > doc[first]) | (place > place[first]))
    return _runs(doc[flagged], place[flagged])


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of all bytes of the stretches, one stretch after the other."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def _flag_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's buckets, the windows with an earlier equal one. Works on a share of the anchors at a time."""
    near, spread, text, spread_text = [], [], [], []
    for batch in batches:
        for kind, n, body, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
            if kind == RUNS:
                yield from _run_batches(np.stack(_unpacked(body.as_buffer(), n, np.int64, np.int64, np.int64), axis=1))
            elif kind == SPREAD:
                spread.append(_unpacked(body.as_buffer(), n, np.uint64, np.int64, np.int64))
                spread_text.append(raw.as_buffer().to_pybytes())
            else:
                near.append(_unpacked(body.as_buffer(), n, np.int64, np.int64, np.int64, np.uint8))
                text.append(raw.as_buffer().to_pybytes())
    if spread:
        print_, doc, place = (np.concatenate(c) for c in zip(*spread))
        data = np.frombuffer(b"".join(spread_text), np.uint8)
        for of in _shares(print_, len(print_) * 100):
            of = of[np.lexsort((place[of], doc[of]))]
            first = of[_first(print_[of], data, of * WINDOW)]
            flagged = of[(doc[of] > doc[first]) | (place[of] > place[first])]
            yield from _run_batches(_runs(doc[flagged], place[flagged]))
    del spread, spread_text
    if near:
        doc, place, size, ahead = (np.concatenate(c) for c in zip(*near))
        data = np.frombuffer(b"".join(text), np.uint8)
        del near, text
        begin = np.cumsum(size) - size
        # Equal windows have equal anchors, so shares by the anchor's leading bytes keep them together.
        for of in _shares(_mixed(_leading(data, begin + ahead)), len(data)):
            yield from _run_batches(_near_runs(data[_spans(begin[of], size[of])], doc[of], place[of], size[of]))


def _shares(key: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Row numbers in shares of about SHARE bytes, rows of equal key together."""
    shares = max(1, size // SHARE)
    share = (key % np.uint64(shares)).astype(np.int64)
    for _, of in _by_bucket(share):
        yield of


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def merged_runs(runs: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes, clipped to the text."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(runs):
        end = min(end, size)
        if begin >= end:
            continue
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _cut_task(with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                text, runs, copy = batch.column(1)[i], batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if len(raw) < WINDOW:
                    runs, copy = None, False  # its key may be another's
                spans = [(0, len(raw))] if copy else merged_runs([(r["begin"], r["end"]) for r in runs or ()], len(raw))
                kept, at = [], 0
                for begin, end in spans:
                    kept.append(raw[at:begin])
                    at = end
                kept = b"".join([*kept, raw[at:]])
                rows.append((batch.column(0)[i].as_py(), len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
                held += len(kept) if with_text else 100
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _RESULT)], schema=_RESULT)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _RESULT)], schema=_RESULT)

    return run


def _splitters(texts: DataFrame, total: int, buckets: int) -> np.ndarray:
    """Quantiles of the anchored suffixes' leading bytes, from at most SAMPLE_DOCS texts or so."""
    sample = texts.select("text").sample(min(1.0, SAMPLE_DOCS / max(1, total)), seed=11).limit(2 * SAMPLE_DOCS)
    prints, found = Fingerprints(), []
    for r in sample.toLocalIterator():
        raw = (r["text"] or "").encode()[: 1 << 16]  # the splitters' balance needs no more; no result depends on it
        if len(raw) >= WINDOW:
            part = Slice([(0, 0, raw)])
            found.append(_leading(part.data, np.unique(part.anchors(prints, prints.sums(part.data))[1]).astype(np.int64)))
    if not found:
        return np.zeros(0, np.uint64)
    values = np.sort(np.concatenate(found))
    return np.unique(values[[len(values) * i // buckets for i in range(1, buckets)]])


def _keyed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """All rows as (doc_id, id, text), and (doc_id, digest) of the texts of a window or more; each doc_id names one such text.

    doc_id is the id itself. Where an id, or none, comes with several texts, it is instead a number in order of id and digest,
    written with the texts once; shorter texts, which keep everything, then have a number without meaning.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    by_id, digest = F.coalesce("id", F.lit(NO_ID)).alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("digest")
    enough = F.coalesce(F.octet_length("text") >= WINDOW, F.lit(False))
    digests = materialize(rows.where(enough).select("id", by_id, digest), "digests")
    if digests.select("doc_id", "digest").distinct().groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows.select(by_id, "id", "text"), digests.select("doc_id", "digest")
    ordered = digests.select("id", "digest").distinct().orderBy(F.asc_nulls_last("id"), "digest")
    # Partitions are ranges in order, so these numbers follow the order.
    ranks = materialize(ordered.select("id", "digest", F.monotonically_increasing_id().alias("doc_id")), "ranks")
    named = ranks.withColumnsRenamed({"id": "of", "digest": "its"})
    long = rows.where(enough).select("id", "text", digest).join(named.hint("merge"), F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("its")))
    short = rows.where(~enough).select(F.monotonically_increasing_id().alias("doc_id"), "id", "text")
    return materialize(long.select("doc_id", "id", "text").union(short), "keyed"), ranks.select("doc_id", "digest")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes, null unless ``with_text``) of every row."""
    spark = docs.sparkSession
    texts, digests = _keyed(docs, key, text)
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = materialize(digests.join(firsts, "digest").where("doc_id > first").select("doc_id").distinct(), "copies")

    # A bucket's task holds its anchors and windows, so buckets follow the size of the input.
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(text).cast("string"))).alias("bytes")).first()
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((size["bytes"] or 0) / BUCKET_BYTES))
    keys = even_keys(spark, partitions)
    splitters = _splitters(texts, size["n"], partitions)
    anchors = texts.select("doc_id", "text").mapInArrow(_anchor_task(splitters, keys), BLOCK).repartition(partitions, "bucket")
    shared = materialize(anchors.mapInArrow(_shared_task, "doc_id long, place long, print long"), "anchors")
    least = max(HEAVY_LEAST, math.ceil(shared.count() / HEAVY_SHARE))
    # Each has a 10,000th of all rows at least, so there are 10,000 at most.
    heavy = np.asarray([r["print"] for r in shared.groupBy("print").count().where(F.col("count") >= least).select("print").collect()], np.int64).view(np.uint64)

    places = shared.join(copies, "doc_id", "left_anti").groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    # The id rides along so that both joins deal out the same columns, once.
    around = texts.join(places.hint("merge"), "doc_id").select("doc_id", "text", "places", "id")
    windows = around.mapInArrow(_window_task(splitters, keys, heavy), BLOCK).repartition(partitions, "bucket")
    runs = windows.mapInArrow(_flag_task, RUN).groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("runs"))
    marks = runs.join(copies.withColumn("copy", F.lit(True)), "doc_id", "full_outer")
    marked = texts.join(marks.hint("merge"), "doc_id", "left").select("id", "text", "runs", F.coalesce("copy", F.lit(False)).alias("copy"))
    return marked.mapInArrow(_cut_task(with_text), RESULT)
