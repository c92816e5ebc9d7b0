"""Exact repeated word sequences: words covered by a window of ``WINDOW`` words that also starts earlier are removed.

Recompression finds what repeats. A round names runs of one symbol, then pairs of a left and a right symbol (each name falls to one of
the sides by its bits). Names are 64-bit mixes of what they stand for, so tasks name equal runs and pairs alike without a table; which names
are shared is what the Spark rounds settle for all documents at once. What a round makes of two neighbours depends on these alone, so in equal windows
all symbols are equal but for those near the borders. Of a window, the symbols that its own words settle are its interior; the
window's anchor is the interior symbol of least name, on the highest level that leaves the window an interior (level 0, the words, always does).

1. ``_slices``: one pass over the texts writes slices of documents as dictionaries and word numbers, about a fourth of the text, with a
   digest of each document's words. Of equal documents only the first goes on; the others are covered by it whole.
2. First round: an anchor's symbol, extended to half a window on the side where its window has more room, is a name of 10 words or more
   that two equal windows have in common. Slices send distinct names (32 bits each, beside those that choose a bucket); buckets say which are shared.
   A name in one place only rules its windows out; a 32-bit collision only lets a window through.
3. Second round: the windows that are left are verified: named by all their 20 words (64 bits, 16 more and those that choose the bucket, from
   two families of fingerprints), and each bucket tells all but the first window of a name. Windows that repeat within a slice are told there, and only
   the first travels, so a passage costs a bucket at most one entry a slice however many documents hold it.
4. What was told goes back to its slice, and the words left are put together.

No set of documents, names or links passes the driver, and no pairs are formed. Results are exact up to collisions of 80 bits or more.

Nulls: a null text has no words. Documents under ``WINDOW`` words keep everything. A null id comes after all others. Rows that
repeat id and words (null ids too) are one document in two rows: neither is the other's earlier copy. Different documents of one id, or without any,
are told apart and ordered by digest. Very long texts are parsed in stretches. An empty table gives an empty result. Only key and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeworks.llm.common import arrow_rows, materialize, scratch_path
from hazeworks.llm.substrings import _mixed, _packed, _unpacked

WINDOW = 20
#: Bytes of text in a slice; a longer document is a slice of its own.
SLICE = 2 << 20
#: Windows that are parsed at once, and words that are named at once.
STRETCH, PIECE = 1 << 17, 1 << 15
#: Names, and windows, in a partition of the two rounds, or fewer. Buckets for each partition.
NAMES, ENTRIES, SPREAD = 1 << 20, 1 << 19, 4
#: Rows sent to Python at a time: documents, slices or blocks.
DOCUMENT_ROWS, SLICE_ROWS = 256, 16
#: The place of rows without an id in the order of ids.
NO_ID = (1 << 63) - 1
_BASE, _SECOND, _RUN, _PAIR = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


class Powers:
    """Polynomials modulo 2^64 of all ranges of a sequence, from prefix sums; powers are kept between calls."""

    def __init__(self, base: np.uint64):
        self.base, self.back = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(values):
            full = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(values), b, np.uint64))])
            self.up, self.down = full(self.base), full(self.back)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((sums[end] - sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64))


def word_names(data: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, begins and ends of words that are joined by single spaces."""
    raw = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    begin, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    names = np.empty(len(begin), np.uint64)
    for at in range(0, len(begin), PIECE):
        b, e = begin[at : at + PIECE], end[at : at + PIECE]
        names[at : at + PIECE] = powers.of(powers.sums(_BYTES[raw[b[0] : e[-1]]]), b - b[0], e - b[0])
    return names, begin, end


def compressed(names: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One round: the new names and the first old symbol of each; of old symbols their run; of runs whether they are left symbols, and their new symbol."""
    new = np.concatenate([[True], names[1:] != names[:-1]])
    run = np.flatnonzero(new)
    length = np.diff(run, append=len(names)).astype(np.uint64)
    name = np.where(length > 1, _mixed(names[run] * _RUN + length), names[run])
    left = (_mixed(name + np.uint64((level + 1) * int(_SECOND) % (1 << 64))) & np.uint64(1)) == 0
    paired = np.zeros(len(run), bool)
    paired[:-1] = left[:-1] & ~left[1:]
    second = np.concatenate([[False], paired[:-1]])
    first = np.flatnonzero(~second)
    pair = first[paired[first]]
    out = name[first]
    out[paired[first]] = _mixed(name[pair] * _PAIR + _mixed(name[pair + 1]))
    return out, run[first], np.cumsum(new) - 1, left, np.cumsum(~second) - 1


def _least(names: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The left-most place of the least name in each range [low, high) of at most ``WINDOW`` places."""
    values, places = [names], [np.arange(len(names))]
    for k in range(WINDOW.bit_length() - 1):
        v, p, step = values[-1], places[-1], 1 << k
        if len(v) <= step:
            break
        keep = v[:-step] <= v[step:]
        values.append(np.where(keep, v[:-step], v[step:]))
        places.append(np.where(keep, p[:-step], p[step:]))
    power = np.frexp((high - low).astype(np.float32))[1] - 1
    out = np.empty(len(low), np.int64)
    for k in range(len(values)):
        of = np.flatnonzero(power == k)
        a, b = low[of], high[of] - (1 << k)
        out[of] = np.where(values[k][a] <= values[k][b], places[k][a], places[k][b])
    return out


def anchors(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (in words) of the anchor of every window of ``names``, which has at least ``WINDOW`` words."""
    count = len(names) - WINDOW + 1
    begin, end = np.empty(count, np.int64), np.empty(count, np.int64)
    window, low = np.arange(count), np.arange(count)
    high, starts, level = low + WINDOW, np.arange(len(names) + 1), 0
    while len(window):
        out, first, run, left, symbol = compressed(names, level)
        # Runs at the borders may go on outside; then a right symbol may belong to one before, a left symbol to one behind.
        a, b = run[low] + 1, run[high - 1]
        inner = a < b
        a += inner & ~left[np.minimum(a, len(left) - 1)]
        b -= inner & left[b - 1]
        inner &= a < b
        done = ~inner
        place = _least(names, low[done], high[done])
        begin[window[done]], end[window[done]] = starts[place], starts[place + 1]
        window, low, high = window[inner], symbol[a[inner]], symbol[b[inner] - 1] + 1
        names, starts, level = out, np.concatenate([starts[first], starts[-1:]]), level + 1
    return begin, end


def window_names(names: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """For every window the name of its extended anchor, and the first word of what that name covers."""
    sums = powers.sums(names)
    begin, end = anchors(names)
    half = (WINDOW - (end - begin) + 1) // 2
    before = begin - np.arange(len(begin)) >= half
    low, high = np.where(before, begin - half, begin), np.where(before, end, end + half)
    # The anchor's length and side are part of the name.
    return _mixed(powers.of(sums, low, high) + ((end - begin) * 2 + before).astype(np.uint64)), low


def _stretches(counts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Word ranges (begin, end) of a slice with the starts, relative to begin, of the windows in them that lie within one document."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, max(0, total - WINDOW + 1), STRETCH):
        start = np.arange(at, min(at + STRETCH, total - WINDOW + 1))
        within = start + WINDOW <= ends[np.searchsorted(ends, start, "right")]
        if within.any():
            yield at, int(start[-1]) + WINDOW, start[within] - at


SLICES = "slice long, ids array<long>, digests array<string>, counts array<int>, words long, body binary"
_SLICES = pa.schema([("slice", pa.int64()), ("ids", pa.list_(pa.int64())), ("digests", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("words", pa.int64()), ("body", pa.binary())])


def _slices_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers, number = Powers(_BASE), TaskContext.get().partitionId() << 32
    held: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        nonlocal number
        held.sort(key=lambda d: (NO_ID if d[0] is None else d[0], d[1]))
        counts = [d[3] for d in held]
        names, begin, end = word_names(data := b" ".join(d[2] for d in held if d[3]), powers)
        if not data:
            names, begin, end = names[:0], begin[:0], end[:0]
        _, first, codes, count = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
        words = [data[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist())]
        # Frequent words first, equally frequent ones in their own order: both numbers and dictionary compress better.
        order = sorted(range(len(words)), key=lambda i, n=count.tolist(): (-n[i], words[i]))
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        dictionary = b" ".join(words[i] for i in order)
        head = np.asarray([len(dictionary)], np.int64).tobytes()
        body = zstandard.compress(head + dictionary + (_packed(rank[codes]) if data else b""), 3)
        number += 1
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([[d[0] for d in held]], _SLICES.field(1).type), pa.array([[d[1] for d in held]]), pa.array([counts], _SLICES.field(3).type), pa.array([len(names)]), pa.array([body], pa.binary())], schema=_SLICES)

    size = 0
    for batch in batches:
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
            data = b" ".join(words)
            if held and size + len(data) > SLICE:
                yield flushed()
                held, size = [], 0
            held.append((id_, hashlib.sha256(data).hexdigest(), data, len(words)))
            size += len(data)
    if held:
        yield flushed()


class Slice:
    """The words of a slice: their dictionary and numbers."""

    def __init__(self, body: pa.Scalar, words: int):
        raw = zstandard.decompress(body.as_buffer())
        size = int(np.frombuffer(raw, np.int64, 1)[0])
        self.dictionary = raw[8 : 8 + size]
        self.codes = _unpacked(memoryview(raw)[8 + size :], words, np.uint32)[0] if words else np.zeros(0, np.uint32)

    def names(self, powers: Powers) -> np.ndarray:
        return word_names(self.dictionary, powers)[0][self.codes] if len(self.codes) else np.zeros(0, np.uint64)


class Windows:
    """The windows of a slice by the name of their extended anchors; ``keys`` are the distinct names, a bucket and 32 bits each, ascending."""

    def __init__(self, names: np.ndarray, counts: np.ndarray, buckets: int, powers: Powers):
        keys, self.at, low = [], [], []
        for begin, end, start in _stretches(counts):
            name, place = window_names(names[begin:end], powers)
            name = name[start]
            bucket = (name >> np.uint64(32)) % np.uint64(buckets)
            keys.append(bucket << np.uint64(32) | name & np.uint64(0xFFFFFFFF))
            low.append(begin + place[start])
            self.at.append(begin + start)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.at, low = join(self.at, np.int64), join(low, np.int64)
        self.keys, self.key = np.unique(join(keys, np.uint64), return_inverse=True)
        # Names that cover words in several places of this slice.
        first = np.full(len(self.keys), -1, np.int64)
        first[self.key] = low
        self.many = np.zeros(len(self.keys), bool)
        self.many[self.key[first[self.key] != low]] = True

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets that have names, and where each begins in ``keys`` (the end included)."""
        bucket = (self.keys >> np.uint64(32)).astype(np.int64)
        begin = np.flatnonzero(np.diff(bucket, prepend=-1))
        return bucket[begin], np.append(begin, len(bucket))


def _binary(data: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Rows data[begin[i]:begin[i + 1]] as bytes."""
    width = data.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer((begin * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


NAMED = "bucket long, slice long, names binary, many binary"


def _names_task(buckets: int) -> Callable:
    schema = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("names", pa.binary()), ("many", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(_BASE)
        for batch in batches:
            for row in range(batch.num_rows):
                part = Slice(batch.column(3)[row], batch.column(2)[row].as_py())
                found = Windows(part.names(powers), batch.column(1)[row].values.to_numpy(), buckets, powers)
                bucket, begin = found.blocks()
                slices = np.full(len(bucket), batch.column(0)[row].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(slices), _binary(found.keys.astype(np.uint32), begin), _binary(found.many.astype(np.uint8), begin)], schema=schema)

    return run


def _shared_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's blocks of names, which are in another block of their bucket, or in several places: a bit each."""
    schema = pa.schema([("slice", pa.int64()), ("bucket", pa.int64()), ("shared", pa.binary())])
    blocks = [(b, s, n.as_buffer().to_pybytes(), m.as_buffer().to_pybytes()) for batch in batches for b, s, n, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3))]
    if not blocks:
        return
    size = np.asarray([len(x[3]) for x in blocks])
    keys = np.repeat(np.asarray([x[0] for x in blocks], np.uint64) << np.uint64(32), size) | np.frombuffer(b"".join(x[2] for x in blocks), np.uint32)
    _, key, count = np.unique(keys, return_inverse=True, return_counts=True)
    shared = (count[key] > 1) | (np.frombuffer(b"".join(x[3] for x in blocks), np.uint8) > 0)
    bits = [np.packbits(x).tobytes() for x in np.split(shared, np.cumsum(size)[:-1])]
    yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in blocks]), pa.array([x[0] for x in blocks]), pa.array(bits, pa.binary())], schema=schema)


#: Kinds of blocks of windows: to be verified, and told within their slice (only the starts).
VERIFY, TOLD = range(2)
BLOCK = "bucket long, slice long, kind int, n int, body binary"
_BLOCK = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("body", pa.binary())])


def _windows_task(name_buckets: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, other = Powers(_BASE), Powers(_SECOND)
        for batch in batches:
            slices, ids, digests, counts_, words, bodies, own, shared = batch.columns
            for row in range(batch.num_rows):
                counts = counts_[row].values.to_numpy()
                names = Slice(bodies[row], words[row].as_py()).names(powers)
                found = Windows(names, counts, name_buckets, powers)
                _, begin = found.blocks()
                bits = sorted((x["bucket"], x["shared"]) for x in shared[row].as_py())
                flags = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for (_, b), n in zip(bits, np.diff(begin), strict=True)]
                wanted = np.concatenate(flags).astype(bool)[found.key] if flags else np.zeros(0, bool)
                mine = np.zeros(len(counts), bool)
                mine[own[row].values.to_numpy()] = True
                doc = np.searchsorted(np.cumsum(counts), found.at, "right")
                wanted &= mine[doc]
                at, doc = found.at[wanted], doc[wanted]
                if not len(at):
                    continue
                one = powers.of(powers.sums(names), at, at + WINDOW)
                two = other.of(other.sums(_mixed(names)), at, at + WINDOW)
                order = np.lexsort((two, one))  # stable: windows of one name stay in order of document and place
                repeated = np.concatenate([[False], (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])])
                told, left = np.sort(at[order[repeated]]), np.sort(order[~repeated])
                number = slices[row].as_py()
                rows = [(number % buckets, number, TOLD, len(told), _packed(told.astype(np.uint32)))] if len(told) else []
                at, doc, one, two = at[left], doc[left], one[left], two[left]
                id_ = ids[row].values.fill_null(NO_ID).to_numpy()[doc]
                # Of a digest its first 63 bits tell documents of one id apart, or without any.
                digest = np.asarray([int(d[:16], 16) >> 1 for d in digests[row].as_py()], np.int64)[doc]
                bucket = ((two >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                for of in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    rows.append((int(bucket[of[0]]), number, VERIFY, len(of), _packed(one[of], two[of].astype(np.uint16), id_[of], digest[of], at[of].astype(np.uint32))))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _BLOCK)], schema=_BLOCK)

    return run


_TOLD = pa.schema([("slice", pa.int64()), ("n", pa.int32()), ("starts", pa.binary())])


def _told(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _TOLD)], schema=_TOLD)


def _verify_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's windows, the starts of all that are not the first of their name, by slice."""
    parts = []
    for batch in batches:
        for bucket, number, kind, n, body in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4)):
            if kind == TOLD:
                yield _told([(number, n, body.as_buffer().to_pybytes())])
            else:
                one, two, id_, digest, at = _unpacked(body.as_buffer(), n, np.uint64, np.uint16, np.int64, np.int64, np.uint32)
                parts.append((one, two.astype(np.uint64) | np.uint64(bucket) << np.uint64(16), id_, digest, at, np.full(n, number, np.int64)))
    if not parts:
        return
    one, two, id_, digest, at, number = (np.concatenate(c) for c in zip(*parts))
    del parts
    order = np.lexsort((at, digest, id_, two, one))
    later = np.concatenate([[False], (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])])
    of = order[later]
    of = of[np.lexsort((at[of], number[of]))]
    if len(of):
        yield _told([(int(number[s[0]]), len(s), _packed(at[s])) for s in np.split(of, np.flatnonzero(np.diff(number[of])) + 1)])


CHANGED = "digest string, n_removed long, kept_sha256 string, spans array<struct<begin: int, end: int>>, kept string"
_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
_CHANGED = pa.schema([("digest", pa.string()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", _SPANS), ("kept", pa.large_string())])


def _kept_task(with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, counts_, words, bodies, told = batch.columns
            for row in range(batch.num_rows):
                counts = counts_[row].values.to_numpy().astype(np.int64)
                part = Slice(bodies[row], words[row].as_py())
                texts, total = np.asarray(part.dictionary.split(b" "), object), int(counts.sum())
                starts = np.concatenate([_unpacked(memoryview(x["starts"]), x["n"], np.uint32)[0] for x in told[row].as_py()]).astype(np.int64)
                ends = np.bincount(starts + WINDOW, minlength=total + 1)
                covered = np.cumsum(np.bincount(starts, minlength=total + 1) - ends)[:total] > 0
                last = np.cumsum(counts)
                gone = np.diff(np.concatenate([[0], np.cumsum(covered)])[np.concatenate([[0], last])])
                names, rows = digests[row].as_py(), []
                for d in np.flatnonzero(gone):
                    own = slice(int(last[d] - counts[d]), int(last[d]))
                    kept = b" ".join(texts[part.codes[own][~covered[own]]].tolist())
                    edges = np.flatnonzero(np.diff(covered[own].astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()
                    rows.append((names[d], int(gone[d]), hashlib.sha256(kept).hexdigest(), [{"begin": a, "end": b} for a, b in edges] if with_text else None, kept.decode() if with_text else None))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _CHANGED)], schema=_CHANGED)

    return run


def _per(total: int, each: int, least: int) -> int:
    return max(least, -(-total // each))


def _bucketed(slices: DataFrame, buckets: int) -> tuple[DataFrame, str]:
    """``slices`` as a table in the shared folder, bucketed so that joins by slice leave it where it is, and its name in the catalogue."""
    spark, path = slices.sparkSession, scratch_path(slices.sparkSession, "word-slices")
    name = f"word_slices_{path[-32:]}"
    with arrow_rows(spark, DOCUMENT_ROWS):
        slices.write.option("path", path).bucketBy(buckets, "slice").format("parquet").saveAsTable(name)
    return spark.table(name), name


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row; ``with_text`` adds ``spans`` (removed word ranges) and ``kept``, the words left (null where nothing was removed)."""
    spark = docs.sparkSession
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    narrow = docs.select(quoted(key).cast("long").alias("id"), quoted(text).alias("text"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices, name = _bucketed(narrow.mapInArrow(_slices_task, SLICES), least)
    total = slices.agg(F.sum("words")).first()[0] or 0

    each = slices.select("slice", F.posexplode(F.arrays_zip("ids", "digests", "counts")).alias("at", "d"))
    rows = materialize(each.select("slice", "at", F.col("d.ids").alias("id"), F.col("d.digests").alias("digest"), F.col("d.counts").cast("long").alias("n_words")), "word-counts")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "slice", "at")
    firsts = materialize(rows.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.first("n_words").alias("n_words")), "first-copies")
    own = firsts.where(F.col("n_words") >= WINDOW).groupBy(F.col("first.slice").alias("slice")).agg(F.sort_array(F.collect_list("first.at")).alias("own"))

    # At most 2/5 of a name for each word were counted on prose.
    partitions = _per(total * 2 // 5, NAMES, least)
    name_buckets = SPREAD * partitions
    named = slices.select("slice", "counts", "words", "body").where(F.col("words") >= WINDOW).mapInArrow(_names_task(name_buckets), NAMED)
    bits = named.repartition(partitions, "bucket").mapInArrow(_shared_task, "slice long, bucket long, shared binary")
    shared = bits.groupBy("slice").agg(F.collect_list(F.struct("bucket", "shared")).alias("shared"))
    marked = slices.join(own, "slice").join(shared, "slice")

    partitions = _per(total, ENTRIES * 4, least)
    blocks = marked.select("slice", "ids", "digests", "counts", "words", "body", "own", "shared").mapInArrow(_windows_task(name_buckets, SPREAD * partitions), BLOCK)
    told = blocks.repartition(partitions, "bucket").mapInArrow(_verify_task, "slice long, n int, starts binary")
    by_slice = told.groupBy("slice").agg(F.collect_list(F.struct("n", "starts")).alias("told"))
    kept = slices.join(by_slice, "slice").select("digests", "counts", "words", "body", "told").mapInArrow(_kept_task(with_text), CHANGED)
    with arrow_rows(spark, SLICE_ROWS):
        changed = materialize(kept, "kept-words")
    spark.sql(f"DROP TABLE {name}")

    found = rows.join(firsts.select("digest", "first"), "digest").join(changed, "digest", "left")
    copy = ~F.col("id").eqNullSafe(F.col("first.id")) & (F.col("n_words") >= WINDOW)
    out = [F.col("id").alias("doc_id"), "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed")]
    out.append(F.when(copy, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"))
    if with_text:
        whole = F.array(F.struct(F.lit(0).alias("begin"), F.col("n_words").cast("int").alias("end")))
        out += [F.when(copy, whole).otherwise(F.col("spans")).alias("spans"), F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept")]
    return found.select(*out)
