"""Byte-level BPE over a monoid tree.

A text is cut at its middle until parts are small; each part is split by the tokenizer's pattern and merged by rank, and
neighbours are joined bottom-up. An encoded part is the list of its pieces; ``join`` is associative:

* left part: a piece that ends before the part's end, and begins LOOK_AHEAD characters before it or earlier, was decided by
  characters inside the part (the pattern never looks behind), so it is final whatever follows; the rest is the tail;
* right part: scanning restarts at the left part's tail, over a window that grows into the right part. Once a
  piece ends where a piece of the right part ends, both scans are at the same place with the same text ahead, so every later
  piece of the right part is final. Pieces near the window's end are not used as long as the window can grow.

Merging works on one piece at a time, so ids outside the window are final as well. Decoding concatenates the tokens' bytes.

Nulls: a null text counts as empty: no ids, and the digests of the empty string. Very long texts are encoded in parts; memory
is a few times the text. Repeated rows get equal results; an empty table gives an empty one; only key and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeworks.llm.common import slices

#: Characters of a leaf of the tree, and of the right part's first window at a join.
LEAF_CHARS, WINDOW_CHARS = 2048, 32
#: A piece that doesn't reach the end of the text is decided by so many characters from its start, or by its own and the next.
LOOK_AHEAD = 3
#: Entries of a generation of a task's cache from piece to ids, and the longest piece it keeps; pieces are mostly words.
CACHE_ENTRIES, CACHE_CHARS = 500_000, 64
#: Pieces of more bytes are merged with a heap.
LONG_PIECE, NO_RANK = 128, 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the neighbours whose union has the least rank are joined, the left-most on ties, while there are any."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n > LONG_PIECE:
        return _merged_long(piece, ranks)
    get, cuts = ranks.get, list(range(n + 1))
    ids = [ranks[piece[i : i + 1]] for i in range(n)]
    pairs = [get(piece[i : i + 2], NO_RANK) for i in range(n - 1)]
    while pairs:
        least = min(pairs)
        if least == NO_RANK:
            break
        i = pairs.index(least)
        ids[i] = least
        del cuts[i + 1], pairs[i], ids[i + 1]
        if i:
            pairs[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], NO_RANK)
        if i < len(pairs):
            pairs[i] = get(piece[cuts[i] : cuts[i + 2]], NO_RANK)
    return ids


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs and a list of neighbours, n log n: (rank, begin, end) is dropped when its ends have moved."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)

    def push(i: int) -> None:
        if i >= 0 and end[i] < n:
            j = end[end[i]]
            r = ranks.get(piece[i:j])
            if r is not None:
                heapq.heappush(heap, (r, i, j))

    while heap:
        _, i, j = heapq.heappop(heap)
        middle = end[i]
        if middle == 0 or middle >= n or end[middle] != j:
            continue
        end[i], end[middle] = j, 0
        if j < n:
            before[j] = i
        push(before[i])
        push(i)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Recent(dict):
    """Values of a function by argument. A full generation becomes the older one, whose entries come back as they are asked for."""

    def __init__(self, of: Callable[[str], tuple[int, ...]], entries: int = CACHE_ENTRIES):
        super().__init__()
        self.of, self.entries, self.older = of, entries, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.older.get(piece)
        if found is None:
            found = self.of(piece)
            if len(piece) > CACHE_CHARS:
                return found
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found


class TreeCodec:
    """Encodes by tree reduction; ``pieces`` of a text are its pattern matches in order, covering it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS):
        self.split = regex.compile(pattern).findall
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.decimals = {rank: str(rank) for rank in ranks.values()}
        self.leaf, self.window = leaf, window
        self.cache = Recent(lambda piece: tuple(self.ids(piece)))

    def pieces(self, text: str) -> list[str]:
        if len(text) <= self.leaf:
            return self.split(text)
        middle = len(text) // 2
        return self.join(self.pieces(text[:middle]), self.pieces(text[middle:]))

    def join(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left or right
        tail = left.pop()
        while left and len(tail) + len(left[-1]) < LOOK_AHEAD:
            tail = left.pop() + tail
        taken, size, want = 0, len(tail), len(tail) + self.window
        while True:
            while taken < len(right) and size < want:
                size += len(right[taken])
                taken += 1
            whole = taken == len(right)
            window = self.split(tail + "".join(right[:taken]))
            ends = dict(zip(accumulate(map(len, right[:taken]), initial=len(tail)), range(taken + 1)))
            start = 0
            for k, piece in enumerate(window):
                end = start + len(piece)
                if not whole and (end == size or start + LOOK_AHEAD > size):
                    break  # what follows the window may still change this piece
                if end in ends:
                    left += window[: k + 1]
                    left += right[ends[end] :]
                    return left
                start = end
            want = 2 * size

    def ids(self, piece: str) -> list[int]:
        return merged(piece.encode("utf-8"), self.ranks)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.cache.__getitem__, self.pieces(text))))

    def decode(self, ids: list[int]) -> bytes:
        """Concatenation up a tree: halves of the ids, leaves by table."""
        if len(ids) <= self.leaf:
            return b"".join(map(self.tokens.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def _codec_task(ranks, pattern: str, key: str, text: str, out: pa.Schema, row: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TreeCodec(ranks.value, pattern)
        for part in slices(batches, text, 4 << 20):
            rows = [row(codec, k, t or "") for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    return run


def _digest_row(codec: TreeCodec, key, text: str) -> dict:
    ids = codec.encode(text)
    line = " ".join(map(codec.decimals.__getitem__, ids))
    return {"doc_id": key, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(line.encode()).hexdigest(), "decoded_sha256": hashlib.sha256(codec.decode(ids)).hexdigest()}


def _ids_row(codec: TreeCodec, key, text: str) -> dict:
    return {"doc_id": key, "ids": codec.encode(text)}


def _run(docs: DataFrame, path: str, pattern: str, key: str, text: str, fields: list[tuple[str, pa.DataType]], ddl: str, row: Callable) -> DataFrame:
    # The vocabulary is a file of fixed size (about 1 MB), whatever the input.
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    key_type = pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string()
    schema = pa.schema([("doc_id", key_type), *fields])
    return narrow.mapInArrow(_codec_task(ranks, pattern, key, "text", schema, row), f"doc_id {id_type}, {ddl}")


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every text."""
    return _run(docs, path, pattern, key, text, [("ids", pa.list_(pa.int32()))], "ids array<int>", _ids_row)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token count and digests of ids and of the decoded bytes."""
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return _run(docs, path, pattern, key, text, fields, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digest_row)
