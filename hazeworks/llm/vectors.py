"""Vector codes: vectors cut into parts, each part coded by the nearest entry of its position's codebook, in whole numbers.

Components become ``floor(scale * x)``. Codebooks start as the parts of the vectors of smallest id and are refitted in rounds: parts go to
their nearest entry (squared distance, least index on ties), entries move to the floor of their parts' mean, unused ones stay.

Finding the nearest entry: one float32 matrix product gives ``|c|^2 - 2 x.c`` for all entries. With k roundings of relative size u = 2^-24
in each of its terms it is off by at most ``k u / (1 - k u) * (2 |x| |c| + |c|^2)``, in any order of summation. Entries whose
interval overlaps the best one's are computed again in int64, exactly, and the least index of the least distance wins. So the result is that of whole numbers.

A round is one pass over the vectors; tasks send sums and counts by (part, entry), at most ``parts * entries`` rows each, and the driver
gets the codebooks alone, whose size is a parameter.

Nulls: vectors that are null or hold null, NaN or infinite components are left out. A null id comes after all others when codebooks start;
null labels are one label. Rows of equal id are vectors of their own (ordered by components to start codebooks). With fewer vectors than
entries, codebooks have as many entries as vectors. An empty table, or one without a sound vector, gives an empty result. Vectors of different lengths, or of a length that the
parts do not divide, are refused with an error, as are components beyond 2^27 after scaling, whose distances a long might not hold. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeworks.llm.common import materialize

#: Largest magnitude of a component after scaling.
LARGEST = 1 << 27


def nearest(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """For each row of ``x`` the index of its nearest entry, the least on ties. Both hold whole numbers (int64)."""
    width = x.shape[1]
    squares = (entries * entries).sum(axis=1)
    left = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1).astype(np.float32)
    right = np.concatenate([-2 * entries, squares[:, None]], axis=1).astype(np.float32)
    scores = left @ right.T
    # Roundings of a term: both factors, the product, a sum for each other term; the rest is slack for this bound's own roundings.
    k = (width + 8) * 2.0**-24
    far = np.sqrt(float(squares.max()))
    off = k / (1 - k) * (1 + 2.0**-10) * (2 * np.sqrt((x * x).sum(axis=1).astype(np.float64)) * far + far * far)
    limit = np.nextafter((scores.min(axis=1) + 2 * off).astype(np.float32), np.float32(np.inf))
    near = scores <= limit[:, None]
    out = near.argmax(axis=1)
    several = np.flatnonzero(near.sum(axis=1) > 1)
    if len(several):
        row, entry = np.nonzero(near[several])
        apart = x[several[row]] - entries[entry]
        distance = (apart * apart).sum(axis=1)
        begins = np.flatnonzero(np.diff(row, prepend=-1))
        best = np.flatnonzero(distance == np.minimum.reduceat(distance, begins)[row])
        out[several] = entry[best[np.flatnonzero(np.diff(row[best], prepend=-1))]]
    return out


def whole(vectors: pa.ListArray, width: int, scale: int) -> np.ndarray:
    """Sound vectors as rows of whole numbers."""
    scaled = np.floor(np.asarray(vectors.flatten()).astype(np.float64) * scale)
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling by {scale}")
    return scaled.astype(np.int64).reshape(-1, width)


def _codes(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (vector, part) and, per vector, the squared distance to its entries."""
    parts, _, width = books.shape
    codes, error = np.empty((len(x), parts), np.int64), np.zeros(len(x), np.int64)
    for p in range(parts):
        own = x[:, p * width : (p + 1) * width]
        codes[:, p] = nearest(own, books[p])
        error += ((own - books[p][codes[:, p]]) ** 2).sum(axis=1)
    return codes, error


#: Vectors whose distances are held at once.
BLOCK = 4096


def _sums_task(books: np.ndarray, scale: int) -> Callable:
    parts, entries, width = books.shape
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = whole(batch.column(0)[at : at + BLOCK], parts * width, scale)
                codes, _ = _codes(x, books)
                for p in range(parts):
                    n[p] += np.bincount(codes[:, p], minlength=entries)
                    for d in range(width):  # a block's sums stay below 2^53
                        total[p, :, d] += np.bincount(codes[:, p], x[:, p * width + d], minlength=entries).astype(np.int64)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], schema=schema)

    return run


def _code_task(books: np.ndarray, scale: int) -> Callable:
    parts, _, width = books.shape
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                codes, error = _codes(whole(part.column(0), parts * width, scale), books)
                text = pa.array(["".join(row) for row in digits[codes].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), text, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def _refitted(books: np.ndarray, sound: DataFrame, scale: int) -> np.ndarray:
    """Entries moved to the floor of their parts' mean."""
    width = books.shape[2]
    each = sound.select("v").mapInArrow(_sums_task(books, scale), "part int, entry int, n long, total array<long>")
    exact = [F.sum(F.get("total", F.lit(d)).cast("decimal(20,0)")).alias(f"t{d}") for d in range(width)]
    out = books.copy()
    for r in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact).collect():  # parts * entries rows at most
        out[r.part, r.entry] = [int(r[f"t{d}"]) // r.n for d in range(width)]
    return out


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def quantize(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every sound vector, written to the shared folder, and the codebooks (part, entry, component).

    ``code`` has two hex digits a part, so ``entries`` may be 256 at most.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hex digits: 1 to 256 entries")
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    sound_part = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    named = vectors.select(quoted(vector).alias("v"), quoted(key).alias("vec_id"), quoted(label).alias("label"))
    sound = named.where(F.col("v").isNotNull() & F.forall("v", sound_part))
    lengths = sound.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    kinds = dict(sound.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    if lengths.low is None:
        return named.sparkSession.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    if lengths.low != lengths.high or lengths.low % parts or not lengths.low:
        raise ValueError(f"vectors have {lengths.low} to {lengths.high} components; all must have one length that {parts} parts divide")
    width = lengths.low // parts
    first = sound.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = whole(pa.array([list(r.v) for r in first], pa.list_(pa.float64())), parts * width, scale)
    books = np.ascontiguousarray(start.reshape(-1, parts, width).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _refitted(books, sound, scale)
    coded = sound.mapInArrow(_code_task(books, scale), schema)
    return materialize(coded, "vector-codes"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``, the error summed over equal labels, nulls together."""
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(20,0)")).cast("long").alias("label_error"))
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"])).drop("of")
