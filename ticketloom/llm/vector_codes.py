"""Vector code compression: a codebook for each part of the vectors, searched by Orchard's method.

Components become integers, floor(scale * x). Vectors are cut into equal consecutive parts; each part
position has a codebook that starts with the parts of the vectors with the smallest ids and is refined
in rounds: every part goes to its nearest entry (squared Euclidean distance, ties to the lower index),
and an entry becomes the componentwise floor of its parts' mean; unused entries stay.

The nearest entry is found on neighbour lists. Every entry keeps the other entries sorted by their
distance from it. A search walks the list of its best entry so far, computes and marks entries not
visited yet, jumps to the list of a better one, and stops where the list's next entry lies beyond twice
the current distance: by the triangle inequality nothing after it can be nearer, or tie. All searches of
a batch advance together, each at its own place in its own list. Distances are squared integers, so
"beyond twice" is "above four times", without rounding.

Integer vectors are stored once. A round is one pass over them that returns per-task sums of at most
(parts x entries) rows; the driver holds the codebooks, whose size is fixed by parameters.

Cases: vectors that are null or hold null or non-finite components are dropped; the number of
components is the longest vector's, rounded up to whole parts, and shorter vectors count as padded
with zeros; equal vec_ids are ordered by their vectors, and null vec_ids come last; with fewer
vectors than entries a codebook has as many entries as there are vectors; components beyond 2^62 after
scaling are held at that limit, and an error that a long cannot hold at its largest value; other
columns are ignored; empty input gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

# Fixed values of the production codes.
SCALE = 4096.0
PARTS = 8
ENTRIES = 16
ROUNDS = 6

LIMIT = 1 << 62
LONG = (1 << 63) - 1
#: Rows that are searched together.
TOGETHER = 8_192


def integer_rows(column: pa.Array, width: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix): rows whose components are all finite, scaled, floored and padded with zeros."""
    lists = column.cast(pa.list_(pa.float64()))
    offsets, values = np.asarray(lists.offsets).astype(np.int64), np.asarray(pc.fill_null(lists.values, float("nan")), dtype=float)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    places = np.flatnonzero(np.asarray(lists.is_valid()) & (bad[offsets[1:]] == bad[offsets[:-1]]))
    mask = np.arange(width) < np.diff(offsets)[places][:, None]
    matrix = np.zeros((len(places), width), np.int64)
    with np.errstate(over="ignore"):
        scaled = np.floor(values[(offsets[:-1][places][:, None] + np.arange(width))[mask]] * scale)
    matrix[mask] = np.clip(scaled, -LIMIT, LIMIT).astype(np.int64)
    return places, matrix


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


class Codebook:
    """The entries of one part position with their neighbour lists."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.apart = _squares(entries[:, None, :], entries[None, :, :])
        n = len(entries)
        # each entry's list: the others by distance, ties by index
        self.lists = np.array([sorted((e for e in range(n) if e != c), key=lambda e, c=c: (self.apart[c, e], e)) for c in range(n)], np.int64).reshape(n, max(0, n - 1))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of every row."""
        rows, n = np.arange(len(x)), len(self.entries)
        best = np.zeros(len(x), np.int64)
        least = _squares(x, self.entries[0][None, :])
        at = np.zeros(len(x), np.int64)
        visited = np.zeros((len(x), n), bool)
        visited[:, 0] = True
        while len(rows := rows[at[rows] < n - 1]):
            entry = self.lists[best[rows], at[rows]]
            within = self.apart[best[rows], entry] <= 4 * least[rows]
            rows, entry = rows[within], entry[within]
            at[rows] += 1
            fresh = ~visited[rows, entry]
            tried, entry = rows[fresh], entry[fresh]
            visited[tried, entry] = True
            distance = _squares(x[tried], self.entries[entry])
            better = (distance < least[tried]) | ((distance == least[tried]) & (entry < best[tried]))
            moved = tried[better]
            best[moved], least[moved], at[moved] = entry[better], distance[better], 0
        return best, least


def _exact(matrix: np.ndarray, codebooks: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows and entries as 64-bit integers where four times a distance, and sums of rows, fit those; else as Python integers."""
    largest = max(int(np.abs(matrix).max(initial=0)), max((abs(v) for book in codebooks for e in book for v in e), default=0))
    kind = np.int64 if 16 * largest * largest * matrix.shape[1] < LIMIT and largest * TOGETHER < LIMIT else object
    return matrix.astype(kind), [np.array(book, dtype=kind) for book in codebooks]


def _split(matrix: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(matrix, parts, axis=1)


def search(matrix: np.ndarray, codebooks: list) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances) of every row and part."""
    matrix, books = _exact(matrix, codebooks)
    found = [Codebook(book).nearest(x) for book, x in zip(books, _split(matrix, len(books)))]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _rows_of(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), width)


def _integers(width: int, scale: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, matrix = integer_rows(batch.column("embedding"), width, scale)
            take = pa.array(places)
            yield pa.record_batch([batch.column("vec_id").take(take), batch.column("label").take(take), pa.array([r.tobytes() for r in matrix], pa.binary())], names=["vec_id", "label", "vector"])

    return run


def _sums(codebooks: list, width: int):
    """Per task and entry: how many parts it is nearest to, and their sums."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = len(codebooks), width // len(codebooks)
        total, count = np.zeros((parts, len(codebooks[0]), size), object), np.zeros((parts, len(codebooks[0])), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                matrix = _rows_of(batch.column("vector").slice(start, TOGETHER), width)
                codes, _ = search(matrix, codebooks)
                for p, x in enumerate(_split(_exact(matrix, codebooks)[0], parts)):
                    for e in np.unique(codes[:, p]).tolist():
                        mine = codes[:, p] == e
                        count[p, e] += int(mine.sum())
                        total[p, e] += x[mine].sum(axis=0)
        part, entry = np.nonzero(count)
        yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]),
                               pa.array([[Decimal(int(v)) for v in total[p, e]] for p, e in zip(part, entry)], pa.list_(pa.decimal128(38, 0)))], names=["part", "entry", "n", "total"])

    return run


def _coded(codebooks: list, width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                codes, distances = search(_rows_of(part.column("vector"), width), codebooks)
                error = [min(int(e), LONG) for e in distances.sum(axis=1).tolist()]
                yield pa.record_batch([part.column("vec_id"), part.column("label"), pa.array([bytes(c).hex() for c in codes.astype(np.uint8)], pa.string()), pa.array(error, pa.int64())],
                                      names=["vec_id", "label", "code", "error"])

    return run


def refine(vectors: DataFrame, codebooks: list, width: int) -> list:
    """One round: the codebooks after every entry became the floor of its parts' mean."""
    size = width // len(codebooks)
    sums = vectors.select("vector").mapInArrow(_sums(codebooks, width), "part int, entry int, n bigint, total array<decimal(38,0)>")
    means = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(size)])
    codebooks = [list(map(tuple, book)) for book in codebooks]
    for row in means.collect():
        codebooks[row["part"]][row["entry"]] = tuple(int(row[f"t{i}"]) // row["n"] for i in range(size))
    return codebooks


def train(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list:
    """Codebooks by part: lists of entries, each a tuple of integers."""
    # ids first; the vector's own order only settles equal ids
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not first:
        return []
    start = np.stack([np.frombuffer(r["vector"], np.int64) for r in first])
    codebooks = [[tuple(int(v) for v in e) for e in part] for part in np.split(start, parts, axis=1)]
    for _ in range(rounds):
        codebooks = refine(vectors, codebooks, width)
    return codebooks


def book_digest(codebooks: list) -> str:
    return hashlib.sha256(",".join(str(v) for book in codebooks for e in book for v in e).encode()).hexdigest()


def compress(vectors: DataFrame, scale: float = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of the vectors of (vec_id, embedding, label)."""
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.col("label").cast("bigint").alias("label"))
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    whole = store(vectors.mapInArrow(_integers(width, scale), "vec_id bigint, label bigint, vector binary"), "code-vectors")
    codebooks = train(whole, width, parts, entries, rounds)
    if not codebooks:
        return whole.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = store(whole.mapInArrow(_coded(codebooks, width), "vec_id bigint, label bigint, code string, error bigint"), "code-rows")
    per_label = coded.groupBy(F.col("label").alias("of")).agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    return coded.join(per_label, coded["label"].eqNullSafe(per_label["of"])).select(
        "vec_id", "label", "code", "error", "label_error", F.lit(book_digest(codebooks)).alias("codebooks_sha256"))
