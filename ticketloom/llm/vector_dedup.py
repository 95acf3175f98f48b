"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Vectors are scaled to unit length, so cosine c is Euclidean distance sqrt(2 - 2 c). A hash is the
cell floor((a.x + b) / w) of a random Gaussian projection a; a table joins K of them, and L tables
are made. Rows that share a bucket in some table are compared by their cosine in double precision.
K grows with the logarithm of the number of distinct vectors, so that a bucket holds few unrelated
ones at any size, and L follows from K: a pair at the limit meets in some table with probability
`recall`, a closer pair with a higher one. No other pair is lost: buckets have no cap.

Equal vectors are one class with a count and are never compared with each other. Only members of
buckets with two classes or more carry their vector to a comparison; a bucket of more than `block`
members is cut into blocks, and each pair of blocks is a unit of work of its own. A comparison
returns one row for a member (how many vectors it links with, and the first member that its links
lead to), never pairs. A pair that meets in several tables counts in the first one only, which both
sides see from their own codes. A group of n near copies costs n^2 cosines, since every count of
links is exact, but no more than linear rows.

Cases: vectors that are null, empty, all zero or hold null or non-finite components link with nothing,
and so do rows without vec_id (component_id null, kept true); shorter vectors count as padded with
zeros; repeated rows are vectors of their own, linked with each other; a class is named by its smallest
vec_id, so the order of rows does not matter; other columns are ignored; empty input gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, store
from .components import components

MIN_COSINE = 0.95
#: Width of a cell, in units of the unit sphere's radius; near 2 the exponent of the table count is smallest.
CELL = 2.0
#: Probability that a pair at the limit is found.
RECALL = 0.95
#: Members of a bucket that one unit of work holds twice at most.
BLOCK = 2_048
#: Runs up to this size are compared pair by pair, many runs at once; longer ones as matrices.
SMALL = 16
SEED = 11


def same_cell(distance: float, cell: float = CELL) -> float:
    """Probability that one hash agrees for two points at a Euclidean distance."""
    r = cell / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_plan(n: int, min_cosine: float = MIN_COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(K, L): unrelated vectors (cosine 0) share a bucket with 0.1 others on average, linked ones meet with `recall`."""
    near = min(same_cell(math.sqrt(max(2 - 2 * min_cosine, 1e-12))), 1 - 1e-9)
    hashes = max(1, math.ceil(math.log(10 * max(n, 1)) / -math.log(same_cell(math.sqrt(2)))))
    return hashes, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**hashes)))


def unit_vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix): the rows that can link, scaled to length 1 and padded with zeros."""
    lists = column.cast(pa.list_(pa.float64()))
    offsets, values = np.asarray(lists.offsets).astype(np.int64), np.asarray(pc.fill_null(lists.values, float("nan")), dtype=float)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    some = np.concatenate([[0], np.cumsum(values != 0)])
    fit = np.asarray(lists.is_valid()) & (bad[offsets[1:]] == bad[offsets[:-1]]) & (some[offsets[1:]] > some[offsets[:-1]])
    places = np.flatnonzero(fit)
    mask = np.arange(width) < np.diff(offsets)[places][:, None]
    matrix = np.zeros((len(places), width))
    matrix[mask] = values[(offsets[:-1][places][:, None] + np.arange(width))[mask]]
    if len(places):
        matrix /= np.abs(matrix).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
        matrix /= np.sqrt((matrix**2).sum(axis=1, keepdims=True))
    return places, matrix


def _classes(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, matrix = unit_vectors(batch.column("embedding"), width)
            matrix += 0.0  # no negative zeros
            rows = [v.tobytes() for v in matrix]
            yield pa.record_batch([batch.column("vec_id").take(pa.array(places)), pa.array([xxhash.xxh3_128_digest(r) for r in rows], pa.binary()), pa.array(rows, pa.binary())],
                                  names=["vec_id", "class", "vector"])

    return run


def matrix_of(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width) if len(column) else np.zeros((0, width), dtype)


def bucket_codes(vectors: np.ndarray, hashes: int, tables: int, cell: float = CELL) -> np.ndarray:
    """(rows, tables): the hash of each row's cells in every table."""
    rng = np.random.default_rng(SEED)
    lines, shift = rng.standard_normal((vectors.shape[1], hashes * tables)), rng.uniform(0, cell, hashes * tables)
    cells = np.floor((vectors @ lines + shift) / cell).astype(np.int64).view(np.uint64).reshape(-1, tables, hashes)
    return np.stack([chain_rows(cells[:, t]) for t in range(tables)], axis=1).view(np.int64)


def chain_rows(cells: np.ndarray) -> np.ndarray:
    out = mix(cells[:, 0] + np.uint64(1))
    for k in range(1, cells.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + cells[:, k])
    return out


def _codes(width: int, hashes: int, tables: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2_048):
                part = batch.slice(start, 2_048)
                codes = bucket_codes(matrix_of(part.column("vector"), np.float64, width), hashes, tables)
                yield pa.record_batch([part.column("class"), part.column("size"), part.column("vector"), pa.array([c.tobytes() for c in codes], pa.binary())],
                                      names=["class", "size", "vector", "codes"])

    return run


def _buckets(tables: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = matrix_of(batch.column("codes"), np.int64, tables)
            for start in range(0, len(codes), 2_048):
                part = codes[start:start + 2_048]
                owner = pa.array(np.repeat(np.arange(start, start + len(part)), tables))
                yield pa.record_batch([batch.column("class").take(owner), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(part))), pa.array(part.ravel())],
                                      names=["class", "table", "code"])

    return run


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first place that links (a, b) lead to, for each of n places."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, label[a], low)
        np.minimum.at(fresh, label[b], low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


def _met_before(left: np.ndarray, right: np.ndarray, table: int) -> np.ndarray:
    """(left rows, right rows): whether two rows share a bucket of an earlier table."""
    met = np.zeros((len(left), len(right)), bool)
    for t in range(table):
        met |= left[:, t, None] == right[None, :, t]
    return met


def compare_block(x: np.ndarray, codes: np.ndarray, sizes: np.ndarray, table: int, side: np.ndarray | None, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of the members of one block of a bucket, or of two blocks, told apart by `side`.

    Members with the same codes in all earlier tables have met each other there, so whether pairs are
    new is decided once for each pair of distinct earlier codes; members without a new partner rest.
    """
    n, links, label = len(x), np.zeros(len(x), np.int64), np.arange(len(x))
    earlier, kind = np.unique(codes[:, :table], axis=0, return_inverse=True) if table else (np.zeros((1, 0), np.int64), np.zeros(n, np.int64))
    kind = kind.ravel()
    left = np.arange(n) if side is None else np.flatnonzero(~side)
    right = left if side is None else np.flatnonzero(side)
    right_kinds = np.unique(kind[right])
    for start in range(0, len(left), 512):
        rows = left[start:start + 512]
        row_kinds, row_kind = np.unique(kind[rows], return_inverse=True)
        new = ~_met_before(earlier[row_kinds], earlier[right_kinds], table) if table else np.ones((1, len(right_kinds)), bool)
        if not new.any():
            continue
        columns = right[new.any(axis=0)[np.searchsorted(right_kinds, kind[right])]]
        linked = (x[rows] @ x[columns].T >= limit) & new[row_kind][:, np.searchsorted(right_kinds, kind[columns])]
        linked &= rows[:, None] != columns[None, :]
        links[rows] += linked @ sizes[columns]
        if side is not None:
            links[columns] += sizes[rows] @ linked
        for r, found in zip(rows.tolist(), linked):
            if found.any():
                other = np.unique(label[columns[found]])
                low = min(label[r], other[0])
                if len(other) > 1 or other[0] != label[r]:
                    label[np.isin(label, np.append(other, label[r]))] = low
    return links, label


def _pairs_of_runs(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places in the same run, for short runs."""
    found = [np.empty((2, 0), np.int64)]
    for k in range(1, len(run)):
        a = np.flatnonzero(run[k:] == run[:-k])
        if not len(a):
            break
        found.append(np.stack([a, a + k]))
    return tuple(np.concatenate(found, axis=1))


_KEY = ["table", "code", "low", "high"]


def _compare(width: int, tables: int, limit: float):
    """Members of units of work, sorted by unit, become (class, links, root) rows."""

    def units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Batches cut where a unit ends; a unit is two blocks at most."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = [np.asarray(batch.column(c)) for c in _KEY]
            change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1
            if held and batch.num_rows and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in _KEY):
                yield pa.Table.from_batches(held)
                held = []
            if len(change):
                yield pa.Table.from_batches([*held, batch.slice(0, int(change[-1]))])
                held = []
                batch = batch.slice(int(change[-1]))
            held.append(batch)
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in units(batches):
            if not whole.num_rows:
                continue
            whole = whole.combine_chunks()
            column = {c: whole.column(c).combine_chunks() for c in whole.column_names}
            x, codes = matrix_of(column["vector"], np.float64, width), matrix_of(column["codes"], np.int64, tables)
            sizes, key = np.asarray(column["size"]), [np.asarray(column[c]) for c in _KEY]
            new = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in key])])
            run_of, begins = np.cumsum(new) - 1, np.append(np.flatnonzero(new), len(new))
            lengths = np.diff(begins)
            links, label = np.zeros(len(x), np.int64), np.arange(len(x))
            # short runs, all at once
            short = np.flatnonzero((lengths <= SMALL)[run_of] & (key[2] == key[3]))
            a, b = (short[p] for p in _pairs_of_runs(run_of[short]))
            if len(a):
                met = ((codes[a] == codes[b]) & (np.arange(tables) < key[0][a][:, None])).any(axis=1)
                close = np.einsum("ij,ij->i", x[a], x[b]) >= limit
                a, b = a[close & ~met], b[close & ~met]
                np.add.at(links, a, sizes[b])
                np.add.at(links, b, sizes[a])
                label = roots(len(x), a, b)
            for r in np.flatnonzero((lengths > SMALL) | (key[2] != key[3])[begins[:-1]]).tolist():
                at = slice(begins[r], begins[r + 1])
                low, high = int(key[2][begins[r]]), int(key[3][begins[r]])
                side = None if low == high else np.asarray(column["block"])[at] == high
                links[at], part = compare_block(x[at], codes[at], sizes[at], int(key[0][begins[r]]), side, limit)
                label[at] = part + begins[r]
            hit = np.flatnonzero(links)
            yield pa.record_batch([column["class"].take(pa.array(hit)), pa.array(links[hit]), column["class"].take(pa.array(label[hit]))], names=["class", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, min_cosine: float = MIN_COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `vectors` (vec_id, embedding)."""
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    known = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = known.mapInArrow(_classes(max(width, 1)), "vec_id bigint, class binary, vector binary")
    rows = store(rows, "vector-rows")
    classes = store(rows.groupBy("class").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("size"), F.min("vector").alias("vector")), "vector-classes")
    width, (hashes, tables) = max(width, 1), table_plan(classes.count(), min_cosine, recall)

    coded = store(classes.select("class", "size", "vector").mapInArrow(
        _codes(width, hashes, tables), "class binary, size bigint, vector binary, codes binary"), "vector-codes")
    members = coded.select("class", "codes").mapInArrow(_buckets(tables), "class binary, table int, code bigint")
    shared = members.groupBy("table", "code").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = members.join(shared, ["table", "code"]).withColumn("block", F.pmod(F.xxhash64("class"), blocks).cast("int"))
    units = placed.select("class", "table", "code", "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")).select(
        "class", "table", "code", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    work = units.join(coded, "class").select(*_KEY, "block", "class", "size", "codes", "vector")
    met = store(work.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(
        _compare(width, tables, min_cosine), "class binary, links bigint, root binary"), "vector-links")

    groups = components(met.select(F.col("class").alias("a"), F.col("root").alias("b")))
    named = classes.select("class", "first", "size").join(groups.withColumnRenamed("node", "class"), "class", "left").withColumn("group", F.coalesce("component", "class"))
    lowest = named.groupBy("group").agg(F.min("first").alias("component_id"))
    links = met.groupBy("class").agg(F.sum("links").alias("links"))
    answers = named.join(lowest, "group").join(links, "class", "left").select(
        "class", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).cast("bigint").alias("n_links"))
    linked = rows.select("vec_id", "class").join(answers, "class").select("vec_id", "n_links", "component_id")
    # rows that no class holds: the id is missing, or the vector cannot link
    able = F.aggregate("embedding", F.lit(0), lambda s, v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(2)).when(v != 0, F.greatest(s, F.lit(1))).otherwise(s)) == 1
    alone = vectors.where(F.col("vec_id").isNull() | F.col("embedding").isNull() | ~able)
    whole = linked.unionByName(alone.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    return whole.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
