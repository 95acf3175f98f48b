"""Exact top-k search by inner product, with a pivot table.

Vectors become integers, floor(scale * x). Every vector carries its distances to a fixed set of
pivots. For a query q and a candidate x, |d(q, p) - d(x, p)| is a lower bound of d(q, x) for each
pivot p, and the largest of them bounds the inner product from above, since
q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2. Candidates are evaluated in the order of their bounds, and a
query stops when its k-th best score is above every bound that is left, so results are exact: the
best bounded candidates go first, and what their k-th score does not eliminate follows.

Vectors are cut into blocks of a fixed size; each block of queries meets each block of candidates
once, and blocks are merged by keeping the k best rows of a query. Nothing is broadcast but the
pivots, whose number is a parameter.

Cases: vectors that are null or hold null or non-finite components, and rows without vec_id, take no
part; shorter vectors count as padded with zeros; every row that shares the query's vec_id is the
query's own; repeated candidate rows are ranked row by row, equal scores by smaller vec_id; repeated
query rows answer each for itself; components beyond 2^31 after scaling are an error; empty input or
fewer candidates than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import store

PIVOTS = 32
CANDIDATE_BLOCK = 16_384
QUERY_BLOCK = 2_048
#: Queries that are bounded together, and candidates with the best bounds that are evaluated first.
GROUP = 16
FIRST = 512


def integer_vectors(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix): rows whose vectors take part, as integers padded with zeros."""
    lists = column.cast(pa.list_(pa.float64()))
    offsets, values = np.asarray(lists.offsets), lists.values
    finite = np.isfinite(np.asarray(pc.fill_null(values, float("nan")), dtype=float))
    bad = np.concatenate([[0], np.cumsum(~finite)])
    present = np.asarray(lists.is_valid()) & (bad[offsets[1:]] == bad[offsets[:-1]])
    places = np.flatnonzero(present)
    sizes = np.diff(offsets)[places]
    matrix = np.zeros((len(places), int(sizes.max()) if len(places) else 0))
    if len(places):
        mask = np.arange(matrix.shape[1]) < sizes[:, None]
        at = (offsets[:-1][places][:, None] + np.arange(matrix.shape[1]))[mask]
        matrix[mask] = np.floor(np.asarray(pc.fill_null(values, 0.0), dtype=float)[at] * scale)
        if np.abs(matrix).max(initial=0) > 2**31:
            raise ValueError("a component is too large for exact scores")
    return places, matrix


def _integers(scale: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, matrix = integer_vectors(batch.column("embedding"), scale)
            width = matrix.shape[1]
            values = pa.ListArray.from_arrays(pa.array((np.arange(len(places) + 1) * width).astype(np.int32)), pa.array(matrix.astype(np.int64).ravel()))
            yield pa.record_batch([batch.column("vec_id").take(pa.array(places)), values], names=["vec_id", "vector"])

    return run


def _padded(lists: list, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for i, v in enumerate(lists):
        out[i, :len(v)] = v
    return out


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return _padded(column.tolist(), width)


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (vectors**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point while they stay below 2^53, else in integers."""
    if np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(1, left.shape[1]) < 2**53:
        return (left @ right.T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T


def _upper_bounds(q_pivot: np.ndarray, x_pivot: np.ndarray, q_square: np.ndarray, x_square: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of some queries with all candidates, from their pivot distances."""
    lower, gap = np.zeros((len(q_pivot), len(x_pivot)), np.float32), np.empty((len(q_pivot), len(x_pivot)), np.float32)
    for p in range(q_pivot.shape[1]):
        np.subtract(q_pivot[:, p, None], x_pivot[None, :, p], out=gap)
        np.abs(gap, out=gap)
        np.maximum(lower, gap, out=lower)
    # single precision: give way by more than its rounding
    slack = 1e-5 * (1 + max(np.abs(q_pivot).max(initial=0), np.abs(x_pivot).max(initial=0)))
    lower = np.maximum(lower.astype(float) - slack, 0)
    return np.floor((q_square[:, None] + x_square[None, :] - lower**2) / 2 + 1e-6)


def block_search(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query place, candidate place, score) of every query within one block of candidates."""
    q_pivot, x_pivot = (np.asfortranarray(_distances(v, pivots).astype(np.float32)) for v in (q, x))
    q_square, x_square = (q**2).sum(axis=1), (x**2).sum(axis=1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for rows in np.array_split(np.arange(len(q)), max(1, -(-len(q) // GROUP))):
        upper = _upper_bounds(q_pivot[rows], x_pivot, q_square[rows], x_square)
        upper[q_ids[rows][:, None] == x_ids[None, :]] = -np.inf
        # the best bounds first: their k-th score stops every candidate bounded below it
        head = min(FIRST, len(x))
        tops = np.argpartition(-upper, head - 1, axis=1)[:, :head]
        stop = np.full(len(rows), -np.inf)
        for r, top in enumerate(tops):
            first = _scores(q[rows[r:r + 1]], x[top])[0][np.isfinite(upper[r, top])]
            if len(first) >= k:
                stop[r] = np.partition(first, len(first) - k)[len(first) - k]
        open_ = (upper >= stop[:, None]) & np.isfinite(upper)
        some = np.flatnonzero(open_.any(axis=0))
        scores = _scores(q[rows], x[some])
        for r, row in enumerate(rows.tolist()):
            mine = np.flatnonzero(open_[r, some])
            score = scores[r, mine]
            if len(mine) > k:
                best = score >= np.partition(score, len(score) - k)[len(score) - k]
                mine, score = mine[best], score[best]
            keep = np.lexsort((x_ids[some[mine]], -score))[:k]
            found.append((np.full(len(keep), row), some[mine[keep]], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 3


def _search(pivots: list[list[int]], k: int):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_row", "query_id", "vec_id", "score"]
        if not len(queries) or not len(candidates):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
        width = max(max(map(len, pivots), default=0), queries["vector"].map(len).max(), candidates["vector"].map(len).max())
        q, x = _matrix(queries["vector"], width), _matrix(candidates["vector"], width)
        q_ids, x_ids = queries["vec_id"].to_numpy(np.int64), candidates["vec_id"].to_numpy(np.int64)
        row, col, score = block_search(q_ids, q, x_ids, x, _padded(pivots, width), k)
        return pd.DataFrame({"query_row": queries["row"].to_numpy(np.int64)[row], "query_id": q_ids[row], "vec_id": x_ids[col], "score": score})

    return run


def top_k(vectors: DataFrame, is_query, k: int, scale: float = 64.0, pivots: int = PIVOTS,
          candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of `vectors` (vec_id, embedding) that meet `is_query`."""
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    whole = store(usable.mapInArrow(_integers(scale), "vec_id bigint, vector array<bigint>").withColumn("row", F.monotonically_increasing_id()), "vectors")
    counts = whole.agg(F.count(F.lit(1)).alias("x"), F.count(F.when(is_query, 1)).alias("q")).first()
    x_blocks, q_blocks = max(1, -(-counts["x"] // candidate_block)), max(1, -(-counts["q"] // query_block))
    first = whole.orderBy(F.xxhash64(F.lit("pivot"), "row"), "row").limit(pivots).select("vector").collect()
    spread = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    candidates = whole.select("vec_id", "vector", spread(x_blocks).alias("xb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
    queries = whole.where(is_query).select("row", "vec_id", "vector", spread(q_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(x_blocks - 1))).alias("xb"))
    near = queries.groupBy("qb", "xb").cogroup(candidates.groupBy("qb", "xb")).applyInPandas(
        _search([list(r["vector"]) for r in first], k), "query_row bigint, query_id bigint, vec_id bigint, score bigint")
    order = W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return (near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
