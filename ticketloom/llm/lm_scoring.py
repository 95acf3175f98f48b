"""Language-model scoring with stupid backoff, as a join of count tables and exploded n-grams.

S(w | context) is count(context w) / count(context) for the longest context (up to order - 1 words)
whose n-gram occurs, times `alpha` for every word the context was shortened by; single words are
divided by the number of words, and a word that occurs nowhere counts as one. Counts cover the
whole corpus; a document's own n-grams are taken off, so it is scored by what all others say.

The relations are packed. Documents are hash-partitioned into blocks of some megabytes; a block's
n-grams are exploded, counted and sorted by a 64-bit hash, and cut into shards, ranges of the hash.
The count tables are these shards: each sums the counts of all blocks and sends every block the
totals of its n-grams, in the block's order, so no keys travel back. Blocks then look their n-grams
up and sum per document. A frequent n-gram is one entry per block, and shards are equally large, so
no key is hot; their numbers follow the size of the input.

Cases: null and blank texts have no words and score null; rows are scored one by one, so repeated
rows and equal ids need no rule (each copy counts as another document); rows without doc_id are
counted and scored; the input's other columns are not returned; empty input gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chain, mix, same_text, texts_of

ORDER = 2
ALPHA = 0.4
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 8 << 20


class Ngrams:
    """N-grams of all orders of a block of texts: per order the places where one starts, and its hash."""

    def __init__(self, texts: pa.Array, order: int):
        words = Words(texts)
        self.owner, self.per_text = words.owner, words.per_text
        base = mix(words.hashes())
        self.places, self.hashes = [], []
        for n in range(1, order + 1):
            inside = np.flatnonzero(same_text(self.owner, n))
            self.places.append(inside)
            self.hashes.append(mix(chain(base, n)[inside] + np.uint64(n)))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate(self.hashes), return_counts=True)


def _limits(shards: int) -> np.ndarray:
    """First hash of each shard but the first."""
    return np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)


def _pack(hashes: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted hashes as compressed high parts and raw low parts (six bytes), and counts."""
    z = zstandard.ZstdCompressor(level=1)
    low = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return z.compress((hashes >> np.uint64(48)).astype("<u2").tobytes()), low.tobytes(), z.compress(counts.astype("<u4").tobytes())


def _unpack(high: bytes, low: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    d = zstandard.ZstdDecompressor()
    top = np.frombuffer(d.decompress(high), "<u2").astype(np.uint64)
    raw = np.zeros((len(top), 8), np.uint8)
    raw[:, :6] = np.frombuffer(low, np.uint8).reshape(-1, 6)
    return (top << np.uint64(48)) | raw.view("<u8").ravel(), np.frombuffer(d.decompress(counts), "<u4").astype(np.int64)


def _explode(order: int, shards: int):
    limits = _limits(shards)

    def run(block: pa.Table) -> pa.Table:
        ngrams = Ngrams(texts_of(block.select(["text"]).combine_chunks().to_batches()[0]), order)
        hashes, counts = ngrams.distinct()
        ends = np.concatenate([[0], np.searchsorted(hashes, limits), [len(hashes)]])
        rows = [(i, *_pack(hashes[a:b], counts[a:b])) for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if b > a]
        number = block.column("block")[0].as_py()
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([number] * len(rows), pa.int32()),
                         **{n: pa.array([r[i + 1] for r in rows], pa.binary()) for i, n in enumerate(("high", "low", "counts"))}})

    return run


def _total(pieces: pa.Table) -> pa.Table:
    """Sums a shard and answers every block with the totals of its n-grams in their order."""
    parts = [_unpack(*(pieces.column(n)[i].as_py() for n in ("high", "low", "counts"))) for i in range(pieces.num_rows)]
    keys = np.unique(np.concatenate([h for h, _ in parts]))
    totals = np.zeros(len(keys), np.int64)
    at = [np.searchsorted(keys, h) for h, _ in parts]
    for where, (_, counts) in zip(at, parts):
        totals[where] += counts  # hashes are distinct within a block
    z = zstandard.ZstdCompressor(level=1)
    return pa.table({"block": pieces.column("block"), "shard": pieces.column("shard"),
                     "totals": pa.array([z.compress(totals[where].astype("<u8").tobytes()) for where in at], pa.binary())})


def _score(order: int, alpha: float, words: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        batch = docs.combine_chunks().to_batches()
        if not batch:
            return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64()), "mean_log_score": pa.array([], pa.float64())})
        ngrams = Ngrams(texts_of(batch[0]), order)
        hashes, _ = ngrams.distinct()
        d = zstandard.ZstdDecompressor()
        order_of = np.argsort(np.asarray(answers.column("shard").combine_chunks())) if answers.num_rows else []
        totals = np.concatenate([np.frombuffer(d.decompress(answers.column("totals")[int(i)].as_py()), "<u8").astype(np.int64) for i in order_of]) if len(order_of) else np.empty(0, np.int64)
        per_text = ngrams.per_text
        # count of the n-gram of length n that starts at each place, without the text's own
        counts = []
        for places, grams in zip(ngrams.places, ngrams.hashes):
            own_key = mix(grams + mix(ngrams.owner[places].astype(np.uint64) + np.uint64(1)))
            _, code, own = np.unique(own_key, return_inverse=True, return_counts=True)
            full = np.zeros(len(ngrams.owner), np.int64)
            full[places] = totals[np.searchsorted(hashes, grams)] - own[code]
            counts.append(full)
        rest = np.maximum(words - per_text[ngrams.owner], 1)
        score = np.log(np.maximum(counts[0], 1) / rest) + (order - 1) * np.log(alpha)
        for n in range(2, order + 1):
            starts = ngrams.places[n - 1]
            starts = starts[counts[n - 1][starts] > 0]
            score[starts + n - 1] = np.log(counts[n - 1][starts] / counts[n - 2][starts]) + (order - n) * np.log(alpha)
        total = np.bincount(ngrams.owner, weights=score, minlength=len(per_text))
        empty = per_text == 0
        return pa.table({"doc_id": batch[0].column("doc_id"), "n_words": pa.array(per_text.astype(np.int64)),
                         "log_score": pa.array(total, mask=empty), "mean_log_score": pa.array(total / np.maximum(per_text, 1), mask=empty)})

    return run


def score_documents(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of every row: sum and mean of log S over its words."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(_word_count("text")).alias("words")).first()
    total = size["bytes"] or 0
    blocks, shards = max(1, -(-total // block_bytes)), max(1, -(-total * order // shard_bytes))
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))
    pieces = cut.groupBy("block").applyInArrow(_explode(order, shards), "shard int, block int, high binary, low binary, counts binary")
    answers = pieces.groupBy("shard").applyInArrow(_total, "block int, shard int, totals binary")
    return cut.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(order, alpha, size["words"] or 0), f"doc_id {kind}, n_words bigint, log_score double, mean_log_score double")


def _word_count(column: str):
    """Words between the six ASCII white-space characters, counted where a word starts."""
    return F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+"))
