"""Line deduplication over levelled sorted runs of line hashes.

Documents are taken in batches of falling doc_id (rising, if the smallest one keeps a line). A run is a sorted table (hash, number of
documents, largest doc_id). A new batch is anti-joined with what the runs have settled already (a
line found in enough documents needs no further counting, and its keeper has been seen, because ids
fall), and what is left becomes a run of level 0. When a level holds `fanout` runs they are merged
into one run of the next level. Every table is written to the shared folder.

Cases: a null text has one empty line and stays null; rows without doc_id are not counted and stay
as they are; repeated rows with one doc_id are one document; ties cannot occur, since lines are
decided by (line, doc_id) alone; other columns pass through, and columns named like an output are
replaced; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, store, strings, texts_of

# What is stripped from both ends of a line, and what shorter keys are exempt from.
STRIP = " \t\n\v\f\r"
MIN_POINTS = 40
MIN_DOCUMENTS = 5

OUTPUTS = ("n_lines", "n_dropped", "kept_text")
_DROP = "__dropped_lines"


def _line_digests(texts: pa.Array, min_points: int) -> tuple[np.ndarray, pa.Array, np.ndarray, list[bytes]]:
    """Owner and text of every line, the places of lines long enough, and the 16-byte digests of those."""
    split = pc.split_pattern(texts, "\n")
    lines = split.flatten()
    owner = np.repeat(np.arange(len(texts)), np.diff(np.asarray(split.offsets)))
    keys = pc.ascii_trim(pc.ascii_lower(lines), characters=STRIP)
    places = np.flatnonzero(np.asarray(pc.utf8_length(keys)) >= min_points)
    return owner, lines, places, [xxhash.xxh3_128_digest(k) for k in strings(keys.take(pa.array(places)))]


def _emit(min_points: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owner, _, places, digests = _line_digests(texts_of(batch), min_points)
            rows = pa.table({"doc_id": batch.column("doc_id").take(pa.array(owner[places])), "line": pa.array(digests, pa.binary())})
            yield from rows.group_by(["doc_id", "line"]).aggregate([]).combine_chunks().to_batches()

    return run


def line_keys(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(doc_id, line): the digests of the long enough lines of every document, once per document."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return known.mapInArrow(_emit(min_points), "doc_id bigint, line binary")


class LineRuns:
    """The levelled runs. Each is a table (line, n_docs, keeper) sorted by hash."""

    def __init__(self, min_documents: int, fanout: int):
        self.min_documents, self.fanout = min_documents, fanout
        self.levels: list[list[DataFrame]] = []

    def all_runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        both = runs[0]
        for run in runs[1:]:
            both = both.unionByName(run)
        return both.groupBy("line").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(store(run.sortWithinPartitions("line"), f"line-run-{level}"))
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(self._merged(full), level + 1)

    def add(self, batch: DataFrame) -> None:
        """Anti-joins a batch (doc_id, line) with the settled lines of the runs and adds the rest."""
        fresh = batch
        for run in self.all_runs():
            fresh = fresh.join(run.where(F.col("n_docs") >= self.min_documents).select("line"), "line", "left_anti")
        per_document = fresh.groupBy("line", "doc_id").agg(F.lit(1).alias("one"))
        self._put(per_document.groupBy("line").agg(F.count("one").alias("n_docs"), F.max("doc_id").alias("keeper")), 0)

    def repeated(self) -> DataFrame:
        """Lines found in at least `min_documents` documents, with the document that keeps them."""
        return self._merged(self.all_runs()).where(F.col("n_docs") >= self.min_documents)


def _batches(keys: DataFrame, n: int) -> list:
    """Limits of doc_id that cut the key rows into about n equal parts, largest ids first."""
    cuts = keys.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 1000).alias("cuts")).first()["cuts"] if n > 1 else None
    limits = [None, *sorted(set(cuts or []), reverse=True), None]
    return list(zip(limits[:-1], limits[1:]))


def repeated_lines(keys: DataFrame, min_documents: int = MIN_DOCUMENTS, batches: int = 4, fanout: int = 2) -> DataFrame:
    runs = LineRuns(min_documents, fanout)
    for upper, lower in _batches(keys, batches):
        part = keys
        if upper is not None:
            part = part.where(F.col("doc_id") <= upper)
        if lower is not None:
            part = part.where(F.col("doc_id") > lower)
        runs.add(part)
    return runs.repeated()


def _rewrite(names: list[str], min_points: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch)
            owner, lines, places, digests = _line_digests(texts, min_points)
            drops = [set(d or ()) for d in batch.column(_DROP).to_pylist()]
            keep = np.ones(len(lines), bool)
            keep[[place for place, doc, digest in zip(places.tolist(), owner[places].tolist(), digests) if digest in drops[doc]]] = False
            total = np.bincount(owner, minlength=len(texts))
            kept = np.bincount(owner[keep], minlength=len(texts))
            offsets = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), lines.filter(pa.array(keep))), "\n")
            made = {"n_lines": pa.array(total.astype(np.int64)), "n_dropped": pa.array((total - kept).astype(np.int64)), "kept_text": joined}
            yield pa.record_batch([made.get(n, batch.column(n) if n in batch.schema.names else None) for n in names], names=names)

    return run


def drop_repeated_lines(docs: DataFrame, min_points: int = MIN_POINTS, min_documents: int = MIN_DOCUMENTS,
                        batches: int = 4, fanout: int = 2, keep: str = "largest") -> DataFrame:
    """The documents with n_lines, n_dropped and kept_text ('' for a null text). `keep` says which
    doc_id keeps a repeated line, the "largest" or the "smallest" that holds it."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is largest or smallest")
    docs = docs.drop(*OUTPUTS, _DROP)
    # the complement of an id sorts the other way, so the smallest id is the largest complement
    ranked = (lambda c: F.bitwise_not(F.col(c))) if keep == "smallest" else F.col
    keys = store(line_keys(docs, min_points).withColumn("doc_id", ranked("doc_id")), "line-keys")
    repeated = repeated_lines(keys, min_documents, batches, fanout)
    lost = (keys.join(repeated, "line").where(F.col("doc_id") != F.col("keeper"))
            .groupBy(ranked("doc_id").alias("__id")).agg(F.collect_set("line").alias(_DROP)))
    joined = docs.join(lost, docs["doc_id"] == lost["__id"], "left").drop("__id")
    fields = [f for f in docs.schema.fields] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())]
    return joined.mapInArrow(_rewrite([f.name for f in fields], min_points), T.StructType(fields))

