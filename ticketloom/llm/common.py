"""Shared by the operators: scratch tables, text slices for Arrow functions, word splitting, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.session import ensure_checkpoint_dir

SLICE_BYTES = 4 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one that the cluster names in spark.checkpoint.dir.

    Only a local session, where driver and tasks are one process, may do without the setting.
    """
    alone = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    unset = not spark.conf.get("spark.checkpoint.dir", "") and not spark.sparkContext.getCheckpointDir()
    root = ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="ticketloom-") if alone and unset else None)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches where a column's bytes pass `size`; a longer text is a slice of its own."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        start, total = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if i > start and total + n > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(column), "")


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a slice of texts, as codes into the slice's distinct words."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        if lower:
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(texts)
        values = split.flatten()
        owner = np.repeat(np.arange(len(texts)), np.diff(np.asarray(split.offsets)))
        full = np.asarray(pc.binary_length(values)) > 0
        encoded = values.filter(pa.array(full)).dictionary_encode()
        self.owner = owner[full]
        self.codes = np.asarray(encoded.indices).astype(np.int64)
        self.distinct: pa.Array = encoded.dictionary
        self.per_text = np.bincount(self.owner, minlength=len(texts))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, in text order."""
        return hash_strings(self.distinct)[self.codes]


def strings(values: pa.Array) -> list[str]:
    """Python strings of an Arrow column; much faster than to_pylist for many short ones."""
    return values.to_numpy(zero_copy_only=False).tolist()


def hash_strings(values: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, strings(values)), np.uint64, len(values))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finisher of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chain(hashes: np.ndarray, order: int) -> np.ndarray:
    """Hash of each run of `order` neighbours; the last `order - 1` places have none."""
    n = max(0, len(hashes) - order + 1)
    out = hashes[:n].copy()
    for k in range(1, order):
        out = mix(out * _MIX + hashes[k:k + n])
    return out


def same_text(owner: np.ndarray, order: int) -> np.ndarray:
    """Whether the run of `order` words that starts at a place lies in one text."""
    n = max(0, len(owner) - order + 1)
    return owner[:n] == owner[order - 1:order - 1 + n]


def sample_by_hash(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About `bound` rows at most, chosen by a hash of the key alone; all rows when there are fewer."""
    count = df.count()
    if count <= bound:
        return df
    share = int(bound / count * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < share)


def digest128(*columns: Column) -> Column:
    """Two 64-bit hashes with different seeds: equal digests mean equal values for all practical sizes."""
    return F.struct(F.xxhash64(F.lit(1), *columns).alias("a"), F.xxhash64(F.lit(2), *columns).alias("b"))
