"""Packing token sequences: shortest-pack-first over the length histogram.

Documents are tokenized once. Whole sequences of `capacity` ids are cut off the front, and what is
left (the remainder, shorter than a sequence) is packed. Only the histogram of remainder lengths
reaches the driver: at most `capacity - 1` numbers. Lengths are placed longest first into the
shortest pack they fit in; packs are patterns with counts, so the work depends on `capacity` alone.
Each pattern then owns ranges of ranks, and remainders find their pack by their rank among the
remainders of equal length. Ranks are counted in two levels (buckets of rows, then bucket offsets),
so a length that a third of all documents share is spread over the buckets.

Cases: null and empty texts are one closing id; repeated rows and equal doc_ids are packed as
separate documents; rows without doc_id are packed too; a text longer than any sequence is cut;
columns of the input other than doc_id and text are not returned; empty input gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, store, strings, texts_of

CAPACITY = 1024
END_ID = 0


#: How patterns of this kind end: the last white space before a word goes with the word.
_LOOK_AHEAD = r"|\s+(?!\S)|\s+"
_SPACES = re.compile(r"\s\s")


class LibraryVocabulary:
    """A tokenizers file and the ids of whole texts.

    When the file's merges are in the order of their ids (as in byte-level BPE of the GPT-2 kind), the
    ids follow from the ranks alone, and tiktoken, which merges much faster, is given the texts; other
    files are left to the tokenizers library. Both give the same ids.
    """

    def __init__(self, path: str, pattern: str):
        self.ranked, self.plain = self._ranked(path, pattern)
        if self.ranked is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.encode_special_tokens = True

    def _ranked(self, path: str, pattern: str):
        """Two tiktoken encodings with the file's ids, or None if ids are not ranks.

        The pattern's look-ahead only matters where white space follows white space, and costs a third
        of the time: the second encoding goes without it and is for texts that have no such place.
        """
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        first = 256
        if any(model["vocab"].get(a + b) != first + i for i, (a, b) in enumerate(merges)):
            return None, None
        ranks = {bytes(_BYTES[c] for c in token): i for token, i in model["vocab"].items() if i < first + len(merges)}
        plain = pattern.removesuffix(_LOOK_AHEAD) + r"|\s+" if pattern.endswith(_LOOK_AHEAD) else pattern
        return tuple(tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for name, p in (("ranked", pattern), ("plain", plain)))

    def ids_of(self, texts: list[str]) -> Iterator[np.ndarray]:
        if self.ranked is not None:
            return ((self.ranked if _SPACES.search(t) else self.plain).encode_to_numpy(t, disallowed_special=()) for t in texts)
        return (np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as itself, the rest from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in printable]
    return {**{chr(b): b for b in printable}, **{chr(256 + i): b for i, b in enumerate(others)}}


_BYTES = _byte_letters()
def _tokenize(path: str, pattern: str, capacity: int, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = LibraryVocabulary(path, pattern)  # a task's own: a worker that goes on to other stages does not keep it
        for batch in slices(batches):
            tokens, crcs = [], []
            for ids in vocab.ids_of(strings(texts_of(batch))):
                raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                tokens.append(len(raw) // 4)
                crcs.append([zlib.crc32(raw[i:i + 4 * capacity]) for i in range(0, len(raw), 4 * capacity)])
            yield pa.record_batch([batch.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "crcs"])

    return run


def tokenized(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, doc_tokens, crcs): ids with the closing id, and the CRC-32 of every `capacity` of them."""
    return docs.select("doc_id", "text").mapInArrow(_tokenize(path, pattern, capacity, end_id), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, doc_tokens bigint, crcs array<bigint>")


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of packs, lengths in the pack) for a histogram of lengths below `capacity`."""
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    done: list[tuple[int, tuple[int, ...]]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            filled = min((f for f, packs in open_packs.items() if packs), default=None)
            if filled is None or filled + length > capacity:
                # as many new packs as there are lengths: later lengths may still join them
                fits = capacity // length
                new = -(-left // fits) if fits > 1 else left
                per = [(left // new + 1, left % new), (left // new, new - left % new)]
                for k, packs in per:
                    if k and packs:
                        _keep(open_packs, done, packs, (length,) * k, capacity)
                left = 0
                continue
            packs, lengths = open_packs[filled].pop()
            used = min(packs, left)
            if packs > used:
                open_packs[filled].append((packs - used, lengths))
            _keep(open_packs, done, used, (*lengths, length), capacity)
            left -= used
    return done + [p for packs in open_packs.values() for p in packs]


def _keep(open_packs, done, packs: int, lengths: tuple[int, ...], capacity: int) -> None:
    filled = sum(lengths)
    (done if filled == capacity else open_packs[filled]).append((packs, lengths))


class Slots:
    """Which ranks of a length go to which packs: flat arrays, sorted by (length, first rank)."""

    def __init__(self, patterns: list[tuple[int, tuple[int, ...]]]):
        rows, taken, first = [], defaultdict(int), 0
        for packs, lengths in patterns:
            offset = 0
            for length in sorted(set(lengths), reverse=True):
                times = lengths.count(length)
                rows.append((length, taken[length], packs, first, offset))
                taken[length] += times * packs
                offset += times * length
            first += packs
        self.packs = first
        self.length, self.rank, self.count, self.sequence, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the remainders with these lengths and ranks."""
        wide = np.int64(1) << 48
        at = np.searchsorted(self.length * wide + self.rank, length * wide + rank, side="right") - 1
        inside = rank - self.rank[at]
        return self.sequence[at] + inside % self.count[at], self.offset[at] + length * (inside // self.count[at])


def _place(slots: Slots, capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, rest, rank, full_before = (np.asarray(batch.column(n)) for n in ("doc_tokens", "__rest", "__rank", "__full_before"))
            full = tokens // capacity
            pieces = full + (rest > 0)
            doc = np.repeat(np.arange(len(tokens)), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = nth * capacity
            last = nth == full[doc]
            sequence, offset = slots.packs + full_before[doc] + nth, np.zeros(len(doc), np.int64)
            if last.any():
                sequence[last], offset[last] = slots.find(rest[doc[last]], rank[doc[last]])
            columns = [batch.column("doc_id").take(pa.array(doc)), start, np.where(last, rest[doc], capacity), batch.column("crcs").flatten(), tokens[doc], sequence, offset]
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
                                  names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Packs of remainders are numbered from 0. A whole sequence cut off a document has a number after
    those: the part of the input it was read in, times 2^40, plus a running number there.
    """
    made = tokenized(docs, path, pattern, capacity, end_id).select("*", (F.col("doc_tokens") % capacity).alias("__rest"), F.spark_partition_id().cast("bigint").alias("__part"))
    made = store(made, "packing-tokens")
    histogram = {r["__rest"]: r["count"] for r in made.where("__rest > 0").groupBy("__rest").count().collect()}
    slots = Slots(pack_histogram(histogram, capacity))
    order = ["doc_id", "doc_tokens", "crcs"]
    running = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    whole = F.floor(F.col("doc_tokens") / capacity)
    numbered = made.withColumn("__full_before", F.shiftleft(F.col("__part"), 40) + F.coalesce(F.sum(whole).over(running), F.lit(0)))
    numbered = numbered.withColumn("__row", F.row_number().over(W.partitionBy("__part", "__rest").orderBy(*order)))
    sizes = made.groupBy("__part", "__rest").agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy("__rest").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__part", "__rest", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    ranked = numbered.join(offsets, ["__part", "__rest"]).withColumn("__rank", F.col("__offset") + F.col("__row") - 1)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(_place(slots, capacity), f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
