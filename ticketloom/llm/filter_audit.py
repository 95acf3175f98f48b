"""Filter interaction audit: how filters overlap, for every order in which they could be applied.

Four filters look at one text; the fifth fails a text that equals the text of a smaller doc_id. For it
a counting Bloom sketch goes first. Every task of the text scan that is read back adds its texts'
digests to counters that stop at 2; these partial sketches are sparse, cut into blocks of fixed size
and merged block by block. A text with a counter below 2 among its own is unique for certain and is
cleared. Only the texts of possible repeats are fetched and shuffled, and grouped by the whole text to
find the smallest doc_id of each. False alarms cost a fetch, never a wrong flag.

A document becomes one row (part, mask of failed filters), and only histograms of masks are kept: the
duplicate filter moves counts from one mask to another. Every order and step is a sum over at most 32
masks a part, so the work after the join does not depend on the number of documents.

Skew: a text that a third of all rows share is one digest per scan task, in the sketch, in the
question and in the answer, and its smallest id is partly aggregated; the join that decides "is it the
first" has the doc_id in its key. The number of blocks grows with the rows, a block does not. Spark
broadcasts the possible repeats' ids only below the session's own size limit; above it, the
fetch is a shuffle join on doc_id, in which texts move once.

Cases: a null text is an empty one; rows without doc_id are counted, never fail as duplicates and have no
labels; repeated rows with the smallest doc_id of a text all pass; a document with several label rows
has quality or toxic 1 if any row says so; a null source is part ''; other columns are ignored; empty
input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, mix, slices, store, texts_of

# The filters in the order of their bits, and the characters that D looks for.
FILTERS = "ABCDE"
SYMBOLS = "[#$%&*|]"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 2
DUPLICATE = 1 << FILTERS.index("E")

#: Counters of a block, counters a text touches, and texts a block is planned for (16 counters each).
BLOCK_COUNTERS = 1 << 16
PROBES = 4
BLOCK_TEXTS = BLOCK_COUNTERS // 16
#: Rows that a task gathers before it hands on its partial sketch.
FLUSH = 1 << 18

_POSITIONS, _COUNTS = np.dtype("<u2"), np.dtype("u1")


def text_masks(texts: pa.Array) -> np.ndarray:
    """The filters A to D that each text fails, as bits."""
    words = Words(texts)
    pairs = np.unique(words.owner * np.int64(max(1, len(words.distinct))) + words.codes)
    distinct = np.bincount(pairs // max(1, len(words.distinct)), minlength=len(texts))
    upper = np.asarray(pc.count_substring_regex(texts, "[A-Z]")).astype(np.int64)
    points = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    fails = (words.per_text < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * words.per_text,
             100 * upper > MAX_UPPER_PERCENT * points, np.asarray(pc.match_substring_regex(texts, SYMBOLS)))
    return sum(np.asarray(f).astype(np.int32) << bit for bit, f in enumerate(fails)) if len(texts) else np.empty(0, np.int32)


def _facts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        mask = text_masks(texts_of(batch))
        yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "part", "task", "digest")), pa.array(mask.astype(np.int32))], names=["doc_id", "part", "task", "digest", "mask"])


def counters_of(digests: pa.Array, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each digest and the counters that it touches there."""
    head = np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)
    step = mix(head[:, 1]) | np.uint64(1)
    places = (head[:, 2, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(BLOCK_COUNTERS)
    return (head[:, 0] % np.uint64(blocks)).astype(np.int64), places.astype(np.int64)


def _partial_sketches(blocks: int):
    """Sparse parts of the sketch from the digests of a task; counters stop at 2."""

    def sketch(digests: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        counts = pa.chunked_array(digests).value_counts()
        block, places = counters_of(counts.field("values"), blocks)
        # a text twice in this task touches its counters twice; one text's own probes are distinct
        times = np.minimum(np.asarray(counts.field("counts")), 2)
        slot, at = np.unique((block[:, None] * BLOCK_COUNTERS + places).ravel(), return_inverse=True)
        total = np.minimum(np.bincount(at.ravel(), weights=np.repeat(times, PROBES)), 2).astype(_COUNTS)
        owner, begins = np.unique(slot // BLOCK_COUNTERS, return_index=True)
        ends = np.append(begins[1:], len(slot))
        position = (slot % BLOCK_COUNTERS).astype(_POSITIONS)
        yield pa.record_batch([pa.array(owner.astype(np.int64)), pa.array([position[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary()),
                               pa.array([total[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary())], names=["block", "positions", "counts"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column("digest"))
                rows += batch.num_rows
            if rows >= FLUSH:
                yield from sketch(held)
                held, rows = [], 0
        if held:
            yield from sketch(held)

    return run


def _merge(parts: pa.Table) -> pa.Table:
    """One block's partial sketches become the bits of its counters that reached 2."""
    total = np.zeros(BLOCK_COUNTERS, np.int8)
    for positions, counts in zip(parts["positions"].to_pylist(), parts["counts"].to_pylist()):
        at = np.frombuffer(positions, _POSITIONS)
        total[at] = np.minimum(total[at] + np.frombuffer(counts, _COUNTS), 2)
    return pa.table({"block": parts["block"].slice(0, 1), "repeated": pa.array([np.packbits(total >= 2).tobytes()], pa.binary())})


def _with_block(blocks: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = counters_of(batch.column("digest"), blocks)[0] if batch.num_rows else np.empty(0, np.int64)
            yield pa.record_batch([*batch.columns, pa.array(block)], names=["task", "digest", "block"])

    return run


def _uncleared(blocks: int):
    """The questions of one block that its sketch can't clear."""

    def run(asked: pa.Table, sketch: pa.Table) -> pa.Table:
        asked = asked.combine_chunks().select(["task", "digest"])
        if not asked.num_rows or not sketch.num_rows:
            return asked.slice(0, 0)
        bits = np.unpackbits(np.frombuffer(sketch["repeated"][0].as_py(), np.uint8)).astype(bool)
        _, places = counters_of(asked["digest"].combine_chunks(), blocks)
        return asked.filter(pa.array(bits[places].all(axis=1)))

    return run


def possible_repeats(facts: DataFrame) -> DataFrame:
    """(task, digest) of the texts that the merged sketch does not clear, from rows (task, digest)."""
    blocks = max(1, -(-facts.count() // BLOCK_TEXTS))
    sketch = facts.select("digest").mapInArrow(_partial_sketches(blocks), "block bigint, positions binary, counts binary")
    merged = sketch.groupBy("block").applyInArrow(_merge, "block bigint, repeated binary")
    questions = facts.select("task", "digest").distinct().mapInArrow(_with_block(blocks), "task long, digest binary, block bigint")
    return questions.groupBy("block").cogroup(merged.groupBy("block")).applyInArrow(_uncleared(blocks), "task long, digest binary")


def failed_filters(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n) whose sums of n count the documents with exactly these failed filters.

    A document has a row with its mask of A to D and n = 1. One that is a duplicate has two more: -1
    at that mask and +1 at the mask with E.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("part"))
    read = docs.select("doc_id", "part", "text", F.spark_partition_id().cast("long").alias("task"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    facts = store(read.mapInArrow(_facts, "doc_id bigint, part string, task long, digest binary, mask int"), "audit-facts")
    named = facts.where("doc_id is not null")
    suspects = store(named.join(possible_repeats(named), ["task", "digest"]).select("doc_id", "part", "mask", "digest"), "audit-suspects")
    # only these documents' texts leave the scan; equal texts have equal masks and digests
    texts = docs.join(suspects.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
    first = texts.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    repeats = suspects.join(first, ["doc_id", "digest"], "left_anti").select("doc_id", "part", "mask")
    moved = repeats.select("doc_id", "part", F.explode(F.array(
        F.struct("mask", F.lit(-1).alias("n")), F.struct(F.col("mask").bitwiseOR(DUPLICATE).alias("mask"), F.lit(1).alias("n")))).alias("m")).select("doc_id", "part", "m.mask", "m.n")
    return facts.select("doc_id", "part", "mask", F.lit(1).alias("n")).unionByName(moved)


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those labelled good and toxic, by their failed filters."""
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    total = lambda c: F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).cast("bigint").alias(c)
    return failed.join(flags, "doc_id", "left").groupBy("part", "mask").agg(total("good"), total("toxic"), F.sum("n").cast("bigint").alias("n"))


def order_rules(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """What each order and step does with each mask: constant rows, (orders x steps x masks) of them."""
    rows = []
    for order in permutations(filters):
        for step, name in enumerate(order, 1):
            before = sum(1 << filters.index(f) for f in order[:step - 1])
            bit = 1 << filters.index(name)
            for mask in range(1 << len(filters)):
                earlier, now = bool(mask & before), bool(mask & bit)
                rows.append(("".join(order), step, mask, int(not earlier and not now), int(now and not earlier), int(now and earlier), int(mask == bit), int(now)))
    return spark.createDataFrame(rows, "filter_order string, step int, mask int, keeps int, removes int, repeats int, alone int, fails int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    counts = mask_counts(failed_filters(docs), labels)
    # in a share 1 / |mask| of the orders a document's failed filter comes first
    orders = 1
    for k in range(2, len(FILTERS) + 1):
        orders *= k
    counts = counts.withColumn("first_in", (F.lit(orders) / F.greatest(F.bit_count("mask"), F.lit(1))).cast("bigint"))
    rules = order_rules(docs.sparkSession)
    total = lambda when, what, name: F.sum(F.col(when) * F.col(what)).cast("bigint").alias(name)
    return counts.join(F.broadcast(rules), "mask").groupBy("part", "filter_order", "step").agg(
        total("keeps", "n", "kept"), total("removes", "n", "removed"), total("repeats", "n", "redundant"), total("alone", "n", "unique_fails"),
        total("removes", "good", "good_lost"), total("removes", "toxic", "toxic_lost"),
        F.sum(F.col("fails") * F.col("n") * F.col("first_in")).cast("bigint").alias("shapley"))
