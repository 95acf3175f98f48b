"""Building blocks that keep a hot group out of a single task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written


def rank_rows(df: DataFrame, by: list[str], bucket: list[Column], order: list[Column], name: str) -> DataFrame:
    """row_number() per `by` in two levels.

    `bucket` must be a coarse prefix of `order` (for example the hour of the leading timestamp).
    Rows are numbered inside (by, bucket); bucket sizes are counted with partial aggregation and
    only those counts are accumulated per group, so a huge group is spread over its buckets.
    Keys and buckets must not be null.
    """
    marks = [f"__b{i}" for i in range(len(bucket))]
    marked = df.select("*", *[b.alias(m) for b, m in zip(bucket, marks)])
    keys = by + marks
    before = W.partitionBy(*by).orderBy(*marks).rowsBetween(W.unboundedPreceding, -1)
    sizes = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    numbered = marked.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    joined = numbered.join(offsets, keys)
    return joined.withColumn(name, (F.col("__offset") + F.col("__rn")).cast("bigint")).drop("__offset", "__rn", *marks)


# ---- prefix scans over range partitions -----------------------------------------------------
#
# Rows are dealt by ranges of (key, order) and sorted, so a key, or one day of it, that holds a third of
# all rows lies in as many partitions as its size asks for. One ordered pass goes over each partition
# and ends with a closing row: its first and last key and what the last key carries on. The closing
# rows, one per partition, are folded in order, and what a partition's first key had before it is
# handed back by partition number. `order` must not leave ties inside a key.


def _same_as_before(columns: list[pa.Array]) -> np.ndarray:
    """Whether a row has the same (null-safe) key as the row before it; false for the first row."""
    same = np.ones(len(columns[0]), bool)
    same[:1] = False
    for column in columns:
        codes = np.asarray(column.dictionary_encode(null_encoding="encode").indices)
        same[1:] &= codes[1:] == codes[:-1]
    return same


class _Runs:
    """Follows the runs of equal keys over the batches of a sorted partition."""

    def __init__(self, by: list[str]):
        self.by, self.first, self.last, self.many = by, None, None, False

    def step(self, batch: pa.RecordBatch) -> tuple[np.ndarray, bool]:
        """(where each row's run begins, whether the batch's first row goes on the run before it)."""
        columns = [batch.column(c) for c in self.by]
        same = _same_as_before(columns)
        begin, end = (tuple(c[i].as_py() for c in columns) for i in (0, len(same) - 1))
        goes_on = self.last is not None and begin == self.last
        self.first = begin if self.first is None else self.first
        self.many |= bool((~same[1:]).any()) or (self.last is not None and not goes_on)
        self.last = end
        return np.maximum.accumulate(np.where(same, 0, np.arange(len(same)))), goes_on


def _key_struct(schema: T.StructType, by: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, schema[c].dataType) for c in by])


def _with_closing(fields: list[pa.Field], seen: pa.Schema, by: list[str], extra: pa.Field) -> pa.Schema:
    """The output's Arrow schema: ordinary columns, then what a closing row holds."""
    key = pa.struct([pa.field(c, seen.field(c).type) for c in by])
    close = pa.struct([pa.field("first", key), pa.field("last", key), pa.field("many", pa.bool_()), extra])
    return pa.schema([*fields, pa.field("__close", close)])


def _closing(out: pa.Schema, part: int, runs: _Runs, **values) -> pa.RecordBatch:
    """The one row that ends a partition; the columns of ordinary rows are null."""
    close = {"first": dict(zip(runs.by, runs.first)), "last": dict(zip(runs.by, runs.last)), "many": runs.many, **values}
    row = {"__part": part, "__close": close}
    return pa.record_batch([pa.array([row.get(f.name)], f.type) for f in out], schema=out)


def number_rows(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """row_number() per `by` in the order of `order`, whatever the size of a group."""
    close = T.StructType([T.StructField("first", _key_struct(df.schema, by)), T.StructField("last", _key_struct(df.schema, by)),
                          T.StructField("many", T.BooleanType()), T.StructField("n", T.LongType())])
    schema = T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__head", T.BooleanType()),
                           T.StructField("__n", T.LongType()), T.StructField("__close", close)])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part, runs, count, head = None, TaskContext.get().partitionId(), _Runs(by), 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or _with_closing([*(pa.field(f.name, f.type) for f in batch.schema), pa.field("__part", pa.int32()), pa.field("__head", pa.bool_()), pa.field("__n", pa.int64())],
                                       batch.schema, by, pa.field("n", pa.int64()))
            begins, goes_on = runs.step(batch)
            number = np.arange(batch.num_rows) - begins + 1
            number[begins == 0] += count if goes_on else 0
            in_head = (begins == 0) & (head and (goes_on or runs.first == tuple(batch.column(c)[0].as_py() for c in by)))
            count, head = int(number[-1]), bool(in_head[-1])
            yield pa.record_batch([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(in_head), pa.array(number),
                                   pa.nulls(batch.num_rows, out.field("__close").type)], schema=out)
        if out is not None:
            yield _closing(out, part, runs, n=count)

    rows = written(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).mapInArrow(scan, schema), "numbered")
    before, carried = [], (None, 0)
    for row in rows.where("__close is not null").select("__part", "__close.*").orderBy("__part").collect():
        had = carried[1] if carried[0] == row["first"] else 0
        before.append((row["__part"], had))
        carried = (row["last"], row["n"] + (0 if row["many"] else had))
    offsets = df.sparkSession.createDataFrame([b for b in before if b[1]], "__part int, __had long")
    # one row per range partition at most
    joined = rows.where("__close is null").join(F.broadcast(offsets), "__part", "left")
    had = F.when(F.col("__head"), F.coalesce("__had", F.lit(0))).otherwise(0)
    return joined.select(*df.columns, (F.col("__n") + had).cast("bigint").alias(name))


def latest_before(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str,
                  columns: list[str], tie: str, name: str) -> DataFrame:
    """As-of join: for each left row the last right row of its key strictly before `left_ts`, as a
    struct (ts, tie, *columns). No pairs are produced, and a hot key or day is spread over partitions."""
    packed = F.struct(F.col(right_ts).alias("ts"), F.col(tie).alias("tie"), *[F.col(c).alias(c) for c in columns])
    l = left.select(F.col(by).alias("__by"), F.col(left_ts).alias("__ts"), F.lit(0).alias("__side"), F.monotonically_increasing_id().alias("__tie"), F.struct("*").alias("__left"))
    r = right.select(F.col(by).alias("__by"), F.col(right_ts).alias("__ts"), F.lit(1).alias("__side"), F.lit(None).cast("bigint").alias("__tie"), packed.alias("__hit"))
    both = l.withColumn("__hit", F.lit(None).cast(r.schema["__hit"].dataType)).unionByName(r.withColumn("__left", F.lit(None).cast(l.schema["__left"].dataType)))
    close = T.StructType([T.StructField(c, _key_struct(both.schema, ["__by"])) for c in ("first", "last")] + [T.StructField("many", T.BooleanType()), T.StructField("hit", both.schema["__hit"].dataType)])
    schema = T.StructType([T.StructField("__left", both.schema["__left"].dataType), T.StructField("__hit", both.schema["__hit"].dataType),
                           T.StructField("__part", T.IntegerType()), T.StructField("__open", T.BooleanType()), T.StructField("__close", close)])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part, runs, head = None, TaskContext.get().partitionId(), _Runs(["__by"]), True
        held = None  # the last hit of the run that the batch before ended with
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            hit_type = batch.schema.field("__hit").type
            if out is None:
                fields = [pa.field("__left", batch.schema.field("__left").type), pa.field("__hit", hit_type), pa.field("__part", pa.int32()), pa.field("__open", pa.bool_())]
                out, held = _with_closing(fields, batch.schema, ["__by"], pa.field("hit", hit_type)), pa.nulls(1, hit_type)
            begins, goes_on = runs.step(batch)
            head = head and (goes_on or runs.first == (batch.column("__by")[0].as_py(),))
            at = np.maximum.accumulate(np.where(np.asarray(batch.column("__side")) == 1, np.arange(n), -1))
            inside = at >= begins
            # place 0 is what was held, so hits of this batch are one further on
            place = np.where(inside, at + 1, np.where((begins == 0) & goes_on, 0, -1))
            hits = pa.concat_arrays([held, batch.column("__hit")])
            lefts = np.flatnonzero(np.asarray(batch.column("__side")) == 0)
            found = hits.take(pa.array(place[lefts], mask=place[lefts] < 0))
            open_ = (begins[lefts] == 0) & head & ~np.asarray(found.is_valid())
            yield pa.record_batch([batch.column("__left").take(pa.array(lefts)), found, pa.array(np.full(len(lefts), part, np.int32)), pa.array(open_),
                                   pa.nulls(len(lefts), out.field("__close").type)], schema=out)
            held = hits.slice(int(place[-1]), 1) if place[-1] >= 0 else pa.nulls(1, hit_type)
            head = head and begins[-1] == 0
        if out is not None:
            yield _closing(out, part, runs, hit=held[0].as_py())

    keys = ["__by", "__ts", "__side", "__hit.tie", "__tie"]
    rows = written(both.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(scan, schema), "as-of")
    before, carried = [], (None, None)
    for row in rows.where("__close is not null").select("__part", "__close.*").orderBy("__part").collect():
        had = carried[1] if carried[0] == row["first"] else None
        before.append((row["__part"], had))
        carried = (row["last"], row["hit"] if row["hit"] is not None or row["many"] else had)
    spark = left.sparkSession
    carry = spark.createDataFrame([b for b in before if b[1] is not None], T.StructType([T.StructField("__part", T.IntegerType()), T.StructField("__had", both.schema["__hit"].dataType)]))
    # one row per range partition at most
    joined = rows.where("__close is null").join(F.broadcast(carry), "__part", "left")
    return joined.select("__left.*", F.when(F.col("__open"), F.col("__had")).otherwise(F.col("__hit")).alias(name))


def nearest_rank(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles of a non-negative number, one row per key.

    Pass one counts rows per 0.1 %-wide value bucket, which is partial aggregation over at most a
    few ten thousand buckets per key. Pass two looks only at the bucket that holds the wanted rank.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    rows = rows.withColumn("__b", F.floor(F.log1p("__v") * 1000))
    counts = rows.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    upto = whole.orderBy("__b").rowsBetween(W.unboundedPreceding, 0)
    counts = counts.select("*", F.sum("__n").over(upto).alias("__cum"), F.sum("__n").over(whole).alias("__total"))
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("p")) for n, p in points.items()]))
    ranks = counts.withColumn("__w", wanted)
    rank = F.greatest(F.lit(1), F.ceil(F.col("__w.p") * F.col("__total")))
    ranks = ranks.withColumn("__rank", rank).where("__rank <= __cum and __rank > __cum - __n")
    ranks = ranks.select(*keys, "__b", F.col("__w.name").alias("__name"), (F.col("__rank") - F.col("__cum") + F.col("__n")).alias("__rank"))
    values = rows.join(ranks, keys + ["__b"])
    values = values.groupBy(*keys, "__name", "__rank", "__v").agg(F.count(F.lit(1)).alias("__m"))
    order = W.partitionBy(*keys, "__name").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    values = values.withColumn("__cum", F.sum("__m").over(order)).where("__cum >= __rank")
    return values.groupBy(*keys).agg(*[F.min(F.when(F.col("__name") == n, F.col("__v"))).alias(n) for n in points])


def histogram_rank(p: float, cum: Column, total: Column, value: Column) -> Column:
    """Nearest-rank percentile inside an aggregate over (value, cumulative count, total) rows."""
    return F.min(F.when(cum >= F.greatest(F.lit(1), F.ceil(F.lit(p) * total)), value))


def own_exchange(key: str) -> Column:
    """The key re-encoded: partitioning by `key` does not count as partitioning by this.

    AQE splits a hot join key only if both inputs are plain exchanges and the split adds no
    shuffle. Joining on the re-encoded key and aggregating on the plain one gives exactly that.
    """
    return F.encode(F.col(key), "UTF-8")
