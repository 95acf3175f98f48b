"""Pages of a sorted table through an order index.

The table is sorted once, by range partitions, and written with each row's place in its partition; one
index row per partition holds how many rows come before it and its first and last sort key. A page
is then read from the one or two partitions that hold its places, however deep it lies, and a reader
may also go on after the last key seen. The index has as many rows as the table has partitions, and
nothing else reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Row places inside a partition in monotonically_increasing_id().
_PLACE_BITS = 33
_KEYS, _PART, _PLACE = "__keys", "__part", "__place"


@dataclass(frozen=True)
class OrderIndex:
    """A stored order: the rows' folder, their columns, and the partitions in order."""

    rows: DataFrame
    columns: list[str]
    parts: list[dict]
    total: int
    descending: list[bool]

    def _between(self, first: int, last: int) -> list[dict]:
        return [p for p in self.parts if p["before"] < last and p["before"] + p["n"] >= first]

    def _positioned(self, parts: list[dict]) -> DataFrame:
        """Rows of some partitions with their position in the whole order, from 1."""
        before = self.rows.sparkSession.createDataFrame([(p[_PART], p["before"]) for p in parts], f"{_PART} int, __before long")
        # partition filters, so other folders are not opened; one index row per partition at most
        kept = self.rows.where(F.col(_PART).isin([p[_PART] for p in parts]))
        return kept.join(F.broadcast(before), _PART).withColumn("position", (F.col("__before") + F.col(_PLACE) + 1).cast("bigint"))

    def positions(self) -> DataFrame:
        """Every row with its position."""
        return self._positioned(self.parts).select(*self.columns, "position")

    def page(self, page: int, page_size: int) -> DataFrame:
        """The rows of one page with position, total, page and page_size; a page after the last is empty."""
        first, last = (page - 1) * page_size + 1, page * page_size
        found = self._positioned(self._between(first, last)).where(F.col("position").between(first, last))
        return found.orderBy("position").select(*self.columns, "position").withColumns({"total": F.lit(self.total).cast("bigint"), "page": F.lit(page), "page_size": F.lit(page_size)})

    def key_at(self, position: int) -> Row | None:
        """The sort key of a row, by which a later reader goes on (see `after`)."""
        found = self._positioned(self._between(position, position)).where(F.col("position") == position).select(_KEYS).first()
        return found[_KEYS] if found else None

    def after(self, key: Row, size: int) -> DataFrame:
        """The next rows after a sort key, which need not be in the table any more."""
        start = next((i for i, p in enumerate(self.parts) if _comes_before(tuple(key), tuple(p["last"]), self.descending)), len(self.parts))
        # the key's own partition may hold any number of later rows, those after it hold only later ones
        chosen, room = self.parts[start:start + 1], size
        for p in self.parts[start + 1:]:
            if room <= 0:
                break
            chosen.append(p)
            room -= p["n"]
        later = self._positioned(chosen).where(_is_after(key, self.descending))
        return later.orderBy("position").limit(size).select(*self.columns, "position")


def _comes_before(a: tuple, b: tuple, descending: list[bool]) -> bool:
    """Spark's order of two keys: nulls are below every value."""
    for x, y, down in zip(a, b, descending):
        if x != y:
            below = x is None or (y is not None and x < y)
            return below != down
    return False


def _is_after(key: Row, descending: list[bool]) -> Column:
    """Whether a row's sort key comes after a given one."""
    after, same = F.lit(False), F.lit(True)
    for name, down in zip(key.__fields__, descending):
        here, value = F.col(_KEYS)[name], key[name]
        if value is None:
            later = F.lit(False) if down else here.isNotNull()
        else:
            later = (here < F.lit(value)) | here.isNull() if down else here > F.lit(value)
        after = after | (same & F.coalesce(later, F.lit(False)))
        same = same & here.eqNullSafe(F.lit(value))
    return after


def build_order_index(df: DataFrame, keys: list[tuple[Column, bool]], path: str) -> OrderIndex:
    """Writes `df` in the order of `keys`, (column, descending) pairs whose last one settles ties, and opens it."""
    names, descending = [f"k{i}" for i in range(len(keys))], [down for _, down in keys]
    # text folding is not repeatable in Spark's eyes, so keys are columns before they are sorted by
    staged = df.withColumn(_KEYS, F.struct(*[k.alias(n) for n, (k, _) in zip(names, keys)]))
    way = [F.col(_KEYS)[n].desc() if down else F.col(_KEYS)[n].asc() for n, down in zip(names, descending)]
    ranged = staged.repartitionByRange(*way).sortWithinPartitions(*way).withColumn("__id", F.monotonically_increasing_id())
    place = F.col("__id").bitwiseAND((1 << _PLACE_BITS) - 1)
    ranged.select(*df.columns, _KEYS, place.alias(_PLACE), F.shiftright("__id", _PLACE_BITS).cast("int").alias(_PART)).write.partitionBy(_PART).parquet(f"{path}/rows")
    stored = T.StructType([*staged.schema.fields, T.StructField(_PLACE, T.LongType()), T.StructField(_PART, T.IntegerType())])
    ends = df.sparkSession.read.schema(stored).parquet(f"{path}/rows").groupBy(_PART).agg(
        F.count(F.lit(1)).alias("n"), F.max_by(_KEYS, _PLACE).alias("last"))
    ends.withColumn("descending", F.lit(descending)).coalesce(1).write.parquet(f"{path}/index")
    return open_order_index(df.sparkSession, path, stored)


def open_order_index(spark: SparkSession, path: str, schema: T.StructType | None = None) -> OrderIndex:
    index = spark.read.parquet(f"{path}/index").orderBy(_PART).collect()
    rows = (spark.read.schema(schema) if schema is not None else spark.read).parquet(f"{path}/rows")
    parts, before = [], 0
    for p in index:
        parts.append({_PART: p[_PART], "n": p["n"], "last": p["last"], "before": before})
        before += p["n"]
    columns = [c for c in rows.columns if c not in (_KEYS, _PLACE, _PART)]
    return OrderIndex(rows, columns, parts, before, list(index[0]["descending"]) if index else [])
