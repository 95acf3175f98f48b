"""Order index: positions, deep pages, continuation after a key, and what a page reads."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ticketloom.operators import explorer, pages


@pytest.fixture
def spread(spark):
    names = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def order_of(spark, tmp_path, rows, keys):
    df = spark.createDataFrame(rows, "a int, s string, id int")
    return pages.build_order_index(df, keys, str(tmp_path / "order"))


ROWS = [(random.Random(i).choice([None, 1, 2, 3]), random.Random(i * 7).choice([None, "x", "Y", "é"]), i) for i in range(700)]


@pytest.mark.parametrize("down_a", [False, True])
@pytest.mark.parametrize("down_s", [False, True])
def test_pages_and_continuation_follow_the_whole_sort(spark, tmp_path, spread, down_a, down_s):
    order = order_of(spark, tmp_path, ROWS, [(F.col("a"), down_a), (F.col("s"), down_s), (F.col("id"), False)])
    way = lambda c, down: F.col(c).desc() if down else F.col(c).asc()
    want = [r["id"] for r in spark.createDataFrame(ROWS, "a int, s string, id int").orderBy(way("a", down_a), way("s", down_s), "id").collect()]
    assert order.total == 700 and len(order.parts) > 4
    got = {r["position"]: r["id"] for r in order.positions().collect()}
    assert [got[i + 1] for i in range(700)] == want
    for page, size in ((1, 10), (35, 20), (70, 10), (8, 99), (71, 10)):
        rows = order.page(page, size).collect()
        assert [r["id"] for r in rows] == want[(page - 1) * size:page * size]
        assert [r["position"] for r in rows] == list(range((page - 1) * size + 1, min(page * size, 700) + 1)) and all(r["total"] == 700 for r in rows)
    for at, size in ((1, 30), (349, 200), (699, 5), (700, 5)):
        assert [r["id"] for r in order.after(order.key_at(at), size).collect()] == want[at:at + size]
    # opened again by its path
    again = pages.open_order_index(spark, str(tmp_path / "order"))
    assert [r["id"] for r in again.page(35, 20).collect()] == want[680:700]


def test_a_deep_page_reads_its_partition_only(spark, tmp_path, spread):
    order = order_of(spark, tmp_path, ROWS, [(F.col("id"), False)])
    page = order.page(69, 10)
    plan = page._jdf.queryExecution().executedPlan().toString()
    chosen = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan).group(1)
    parts = {int(n) for n in re.findall(r"(?:= |[(,])(\d+)", chosen)}
    assert "__part" in chosen and page.count() == 10 and 1 <= len(parts) <= 2 < len(order.parts)
    assert "Exchange rangepartitioning" not in plan or "offset" not in plan.lower()


def test_a_key_between_rows_and_an_empty_table(spark, tmp_path, spread):
    order = order_of(spark, tmp_path, [r for r in ROWS if r[2] % 2], [(F.col("id"), True)])
    key = order.key_at(1)
    assert [r["id"] for r in order.after(type(key)(k0=100), 3).collect()] == [99, 97, 95]
    empty = pages.build_order_index(spark.createDataFrame([], "id int"), [(F.col("id"), False)], str(tmp_path / "none"))
    assert empty.total == 0 and empty.page(1, 10).count() == 0 and empty.key_at(1) is None and empty.positions().count() == 0


def test_ticket_order_keeps_missing_last_and_refuses_bad_pages(spark, tmp_path):
    rows = spark.createDataFrame([("10", "app 10"), ("9", "app 9"), ("8", None), ("7", "app 9")], "ticket_id string, app string")
    for down, want in ((False, ["7", "9", "10", "8"]), (True, ["10", "7", "9", "8"])):
        order = explorer.ticket_order(rows, str(tmp_path / f"o{down}"), "app", down)
        assert [r["ticket_id"] for r in explorer.paginate(order, 1, 10).collect()] == want
        assert [r["ticket_id"] for r in explorer.ticket_sort(rows, "app", down).collect()] == want
    for page, size in ((0, 10), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            explorer.paginate(order, page, size)
