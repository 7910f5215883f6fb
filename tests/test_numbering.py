"""Running numbers over ranges: hot keys, sparse positions, null keys, filters, and the plans of the page operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagestrata import plans
from pagestrata.operators import pages as P
from pagestrata.operators.common import in_ranges, numbered, running

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    """Nine tenths of the rows under one key, at sparse positions; small keys, a null key."""
    rng = random.Random(4)
    rows = [("hot", i * 10**9 + rng.randrange(10**8), rng.randrange(3)) for i in range(9000)]
    rows += [(rng.choice(["a", "b", "c", "zz", None]), i, rng.randrange(3)) for i in range(1000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, pos long, n int").repartition(5)


def by_hand(rows, amount):
    out, sums = [], {}
    for k, pos, n in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        sums[k] = sums.get(k, 0) + amount(n)
        out.append((k, pos, n, sums[k]))
    return sorted(out, key=repr)


def test_numbers_and_sums_along_keys(table):
    rows, df = table
    assert sorted((tuple(r) for r in numbered(df, ["k"], "pos", "at").select("k", "pos", "n", "at").collect()), key=repr) == by_hand(rows, lambda n: 1)
    laid = in_ranges(df, ["k"], ["pos"])
    found = running(laid, ["k"], "at", F.col("n"))
    assert found.columns == ["k", "pos", "n", "at"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == by_hand(rows, lambda n: n)
    some = running(laid.filter("n > 0"), ["k"], "at")
    assert sorted((tuple(r) for r in some.collect()), key=repr) == by_hand([r for r in rows if r[2] > 0], lambda n: 1)
    assert numbered(df.filter("false"), ["k"], "pos", "at").count() == 0


def test_a_hot_key_is_spread(spark, table):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "20")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sizes = [r["count"] for r in in_ranges(table[1], ["k"], ["pos"]).groupBy("_range").count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert len(sizes) >= 15 and max(sizes) <= 3 * sum(sizes) / len(sizes)


def test_several_columns_of_order(spark):
    rows = [(t, f, p) for t in (1, 2) for f in (30, 10, 20) for p in range(f // 10)]
    got = P.merge_documents(spark.createDataFrame(rows, "target int, file_ord int, page_no int").repartition(3))
    for t in (1, 2):
        mine = sorted((r["file_ord"], r["page_no"], r["new_page"]) for r in got.filter(F.col("target") == t).collect())
        assert [n for _, _, n in mine] == list(range(1, 7))


def test_delete_and_move(spark):
    pages = spark.createDataFrame([(d, p) for d in range(4) for p in range(1, 6)], "doc_id int, page_no int")
    chosen = spark.createDataFrame([(0, 2), (0, 2), (0, 4), *((1, p) for p in range(1, 6)), (9, 1)], "doc_id int, page_no int")
    assert sorted(tuple(r) for r in P.delete_pages(pages, chosen).collect()) == [(0, 1, 1), (0, 3, 2), (0, 5, 3)]
    order = pages.select("*", F.col("page_no").alias("pos"))
    moves = spark.createDataFrame([(0, 1, 1), (1, 1, -1), (2, 5, 1), (3, 5, -1)], "doc_id int, page_no int, delta int")
    got = {(r["doc_id"], r["page_no"]): r["pos"] for r in P.move_page(order, moves).collect()}
    assert {k: v for k, v in got.items() if k[1] != v} == {(0, 1): 2, (0, 2): 1, (3, 5): 4, (3, 4): 5} and len(got) == 20


@pytest.mark.parametrize("name", ["split_pages", "select_pages", "unique_names", "merge_documents", "delete_pages", "moved_pages", "reorder_pages"])
def test_plans_read_their_input_few_times(spark, name):
    plan = plans.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Scan ") <= (4 if name == "reorder_pages" else 3), plan
