"""Folds over pages and tables work on lists: no pandas table a group, same results for few and for many boxes, null places."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagestrata import plans
from pagestrata.operators import graphics as I
from pagestrata.operators import ocr as O
from pagestrata.operators import tables as J

FOLDER = "/root/testdata/sf0.001"
SEG = "doc_id int, page_no int, dir string, pos double, a double, b double, ruled boolean"


@pytest.mark.parametrize("name", ["absorb_inner", "clean_fills", "cluster_boxes", "extend_down", "merge_cells", "palette", "snap_sizes", "stack_components", "stream_blocks"])
def test_folds_make_no_pandas_tables(spark, name):
    plan = plans.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "MapInArrow" in plan


def frame(x0, y0, x1, y1):
    return [(1, 0, "h", y, x0, x1, True) for y in (y0, y1)] + [(1, 0, "v", x, y0, y1, True) for x in (x0, x1)]


def test_absorb_inner_takes_the_sides_of_its_cell(spark):
    s = spark.createDataFrame(frame(0.0, 0.0, 200.0, 100.0) + frame(20.0, 8.0, 185.0, 90.0) + frame(300.0, 0.0, 400.0, 50.0), SEG)
    got = sorted(tuple(r)[2:] for r in J.absorb_inner(J.segment_components(s)).collect())
    one = [("h", 0.0, 0.0, 200.0, True, 0)] * 2 + [("h", 100.0, 0.0, 200.0, True, 0)] * 2 + [("v", x, 0.0, 100.0, True, 0) for x in (0.0, 200.0)]
    assert [r for r in got if r[1] < 300 and r[2] < 300] == sorted(one)
    assert len(got) == 10


def test_extend_down_stops_where_a_row_crosses(spark):
    g = spark.createDataFrame([(1, 0, 0, [0.0, 100.0, 200.0], 20.0, 20.0, True)], "doc_id int, page_no int, table_no int, xs array<double>, y1 double, last_h double, open boolean")
    rows = [(1, 0, n, x, x + w, 24.0 + 14 * n, 34.0 + 14 * n, 10.0) for n, x, w in ((0, 5.0, 30.0), (0, 105.0, 30.0), (1, 105.0, 40.0), (2, 60.0, 80.0), (3, 5.0, 9.0))]
    lines = spark.createDataFrame(rows, "doc_id int, page_no int, row_no int, x0 double, x1 double, top double, bottom double, size double")
    assert [tuple(r) for r in J.extend_down(g, lines).collect()] == [(1, 0, 0, 2, 50.0)]


def test_palette_gathers_words_in_their_order(spark):
    rows = [(1, 0, 0, n, 10.0 * n, *c) for n, c in enumerate([(0, 0, 0), (36, 36, 36), (54, 54, 54), (200, 0, 0), (73, 73, 73)])]
    words = spark.createDataFrame(rows, "doc_id int, page_no int, line int, word_no int, x0 double, r int, g int, b int").repartition(3)
    assert [r["color"] for r in O.palette(words).orderBy("word_no").collect()] == ["000000"] * 3 + ["C80000", "000000"][:1] + ["494949"]


def pages(n):
    dice = random.Random(7)
    return [(1, 0, i, 6.0 * dice.randrange(40), 6.0 * dice.randrange(40), 3.0 + dice.randrange(30), 3.0 + dice.randrange(9), f"{dice.randrange(4) * 60:02X}8040", dice.choice([1.0, 0.5])) for i in range(n)]


def test_few_and_many_boxes_give_the_same(spark, monkeypatch):
    f = spark.createDataFrame(pages(50), "doc_id int, page_no int, paint_order int, x double, y double, w double, h double, color string, opacity double")
    images = f.filter("paint_order % 9 = 8").withColumn("paint_order", F.col("paint_order") + 20)
    told = lambda: [sorted(map(tuple, df.collect())) for df in (I.clean_fills(f, images), I.cluster_boxes(f, 1.0))]
    by_lists = told()
    monkeypatch.setattr(I, "FEW", 0)
    fn = I._clusters
    boxes = [(x, y, x + w, y + h, 1) for _, _, _, x, y, w, h, *_ in pages(50)]
    import numpy as np

    assert sorted(tuple(r) for r in fn(np.array(boxes, dtype=float), 1.0).tolist()) == [tuple(map(float, r[2:])) for r in by_lists[1]]
    assert len(by_lists[0]) > 5 and len(by_lists[1]) > 1


def test_null_places_are_kept(spark):
    f = spark.createDataFrame([(1, 0, 0, None, 0.0, 5.0, 5.0, "102030", None), (1, 0, 1, 0.0, 0.0, 9.0, 9.0, "405060", 1.0)], "doc_id int, page_no int, paint_order int, x double, y double, w double, h double, color string, opacity double")
    assert sorted((r["paint_order"], r["x"], r["color"]) for r in I.clean_fills(f).collect()) == [(0, None, "102030"), (1, 0.0, "405060")]
    assert sorted((r["x"] is None, r["members"]) for r in I.cluster_boxes(f).collect()) == [(False, 1), (True, 1)]
    s = spark.createDataFrame([(1, 0, "h", None, 0.0, 9.0, True), (1, 0, "v", 0.0, 0.0, 9.0, True), (1, 0, "h", 0.0, 0.0, 9.0, True)], SEG)
    assert sorted((r["dir"], r["pos"] is None, r["comp"]) for r in J.segment_components(s).collect()) == [("h", False, 0), ("h", True, 1), ("v", False, 0)]
