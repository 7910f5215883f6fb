"""Shifts: raster rows travel as bytes of ink, pages are solved in batches."""

from __future__ import annotations

import random

import numpy as np

from pagestrata import plans
from pagestrata.operators import metrics as M

PAGE = ["doc_id", "page_no"]


def test_greys_are_not_shuffled_twice(spark):
    plan = plans.QUERIES["best_shift"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan and "substring" not in plan


def test_pages_with_one_side_or_none_of_ink(spark):
    draw, rows, masks = random.Random(5), ([], []), {}
    for page in range(300):
        for side in (0, 1):
            for y in range(draw.randint(1, 9)) if page % 7 or side else ():
                g = [draw.choice([0, 169, 170, 255]) if page % 5 else 255 for _ in range(draw.randint(0, 12))]
                rows[side].append((page // 9 or None, page % 9, y, g))
                masks.setdefault((page // 9 or None, page % 9), []).append((side, y, g))
    a, b = (spark.createDataFrame(draw.sample(r, len(r)), "doc_id long, page_no int, y int, greys array<int>") for r in rows)
    got = {tuple(r)[:2]: tuple(r)[2:] for r in M.best_shift(a, b, PAGE, 3).collect()}
    want = {}
    for key, page in masks.items():
        ink = np.zeros((2, max(y for _, y, _ in page) + 1, max(len(g) for _, _, g in page)), bool)
        for side, y, g in page:
            ink[side, y, : len(g)] = np.array(g, int) < 170
        want[key] = M.shift_of(ink[0], ink[1], 3)
    assert got == want
