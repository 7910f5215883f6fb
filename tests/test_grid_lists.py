"""Grids: a component's segments are read as one list; edges are those found pair by pair."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pagestrata import plans
from pagestrata.operators import tables as J


def test_grid_is_not_joined_segment_by_segment(spark):
    for name, joins in (("grid_lines", 0), ("grid_of", 1)):
        plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and sum("Join" in line for line in plan.splitlines()) <= joins and "ENSURE_REQUIREMENTS" not in plan


def test_edges_pair_by_pair(spark, monkeypatch):
    draw, segs = random.Random(7), []
    for doc in range(40):
        for _ in range(draw.randint(1, 25)):
            a = draw.randint(0, 40) * 2.5
            segs.append((doc, 0, doc % 2, draw.choice("hv"), draw.randint(0, 40) * 2.5, a, a + draw.randint(1, 30) * 2.5, draw.random() < 0.6))
    table = spark.createDataFrame(segs, "doc_id long, page_no int, comp int, dir string, pos double, a double, b double, ruled boolean").cache()
    lines = J.grid_lines(table).cache()
    at = {}
    for r in lines.orderBy("line_no").collect():
        at.setdefault(r["doc_id"], {"h": [], "v": []})[r["dir"]].append(r["pos"])
    want = set()
    for doc, sides in at.items():
        for d, across in (("h", "v"), ("v", "h")):
            for i, pos in enumerate(sides[d]):
                for j, (lo, hi) in enumerate(zip(sides[across], sides[across][1:])):
                    near = [s for s in segs if s[0] == doc and s[3] == d and abs(s[4] - pos) <= J.TOUCH]
                    covered, reach = 0.0, lo
                    for x, y in sorted((max(s[5], lo), min(s[6], hi)) for s in near):
                        covered, reach = covered + max(0.0, y - max(x, reach)), max(reach, y)
                    drawn = bool(near) and covered >= 0.6 * (hi - lo) - 0.5
                    rule = any(s[7] and min(s[6], hi) - max(s[5], lo) >= 0.5 * (hi - lo) - 0.5 for s in near)
                    want.add((doc, 0, doc % 2, d, i, j, pos, drawn, drawn and rule))
    for most in (J.EDGES, 1):
        monkeypatch.setattr(J, "EDGES", most)
        assert {tuple(r) for r in J.grid_edges(table, lines).collect()} == want and want
    alone = J.grid_edges(table.filter("false"), lines).filter(F.col("drawn") | F.col("ruled"))
    assert alone.isEmpty() and J.grid_lines(table.filter("false")).isEmpty() and J.grid_edges(table, lines.filter("false")).isEmpty()
