"""Glyphs are counted where they stand before anything of a line or page is gathered; results are those of the glyphs themselves."""

from __future__ import annotations

import random

import pytest

from pagestrata import plans
from pagestrata.operators import lines as L

FOLDER = "/root/testdata/sf0.001"


def nodes(df, name):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if line.strip(" :+-").startswith(name)]


@pytest.mark.parametrize("name", ["line_features", "turned_features"])
def test_lines_gather_kinds_of_glyphs(spark, name):
    df = plans.QUERIES[name](spark, FOLDER)
    assert any("partial_sum(length(text" in line for line in nodes(df, "HashAggregate")) and not any("length(text" in line for line in nodes(df, "ObjectHashAggregate"))


def test_features_by_hand(spark):
    draw = random.Random(3)
    rows = [(1, 0, n // 30, n, "x" * draw.randint(1, 2), draw.random() < 0.2, float(n % 30 * 6), 100.0 + draw.choice([0, 0, 0.25, -4, 3]), draw.choice([10.0, 10.1, 6.0, 12.0]), 6.0, 5.0) for n in range(600)]
    names = "doc_id long, page_no int, line_no int, seq int, text string, ws boolean, x double, y double, size double, adv double, ink double"
    glyphs = spark.createDataFrame(draw.sample(rows, len(rows)), names)
    for r in L.line_features(glyphs).collect():
        g = [x for x in rows if x[2] == r["line_no"] and not x[5]]
        quarter = lambda x: int(x[8] * 4 + 0.5) / 4
        size = max((sum(len(x[4]) for x in g if quarter(x) == q), q) for q in map(quarter, g))[1]
        ys = sorted(x[7] for x in g if abs(x[8] - size) <= 0.12 * size)
        base = ys[(len(ys) - 1) // 2]
        small = [x[7] - base for x in g if x[8] <= 0.88 * size]
        want = (size, base, sum(v < -0.12 * size for v in small), sum(v > 0.08 * size for v in small), min(x[6] for x in g), max(x[6] for x in g) + 5, len(g))
        assert tuple(r)[3:] == want
    (stats,) = L.spacing_stats(glyphs).collect()
    spaces = positional = 0
    held, last = False, None
    for _, _, _, _, _, ws, x, y, size, _, ink in rows:
        if ws:
            held = True
            continue
        if last:
            gap, off, big, least = x - last[0] - last[3], abs(y - last[1]), max(size, last[2]), min(size, last[2])
            near = (off <= 0.12 * last[2] or (least <= 0.85 * big and off <= 0.6 * big)) and -0.3 * size < gap < 1.5 * size
            spaces, positional = spaces + (near and held), positional + (near and not held and gap > 0.2 * size)
        held, last = False, (x, y, size, ink)
    ems = sorted(r[9] / r[8] for r in rows if r[5])
    assert (stats["space_gaps"], stats["positional"], stats["em"]) == (spaces, positional, ems[len(ems) // 2])
