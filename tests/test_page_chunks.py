"""Chunks in one reading: equal to the four operators step by step, on crowded pages of every kind of glyph."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pagestrata import plans
from pagestrata.operators import lines as L
from tests.test_pieces import GLYPH

PAGE = ["doc_id", "page_no"]


def glyphs(pages):
    dice, out = random.Random(3), []
    for page in range(pages):
        u, v, step = 50.0, 100.0, 5.0
        for seq in range(160):
            kind = dice.random()
            if kind < 0.05:
                u, v = 50.0, v + dice.choice([1.0, 12.0])
            elif kind < 0.2:
                u += dice.choice([2.0, 4.0, 5.0, 9.0, -4.0, 30.0])
            ws = dice.random() < 0.15
            text = " " if ws else dice.choice(["a", "b", ""] if page % 2 else ["a"])
            size = dice.choice([10.0, 10.0, 10.0, 6.0, 0.0]) if page % 3 == 0 else 10.0
            out.append((page // 4, page, seq, text, ws, u, v + dice.choice([0.0, 0.0, 0.5]), size, step, 0.0 if ws else step, 1.0, 0.001 * dice.choice([0, 0, 0, 1, 4]), dice.random() < 0.03))
            u += step + (3.0 if page % 5 == 1 else 0.0)
    return out + [(9, 0, 0, " ", True, 5.0, 5.0, 10.0, 5.0, 0.0, 1.0, 0.0, False), (9, 1, 0, "a", False, None, 5.0, 10.0, 5.0, 5.0, 1.0, 0.0, False)]


def test_one_reading_equals_the_steps(spark):
    g = spark.createDataFrame(glyphs(24), GLYPH).repartition(3).cache()
    stats = L.spacing_stats(g)
    chunks = L.content_chunks(g, stats)
    gaps = L.word_gaps(g, chunks).withColumn("gaps", F.array_sort("gaps"))
    want = L.chunk_boxes(g, chunks).join(gaps, [*PAGE, "chunk"]).join(stats.select(*PAGE, "limit"), PAGE)
    got = L.page_chunks(g).withColumn("gaps", F.array_sort("gaps"))
    a, b = (sorted(map(tuple, df.select(got.columns).collect()), key=str) for df in (got, want))
    assert a == b and len(a) > 300
    assert L.page_chunks(g.filter("false")).count() == 0


def test_glyphs_are_read_once(spark):
    plan = plans.QUERIES["content_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Window" not in plan
