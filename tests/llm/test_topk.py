"""Exact top-k search, held against brute force in whole numbers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagestrata.llm import topk


def by_hand(rows, asks, most):
    out = []
    for q, x in rows.items():
        if asks(q):
            found = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y, strict=True)))), k) for k, y in rows.items() if k != q and len(y) == len(x))
            out += [(q, i + 1, k, -s) for i, (s, k) in enumerate(found[:most])]
    return sorted(out)


def test_best():
    rng = np.random.default_rng(1)
    for size in (3, 10**6, 2**60):
        for _ in range(30):
            scores, allowed = rng.integers(-size, size, (5, 30)), rng.random((5, 30)) < 0.6
            want = [(r, c) for r in range(5) for c in sorted((c for c in range(30) if allowed[r, c]), key=lambda c: (-int(scores[r, c]), c))[:4]]
            q, i = topk.best(scores, allowed, 4)
            assert list(zip(q.tolist(), i.tolist(), strict=True)) == want


@pytest.mark.parametrize(("size", "shard", "block"), [(4, 1 << 15, 1 << 13), (1000, 20, 7), (2**40, 50, 50), (2**62, 50, 3)])
def test_search_against_brute_force(spark, size, shard, block):
    """Many vectors alike, so that ties go far beyond k; two lengths; odd rows."""
    rng = random.Random(size)
    same = [rng.randint(-size, size) for _ in range(6)]
    rows = {k: [rng.randint(-size, size) for _ in range(6)] if k % 3 else same for k in range(300)} | {k: [rng.randint(-9, 9) for _ in range(3)] for k in range(300, 310)}
    odd = [(None, same), (500, None), (505, []), (510, [1, None, 1, 1, 1, 1]), (0, rows[0])]
    table = spark.createDataFrame([(k, v, 0, 1.0) for k, v in [*rows.items(), *odd]], "vec_id long, embedding array<long>, rank int, score double").repartition(3)
    found = topk.search(table, F.col("vec_id") % 5 == 0, 20, shard=shard, block=block)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in found.collect()) == by_hand(rows, lambda k: k % 5 == 0, 20)


def test_few_rows_and_none(spark):
    table = spark.createDataFrame([(20, [1, 2]), (1, [3, 4]), (2, [-5, 6])], "vec_id long, embedding array<long>")
    assert sorted(tuple(r) for r in topk.search(table, F.col("vec_id") % 20 == 0).collect()) == [(20, 1, 1, 11), (20, 2, 2, 7)]
    assert topk.search(table.where("false"), F.lit(True)).count() == 0 and topk.search(table, F.lit(False)).count() == 0


def test_scaled(spark):
    rows = [(1, [0.5, -0.01]), (2, None), (3, [1.0, None]), (4, [1.0, math.nan]), (5, [math.inf, 1.0]), (6, [1e300, 1.0]), (7, [])]
    found = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>").where("vec_id <> 6"), "embedding", 64)
    assert {r["vec_id"]: r["embedding"] for r in found.collect()} == {1: [32, -1], 2: None, 3: None, 4: None, 5: None, 7: []}
    assert topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>").where("vec_id = 6"), "embedding", 64).first()["embedding"] is None
