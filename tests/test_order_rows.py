"""Order of n-grams: found row by row, without a shuffle, as by brute force."""

from __future__ import annotations

import random

from pagestrata import plans
from pagestrata.operators import metrics as M


def by_hand(a, b, enough=20):
    for n in (3, 2, 1):
        x, y = ([tuple(t[i : i + n]) for i in range(len(t) - n + 1)] for t in (a, b))
        at = [y.index(g) for g in x if x.count(g) == 1 and y.count(g) == 1]
        if len(at) >= enough:
            break
    best = [0] * len(at)
    for i in range(len(at)):
        best[i] = 1 + max([best[j] for j in range(i) if at[j] < at[i]], default=0)
    return n, len(at), max(best, default=0)


def test_order_score_by_hand(spark):
    draw = random.Random(4)
    rows = [(1, None, ["a"]), (2, ["a", "b"], ["b"]), (3, ["a b", "c"], ["a", "b c"])]
    for i in range(4, 40):
        a = [draw.choice("abcdefghijklmnopqrstuvwxyz") + draw.choice("xyz ") for _ in range(draw.randint(0, 60))]
        b = [t for t in a if draw.random() > 0.1]
        at = draw.randint(0, len(b))
        rows.append((i, a, b[at:] + b[:at]))
    found = M.order_score(spark.createDataFrame(rows, "id bigint, a array<string>, b array<string>"), "a", "b", "id").collect()
    want = {i: by_hand(a or [], b or []) for i, a, b in rows}
    assert len(found) == len(rows)
    for r in found:
        n, anchors, rising = want[r.id]
        assert (r.n, r.anchors) == (n, anchors) and (r.score is None if not anchors else abs(r.score - rising / anchors) <= 5.1e-5)


def test_nothing_is_shuffled(spark):
    plan = plans.QUERIES["order_score"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
