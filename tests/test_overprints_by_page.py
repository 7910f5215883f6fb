"""Overprints are told page by page from numbers: no glyph meets another by a join, and no window is sorted."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from pagestrata import plans
from pagestrata.operators import lines as L


def test_glyphs_are_read_once_and_not_joined(spark):
    plan = plans.QUERIES["dedupe_overprints"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "lag(" not in plan and "ENSURE_REQUIREMENTS" not in plan


def test_pairs_are_all_those_within_reach(monkeypatch):
    dice = random.Random(5)
    n = 400
    text = np.array([dice.randrange(3) for _ in range(n)])
    x, y = (np.array([dice.uniform(-20, 30) for _ in range(n)]) for _ in "xy")
    size = np.array([dice.choice([0.5, 6.0, 12.0]) for _ in range(n)])
    x[7] = np.nan
    ink = np.arange(n)[::2]
    want = {(t, u) for t in ink for u in ink if t != u and text[t] == text[u] and np.hypot(x[t] - x[u], y[t] - y[u]) <= 0.3 * size[t]}
    for portion in (L.PAIRS, 5):
        monkeypatch.setattr(L, "PAIRS", portion)
        found = [(int(a), int(b)) for t, u in L._near_copies(text, ink, x, y, size) for a, b in zip(t, u)]
        assert len(found) == len(set(found)) and want <= set(found) and len(want) > 20


def test_empty_and_null_pages():
    one = lambda *v: [pa.array([c], t) for c, t in zip(v, (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), *[pa.float64()] * 5))]
    assert L._told_of_page(*one(1, "a", None, False, False, 1.0, 1.0, 9.0, 1.0, 0.0)).tolist() == [1]
    assert L._told_of_page(*one(1, None, None, None, None, None, None, None, None, None)).tolist() == [1]
