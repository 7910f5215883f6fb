"""The registered queries give the word gaps of pieces to ``group_lines``, so that its last stage can join what it is for."""

from __future__ import annotations

import pytest

from pagestrata import plans
from pagestrata.operators import lines as L
from pagestrata.operators import pieces


@pytest.mark.parametrize("name", ["group_lines", "turned_lines"])
def test_queries_join_pieces_by_their_word_gaps(spark, name, monkeypatch):
    given = []
    held = pieces.group_lines
    monkeypatch.setattr(L, "group_lines", lambda boxes, stats, gaps=None: given.append(gaps) or held(boxes, stats, gaps))
    plans.QUERIES[name](spark, "/root/testdata/sf0.001").schema
    assert len(given) == 1 and given[0] is not None and "gaps" in given[0].columns


def test_no_gaps_no_stage(spark, monkeypatch):
    monkeypatch.setattr(pieces, "_rejoined", lambda p: 1 / 0)
    boxes = spark.createDataFrame([(1, 0, c, u, u + 9.0, 100.0 * (c > 1), 10.0, 1.0, 0.0, False) for c, u in enumerate((50.0, 99.0, 0.0))], "doc_id int, page_no int, chunk int, u0 double, u1 double, base double, size double, dx double, dy double, invisible boolean")
    stats = spark.createDataFrame([(1, 0, 1.0)], "doc_id int, page_no int, limit double")
    assert sorted((r["chunk"], r["line"]) for r in pieces.group_lines(boxes, stats).collect()) == [(0, 0), (1, 1), (2, 2)]
