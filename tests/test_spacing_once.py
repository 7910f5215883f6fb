"""Spacing of pages: glyphs are read and sorted once."""

from __future__ import annotations

from pagestrata import plans
from tests.test_counted_glyphs import FOLDER, nodes


def test_spacing_sorts_glyphs_once(spark):
    df = plans.QUERIES["spacing_stats"](spark, FOLDER)
    assert len(nodes(df, "Exchange")) == 1 and len(nodes(df, "Window")) == 1 and not nodes(df, "SortMergeJoin")
