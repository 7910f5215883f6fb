"""Shuffles of glyphs and cells: pages are dealt as texts, before they are cut into characters; no such side is held whole."""

from __future__ import annotations

import pytest

from pagestrata import plans
from pagestrata.sources import derived

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["attach_links", "decorate", "dedupe_overprints", "replace_spans", "split_tabs", "content_chunks", "style_runs", "visible_glyphs", "spacing_stats", "line_features", "ink_f1"])
def test_characters_are_not_shuffled(spark, name):
    plan = plan_of(plans.QUERIES[name](spark, FOLDER))
    dealt = [line.strip(" :+-")[:60] for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange SinglePartition" in line]
    assert dealt and "ENSURE_REQUIREMENTS" not in plan


def test_parts_grow_with_the_stored_documents(spark, monkeypatch):
    parts = lambda: derived.glyphs(spark, FOLDER).rdd.getNumPartitions()
    assert parts() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(derived, "TASK_BYTES", 1 << 12)
    assert parts() > 2 * spark.sparkContext.defaultParallelism
