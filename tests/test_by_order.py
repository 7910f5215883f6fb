"""Shuffles of drawn tables: line items are dealt by order before they are cut into cells, bands or pieces of rules."""

from __future__ import annotations

import pytest

from pagestrata import plans
from pagestrata.operators import graphics
from pagestrata.sources import derived

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["merge_strips", "loose_marks", "merge_dashes", "grid_lines"])
def test_drawn_rows_are_not_shuffled(spark, name):
    plan = plan_of(plans.QUERIES[name](spark, FOLDER))
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan and "Broadcast" not in plan


def test_parts_grow_with_the_rows(spark, monkeypatch):
    parts = lambda: derived.rule_pieces(spark, FOLDER).rdd.getNumPartitions()
    assert parts() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(derived, "TASK_ITEMS", 100)
    assert parts() > 2 * spark.sparkContext.defaultParallelism


def test_strips_along_both_directions(spark):
    grey = lambda k: f"{40 + 10 * k:02X}" * 3
    across = [(1, 0, 10 + k, 5.0 * k, 0.0, 5.0, 16.0, grey(k), 1.0) for k in range(7)]
    down = [(1, 0, 30 + k, 100.0, 50.0 + 5 * k, 16.0, 5.0, grey(k % 6), 0.5) for k in range(6)]
    few = [(1, 0, 50 + k, 5.0 * k, 200.0, 5.0, 16.0, grey(k), 1.0) for k in range(5)]
    df = spark.createDataFrame(across + down + few, "doc_id bigint, page_no int, paint_order int, x double, y double, w double, h double, color string, opacity double")
    got = sorted((r.n, r.x, r.y, r.w, r.h, r.color, r.opacity, r.paint_order, r.gradient) for r in graphics.merge_strips(df).collect())
    assert got == [(6, 100.0, 50.0, 16.0, 30.0, "414141", 0.5, 35, True), (7, 0.0, 0.0, 35.0, 16.0, "464646", 1.0, 16, True)]


def test_table_match_shuffles_choices_alone(spark):
    plan = plan_of(plans.QUERIES["table_match"](spark, FOLDER))
    back = [line for line in plan.splitlines() if "ENSURE_REQUIREMENTS" in line]
    assert "MapInPandas" not in plan and "Broadcast" not in plan and len(back) <= 2
