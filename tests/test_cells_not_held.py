"""Cells are many more than what they are read from: no join of cell_attributes holds a side whole on the driver."""

from __future__ import annotations

from pagestrata import plans


def test_no_side_is_broadcast(spark):
    plan = plans.QUERIES["cell_attributes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
