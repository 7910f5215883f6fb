"""Style scores: words are never dealt by their family, of which one may hold most of them, however large the table."""

from __future__ import annotations

import pytest

from pagestrata import plans


@pytest.mark.parametrize("name", ["top_mismatches", "style_agreement"])
def test_words_are_not_dealt_by_family(spark, name):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table too large to be held
    try:
        plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert not any("family" in line for line in joins) and "BroadcastHashJoin" in plan
