"""Folds of pages and regions over lists: texts are dealt once, no pandas table a group, missing measures count as unmeasured."""

from __future__ import annotations

import pytest

from pagestrata import plans
from pagestrata.operators import layout as H

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["group_paragraphs", "zones"])
def test_lines_are_dealt_once_and_fold_as_lists(spark, name):
    plan = plans.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_paragraphs_of_unmeasured_rows(spark):
    row = lambda doc, n, y, **o: {"doc_id": doc, "page_no": 0, "region_no": None, "row_no": n, "text": "Some words that fill it", "x0": 72.0, "x1": 500.0, "baseline": y, "size": 12.0, "bold": False, "first_w": 60.0, "marked": False, "text_x": None, "tabs": 0, "tab_x": None, "stack": None, "left": 72.0, "wrap_right": 540.0, "leading": 1.2} | o
    rows = [row(1, 2, 128.0), row(1, 0, 100.0), row(1, 1, 114.0), row(1, 3, None), row(2, 0, 100.0, bold=None), row(2, 1, 114.0, x0=None, bold=None), row(2, 2, 170.0, marked=True)]
    kinds = "doc_id int, page_no int, region_no int, row_no int, text string, x0 double, x1 double, baseline double, size double, bold boolean, first_w double, marked boolean, text_x double, tabs int, tab_x double, stack int, left double, wrap_right double, leading double"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], kinds).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = H.group_paragraphs(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["doc_id"], r["row_no"], r["para_id"], r["keep_lines"]) for r in got) == [(1, 0, 0, False), (1, 1, 0, False), (1, 2, 0, False), (1, 3, 0, False), (2, 0, 0, False), (2, 1, 0, False), (2, 2, 1, False)]
