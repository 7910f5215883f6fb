"""Groups as lists: cut at batch ends, null keys, one call a group; operators on them make no pandas table a group."""

from __future__ import annotations


from pagestrata.operators import graphics, tables
from pagestrata.operators.common import grouped_rows


def test_groups_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(k, v) for k, n in ((None, 5), (1, 7), (2, 1), (1 << 60, 4)) for v in range(n)]
        df = spark.createDataFrame(rows, "k bigint, v int").repartition(5)
        got = grouped_rows(df, ["k"], lambda g: [(g["k"][0], len(g["v"]), sum(g["v"]))], "k bigint, n int, total int").collect()
        assert sorted(map(tuple, got), key=str) == sorted([(None, 5, 10), (1, 7, 21), (2, 1, 0), (1 << 60, 4, 6)], key=str)
        assert grouped_rows(df.filter("false"), ["k"], lambda g: [(0,)], "k bigint").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_small_groups_make_no_pandas_tables(spark):
    t = spark.createDataFrame([(1, 0, n, 10.0 * n, 0.0, 12.0, 10.0) for n in range(4)], "doc_id int, page_no int, table_no int, x double, y double, w double, h double")
    s = spark.createDataFrame([(1, 0, "h", 0.0, 0.0, 9.0, True), (1, 0, "v", 0.0, 0.0, 9.0, True), (1, 0, "h", 90.0, 0.0, 9.0, True)], "doc_id int, page_no int, dir string, pos double, a double, b double, ruled boolean")
    px = spark.createDataFrame([(1, 255, 255, 255)] * 5 + [(1, 0, 0, 0)], "doc_id int, r int, g int, b int")
    plans = [tables.pick_tables(t), tables.segment_components(s), tables.absorb_inner(tables.segment_components(s)), graphics.two_colors(px, ["doc_id"])]
    assert [p._jdf.queryExecution().executedPlan().toString().count("MapInPandas") for p in plans] == [0] * 4
    assert sorted(r["table_no"] for r in plans[0].collect()) == [0, 1, 2, 3]
    assert sorted((r["dir"], r["pos"], r["comp"]) for r in plans[1].collect()) == [("h", 0.0, 0), ("h", 90.0, 1), ("v", 0.0, 0)]
    assert [tuple(r) for r in plans[3].collect()] == [(1, "FFFFFF", "000000")]


def test_cells_are_lists_and_dealt_once(spark):
    from pagestrata import plans
    from pagestrata.operators import plug

    plan = plans.QUERIES["map_cells"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and plan.count("Exchange hashpartitioning") == 1
    df = spark.createDataFrame([(1, 0, "b"), (1, 0, "a"), (1, None, "c"), (2, 0, None)], "doc_id int, row_no int, text string").repartition(3)
    got = plug.map_cells(df, lambda g: [(g["doc_id"][0], g["row_no"][0], len(g["text"]))], "doc_id int, row_no int, n int", ["doc_id", "row_no"]).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 0, 2), (1, None, 1), (2, 0, 1)]
