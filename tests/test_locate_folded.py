"""Targets and glyphs are compared after compatibility folding, and by number where a character is unknown."""

from __future__ import annotations

from pagestrata import plans
from pagestrata.operators import edits as E
from tests import oracle_check

GLYPH = "doc_id int, page_no int, seq int, text string, ws boolean, x double, y double, dx double, dy double, size double, adv double"
EDIT = "edit_id int, doc_id int, page_no int, x double, y double, ux double, uy double, w double, size double, old string"


def found(spark, chars, old):
    g = spark.createDataFrame([(1, 0, i, c, c == " ", 6.0 * i, 0.0, 1.0, 0.0, 12.0, 6.0) for i, c in enumerate(chars)], GLYPH)
    t = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 1.0, 0.0, 6.0 * len(chars), 12.0, old)], EDIT)
    return [(r["ok"], r["reason"], r["copies"]) for r in E.locate_edits(t, g).collect()]


def test_unknown_characters_are_counted(spark):
    assert found(spark, ["t", None, "e"], "the") == [(True, None, 1)]
    assert found(spark, ["t", None, " ", "e"], "th e") == [(True, None, 1)]
    assert found(spark, ["t", None, "e", "n"], "the") == [(False, "text mismatch", None)]


def test_the_query_folds_what_it_compares(spark, tmp_path):
    spark.createDataFrame([(1, "the thﬁn then thª", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    plan = plans.QUERIES["locate_edits"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
    got = sorted(map(tuple, plans.QUERIES["locate_edits"](spark, str(tmp_path)).collect()))
    con = oracle_check.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(plans.SQL["locate_edits"]).fetchall())
