"""Targets of several pages under one id: the registered ids repeat from the tenth page of a document on."""

from __future__ import annotations

from pagestrata import plans
from tests import oracle_check


def test_ids_of_long_documents_agree_with_sql(spark, tmp_path):
    line = " ".join(["the then en", "enen other then the"])
    long = "\n".join([f"{'the ' * (n % 3)}{line} th{n % 7}" for n in range(1200)])
    rows = [(d, long if d % 2 == 0 else long.replace("other", "en the") + "\nthe", "en", "s", 1) for d in range(4)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in plans.QUERIES["locate_edits"](spark, str(tmp_path)).collect())
    con = oracle_check.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(plans.SQL["locate_edits"]).fetchall(), key=str)
    assert sorted(got, key=str) == want
    assert {"text mismatch", "width mismatch"} <= {r[2] for r in got}


def test_pages_of_one_id_are_read_by_place_then_page(spark):
    from pagestrata.operators import edits as E

    glyphs = [(1, p, at + i, ch, False, 6.0 * (at + i), 0.0, 1.0, 0.0, 12.0, 6.0) for p, at in ((0, 0), (1, 2), (2, 10), (3, 1)) for i, ch in enumerate("the")]
    g = spark.createDataFrame(glyphs, "doc_id int, page_no int, seq int, text string, ws boolean, x double, y double, dx double, dy double, size double, adv double")
    edits = [(e, 1, p, 6.0 * at, 0.0, 1.0, 0.0, 18.0, 12.0, "the") for e, p, at in ((1, 0, 0), (1, 1, 2), (2, 0, 0), (2, 2, 10), (3, 1, 2), (4, 1, 2), (4, 3, 1))]
    t = spark.createDataFrame(edits, "edit_id int, doc_id int, page_no int, x double, y double, ux double, uy double, w double, size double, old string")
    got = sorted((r["edit_id"], r["reason"], r["copies"]) for r in E.locate_edits(t, g).collect())
    assert got == [(1, "width mismatch", None)] * 2 + [(2, "width mismatch", None)] * 2 + [(3, None, 1)] + [(4, "text mismatch", None)] * 2
