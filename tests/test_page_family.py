"""Faces of pages: words are measured where they stand, not once for each face; odd widths; whole groups of sorted batches."""

from __future__ import annotations

import math
import statistics

import pyarrow as pa

from pagestrata import plans
from pagestrata.operators import ocr
from pagestrata.operators.common import starts, whole_groups

FACES = {"Times New Roman": {"a": 0.25, "b": 0.5, "m": 0.75}, "Arial": {"a": 0.21875, "b": 0.5625, "m": 0.828125}, "Courier New": {"a": 0.59375, "b": 0.59375, "m": 0.59375}}


def by_hand(words):
    """The face of one page: (line, text, width, confidence) of its words."""
    spread = []
    for rank, (family, em) in enumerate(FACES.items()):
        of: dict = {}
        for line, text, w, conf in words:
            if text is not None and len(text) >= 2 and conf >= 60 and all(c in em for c in text):
                of.setdefault(line, []).append(None if w is None else w / (sum(em[c] for c in text) - 0.05))
        devs, n = [], 0
        for vs in of.values():
            seen = [v for v in vs if v is not None]
            if len(vs) >= 2:
                n += len(vs)
                middle = statistics.median(seen) if seen else 0
                devs += [abs(math.log(v / middle)) for v in seen if middle and v / middle > 0]
        spread.append((sum(devs) / len(devs) if devs else None, rank, family, n))
    if any(s[0] is None for s in spread) or min(s[3] for s in spread) < 4:
        return "Arial"
    spread.sort()
    return spread[0][2] if spread[1][0] >= 1.25 * spread[0][0] else "Arial"


def test_faces_of_odd_pages(spark):
    pages = {}
    for k, (family, em) in enumerate(FACES.items()):
        wide = lambda t: 12 * (sum(em[c] for c in t) - 0.05) * 1.001 ** len(t)  # noqa: B023, E731
        clean = [(n % 3, t, wide(t), 90) for n, t in enumerate(["abm", "mmb", "aab", "bbbm", "amam", "mm", "abba", "bm", "mab"])]
        pages[k] = clean
        pages[10 + k] = [*clean, (0, "ab", None, 90), (1, "ééé", 5.0, 90), (1, None, 5.0, 90), (2, "b", 400.0, 90), (2, "mm", 400.0, 10)]
        pages[20 + k] = [*clean, (7, "ab", 0.0, 90), (7, "mm", 0.0, 90), (8, "am", -3.0, 90), (8, "am", 9.0, 90), (8, "mb", 9.0, 90)]
    pages[30] = [(0, "ab", 9.0, 90), (0, "ba", 9.0, 90)]
    pages[31] = [(0, None, 9.0, 90), (None, "a", None, 90)]
    rows = [(p, 0, line, t, 3.0, None if w is None else 3.0 + w, c) for p, ws in pages.items() for line, t, w, c in ws]
    words = spark.createDataFrame(rows, "doc_id long, page_no int, line int, text string, x0 double, x1 double, confidence int").repartition(3)
    widths = spark.createDataFrame([(f, c, e) for f, em in FACES.items() for c, e in em.items()], "family string, ch string, em double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {r["doc_id"]: r["family"] for r in ocr.page_family(words, widths).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {p: by_hand(ws) for p, ws in pages.items()} and set(got.values()) == set(FACES)
    assert ocr.page_family(words.filter("false"), widths).count() == 0


def test_words_are_sorted_once_and_not_multiplied(spark):
    plan = plans.QUERIES["page_family"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Generate explode") == 0 and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_line_medians_are_sorted_lists(spark):
    plan = plans.QUERIES["ocr_baseline"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and plan.count("Exchange hashpartitioning") == 1
    rows = [(1, 0, k, t, 10.0, b) for k, words in enumerate([[("acen", 22.0), ("moru", 20.0), ("sx", 21.0), ("zz", 25.0)], [("acen", 22.0), ("gy", 24.0)], [("--", 9.0), (None, 8.0)], [("acen", None), ("moru", 20.0), ("sx", 21.0)]]) for t, b in words]
    words = spark.createDataFrame(rows, "doc_id int, page_no int, line int, text string, top double, bottom double")
    got = {r["line"]: r["baseline"] for r in ocr.ocr_baseline(words).collect()}
    assert got[0] == 21.5 and abs(got[1] - (22.0 + 24.0 - 14 * 0.21 / 0.7) / 2) < 1e-9 and got[2] is None and got[3] == 20.5


def test_whole_groups():
    keys = [None, None, 1, 1, 1, 1, 1, 2, 3, 3]
    for size in (1, 2, 3, 4, 10):
        cut = [pa.RecordBatch.from_pydict({"k": pa.array(keys[i : i + size], pa.int64()), "v": list(range(i, min(i + size, 10)))}) for i in range(0, 10, size)]
        got = list(whole_groups(iter(cut), 1))
        assert [v for b in got for v in b.column(1).to_pylist()] == list(range(10))
        ends = [(b.column(0)[0].as_py(), b.column(0)[b.num_rows - 1].as_py()) for b in got]
        assert all(a[1] != b[0] for a, b in zip(ends, ends[1:]))
        assert [b.column(0)[i].as_py() for b in got for i in starts(b, 1).tolist()] == [None, 1, 2, 3]
    assert list(whole_groups(iter([]), 1)) == []
