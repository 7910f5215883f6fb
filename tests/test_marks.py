"""Marks inside tables, by literal cases."""

from pagestrata.operators import tables as J

KEY = "doc_id int, page_no int, table_no int"
FILL = "doc_id int, page_no int, mark_no long, x double, y double, w double, h double, color string, opacity double"
RULE = "doc_id int, page_no int, mark_no long, x1 double, y1 double, x2 double, y2 double, width double, color string, style string"


def frames(spark, fills=(), rules=()):
    tables = spark.createDataFrame([(1, 0, 0, 100.0, 100.0, 200.0, 60.0), (1, 0, 1, 90.0, 90.0, 300.0, 300.0)], KEY + ", x double, y double, w double, h double")
    xs = spark.createDataFrame([(1, 0, 0, v) for v in (100.0, 200.0, 300.0)] + [(1, 0, 1, v) for v in (90.0, 390.0)], KEY + ", pos double")
    ys = spark.createDataFrame([(1, 0, 0, v) for v in (100.0, 130.0, 160.0)] + [(1, 0, 1, v) for v in (90.0, 390.0)], KEY + ", pos double")
    text = spark.createDataFrame([(1, 0, 212.0, 136.0, 10.0, 8.0)], "doc_id int, page_no int, x double, y double, w double, h double")
    return tables, xs, ys, spark.createDataFrame([(1, 0, *f) for f in fills], FILL), text, spark.createDataFrame([(1, 0, *r) for r in rules], RULE)


def marks(spark, **given):
    rows = J.loose_marks(*frames(spark, **given)).collect()
    return {(r["kind"], r["mark_no"]): (r["table_no"], r["row"], r["col"], r["under_text"]) for r in rows}


def test_fills_off_the_grid(spark):
    fills = [
        (1, 100.0, 100.0, 100.0, 30.0, "FF0000", 1.0),  # a cell's background
        (2, 210.0, 135.0, 14.0, 10.0, "FF0000", 1.0),  # a badge with a word on it
        (3, 110.0, 105.0, 20.0, 5.0, "FFFFFF", 1.0),  # white
        (4, 110.0, 105.0, 20.0, 5.0, "00FF00", 0.02),  # hardly there
        (5, 110.0, 105.0, 1.0, 1.0, "00FF00", 1.0),  # too small
        (6, 100.0, 102.4, 100.0, 27.6, "00FF00", 1.0),  # within 2.5 of the lines
        (7, 100.0, 102.6, 100.0, 27.4, "00FF00", 1.0),  # not within
        (8, 320.0, 200.0, 10.0, 10.0, "00FF00", 1.0),  # only the larger table holds it
        (9, 500.0, 500.0, 10.0, 10.0, "00FF00", 1.0),  # outside
    ]
    assert marks(spark, fills=fills) == {("fill", 2): (0, 1, 1, True), ("fill", 7): (0, 0, 0, False), ("fill", 8): (1, 0, 0, False)}


def test_rules_off_the_grid(spark):
    rules = [
        (1, 100.0, 130.0, 300.0, 130.0, 1.0, "000000", None),  # a border
        (2, 290.0, 115.0, 110.0, 115.0, 1.0, "000000", None),  # a separator, drawn from the right
        (3, 110.0, 115.0, 290.0, 115.0, 1.0, "000000", "dashed"),
        (4, 110.0, 115.0, 290.0, 119.0, 1.0, "000000", None),  # slanted
        (5, 250.0, 132.0, 250.0, 158.0, 0.0, "000000", None),  # upright, no width: a quarter point
        (6, 202.4, 101.0, 202.4, 159.0, 1.0, "000000", None),  # within 2.5 of a line between columns
        (7, 110.0, 130.0, 290.0, 130.4, 1.0, "000000", None),  # level within half a point, on a border
        (8, 217.0, 136.0, 217.0, 144.0, 9.0, "FFFFFF", None),  # thick, with a word on it; white counts
        (9, 50.0, 115.0, 250.0, 115.0, 1.0, "000000", None),  # sticks out of both tables
    ]
    assert marks(spark, rules=rules) == {("rule", 2): (0, 0, 0, False), ("rule", 5): (0, 1, 1, False), ("rule", 8): (0, 1, 1, True)}


def test_empty_and_missing_input(spark):
    tables, xs, ys, fills, text, rules = frames(spark)
    assert J.loose_marks(tables, xs, ys, fills, text, rules).count() == 0
    fills = frames(spark, fills=[(1, 110.0, 105.0, 20.0, 5.0, "00FF00", 1.0), (1, 110.0, 105.0, 20.0, 5.0, "00FF00", 1.0)])[3]
    found = J.loose_marks(tables, xs.limit(0), ys.limit(0), fills, text).collect()  # repeated row; no lines known
    assert [(r["mark_no"], r["table_no"], r["row"], r["col"]) for r in found] == [(1, 0, None, None)]


def test_documents_that_look_scanned(spark):
    from pagestrata.operators import ocr as O

    pages = [(d, p, True, b) for d, b in ((1, 200_000), (2, 200_000), (3, 50_000), (4, 102_400), (5, None), (6, 200_000)) for p in range(4)]
    words = [(1, 3, "x" * 19), (2, 0, "y" * 399), (2, 3, "z"), (3, 0, "w" * 20), (4, 0, None), (6, 2, "z" * 20)]
    given = spark.createDataFrame(pages, "doc_id int, page_no int, drawn boolean, bytes long"), spark.createDataFrame(words, "doc_id int, page_no int, text string")
    told = lambda df: {r["doc_id"]: (r["pages"], r["chars"], r["has_text"], r["looks_scanned"], r["level"]) for r in df.collect()}
    light = (False, "light")
    assert told(O.scanned_documents(*given)) == {1: (4, 19, False, True, "strong"), 2: (4, 400, True, *light), 3: (4, 20, True, *light), 4: (4, 0, False, *light), 5: (4, 0, False, *light), 6: (4, 20, True, True, "balanced")}
    assert told(O.scanned_documents(*given, first=3))[1] == (4, 0, False, True, "strong")
    assert O.scanned_documents(given[0].limit(0), given[1]).count() == 0
