"""Overprinted copies: chains, directions, hidden layers, narrow letters and the blanks of copies; literal cases."""

from __future__ import annotations

from pagestrata.operators import lines as L

GLYPH = "doc_id int, page_no int, seq int, text string, ws boolean, x double, y double, size double, color string, bold boolean, invisible boolean, adv double, ink double, dx double, dy double"


def word(text, seq, x=100.0, y=50.0, step=6.0, hidden=False, color="000000", up=False):
    return [(1, 0, seq + i, c, c == " ", x + step * i, y, 12.0, color, False, hidden, step, step, 0.0 if up else 1.0, 1.0 if up else 0.0) for i, c in enumerate(text)]


def left(spark, rows):
    got = L.dedupe_overprints(spark.createDataFrame(rows, GLYPH).repartition(3)).orderBy("seq").collect()
    return [r["seq"] for r in got], [r["seq"] for r in got if r["bold"]]


def test_chains_keep_the_top_and_hidden_ones_yield(spark):
    pages = [
        (word("cat", 0) + word("cat", 10, 100.3) + word("cat", 20, 100.6), ([20, 21, 22], [20, 21, 22])),
        (word("cat", 0) + word("cat", 10, hidden=True) + word("cat", 20, color="FF0000"), ([20, 21, 22], [])),
        (word("cat", 0, hidden=True) + word("cat", 10, hidden=True), ([10, 11, 12], [])),
        (word("cat", 0) + word("cat", 10, up=True), ([0, 1, 2, 10, 11, 12], [])),
        (word("ii", 0, step=3.0), ([0, 1], [])),
        (word("cat", 0) + word("cat", 10, 105.0), ([0, 1, 2, 10, 11, 12], [])),
    ]
    rows = [(1, n, *r[2:]) for n, (page, _) in enumerate(pages) for r in page]
    got = L.dedupe_overprints(spark.createDataFrame(rows, GLYPH).repartition(3)).collect()
    for n, (_, want) in enumerate(pages):
        mine = sorted((r["seq"], r["bold"]) for r in got if r["page_no"] == n)
        assert ([s for s, _ in mine], [s for s, b in mine if b]) == want


def test_blanks_go_with_the_struck_glyphs_around_them(spark):
    assert left(spark, word("ab cd", 0) + word("ab cd", 10, 101.0, 51.0))[0] == [10, 11, 12, 13, 14]
    assert left(spark, word("a b", 0) + word("a b", 10, 101.0, 51.0))[0] == [0, 1, 2, 10, 11, 12]  # no neighbour tells
    assert left(spark, word("ab  ", 0) + word("ab ", 10, 101.0, 51.0))[0] == [3, 10, 11, 12]
    assert left(spark, word(" ab", 0) + word("xab", 10, 101.0, 51.0))[0] == [10, 11, 12]
