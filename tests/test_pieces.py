"""Chunks, lines and rows on text of every direction, hidden copies, raised marks and justified pieces; literal cases."""

from __future__ import annotations

import math

import pytest

from pagestrata.operators import lines as L

GLYPH = "doc_id long, page_no int, seq int, text string, ws boolean, x double, y double, size double, adv double, ink double, dx double, dy double, invisible boolean"


def typed(text, u, v, seq, size=10.0, step=5.0, angle=0.0, hidden=False, gap=None):
    """Glyphs of a text from (u, v) on in a frame turned by angle; blanks are space glyphs unless gap tells their width."""
    dx, dy = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    out = []
    for c in text:
        if c == " " and gap is not None:
            u += gap
            continue
        ws = c == " "
        out.append((1, 0, seq, c, ws, u * dx - v * dy, u * dy + v * dx, float(size), float(step), 0.0 if ws else float(step), dx, dy, hidden))
        u, seq = u + step, seq + 1
    return out


def lined(spark, glyphs, limit=1.0, rejoin=False):
    g = spark.createDataFrame(glyphs, GLYPH).repartition(3)
    stats = spark.createDataFrame([(1, 0, limit)], "doc_id long, page_no int, limit double")
    chunks = L.content_chunks(g, stats)
    boxes = L.chunk_boxes(g, chunks)
    lines = L.group_lines(boxes, stats, L.word_gaps(g, chunks) if rejoin else None)
    read = {}
    for r in g.join(chunks, ["doc_id", "page_no", "seq"]).join(lines, ["doc_id", "page_no", "chunk"]).orderBy("seq").collect():
        read[r["line"]] = read.get(r["line"], "") + r["text"]
    return [read[k] for k in sorted(read)], L.line_boxes(boxes, lines)


@pytest.mark.parametrize("angle", [0, 45, 90, 180, -90, 12.5])
def test_lines_in_every_direction(spark, angle):
    glyphs = typed("one two", 50, 100, 0, angle=angle) + typed("three", 50, 115, 20, angle=angle) + typed("far", 200, 100, 40, angle=angle)
    found, boxes = lined(spark, glyphs)
    assert found == ["one two", "far", "three"]
    assert sorted((round(r["u0"], 6), round(r["u1"], 6), round(r["base"], 6)) for r in boxes.collect()) == [(50, 75, 115), (50, 85, 100), (200, 215, 100)]


def test_directions_and_hidden_copies_stay_apart(spark):
    """A level, an upward and a nearly level word that cross, and a hidden copy under the first."""
    glyphs = typed("level", 50, 100, 0) + typed("level", 50, 100, 10, hidden=True) + typed("upward", 90, -60, 20, angle=90) + typed("tilted", 50, 100, 30, angle=3)
    found, boxes = lined(spark, glyphs)
    assert sorted(found) == ["level", "level", "tilted", "upward"]
    assert sorted(r["invisible"] for r in boxes.collect()) == [False, False, False, True]


def test_angles_that_hang_together_are_one_direction(spark):
    glyphs = typed("ab", 50, 100, 0) + typed("cd", 60, 100, 2, angle=0.05) + typed("ef", 70, 100, 4, angle=0.1)
    assert lined(spark, glyphs)[0] == ["abcdef"]


@pytest.mark.parametrize("angle", [0, 90])
def test_raised_marks_join_the_nearest_bigger_line(spark, angle):
    """Drawn after both lines: a mark between two pieces of the first (drawn backwards), one that only the second is near to."""
    glyphs = typed("is", 63, 100, 0, angle=angle) + typed("mc", 50, 100, 2, angle=angle) + typed("low", 50, 118, 4, angle=angle)
    glyphs += typed("2", 60, 96, 10, size=6, step=3, angle=angle) + typed("*", 66, 114, 11, size=6, step=3, angle=angle)
    found, _ = lined(spark, glyphs)
    assert sorted(found) == ["ismc2", "low*"]


def test_overlapping_pieces_take_turns(spark):
    """Two lines drawn over each other, each in two pieces out of order, keep their pieces."""
    glyphs = typed("aaaa", 50, 100, 0) + typed("bbbb", 51, 100.2, 10) + typed("cc", 200, 100, 20)
    assert sorted(lined(spark, glyphs)[0]) == ["aaaa", "bbbb", "cc"]


def test_justified_pieces_are_joined_again(spark):
    """The word gaps are 5 and the limit 4.5: a gap of 6 or 6.5 parts pieces but is like them, one of 8 is not (5 * 1.35 = 6.75)."""
    words = typed("ab", 50, 100, 0) + typed(" ", 60, 100, 2) + typed("cd", 65, 100, 3) + typed(" ", 75, 100, 5) + typed("ef", 80, 100, 6)
    even = words + typed("gh", 96, 100, 20)
    assert lined(spark, even, limit=0.45)[0] == ["ab cd ef", "gh"]
    assert lined(spark, even, limit=0.45, rejoin=True)[0] == ["ab cd efgh"]
    assert lined(spark, words + typed("gh", 96.5, 100, 20), limit=0.45, rejoin=True)[0] == ["ab cd efgh"]
    assert lined(spark, words + typed("gh", 98, 100, 20), limit=0.45, rejoin=True)[0] == ["ab cd ef", "gh"]


def test_rows_of_pieces_feed_word_spaced_rows(spark):
    glyphs = [g for row, (y, at) in enumerate([(100, (50, 90, 130)), (120, (50, 90, 130)), (300, (50, 80, 110))]) for i, u in enumerate(at) for g in typed("abc", u, y, row * 100 + i * 10)]
    _, boxes = lined(spark, glyphs)
    rows = L.rows_of_pieces(boxes)
    assert [(r["row_no"], r["x0"], r["x1"]) for r in rows.orderBy("row_no", "x0").collect()] == [(0, 50, 65), (0, 90, 105), (0, 130, 145), (1, 50, 65), (1, 90, 105), (1, 130, 145), (2, 50, 65), (2, 80, 95), (2, 110, 125)]
    assert [(r["row_no"], r["joined"]) for r in L.join_word_spaced_rows(rows).orderBy("row_no").collect()] == [(0, False), (1, False), (2, True)]


def test_features_and_tabs_follow_the_text(spark):
    kind = GLYPH.replace("page_no int,", "page_no int, line_no int,")
    level, up = (spark.createDataFrame([(*g[:2], 0, *g[2:]) for g in typed("a b c ", 50, 100, 0, angle=angle) + typed("d", 120, 100, 6, angle=angle)], kind) for angle in (0, 90))
    told = lambda df: [tuple(round(v, 6) for v in r) for r in L.line_features(df).collect()]
    assert told(level) == told(up) and told(up)[0][3:5] == (10.0, 100.0)
    assert [r["piece"] for r in L.split_tabs(up).orderBy("seq").collect()] == [0] * 6 + [1] == [r["piece"] for r in L.split_tabs(level).orderBy("seq").collect()]
    assert L.split_tabs(up).columns == [*up.columns, "piece"]
