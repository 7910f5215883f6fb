"""Queries of table reconstruction."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestrata.operators import tables as J
from pagestrata.operators.common import r4
from pagestrata.plans.registry import query, s4
from pagestrata.sources import derived

PAGE = ["doc_id", "page_no"]


def rules(spark, d):
    return derived.table_rules(spark, d).withColumn("style", F.lit(None).cast("string"))


def segments(spark, d):
    return rules(spark, d).select(*PAGE, "dir", "pos", "a", "b", F.lit(True).alias("ruled"))


@query(
    "table_segments",
    """
    WITH r AS (SELECT doc_id, page_no, dir, pos, a, b, true AS ruled FROM fx_rules WHERE NOT (dir='h' AND pos=178) AND b-a>=4), f AS (SELECT * FROM fx_fills WHERE w>=3 AND h>=3 AND w*h<=0.5*612*792)
    SELECT * FROM r UNION ALL SELECT doc_id, page_no, 'h', y, x, x+w, false FROM f UNION ALL SELECT doc_id, page_no, 'h', y+h, x, x+w, false FROM f UNION ALL SELECT doc_id, page_no, 'v', x, y, y+h, false FROM f UNION ALL SELECT doc_id, page_no, 'v', x+w, y, y+h, false FROM f
    """,
    "fx_rules fx_fills",
)
def _(spark, d):
    r = derived.table_rules(spark, d).withColumn("style", F.when((F.col("dir") == "h") & (F.col("pos") == 178), "dotted"))
    return J.table_segments(r, derived.fills(spark, d), 612.0 * 792.0)


def apart(spark, d):
    """Two tables on a page where an order has more than three rows: the lower part is moved down."""
    s = segments(spark, d)
    low = (F.col("dir") == "h") & (F.col("pos") >= 178)
    top = s.filter(~low & ((F.col("dir") == "h") | (F.col("a") < 178))).withColumn("b", F.when(F.col("dir") == "v", F.least("b", F.lit(158.0))).otherwise(F.col("b")))
    foot = s.filter(low | ((F.col("dir") == "v") & (F.col("b") > 178)))
    foot = foot.withColumn("a", F.when(F.col("dir") == "v", F.greatest("a", F.lit(178.0)) + 40).otherwise(F.col("a"))).withColumn("b", F.when(F.col("dir") == "v", F.col("b") + 40).otherwise(F.col("b"))).withColumn("pos", F.when(F.col("dir") == "h", F.col("pos") + 40).otherwise(F.col("pos")))
    return top.unionByName(foot)


@query("segment_components")
def _(spark, d):
    return J.component_boxes(J.segment_components(apart(spark, d)))


@query("absorb_inner")
def _(spark, d):
    s = segments(spark, d)
    f = derived.fills(spark, d).filter("w > 300").select(*PAGE, (F.col("y") + 4).alias("y"))
    e = lambda dd, pos, a, b: f.select(*PAGE, F.lit(dd).alias("dir"), pos.alias("pos"), a.alias("a"), b.alias("b"), F.lit(False).alias("ruled"))
    inset = e("h", F.col("y"), F.lit(175.0), F.lit(265.0)).unionByName(e("h", F.col("y") + 12, F.lit(175.0), F.lit(265.0))).unionByName(e("v", F.lit(175.0), F.col("y"), F.col("y") + 12)).unionByName(e("v", F.lit(265.0), F.col("y"), F.col("y") + 12))
    return J.component_boxes(J.absorb_inner(J.segment_components(s.unionByName(inset))))


@query("stack_components")
def _(spark, d):
    lines = derived.cells(spark, d).select(*PAGE, "x", (F.col("y") + F.when(F.col("y") >= 180, 20.0).otherwise(0.0)).alias("y"), (F.length("text") * 6.0).alias("w"), "h")
    return J.component_boxes(J.stack_components(J.segment_components(apart(spark, d)), lines))


GRID_SQL = """
hp AS (SELECT DISTINCT doc_id, pos FROM fx_rules WHERE dir='h' UNION SELECT doc_id, max(b) FROM fx_rules WHERE dir='v' GROUP BY doc_id),
ln AS (SELECT doc_id, 'h' AS dir, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos)-1 AS line_no FROM hp UNION ALL SELECT doc_id, 'v', pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos)-1 FROM fx_rules WHERE dir='v')
"""


def one_component(spark, d):
    return segments(spark, d).withColumn("comp", F.lit(0))


@query("grid_lines", f"WITH {GRID_SQL} SELECT doc_id, 0 AS page_no, 0 AS comp, dir, CAST(line_no AS INT) AS line_no, pos FROM ln", "fx_rules")
def _(spark, d):
    return J.grid_lines(one_component(spark, d)).select(*PAGE, "comp", "dir", "line_no", r4(F.col("pos")).alias("pos"))


@query(
    "grid_of",
    f"""
    WITH {GRID_SQL}, ce AS (SELECT doc_id, CASE dir WHEN 'v' THEN 'h' ELSE 'v' END AS dir, line_no AS cell_no, pos AS lo, lead(pos) OVER (PARTITION BY doc_id,dir ORDER BY pos) AS hi FROM ln),
    ed AS (SELECT ln.doc_id, dir, ln.line_no, cell_no, pos, lo, hi FROM ln JOIN ce USING (doc_id, dir) WHERE hi IS NOT NULL),
    cv AS (SELECT e.doc_id, e.dir, e.line_no, e.cell_no, sum(least(r.b,hi)-greatest(r.a,lo)) AS c FROM ed e JOIN fx_rules r ON r.doc_id=e.doc_id AND r.dir=e.dir AND r.pos=e.pos AND least(r.b,hi)>greatest(r.a,lo) GROUP BY ALL)
    SELECT ed.doc_id, 0 AS page_no, dir, CAST(line_no AS INT) AS line_no, CAST(cell_no AS INT) AS cell_no, coalesce(c,0)>=0.6*(hi-lo)-0.5 AS drawn, coalesce(c,0)>=0.6*(hi-lo)-0.5 AS ruled FROM ed LEFT JOIN cv USING (doc_id,dir,line_no,cell_no)
    """,
    "fx_rules",
)
def _(spark, d):
    s = one_component(spark, d)
    return J.grid_edges(s, J.grid_lines(s)).drop("comp", "pos")


def pieces(spark, d):
    """Cells as text pieces of rows; the widest column wraps in some rows."""
    c = derived.cells(spark, d).groupBy("doc_id", "row_no", "col_no").agg(F.min("text").alias("text"), F.min("x").alias("x"), F.min("y").alias("y"))
    c = c.filter((F.col("row_no") % 3 != 2) | (F.col("col_no") == 1))
    return c.select("doc_id", F.lit(0).alias("page_no"), "row_no", "col_no", F.col("x").alias("x0"), (F.col("x") + F.length("text") * 6).alias("x1"), (F.lit(100.0) + F.col("row_no") * 14 + F.when(F.col("row_no") >= 5, 8.0).otherwise(0.0)).alias("baseline"), F.lit(12.0).alias("size"), "text")


@query("stream_blocks")
def _(spark, d):
    return J.stream_blocks(pieces(spark, d)).select(*PAGE, "row_no", "x0", "block_no", "col")


PIECE_SQL = """
pc AS (SELECT doc_id, row_no, col_no AS col, min(text) AS text, min(x) AS x0 FROM fx_cells WHERE row_no%3<>2 OR col_no=1 GROUP BY ALL), pl AS (SELECT *, x0+length(text)*6.0 AS x1, 100.0+row_no*14+CASE WHEN row_no>=5 THEN 8.0 ELSE 0.0 END AS bl FROM pc),
rw AS (SELECT doc_id, row_no, count(DISTINCT col) AS cols, min(bl) AS bl FROM pl GROUP BY ALL), st AS (SELECT *, CASE WHEN lag(bl) OVER w IS NOT NULL AND (cols>=2 OR bl-lag(bl) OVER w>1.45*12) THEN 1 ELSE 0 END AS s FROM rw WINDOW w AS (PARTITION BY doc_id ORDER BY bl,row_no)),
lr AS (SELECT doc_id, row_no, cols, CAST(sum(s) OVER (PARTITION BY doc_id ORDER BY bl,row_no) AS INT) AS table_row FROM st)
"""


def block_pieces(spark, d):
    return pieces(spark, d).withColumn("block_no", F.lit(0)).withColumnRenamed("col_no", "col")


@query("logical_rows", f"WITH {PIECE_SQL} SELECT doc_id, 0 AS page_no, 0 AS block_no, row_no, cols, table_row FROM lr", "fx_cells")
def _(spark, d):
    return J.logical_rows(block_pieces(spark, d))


@query(
    "accept_stream",
    f"""
    WITH {PIECE_SQL}, m AS (SELECT doc_id, sum(CASE WHEN cols>=2 THEN 1 ELSE 0 END) AS multi, count(*) AS nr, count(DISTINCT table_row) AS nt FROM lr GROUP BY doc_id),
    c AS (SELECT doc_id, col, count(DISTINCT table_row) AS held FROM pl JOIN lr USING (doc_id,row_no) GROUP BY ALL), g AS (SELECT doc_id, count(*) AS n_cols, min(held) AS least_ FROM c GROUP BY doc_id)
    SELECT doc_id, 0 AS page_no, 0 AS block_no, CAST(multi AS BIGINT) AS multi, n_cols, nt AS n_table_rows, multi>=3 AND n_cols>=2 AND NOT (n_cols=2 AND NOT (nt<nr AND multi>=4)) AND least_>=least(2,nt) AS accepted FROM m JOIN g USING (doc_id)
    """,
    "fx_cells",
)
def _(spark, d):
    p = block_pieces(spark, d)
    return J.accept_stream(p, J.logical_rows(p))


CUTS = (150.0, 246.0)


@query(
    "split_at_gap",
    """
    WITH w AS (SELECT *, x+CASE WHEN x>=216 THEN 30 ELSE 0 END AS u FROM fx_words), g AS (SELECT doc_id, page_no, line_no, word_no, size, lag(u+w) OVER (PARTITION BY doc_id,page_no,line_no ORDER BY u,word_no) AS l, u AS r FROM w), h AS (SELECT * FROM g WHERE l IS NOT NULL),
    c AS (SELECT unnest([0,1]) AS cut_no, unnest([150.0::DOUBLE,246.0::DOUBLE]) AS ca), k AS (SELECT *, abs((l+r)/2-ca) AS d, l<=ca+1 AND r>=ca-1 AS clean FROM h, c),
    b AS (SELECT doc_id, page_no, line_no, cut_no, arg_min(word_no, d*1000000+word_no) FILTER (clean) AS cw, arg_min(r-l, d*1000000+word_no) FILTER (clean) AS cg, arg_min(word_no, d*1000000+word_no) FILTER (d<=6) AS nw, max(size) AS size FROM k GROUP BY ALL),
    o AS (SELECT b.doc_id, b.page_no, b.line_no, cut_no, list_sort(list(r-l)) AS o FROM b JOIN h USING (doc_id,page_no,line_no) WHERE cw IS NOT NULL AND h.word_no<>cw AND r-l>0 GROUP BY ALL)
    SELECT doc_id, page_no, line_no, cut_no, coalesce(cw,nw) AS next_word, cw IS NOT NULL AS in_gap, coalesce(cg>=greatest(0.6*size, CASE WHEN len(o)>0 THEN 2*o[len(o)//2+1] ELSE 0 END),false) AS column_gap FROM b LEFT JOIN o USING (doc_id,page_no,line_no,cut_no)
    """,
    "fx_words",
)
def _(spark, d):
    w = derived.words(spark, d).withColumn("x", F.col("x") + F.when(F.col("x") >= 216, 30.0).otherwise(0.0))
    cuts = w.select("doc_id", "page_no", "line_no").distinct().select("*", F.posexplode(F.array(*[F.lit(c) for c in CUTS])).alias("cut_no", "at"))
    return J.split_at_gap(w, cuts)


@query(
    "split_tall_rows",
    """
    WITH l AS (SELECT doc_id, row_no AS rr, col_no AS col, min(y) AS top FROM fx_cells WHERE row_no%3<>2 OR col_no=1 GROUP BY ALL), t AS (SELECT doc_id, rr, count(DISTINCT col) AS cols, min(top) AS top FROM l GROUP BY ALL), c AS (SELECT *, lag(top) OVER w AS pt, row_number() OVER w-1 AS k FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY top))
    SELECT doc_id, 0 AS page_no, 0 AS table_no, 0 AS row_no, CAST(k AS INT) AS text_row, (pt+12+top)/2 AS cut FROM c WHERE pt IS NOT NULL AND (cols>=2 OR top-pt>1.45*12)
    """,
    "fx_cells",
)
def _(spark, d):
    c = derived.cells(spark, d).filter((F.col("row_no") % 3 != 2) | (F.col("col_no") == 1))
    lines = c.select(*PAGE, F.lit(0).alias("table_no"), F.col("col_no").alias("col"), (F.col("y") + 12).alias("baseline"), F.lit(12.0).alias("size"), F.col("y").alias("top"), (F.col("y") + 12).alias("bottom"))
    rows = c.select(*PAGE).distinct().select(*PAGE, F.lit(0).alias("table_no"), F.lit(0).alias("row_no"), F.lit(90.0).alias("y0"), F.lit(900.0).alias("y1"), F.lit(True).alias("inherited"))
    return J.split_tall_rows(rows, lines)


@query("extend_down")
def _(spark, d):
    r = derived.table_rows(spark, d)
    grids = r.groupBy("doc_id").agg(F.min("row_no").alias("m")).select("doc_id", F.lit(0).alias("page_no"), F.lit(0).alias("table_no"), F.array(*[F.lit(70.0 + 100 * k) for k in range(5)]).alias("xs"), (F.lit(118.0) + F.col("m") * 20).alias("y1"), F.lit(20.0).alias("last_h"), F.lit(True).alias("open"))
    c = derived.cells(spark, d)
    lines = c.select(*PAGE, "row_no", F.col("x").alias("x0"), (F.col("x") + F.length("text") * 6).alias("x1"), F.col("y").alias("top"), (F.col("y") + 12).alias("bottom"), F.lit(12.0).alias("size"))
    return J.extend_down(grids, lines)


def grid_cells(spark, d):
    r = derived.table_rows(spark, d)
    each = r.select("doc_id", "row_no", "q", "pk", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("c"))
    return each.select("doc_id", F.lit(0).alias("page_no"), F.lit(0).alias("table_no"), F.col("row_no").alias("r"), "c", "q", "pk", (F.lit(70.0) + F.col("c") * 100).alias("x0"), (F.lit(170.0) + F.col("c") * 100).alias("x1"), (F.lit(98.0) + F.col("row_no") * 20).alias("y0"), (F.lit(118.0) + F.col("row_no") * 20).alias("y1"))


def cell_lines(spark, d):
    """Cell texts as lines, some so long that they cross into the next cell, some pushed low."""
    c = derived.cells(spark, d)
    wide = F.when((F.col("row_no") % 3 == 1) & (F.col("col_no") == 1), 130.0).otherwise(F.length("text") * 6.0)
    return c.groupBy("doc_id", "page_no", "row_no", "col_no").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(wide).alias("w"), F.min("h").alias("h")).select(*PAGE, (F.col("row_no") * 10 + F.col("col_no")).alias("line_no"), "x", (F.col("y") + F.when(F.col("col_no") == 3, 7.0).otherwise(0.0)).alias("y"), "w", "h")


CELL_LINE_SQL = "cl AS (SELECT doc_id, row_no*10+col_no AS line_no, min(x) AS x, min(y)+CASE WHEN col_no=3 THEN 7 ELSE 0 END AS y, max(CASE WHEN row_no%3=1 AND col_no=1 THEN 130.0 ELSE length(text)*6.0 END) AS w, min(h) AS h FROM fx_cells GROUP BY doc_id, row_no, col_no)"
ASSIGN_SQL = f"""
{CELL_LINE_SQL}, ge AS (SELECT doc_id, row_no AS r, c, 70.0+c*100 AS x0, 170.0+c*100 AS x1, 98.0+row_no*20 AS y0, 118.0+row_no*20 AS y1 FROM fx_rows, (SELECT unnest(range(4)) AS c)),
ag AS (SELECT cl.*, r, c, x0, x1, y0, y1 FROM cl JOIN ge ON ge.doc_id=cl.doc_id AND x+w/2>=x0 AND x+w/2<x1 AND y+h/2>=y0 AND y+h/2<y1)
"""


@query(
    "assign_cells",
    f"""
    WITH {ASSIGN_SQL} SELECT doc_id, 0 AS page_no, 0 AS table_no, line_no, r, CAST(c AS INT) AS c, (x0>x+2 AND x0<x+w-2) OR (x1>x+2 AND x1<x+w-2) AS cross_v, (y0-y>0.3*h AND y+h-y0>0.3*h) OR (y1-y>0.3*h AND y+h-y1>0.3*h) AS cross_h FROM ag
    """,
    "fx_cells fx_rows",
)
def _(spark, d):
    return J.assign_cells(cell_lines(spark, d), grid_cells(spark, d))


@query(
    "intruders",
    f"""
    WITH {ASSIGN_SQL}, t AS (SELECT doc_id, min(98.0+row_no*20) AS y, 10.0+max(row_no)*20 AS y1 FROM fx_rows GROUP BY doc_id)
    SELECT cl.doc_id, 0 AS page_no, 0 AS table_no, count(*) AS intruders FROM cl JOIN t ON t.doc_id=cl.doc_id AND greatest(0,least(x+w,470)-greatest(x,70))*greatest(0,least(cl.y+h,t.y+200)-greatest(cl.y,t.y))>0.3*w*h ANTI JOIN (SELECT doc_id, line_no FROM ag WHERE c<>2) a ON a.doc_id=cl.doc_id AND a.line_no=cl.line_no GROUP BY cl.doc_id
    """,
    "fx_cells fx_rows",
)
def _(spark, d):
    t = derived.table_rows(spark, d).groupBy("doc_id").agg((F.min("row_no") * 20 + 98.0).alias("y")).select("doc_id", F.lit(0).alias("page_no"), F.lit(0).alias("table_no"), F.lit(70.0).alias("x"), "y", F.lit(400.0).alias("w"), F.lit(200.0).alias("h"))
    lines = cell_lines(spark, d)
    return J.intruders(lines, t, J.assign_cells(lines, grid_cells(spark, d)).filter("c <> 2"))


@query("merge_cells")
def _(spark, d):
    lines = cell_lines(spark, d)
    a = J.assign_cells(lines, grid_cells(spark, d)).join(lines, [*PAGE, "line_no"])
    ink = a.groupBy(*J.TABLE, "r", "c").agg(F.collect_list(F.struct(F.col("x").alias("x0"), (F.col("x") + F.col("w")).alias("x1"), F.col("y").alias("top"), (F.col("y") + F.col("h")).alias("bottom"), F.lit(12.0).alias("size"))).alias("ink"))
    c = grid_cells(spark, d).join(ink, [*J.TABLE, "r", "c"], "left")
    cells = c.select(*J.TABLE, "r", "c", "x0", "x1", F.lit("").alias("shade"), (F.col("pk") % 5 != 0).alias("left_drawn"), (F.col("q") % 4 != 0).alias("top_drawn"), ((F.col("r") % 3 == 1) & (F.col("c") == 2)).alias("cross_left"), F.lit(False).alias("cross_top"), F.lit(False).alias("inherited"), "ink")
    return J.merge_cells(cells)


@query(
    "normalise_grid",
    """
    WITH g AS (SELECT doc_id, row_no AS r, 0 AS c, 1 AS rs, CASE WHEN q%3=0 THEN 4 ELSE 2 END AS cs FROM fx_rows UNION ALL SELECT doc_id, row_no, 2, 1, 2 FROM fx_rows WHERE q%3<>0),
    x AS (SELECT doc_id, b, dense_rank() OVER (PARTITION BY doc_id ORDER BY b)-1 AS n FROM (SELECT DISTINCT doc_id, unnest([c,c+cs]) AS b FROM g)), y AS (SELECT doc_id, b, dense_rank() OVER (PARTITION BY doc_id ORDER BY b)-1 AS n FROM (SELECT DISTINCT doc_id, unnest([r,r+rs]) AS b FROM g))
    SELECT g.doc_id, 0 AS page_no, 0 AS table_no, r, c, CAST(y0.n AS INT) AS new_r, CAST(x0.n AS INT) AS new_c, CAST(y1.n-y0.n AS INT) AS new_row_span, CAST(x1.n-x0.n AS INT) AS new_col_span FROM g JOIN x x0 ON x0.doc_id=g.doc_id AND x0.b=c JOIN x x1 ON x1.doc_id=g.doc_id AND x1.b=c+cs JOIN y y0 ON y0.doc_id=g.doc_id AND y0.b=r JOIN y y1 ON y1.doc_id=g.doc_id AND y1.b=r+rs
    """,
    "fx_rows",
)
def _(spark, d):
    r = derived.table_rows(spark, d)
    base = r.select("doc_id", F.lit(0).alias("page_no"), F.lit(0).alias("table_no"), F.col("row_no").alias("r"), "q", F.lit(1).alias("row_span"))
    first = base.withColumn("c", F.lit(0)).withColumn("col_span", F.when(F.col("q") % 3 == 0, 4).otherwise(2))
    rest = base.filter("q % 3 <> 0").withColumn("c", F.lit(2)).withColumn("col_span", F.lit(2))
    return J.normalise_grid(first.unionByName(rest).drop("q"))


@query(
    "cell_attributes",
    """
    WITH c AS (SELECT doc_id, row_no, row_no*10+c AS cell_no, q, pk, c, 70.0+c*100 AS x, 98.0+row_no*20 AS y FROM fx_rows, (SELECT unnest(range(4)) AS c)),
    s AS (SELECT c.doc_id, cell_no, arg_max(color, paint_order) AS color FROM c JOIN fx_fills f ON f.doc_id=c.doc_id AND greatest(0,least(f.x+f.w,c.x+100)-greatest(f.x,c.x))*greatest(0,least(f.y+f.h,c.y+20)-greatest(f.y,c.y))>=0.55*2000 GROUP BY ALL)
    SELECT doc_id, 0 AS page_no, 0 AS table_no, cell_no, q%2=0 AS border_top, true AS border_right, q%3<>0 AS border_bottom, c=0 AS border_left, CASE WHEN color<>'FFFFFF' THEN color END AS shading, CASE pk%3 WHEN 0 THEN 'center' WHEN 1 THEN 'top' ELSE 'bottom' END AS vertical FROM c LEFT JOIN s USING (doc_id, cell_no)
    """,
    "fx_rows fx_fills",
)
def _(spark, d):
    c = grid_cells(spark, d).withColumn("cell_no", F.col("r") * 10 + F.col("c"))
    cells = c.select(*J.TABLE, "cell_no", F.col("x0").alias("x"), F.col("y0").alias("y"), F.lit(100.0).alias("w"), F.lit(20.0).alias("h"))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), v.alias("ruled")) for s, v in (("top", F.col("q") % 2 == 0), ("right", F.lit(True)), ("bottom", F.col("q") % 3 != 0), ("left", F.col("c") == 0))]))
    edges = c.select(*J.TABLE, "cell_no", sides.alias("e")).select(*J.TABLE, "cell_no", "e.*")
    top = F.col("y0") + F.when(F.col("pk") % 3 == 0, 4.0).when(F.col("pk") % 3 == 1, 1.0).otherwise(7.0)
    return J.cell_attributes(cells, edges, derived.fills(spark, d), c.select(*J.TABLE, "cell_no", top.alias("top"), (top + 12).alias("bottom")))


@query(
    "accept_ruled",
    """
    WITH t AS (SELECT doc_id, count(*) AS rows, 1+min(q)%4 AS cols, sum(q%3) AS filled, sum(CASE WHEN q%10=0 THEN 3 ELSE 0 END) AS intruders, min(pk)%5 AS framed, sum(CASE WHEN flag='R' THEN 1 ELSE 0 END) AS shaded, min(q)%6 AS ff, 30.0+min(q)*10 AS w, count(*)*20.0 AS h FROM fx_rows GROUP BY doc_id),
    a AS (SELECT *, CASE WHEN filled=0 OR intruders>greatest(2,0.3*filled) OR (ff>=3 AND filled<rows) THEN false WHEN cols>=2 AND rows>=2 THEN filled>=2 WHEN cols>=2 THEN filled>=2 AND (framed>=3 OR shaded>0) WHEN h>0.6*792 OR w<40 OR ff>0 THEN false WHEN rows>=2 THEN framed>=3 OR (shaded>0 AND shaded<rows) ELSE framed=4 END AS accepted FROM t)
    SELECT doc_id, accepted FROM a
    """,
    "fx_rows",
)
def _(spark, d):
    r = derived.table_rows(spark, d).groupBy("doc_id").agg(
        F.count("*").alias("rows"), (F.min("q") % 4 + 1).alias("cols"), F.sum(F.col("q") % 3).alias("filled"), F.sum(F.when(F.col("q") % 10 == 0, 3).otherwise(0)).alias("intruders"), (F.min("pk") % 5).alias("framed"),
        F.count_if(F.col("flag") == "R").alias("shaded_rows"), (F.min("q") % 6).alias("free_fills"), (F.min("q") * 10 + 30.0).alias("w"), (F.count("*") * 20.0).alias("h"),
    )
    t = r.withColumns({"page_no": F.lit(0), "table_no": F.lit(0), "x": F.lit(0.0), "y": F.lit(0.0), "cells": F.col("rows") * F.col("cols"), "used": F.col("filled"), "coverage": F.when(F.col("filled") < F.col("rows"), 0.0).otherwise(1.0), "median_col_w": F.lit(50.0)})
    return J.accept_ruled(t, 612.0, 792.0).select("doc_id", "accepted")


@query("pick_tables")
def _(spark, d):
    r = derived.table_rows(spark, d)
    t = r.select("doc_id", F.lit(0).alias("page_no"), F.col("row_no").alias("table_no"), (F.col("pk") % 50 * 4.0).alias("x"), (F.col("row_no") * 30.0).alias("y"), (F.col("q") * 4.0).alias("w"), (F.col("q") + 20.0).alias("h"))
    return J.pick_tables(t)


@query(
    "loose_marks",
    """
    WITH ru AS (SELECT doc_id, 'rule' AS kind, 100000+row_no AS mark_no, 90.0 AS x, 107.5+row_no*20 AS y, 360.0 AS w, 1.0 AS h, '808080' AS color, 'h' AS dir, 108.0+row_no*20 AS ln FROM fx_rows WHERE pk%4>=2
      UNION ALL SELECT doc_id, 'rule', 200000+row_no, 240.0, 100.0+row_no*20, 0.25, 16.0, '303030', 'v', 240.0 FROM fx_rows
      UNION ALL SELECT doc_id, 'rule', row_number() OVER (PARTITION BY doc_id ORDER BY dir,pos,a,b), CASE dir WHEN 'h' THEN a ELSE pos-0.5 END, CASE dir WHEN 'h' THEN pos-0.5 ELSE a END, CASE dir WHEN 'h' THEN b-a ELSE 1.0 END, CASE dir WHEN 'h' THEN 1.0 ELSE b-a END, '000000', dir, pos FROM fx_rules),
    f AS (SELECT doc_id, 'fill' AS kind, paint_order AS mark_no, x, y, w, h, color, NULL AS dir, NULL AS ln FROM fx_fills WHERE NOT (color='FFFFFF' AND opacity>0.9) UNION ALL SELECT * FROM ru),
    t AS (SELECT doc_id, min(98.0+row_no*20) AS y0, max(118.0+row_no*20) AS y1 FROM fx_rows GROUP BY doc_id), ys AS (SELECT DISTINCT doc_id, unnest([98.0+row_no*20, 118.0+row_no*20]) AS pos FROM fx_rows),
    i AS (SELECT f.*, x+w/2 AS cx, y+h/2 AS cy, y1 FROM f JOIN t USING (doc_id) WHERE x>=68.5 AND x+w<=471.5 AND y>=y0-1.5 AND y+h<=y1+1.5),
    g AS (SELECT i.kind, i.doc_id, i.mark_no, bool_or(abs(pos-y)<=2.5) AND bool_or(abs(pos-(y+h))<=2.5) AS ly, bool_or(abs(pos-ln)<=2.5) AS la, count(*) FILTER (WHERE pos<cy) AS n, min(pos) AS least_, max(pos) AS most FROM i JOIN ys USING (doc_id) GROUP BY ALL),
    x AS (SELECT *, abs(x-70-100*round((x-70)/100))<=2.5 AND abs(x+w-70-100*round((x+w-70)/100))<=2.5 AS lx, abs(ln-70-100*round((ln-70)/100))<=2.5 AS lv FROM i JOIN g USING (doc_id,kind,mark_no)),
    l AS (SELECT * FROM x WHERE NOT CASE WHEN kind='fill' THEN lx AND ly WHEN dir='h' THEN la ELSE lv END),
    c AS (SELECT DISTINCT l.doc_id, l.kind, mark_no FROM l JOIN fx_cells k ON k.doc_id=l.doc_id AND greatest(0,least(k.x+length(k.text)*6,l.x+l.w)-greatest(k.x,l.x))*greatest(0,least(k.y+12,l.y+l.h)-greatest(k.y,l.y))>0.2*length(k.text)*6*12)
    SELECT doc_id, 0 AS page_no, 0 AS table_no, kind, mark_no, color, CASE WHEN cy BETWEEN least_ AND most THEN CAST(greatest(n,1)-1 AS INT) END AS row, CASE WHEN cx BETWEEN 70 AND 470 THEN CAST(greatest(ceil((cx-70)/100),1)-1 AS INT) END AS col, c.mark_no IS NOT NULL AS under_text FROM l LEFT JOIN c USING (doc_id, kind, mark_no)
    """,
    "fx_fills fx_rows fx_cells fx_rules",
)
def _(spark, d):
    from pyspark.sql import Window

    r = derived.table_rows(spark, d)
    key = [F.col("doc_id"), F.lit(0).alias("page_no"), F.lit(0).alias("table_no")]
    box = r.groupBy("doc_id").agg((F.min("row_no") * 20 + 98.0).alias("y"), (F.max("row_no") * 20 + 118.0).alias("y1"))
    tables = box.select(*key, F.lit(70.0).alias("x"), "y", F.lit(400.0).alias("w"), (F.col("y1") - F.col("y")).alias("h"))
    xs = box.select(*key, F.explode(F.array(*[F.lit(70.0 + 100 * k) for k in range(5)])).alias("pos"))
    ys = r.select(*key, F.explode(F.array(F.col("row_no") * 20 + 98.0, F.col("row_no") * 20 + 118.0)).alias("pos")).distinct()
    fills = derived.fills(spark, d).withColumn("mark_no", F.col("paint_order"))
    text = derived.cells(spark, d).select(*PAGE, "x", "y", (F.length("text") * 6.0).alias("w"), "h")
    middle, kind = F.col("row_no") * 20 + 108.0, F.col("pk") % 4  # separators in the rows: dashed, slanted or solid; upright hair lines
    rule = lambda no, x1, y1, x2, y2, width, color, style: [F.col("doc_id"), F.lit(0).alias("page_no"), no.cast("long").alias("mark_no"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), F.lit(width).alias("width"), F.lit(color).alias("color"), style.cast("string").alias("style")]
    none, level, s = F.lit(None), F.col("dir") == "h", derived.table_rules(spark, d)
    rules = r.select(*rule(F.col("row_no") + 100000, F.lit(450.0), middle, F.lit(90.0), middle + F.when(kind == 1, 3.0).otherwise(0.0), 1.0, "808080", F.when(kind == 0, "dashed")))
    rules = rules.union(r.select(*rule(F.col("row_no") + 200000, F.lit(240.125), middle - 8, F.lit(240.125), middle + 8, 0.25, "303030", none)))
    s = s.withColumn("no", F.row_number().over(Window.partitionBy("doc_id").orderBy("dir", "pos", "a", "b")))
    rules = rules.union(s.select(*rule(F.col("no"), F.when(level, F.col("a")).otherwise(F.col("pos")), F.when(level, F.col("pos")).otherwise(F.col("a")), F.when(level, F.col("b")).otherwise(F.col("pos")), F.when(level, F.col("pos")).otherwise(F.col("b")), 1.0, "000000", none)))
    return J.loose_marks(tables, xs, ys, fills, text, rules)


@query(
    "expand_grid",
    """
    WITH c AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY row_no)-1 AS r, k, q, pk FROM fx_rows, (SELECT unnest(range(3)) AS k)), s AS (SELECT *, CASE WHEN k=1 THEN 1+q%3 ELSE 1 END AS span, k=0 AND pk%2=0 AND r>0 AS cont, concat(pk,'.',k) AS t FROM c),
    p AS (SELECT *, coalesce(sum(span) OVER (PARTITION BY doc_id,r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS c0 FROM s), e AS (SELECT doc_id, r, unnest(range(CAST(c0 AS BIGINT),CAST(c0+span AS BIGINT))) AS c, CASE WHEN cont THEN NULL ELSE t END AS t FROM p)
    SELECT doc_id, 0 AS page_no, 0 AS table_no, CAST(r AS INT) AS r, CAST(c AS INT) AS c, coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY doc_id,c ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),'') AS text FROM e
    """,
    "fx_rows",
)
def _(spark, d):
    from pyspark.sql import Window

    r = derived.table_rows(spark, d).withColumn("r", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("row_no")) - 1)
    each = r.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("cell_no"))
    cells = each.select(
        "doc_id", F.lit(0).alias("page_no"), F.lit(0).alias("table_no"), "r", "cell_no", F.when(F.col("cell_no") == 1, F.col("q") % 3 + 1).otherwise(1).alias("span"),
        ((F.col("cell_no") == 0) & (F.col("pk") % 2 == 0)).alias("continues"), F.concat(F.col("pk").cast("string"), F.lit("."), F.col("cell_no").cast("string")).alias("text"),
    )
    return J.expand_grid(cells)
