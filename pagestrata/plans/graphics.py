"""Queries of fills, rules and art."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestrata.operators import graphics as I
from pagestrata.operators.common import r4
from pagestrata.plans.registry import query, s4
from pagestrata.sources import derived

STRIP = "printf('%02X%02X%02X', 40+k*(pk%4)*10, 60+k*(pk%4)*10, 80+k*(pk%4)*10)"


def strips(spark, d):
    r = derived.table_rows(spark, d)
    each = r.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    v = F.col("k") * (F.col("pk") % 4) * 10
    return each.select(
        "doc_id", F.lit(0).alias("page_no"), (F.col("row_no") * 100 + F.col("k")).alias("paint_order"),
        (F.lit(100.0) + F.col("k") * 5 + F.when((F.col("k") >= 4) & (F.col("q") % 5 == 0), 3.0).otherwise(0.0)).alias("x"), (F.lit(98.0) + F.lit(20.0) * F.col("row_no")).alias("y"), F.lit(5.0).alias("w"), F.lit(16.0).alias("h"),
        F.concat(*[F.lpad(F.hex((v + c).cast("long")), 2, "0") for c in (40, 60, 80)]).alias("color"), F.lit(1.0).alias("opacity"),
    )


@query(
    "merge_strips",
    """
    SELECT doc_id, 0 AS page_no, CAST(8 AS BIGINT) AS n, 100.0::DOUBLE AS x, 98.0::DOUBLE+20.0*row_no AS y, 40.0::DOUBLE AS w, 16.0::DOUBLE AS h, printf('%02X%02X%02X', CAST(floor(40+3.5*(pk%4)*10+0.5) AS INT), CAST(floor(60+3.5*(pk%4)*10+0.5) AS INT), CAST(floor(80+3.5*(pk%4)*10+0.5) AS INT)) AS color, 1.0::DOUBLE AS opacity,
     row_no*100+7 AS paint_order, 7*(pk%4)*10/255.0>0.1 AS gradient FROM fx_rows WHERE q%5<>0 AND pk%4 IN (1,2)
    """,
    "fx_rows",
)
def _(spark, d):
    return I.merge_strips(strips(spark, d))


@query("clean_fills")
def _(spark, d):
    return I.clean_fills(derived.fills(spark, d))


@query(
    "dotted_rows",
    """
    WITH s AS (SELECT *, b-a AS sz, lag(b-a) OVER w AS ps, a-lag(b) OVER w AS g, color<>lag(color) OVER w AS cc FROM fx_pieces WINDOW w AS (PARTITION BY doc_id,pos ORDER BY a)),
    r AS (SELECT *, sum(CASE WHEN g IS NULL OR (NOT cc AND g BETWEEN -0.05 AND 4*ps+0.5) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id,pos ORDER BY a) AS run FROM s),
    m AS (SELECT doc_id, pos, run, count(*) AS n, min(a) AS a, max(b) AS b, any_value(width) AS width, any_value(color) AS color, any_value(sz) AS sz, any_value(g) FILTER (g IS NOT NULL) AS g FROM r GROUP BY ALL)
    SELECT doc_id, 0 AS page_no, 'h' AS dir, pos, a, b, width, color, 'dotted' AS style, n FROM m WHERE n>=5 AND CASE sz WHEN 2.0 THEN 4.0 WHEN 8.0 THEN 4.0 WHEN 20.0 THEN 20.0 ELSE 0.0 END>=0.1*sz
    """,
    "fx_pieces",
)
def _(spark, d):
    return I.dotted_rows(derived.rule_pieces(spark, d))


@query(
    "merge_touching",
    """
    WITH o AS (SELECT *, lag(b) OVER w AS p FROM fx_pieces WINDOW w AS (PARTITION BY doc_id,pos,color,width ORDER BY a)), r AS (SELECT *, sum(CASE WHEN a-p>greatest(1,1.5*width) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id,pos,color,width ORDER BY a) AS run FROM o)
    SELECT doc_id, 0 AS page_no, 'h' AS dir, pos, min(a) AS a, max(b) AS b, width, color, '' AS style, count(*) AS pieces FROM r GROUP BY doc_id, pos, color, width, run
    """,
    "fx_pieces",
)
def _(spark, d):
    return I.merge_touching(derived.rule_pieces(spark, d)).withColumn("pos", r4(F.col("pos")))


@query(
    "merge_dashes",
    """
    WITH o AS (SELECT *, a-lag(b) OVER w AS g FROM fx_pieces WINDOW w AS (PARTITION BY doc_id,pos,color,width ORDER BY a)), r AS (SELECT *, sum(CASE WHEN g<=0 OR g>greatest(6,4*width) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id,pos,color,width ORDER BY a) AS run FROM o),
    m AS (SELECT *, count(*) OVER (PARTITION BY doc_id,pos,color,width,run) AS n FROM r)
    SELECT doc_id, 0 AS page_no, 'h' AS dir, pos, color, width, 'dashed' AS style, min(a) AS a, max(b) AS b FROM m WHERE n>=4 AND b-a<=12 GROUP BY doc_id, pos, color, width, run
    UNION ALL SELECT doc_id, 0, 'h', pos, color, width, '', a, b FROM m WHERE NOT (n>=4 AND b-a<=12)
    """,
    "fx_pieces",
)
def _(spark, d):
    return I.merge_dashes(derived.rule_pieces(spark, d))


@query(
    "visible_rules",
    """
    WITH r AS (SELECT doc_id, piece_no, pos+9 AS pos, a, b, width, color, (piece_no//100)*10+CASE WHEN piece_no%3=0 THEN -1 ELSE 5 END AS po FROM fx_pieces), j AS (SELECT r.doc_id, r.piece_no, bool_or(f.paint_order>po AND f.x<=a+0.1 AND f.x+f.w>=b-0.1 AND f.y<=pos-width/2+0.1 AND f.y+f.h>=pos+width/2-0.1) AS hid
      FROM r JOIN fx_fills f ON f.doc_id=r.doc_id AND f.x<=a+0.25 AND f.x+f.w>=b-0.25 AND f.y<=pos-width/2+0.25 AND f.y+f.h>=pos+width/2-0.25 GROUP BY ALL)
    SELECT doc_id, piece_no, pos, a, b FROM r ANTI JOIN (SELECT * FROM j WHERE hid) USING (doc_id, piece_no) WHERE pos<792 OR true
    """,
    "fx_pieces fx_fills",
)
def _(spark, d):
    p = derived.rule_pieces(spark, d)
    order = F.floor(F.col("piece_no") / 100) * 10 + F.when(F.col("piece_no") % 3 == 0, -1).otherwise(5)
    rules = p.withColumn("rule_no", F.col("piece_no")).withColumn("pos", F.col("pos") + 9).withColumn("paint_order", order)
    return I.visible_rules(rules, derived.fills(spark, d), 612.0, 792.0).select("doc_id", "piece_no", "pos", "a", "b")


@query("cluster_boxes")
def _(spark, d):
    f = derived.fills(spark, d).withColumn("box_no", F.col("paint_order"))
    return I.cluster_boxes(f.withColumn("x", F.col("x") + F.col("paint_order") % 30), 9.0)


@query(
    "vector_art",
    """
    WITH a AS (SELECT doc_id, page_no, paint_order AS area_no, x, y, w, h FROM fx_fills), t AS (SELECT doc_id, 70.0::DOUBLE AS x, 138.0::DOUBLE AS y, 60.0::DOUBLE AS w, 20.0::DOUBLE AS h FROM fx_rows WHERE row_no=2 AND q%3=0),
    p AS (SELECT doc_id, 380.0::DOUBLE AS x, 98.0+20.0*row_no AS y, 10.0::DOUBLE AS w, 10.0::DOUBLE AS h FROM fx_rows WHERE q%7=0),
    b AS (SELECT * FROM a WHERE greatest(w,h)>=6 AND w*h>=36 AND least(w,h)>=2 AND w*h<=0.6*612*792),
    c AS (SELECT b.doc_id, area_no FROM b JOIN t ON t.doc_id=b.doc_id WHERE greatest(0,least(b.x+b.w,t.x+t.w)-greatest(b.x,t.x))*greatest(0,least(b.y+b.h,t.y+t.h)-greatest(b.y,t.y))>0.05*least(b.w*b.h,t.w*t.h)
      UNION SELECT b.doc_id, area_no FROM b JOIN p ON p.doc_id=b.doc_id WHERE greatest(0,least(b.x+b.w,p.x+p.w)-greatest(b.x,p.x))*greatest(0,least(b.y+b.h,p.y+p.h)-greatest(b.y,p.y))>0.05*b.w*b.h),
    w AS (SELECT b.doc_id, area_no, sum(greatest(0,least(b.x+b.w,k.x+k.w)-greatest(b.x,k.x))*greatest(0,least(b.y+b.h,k.y+k.h)-greatest(b.y,k.y))) AS u FROM b JOIN (SELECT doc_id, x, y+3 AS y, length(text)*6.0 AS w, h FROM fx_cells) k ON k.doc_id=b.doc_id GROUP BY ALL),
    k AS (SELECT b.*, row_number() OVER (PARTITION BY b.doc_id ORDER BY b.w*b.h DESC, area_no) AS r FROM b LEFT JOIN w USING (doc_id, area_no) ANTI JOIN c USING (doc_id, area_no) WHERE coalesce(u,0)<=0.3*b.w*b.h)
    SELECT doc_id, page_no, area_no, x, y, w, h, CAST(r AS INT) AS rank FROM k
    """,
    "fx_fills fx_rows fx_cells",
)
def _(spark, d):
    r = derived.table_rows(spark, d).withColumn("page_no", F.lit(0))
    areas = derived.fills(spark, d).withColumn("area_no", F.col("paint_order")).select("doc_id", "page_no", "area_no", "x", "y", "w", "h")
    tables = r.filter("row_no = 2 AND q % 3 = 0").select("doc_id", "page_no", F.lit(70.0).alias("x"), F.lit(138.0).alias("y"), F.lit(60.0).alias("w"), F.lit(20.0).alias("h"))
    photos = r.filter("q % 7 = 0").select("doc_id", "page_no", F.lit(380.0).alias("x"), (F.lit(98.0) + F.lit(20.0) * F.col("row_no")).alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"))
    words = derived.cells(spark, d).select("doc_id", "page_no", "x", (F.col("y") + 3).alias("y"), (F.length("text") * 6.0).alias("w"), "h")
    return I.vector_art(areas, words, tables, photos, 612.0, 792.0)


@query("two_colors")
def _(spark, d):
    c = derived.colors(spark, d)
    from pagestrata.functions.geometry import channels

    px = c.select("doc_id", F.explode(F.array("dark", "light", "light")).alias("c"))
    r, g, b = channels(F.col("c"))
    return I.two_colors(px.select("doc_id", r.alias("r"), g.alias("g"), b.alias("b")), ["doc_id"])
