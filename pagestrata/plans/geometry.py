"""Queries of the colour, box and interval functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestrata.functions import geometry as G
from pagestrata.operators.common import r4
from pagestrata.plans.registry import query, s4
from pagestrata.sources import derived


def _ch(c: str, i: int) -> str:
    return f"CAST(('0x'||substr({c},{1 + 2 * i},2)) AS INT)"


def _chs(c: str) -> str:
    return ",".join(_ch(c, i) for i in range(3))


def _lin(c: str, i: int) -> str:
    v = f"({_ch(c, i)}/255.0::DOUBLE)"
    return f"(CASE WHEN {v}<=0.03928 THEN {v}/12.92 ELSE pow(({v}+0.055)/1.055,2.4) END)"


@query(
    "luminance",
    f"""
    SELECT doc_id, item_no, {s4(f"0.2126*{_lin('a', 0)}+0.7152*{_lin('a', 1)}+0.0722*{_lin('a', 2)}")} AS luminance, greatest({_chs("a")})-least({_chs("a")}) AS chroma,
     CASE WHEN alpha>=0.98 THEN a ELSE printf('%02X%02X%02X',{",".join(f"CAST(floor(255.0*(1.0-alpha*(1.0-{_ch('a', i)}/255.0::DOUBLE))+0.5) AS BIGINT)" for i in range(3))}) END AS on_white
    FROM fx_colors
    """,
    "fx_colors",
)
def _(spark, d):
    a = F.col("a")
    return derived.colors(spark, d).select(
        "doc_id", "item_no", r4(G.luminance(a)).alias("luminance"), G.chroma(a).alias("chroma"), G.over_white(a, F.col("alpha")).alias("on_white")
    )


_hyp = lambda c, base: "sqrt(" + "+".join(f"pow({base}-{_ch(c, i)},2)" for i in range(3)) + ")"


@query(
    "same_color",
    f"""
    SELECT doc_id, item_no, greatest({",".join(f"abs({_ch('a', i)}-{_ch('b', i)})" for i in range(3))})<=40 AS same,
     CASE WHEN greatest({_chs("dark")})-least({_chs("dark")})<28 AND greatest({_chs("dark")})<70 THEN '000000' ELSE dark END AS ink,
     CASE WHEN greatest({_chs("light")})-least({_chs("light")})<8 AND {_hyp("light", 255)}<10 THEN 'FFFFFF' WHEN greatest({_chs("light")})-least({_chs("light")})<8 AND {_hyp("light", 0)}<10 THEN '000000' ELSE light END AS pure
    FROM fx_colors
    """,
    "fx_colors",
)
def _(spark, d):
    return derived.colors(spark, d).select(
        "doc_id", "item_no", G.same_color(F.col("a"), F.col("b")).alias("same"), G.snap_ink(F.col("dark")).alias("ink"), G.snap_pure(F.col("light")).alias("pure")
    )


@query(
    "box_algebra",
    """
    WITH p AS (SELECT doc_id, page_no, line_no, word_no, x, y, w, h, lead(x) OVER q AS nx, lead(y) OVER q AS ny, lead(w+3) OVER q AS nw, lead(h) OVER q AS nh FROM fx_words
      WINDOW q AS (PARTITION BY doc_id, page_no ORDER BY line_no, word_no))
    SELECT doc_id, page_no, sum(w*h) AS area, sum(greatest(0,least(x+w+9,nx+nw)-greatest(x,nx))*greatest(0,least(y+h,ny+nh)-greatest(y,ny))) AS shared,
     sum((greatest(x+w,nx+nw)-least(x,nx))*(greatest(y+h,ny+nh)-least(y,ny))) AS joint,
     CAST(sum(CASE WHEN nx>=x-1 AND ny>=y-1 AND nx+nw<=x+w+1 AND ny+nh<=y+h+1 THEN 1 ELSE 0 END) AS BIGINT) AS inside FROM p WHERE nx IS NOT NULL GROUP BY doc_id, page_no
    """,
    "fx_words",
)
def _(spark, d):
    from pyspark.sql import Window

    q = Window.partitionBy("doc_id", "page_no").orderBy("line_no", "word_no")
    p = derived.words(spark, d).select(
        "doc_id", "page_no", "x", "y", "w", "h", F.lead("x").over(q).alias("nx"), F.lead("y").over(q).alias("ny"), (F.lead("w").over(q) + 3).alias("nw"), F.lead("h").over(q).alias("nh")
    ).filter("nx IS NOT NULL")
    a, b = G.box(), G.box("n")
    wide = (a[0], a[1], a[2] + 9, a[3])
    return p.groupBy("doc_id", "page_no").agg(
        F.sum(G.area(a)).alias("area"),
        F.sum(G.overlap(wide, b)).alias("shared"),
        F.sum(G.area(G.union_box(a, b))).alias("joint"),
        F.count_if(G.contains(a, b)).alias("inside"),
    )


LINE = "doc_id, page_no, line_no"


@query(
    "interval_gaps",
    f"""
    WITH p AS (SELECT {LINE}, x AS lo, x+e AS hi, max(x+e) OVER (PARTITION BY {LINE} ORDER BY x, x+e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT *, CASE WHEN length(text)>2 THEN w ELSE 1.0 END AS e FROM fx_words))
    SELECT {LINE}, reach AS gap_lo, lo AS gap_hi FROM p WHERE lo-reach>=12
    """,
    "fx_words",
)
def _(spark, d):
    ink = F.when(F.length("text") > 2, F.col("w")).otherwise(1.0)  # short words leave little ink
    spans = derived.words(spark, d).select("doc_id", "page_no", "line_no", F.col("x").alias("lo"), (F.col("x") + ink).alias("hi"))
    return G.interval_gaps(spans, ["doc_id", "page_no", "line_no"], "lo", "hi", 12.0)


@query(
    "interval_coverage",
    """
    WITH s AS (SELECT c.doc_id, c.row_no, c.x-2 AS a, c.x+98 AS b, greatest(c.x-2, r.a) AS lo, least(c.x+98, r.b-CASE WHEN c.col_no=3 THEN 45 ELSE 0 END) AS hi
      FROM fx_cells c JOIN fx_rules r ON r.doc_id=c.doc_id AND r.dir='h' AND r.pos=c.y-2),
    t AS (SELECT *, coalesce(max(hi) OVER (PARTITION BY doc_id,row_no,a ORDER BY lo,hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),a) AS reach FROM s)
    SELECT doc_id, row_no, a, sum(greatest(0,hi-greatest(lo,reach))) AS covered, max(b)-max(a) AS span, sum(greatest(0,hi-greatest(lo,reach)))>=0.6*(max(b)-max(a))-0.5 AS drawn FROM t GROUP BY doc_id, row_no, a
    """,
    "fx_cells fx_rules",
)
def _(spark, d):
    c = derived.cells(spark, d).select("doc_id", "row_no", "col_no", (F.col("x") - 2).alias("a"), (F.col("x") + 98).alias("b"), (F.col("y") - 2).alias("pos"))
    r = derived.table_rules(spark, d).filter("dir = 'h'").select("doc_id", "pos", F.col("a").alias("lo"), F.col("b").alias("rb"))
    s = c.join(r, ["doc_id", "pos"]).withColumn("hi", F.col("rb") - F.when(F.col("col_no") == 3, 45.0).otherwise(0.0))
    return G.interval_coverage(s.withColumn("edge", F.col("a")), ["doc_id", "row_no", "edge"], "lo", "hi", "a", "b").withColumnRenamed("edge", "a")


@query(
    "cluster_1d",
    f"""
    WITH p AS (SELECT doc_id, page_no, x AS pos, count(*)::DOUBLE AS weight FROM fx_words GROUP BY doc_id, page_no, x),
    q AS (SELECT *, CASE WHEN pos-lag(pos) OVER (PARTITION BY doc_id,page_no ORDER BY pos)>6 THEN 1 ELSE 0 END AS f FROM p),
    g AS (SELECT *, CAST(sum(f) OVER (PARTITION BY doc_id,page_no ORDER BY pos) AS INT) AS cluster FROM q)
    SELECT doc_id, page_no, cluster, {s4("sum(pos*weight)/sum(weight)")} AS pos, sum(weight) AS weight, count(*) AS n FROM g GROUP BY doc_id, page_no, cluster
    """,
    "fx_words",
)
def _(spark, d):
    p = derived.words(spark, d).groupBy("doc_id", "page_no", F.col("x").alias("pos")).agg(F.count("*").cast("double").alias("weight"))
    return G.cluster_1d(p, ["doc_id", "page_no"], "pos", "weight", 6.0).withColumn("pos", r4(F.col("pos")))


@query(
    "ink_span",
    """
    SELECT doc_id, page_no, line_no, x+6.0*(length(t)-length(ltrim(t))) AS x0, x+6.0*length(rtrim(t)) AS x1, CAST(length(t)+1 AS INT) AS starts, x+6.0*(length(t)//2) AS mid
    FROM (SELECT *, concat('  ',text,'   ') AS t FROM fx_lines)
    """,
    "fx_lines",
)
def _(spark, d):
    lines = derived.word_lines(spark, d).withColumn("t", F.concat(F.lit("  "), "text", F.lit("   ")))
    n = F.length("t")
    w = F.lit(6.0) * n
    xs = G.char_xs(F.col("t"), F.col("x"), w)
    return lines.select(
        "doc_id", "page_no", "line_no", G.ink_span(F.col("t"), F.col("x"), w).alias("s"), F.size(xs).alias("starts"), F.element_at(xs, (F.floor(n / 2) + 1).cast("int")).alias("mid")
    ).select("doc_id", "page_no", "line_no", "s.x0", "s.x1", "starts", "mid")
