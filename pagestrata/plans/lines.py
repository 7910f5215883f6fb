"""Queries from glyphs and words to lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestrata.operators import lines as L
from pagestrata.operators.common import half_up, r4
from pagestrata.plans.registry import query, s2, s4
from pagestrata.session import cut_lineage
from pagestrata.sources import derived
from pagestrata.sources.derived import table

PAINT_SQL = "pt AS (SELECT doc_id, page_no, line_no*100000+99999 AS op, x-1 AS x0, y AS y0, x+w+1 AS x1, y+h+2 AS y1 FROM fx_words WHERE length(text)>=9)"


@query("read_glyphs", "SELECT doc_id, page_no, line_no, count(*) AS n, sum(x) AS u, sum(y) AS v FROM fx_glyphs GROUP BY doc_id, page_no, line_no", "fx_glyphs")
def _(spark, d):
    from pagestrata.sources.files import along_baseline

    return along_baseline(derived.glyphs(spark, d)).groupBy(*L.LINE).agg(F.count("*").alias("n"), F.sum("u").alias("u"), F.sum("v").alias("v"))


@query(
    "visible_glyphs",
    f"""
    WITH {PAINT_SQL}, h AS (SELECT DISTINCT g.doc_id, g.page_no, g.seq FROM fx_glyphs g JOIN pt p ON g.doc_id=p.doc_id AND g.page_no=p.page_no AND op>seq AND x>=x0-0.5 AND y-0.6*size>=y0-0.5 AND x+adv<=x1+0.5 AND y+0.15*size<=y1+0.5)
    SELECT doc_id, page_no, line_no, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM fx_glyphs ANTI JOIN h USING (doc_id,page_no,seq) WHERE x+3 BETWEEN -1 AND 613 AND y-size*0.3 BETWEEN -1 AND 1201 GROUP BY doc_id, page_no, line_no
    """,
    "fx_words fx_glyphs",
)
def _(spark, d):
    w = derived.words(spark, d).filter(F.length("text") >= 9)
    paints = w.select("doc_id", "page_no", (F.col("line_no") * 100000 + 99999).alias("op"), (F.col("x") - 1).alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w") + 1).alias("x1"), (F.col("y") + F.col("h") + 2).alias("y1"))
    return L.visible_glyphs(derived.glyphs(spark, d), paints, 612.0, 1200.0).groupBy(*L.LINE).agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query(
    "attach_links",
    """
    WITH k AS (SELECT doc_id, page_no, line_no*1000+word_no%10 AS link_no, x, y, w, h, concat('u',text) AS uri FROM fx_words WHERE text LIKE 't%'), j AS (SELECT g.doc_id, g.page_no, g.line_no, g.seq, arg_min(uri,link_no) AS link FROM fx_glyphs g JOIN k ON g.doc_id=k.doc_id AND g.page_no=k.page_no AND g.x+3 BETWEEN k.x+1.5 AND k.x+k.w-1.5 AND g.y-g.size*0.3 BETWEEN k.y-1 AND k.y+k.h+1 GROUP BY ALL)
    SELECT doc_id, page_no, line_no, link, count(*) AS n FROM j GROUP BY ALL
    """,
    "fx_words fx_glyphs",
)
def _(spark, d):
    w = derived.words(spark, d).filter(F.col("text").startswith("t"))
    links = w.select("doc_id", "page_no", (F.col("line_no") * 1000 + F.col("word_no") % 10).alias("link_no"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"), F.concat(F.lit("u"), "text").alias("uri"))
    return L.attach_links(derived.glyphs(spark, d), links).filter("link IS NOT NULL").groupBy(*L.LINE, "link").agg(F.count("*").alias("n"))


def doubled(spark, d):
    """Glyphs with a shadow under words in capitals and letters struck twice a hair apart."""
    g = derived.glyphs(spark, d).withColumn("invisible", F.lit(False)).withColumn("copy", F.lit(1))
    shadow = g.filter("bold").withColumn("x", F.col("x") + 0.25).withColumn("copy", F.lit(0))
    return g.withColumn("bold", F.lit(False)).unionByName(shadow.withColumn("bold", F.lit(False))).withColumn("seq", F.col("seq") * 2 + F.col("copy"))


@query("dedupe_overprints", "SELECT doc_id, page_no, count(*) AS n, CAST(sum(CASE WHEN bold THEN 1 ELSE 0 END) AS BIGINT) AS bold FROM fx_glyphs GROUP BY doc_id, page_no", "fx_glyphs")
def _(spark, d):
    return L.dedupe_overprints(doubled(spark, d)).groupBy(*L.PAGE).agg(F.count("*").alias("n"), F.count_if("bold").alias("bold"))


@query(
    "replace_spans",
    """
    WITH s AS (SELECT *, CASE WHEN regexp_matches(text,'[0-9]') THEN line_no END AS span FROM fx_glyphs), t AS (SELECT *, CASE WHEN span IS NULL THEN text WHEN row_number() OVER (PARTITION BY doc_id,page_no,span ORDER BY seq)=1 THEN '#' ELSE '' END AS t FROM s)
    SELECT doc_id, page_no, line_no, string_agg(t,'' ORDER BY seq) AS text FROM t GROUP BY doc_id, page_no, line_no
    """,
    "fx_glyphs",
)
def _(spark, d):
    g = derived.glyphs(spark, d).withColumn("span", F.when(F.col("text").rlike("[0-9]"), F.col("line_no"))).withColumn("span_text", F.lit("#"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda r: r["text"]), "")
    return L.replace_spans(g).groupBy(*L.LINE).agg(text.alias("text"))


STATS_SQL = """
ik AS (SELECT * FROM (SELECT *, sum(CASE WHEN ws THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id,page_no ORDER BY seq) AS k FROM fx_glyphs) WHERE NOT ws),
gp AS (SELECT *, x-(lag(x) OVER w+lag(ink) OVER w) AS gap, y-lag(y) OVER w AS off, lag(size) OVER w AS ps, k>lag(k) OVER w AS saw FROM ik WINDOW w AS (PARTITION BY doc_id,page_no ORDER BY seq)),
nr AS (SELECT *, (abs(off)<=0.12*ps OR (least(size,ps)<=0.85*greatest(size,ps) AND abs(off)<=0.6*greatest(size,ps))) AND gap>-0.3*size AND gap<1.5*size AS near FROM gp),
ct AS (SELECT doc_id, page_no, CAST(sum(CASE WHEN near AND saw THEN 1 ELSE 0 END) AS BIGINT) AS space_gaps, CAST(sum(CASE WHEN near AND NOT saw AND gap>0.2*size THEN 1 ELSE 0 END) AS BIGINT) AS "positional" FROM nr GROUP BY doc_id, page_no),
em AS (SELECT doc_id, page_no, list_sort(list(adv/size))[len(list(adv/size))//2+1] AS em FROM fx_glyphs WHERE ws GROUP BY doc_id, page_no),
ss AS (SELECT doc_id, page_no, space_gaps, "positional", coalesce(em,0.28::DOUBLE) AS em, space_gaps>=8 AND space_gaps>=4*"positional" AS spaced FROM ct LEFT JOIN em USING (doc_id,page_no))
"""


@query("spacing_stats", f"WITH {STATS_SQL} SELECT *, CASE WHEN spaced THEN greatest(0.45::DOUBLE,least(1.0::DOUBLE,1.8::DOUBLE*least(em,0.5::DOUBLE))) ELSE 1.0::DOUBLE END AS \"limit\" FROM ss", "fx_glyphs")
def _(spark, d):
    return L.spacing_stats(derived.glyphs(spark, d))


def apart(spark, d):
    """Glyphs in content order with a column-sized jump inside some lines."""
    return derived.glyphs(spark, d).withColumn("x", F.col("x") + F.when((F.col("para_no") % 3 == 1) & (F.col("x") >= 216), 60.0).otherwise(0.0))


def chunked(glyphs):
    """Boxes, limits and gaps of chunks; the glyphs are read once."""
    c = cut_lineage(L.page_chunks(glyphs))
    return c.drop("gaps", "limit"), c.select("doc_id", "page_no", "limit").distinct(), c.select("doc_id", "page_no", "chunk", "gaps")


@query("content_chunks")
def _(spark, d):
    return L.page_chunks(apart(spark, d)).drop("gaps", "limit")


@query("group_lines")
def _(spark, d):
    boxes, stats, gaps = chunked(apart(spark, d))
    return L.group_lines(boxes, stats, gaps).join(boxes, ["doc_id", "page_no", "chunk"]).groupBy("doc_id", "page_no", "line").agg(F.count("*").alias("chunks"), F.min("u0").alias("x0"), F.max("u1").alias("x1"))


FEAT_SQL = """
fs AS (SELECT doc_id, page_no, line_no, arg_max(q,n*1000+q) AS fs FROM (SELECT doc_id, page_no, line_no, floor(size*4+0.5)/4 AS q, count(*)::DOUBLE AS n FROM fx_glyphs WHERE NOT ws GROUP BY ALL) GROUP BY ALL),
bs AS (SELECT doc_id, page_no, line_no, any_value(fs) AS fs, list_sort(list(y) FILTER (abs(size-fs)<=0.12*fs)) AS l FROM fx_glyphs JOIN fs USING (doc_id,page_no,line_no) WHERE NOT ws GROUP BY ALL),
ft AS (SELECT doc_id, page_no, line_no, fs, l[CAST(floor(0.5*(len(l)-1)) AS INT)+1] AS bl FROM bs)
"""


TURNS = [0, 90, 180, -90]


def turned(spark, d):
    """Glyphs of paragraphs set level, upwards, upside down and downwards, at the places that keeps along and across."""
    q = F.col("para_no") % 4
    dx, dy = (F.element_at(F.array(*[F.lit(float(v)) for v in vs]), (q + 1).cast("int")) for vs in ((1, 0, -1, 0), (0, 1, 0, -1)))
    g = derived.glyphs(spark, d).withColumns({"dx": dx, "dy": dy, "_u": F.col("x"), "_v": F.col("y")})
    u, v, dx, dy = (F.col(c) for c in ("_u", "_v", "dx", "dy"))
    return g.withColumns({"x": u * dx - v * dy, "y": u * dy + v * dx}).drop("_u", "_v")


@query(
    "turned_lines",
    f"""
    WITH l AS (SELECT doc_id, page_no, ({TURNS})[para_no%4+1] AS turn, y+h AS v, length(text)*6.0::DOUBLE AS w FROM fx_lines WHERE length(text)>0)
    SELECT doc_id, page_no, CAST(turn AS INT) AS turn, count(*) AS lines, min(72.0::DOUBLE) AS u0, sum(w) AS width, max(w) AS widest FROM l GROUP BY doc_id, page_no, turn
    """,
    "fx_lines",
)
def _(spark, d):
    boxes, stats, gaps = chunked(turned(spark, d))
    lines = L.line_boxes(boxes, L.group_lines(boxes, stats, gaps))
    turn = F.round(F.degrees(F.atan2("dy", "dx"))).cast("int").alias("turn")
    width = F.col("u1") - F.col("u0")
    return lines.groupBy("doc_id", "page_no", turn).agg(F.count("*").alias("lines"), F.min("u0").alias("u0"), F.sum(width).alias("width"), F.max(width).alias("widest"))


@query(
    "turned_features",
    f"""
    WITH {FEAT_SQL} SELECT doc_id, page_no, line_no, any_value(fs) AS font_size, any_value(bl) AS baseline, min(x) AS x0, max(x+ink) AS x1, count(*) AS inks FROM fx_glyphs JOIN ft USING (doc_id,page_no,line_no) WHERE NOT ws GROUP BY doc_id, page_no, line_no
    """,
    "fx_glyphs",
)
def _(spark, d):
    return L.line_features(turned(spark, d)).select(*L.LINE, "font_size", "baseline", "x0", "x1", "inks")


@query(
    "split_tabs",
    """
    WITH g AS (SELECT *, x+CASE WHEN para_no%3=1 AND x>=216 THEN 40.0 ELSE 0.0 END AS u FROM fx_glyphs),
    p AS (SELECT *, lag(ws) OVER w AS pw, lag(u+adv) OVER w AS pe, max(CASE WHEN NOT ws THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id,page_no,line_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, last_value(CASE WHEN NOT ws THEN size END IGNORE NULLS) OVER (PARTITION BY doc_id,page_no,line_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps FROM g WINDOW w AS (PARTITION BY doc_id,page_no,line_no ORDER BY seq)),
    e AS (SELECT *, CASE WHEN NOT ws AND pw AND seen=1 THEN u-pe END AS ex, greatest(size,ps) AS s FROM p), m AS (SELECT doc_id, page_no, line_no, list_sort(list(ex) FILTER (ex IS NOT NULL)) AS l FROM e GROUP BY ALL),
    t AS (SELECT e.*, len(l) AS jumps, coalesce(ex>greatest(0.3*s,2*greatest(0,l[len(l)//2+1])+0.1*s),false) AS tab FROM e JOIN m USING (doc_id,page_no,line_no)), k AS (SELECT *, sum(CASE WHEN tab THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id,page_no,line_no) AS tabs FROM t),
    r AS (SELECT *, CAST(sum(CASE WHEN tab AND NOT (jumps>2 AND tabs>0.5*jumps) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id,page_no,line_no ORDER BY seq) AS INT) AS piece FROM k)
    SELECT doc_id, page_no, line_no, piece, count(*) AS n, min(u) AS x0 FROM r GROUP BY ALL
    """,
    "fx_glyphs",
)
def _(spark, d):
    g = derived.glyphs(spark, d).withColumn("x", F.col("x") + F.when((F.col("para_no") % 3 == 1) & (F.col("x") >= 216), 40.0).otherwise(0.0))
    return L.split_tabs(g).groupBy(*L.LINE, "piece").agg(F.count("*").alias("n"), F.min("x").alias("x0"))


@query(
    "join_word_spaced_rows",
    """
    WITH p AS (SELECT doc_id, page_no, line_no AS row_no, word_no, x+word_no%10*10 AS x0, x+w+word_no%10*10 AS x1, y+h AS baseline, size FROM fx_words),
    g AS (SELECT *, x0-lag(x1) OVER (PARTITION BY doc_id,page_no,row_no ORDER BY x0,word_no) AS gap FROM p),
    r AS (SELECT doc_id, page_no, row_no, count(*) AS n, max(size) AS em, min(gap) AS lo, max(gap) AS hi, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS l, min(baseline) AS base FROM g GROUP BY ALL),
    c AS (SELECT *, true AS even FROM r WHERE n>=3 AND lo>0 AND hi<=3*em AND hi-lo<=greatest(0.06*em, 0.08*l[len(l)//2+1])),
    e AS (SELECT doc_id, page_no, row_no, base, x0 AS edge, floor(x0/1.5) AS strip FROM g JOIN r USING (doc_id,page_no,row_no) WHERE gap IS NOT NULL),
    m AS (SELECT e.*, c.em, e.strip+k AS s FROM e JOIN c USING (doc_id,page_no,row_no), (SELECT unnest([-1,0,1]) AS k)),
    b AS (SELECT DISTINCT m.doc_id, m.page_no, m.row_no, true AS tabular FROM m JOIN e o ON o.doc_id=m.doc_id AND o.page_no=m.page_no AND o.strip=m.s WHERE o.row_no<>m.row_no AND abs(o.row_no-m.row_no)<=4 AND abs(o.base-m.base)<=5*m.em AND abs(m.edge-o.edge)<1.5)
    SELECT doc_id, page_no, row_no, r.n, coalesce(even,false) AND NOT coalesce(tabular,false) AS joined FROM r LEFT JOIN c USING (doc_id,page_no,row_no) LEFT JOIN b USING (doc_id,page_no,row_no)
    """,
    "fx_words",
)
def _(spark, d):
    w = derived.words(spark, d)
    p = w.select("doc_id", "page_no", F.col("line_no").alias("row_no"), F.col("word_no").alias("piece_no"), (F.col("x") + F.col("word_no") % 10 * 10).alias("x0"), (F.col("x") + F.col("w") + F.col("word_no") % 10 * 10).alias("x1"), (F.col("y") + F.col("h")).alias("baseline"), "size")
    return L.join_word_spaced_rows(p)


@query(
    "line_features",
    f"""
    WITH {FEAT_SQL} SELECT doc_id, page_no, line_no, any_value(fs) AS font_size, any_value(bl) AS baseline, CAST(sum(CASE WHEN size<=0.88*fs AND y-bl<-0.12*fs THEN 1 ELSE 0 END) AS BIGINT) AS superscripts, CAST(sum(CASE WHEN size<=0.88*fs AND y-bl>0.08*fs THEN 1 ELSE 0 END) AS BIGINT) AS subscripts,
     min(x) AS x0, max(x+ink) AS x1, count(*) AS inks FROM fx_glyphs JOIN ft USING (doc_id,page_no,line_no) WHERE NOT ws GROUP BY doc_id, page_no, line_no
    """,
    "fx_glyphs",
)
def _(spark, d):
    return L.line_features(derived.glyphs(spark, d))


@query(
    "style_runs",
    f"""
    WITH {FEAT_SQL},
    g AS (SELECT g.*, fs, bl, sum(CASE WHEN ws THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id,page_no,line_no ORDER BY seq) AS k FROM fx_glyphs g JOIN ft USING (doc_id,page_no,line_no)),
    t AS (SELECT *, CASE WHEN size<=0.88*fs AND y-bl<-0.12*fs THEN 'super' WHEN size<=0.88*fs AND y-bl>0.08*fs THEN 'sub' ELSE '' END AS lift FROM g WHERE NOT ws),
    f AS (SELECT *, coalesce(k>lag(k) OVER w OR x-(lag(x) OVER w+lag(ink) OVER w)>CASE WHEN lift<>'' OR lag(lift) OVER w<>'' THEN 0.2*fs ELSE 0.11*fs END, false) AS space, NOT coalesce(family=lag(family) OVER w AND abs(size-lag(size) OVER w)<0.25 AND bold=lag(bold) OVER w AND color=lag(color) OVER w AND lift=lag(lift) OVER w, true) AS fresh, coalesce(lag(lift) OVER w<>'', false) AS up
      FROM t WINDOW w AS (PARTITION BY doc_id,page_no,line_no ORDER BY seq)),
    n AS (SELECT *, CAST(sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER w AS INT) AS run, concat(CASE WHEN space AND fresh AND up THEN ' ' ELSE '' END, text, CASE WHEN coalesce(lead(space) OVER w AND NOT (lead(fresh) OVER w AND lead(up) OVER w), false) THEN ' ' ELSE '' END) AS p FROM f WINDOW w AS (PARTITION BY doc_id,page_no,line_no ORDER BY seq))
    SELECT doc_id, page_no, line_no, run, string_agg(p, '' ORDER BY seq) AS text, arg_min(family,seq) AS family, arg_min(size,seq) AS size, arg_min(bold,seq) AS bold, arg_min(color,seq) AS color, arg_min(lift,seq) AS lift, min(x) AS x0, max(x+ink) AS x1 FROM n GROUP BY doc_id, page_no, line_no, run
    """,
    "fx_glyphs",
)
def _(spark, d):
    g = derived.glyphs(spark, d)
    return L.style_runs(g, L.line_features(g))


@query(
    "line_stretch",
    f"""
    WITH s AS (SELECT *, x+CASE WHEN line_no%3=0 THEN (word_no%10)*3.0 ELSE 0 END AS u FROM fx_words), g AS (SELECT *, u-lag(u+w) OVER (PARTITION BY doc_id,page_no,line_no ORDER BY u,word_no) AS g FROM s), l AS (SELECT doc_id, page_no, line_no, list_sort(list(g/6.0::DOUBLE) FILTER (g IS NOT NULL)) AS r, max(u+w)-min(u)-sum(greatest(0,coalesce(g-6,0))) AS n FROM g GROUP BY ALL)
    SELECT doc_id, page_no, line_no, CASE WHEN len(r)>=2 THEN {s2("r[CAST(floor(0.5*(len(r)-1)) AS INT)+1]")} END AS stretch, {s2("n")} AS natural_width FROM l
    """,
    "fx_words",
)
def _(spark, d):
    w = derived.words(spark, d).withColumn("x", F.col("x") + F.when(F.col("line_no") % 3 == 0, F.col("word_no") % 10 * 3.0).otherwise(0.0))
    return L.line_stretch(w, F.lit(6.0))


@query(
    "order_lines",
    """
    WITH l AS (SELECT doc_id, page_no, line_no, CASE WHEN para_no%2=1 THEN 300.0 ELSE 72.0 END AS x, y+h-CASE WHEN para_no%2=1 THEN 18 ELSE 0 END AS b, size, CASE WHEN para_no%9=8 THEN 1 ELSE 0 END AS rot FROM fx_lines),
    f AS (SELECT *, CASE WHEN b-lag(b) OVER w>0.2*least(size,lag(size) OVER w) THEN 1 ELSE 0 END AS s FROM l WINDOW w AS (PARTITION BY doc_id,page_no,rot ORDER BY b,x,line_no)), r AS (SELECT *, sum(s) OVER (PARTITION BY doc_id,page_no,rot ORDER BY b,x,line_no) AS row_ FROM f)
    SELECT doc_id, page_no, line_no, CAST(row_number() OVER (PARTITION BY doc_id,page_no ORDER BY rot,row_,x,line_no) AS INT) AS reading_no FROM r
    """,
    "fx_lines",
)
def _(spark, d):
    odd = F.col("para_no") % 2 == 1
    lines = derived.word_lines(spark, d).select(
        *L.LINE, F.when(odd, 300.0).otherwise(72.0).alias("x"), (F.col("y") + F.col("h") - F.when(odd, 18.0).otherwise(0.0)).alias("baseline"), "size", F.when(F.col("para_no") % 9 == 8, 90.0).alias("rotation")
    )
    return L.order_lines(lines).select(*L.LINE, "reading_no")


@query(
    "line_tag",
    """
    WITH g AS (SELECT *, CASE WHEN regexp_matches(text,'[a-m]') THEN 1 WHEN regexp_matches(text,'[n-t]') THEN 2 END AS tag, line_no=0 AND text<>'e' AS art FROM fx_glyphs WHERE NOT ws), v AS (SELECT doc_id, page_no, line_no, tag, art, count(*) AS n, min(seq) AS f FROM g GROUP BY ALL),
    a AS (SELECT doc_id, page_no, line_no, sum(n) AS al, sum(CASE WHEN art THEN n ELSE 0 END) AS fu, max(CASE WHEN tag IS NOT NULL AND NOT art THEN n*10000000000-f END) AS top, arg_max(CASE WHEN tag IS NOT NULL AND NOT art THEN tag END, CASE WHEN tag IS NOT NULL AND NOT art THEN n*10000000000-f END) AS tag, max(CASE WHEN tag IS NOT NULL AND NOT art THEN n END) AS bn FROM v GROUP BY ALL)
    SELECT doc_id, page_no, line_no, fu>0.5*al AS artifact, CASE WHEN fu<=0.5*al AND bn>=0.3*al THEN tag END AS tag_id FROM a
    """,
    "fx_glyphs",
)
def _(spark, d):
    t = F.col("text")
    g = derived.glyphs(spark, d).withColumn("tag_id", F.when(t.rlike("[a-m]"), 1).when(t.rlike("[n-t]"), 2)).withColumn("artifact", (F.col("line_no") == 0) & (t != "e"))
    return L.line_tag(g)


ROLES = ["P", "H1", "H3", "H", "Title", "Span", "LI", "H7"]


@query(
    "heading_role",
    f"SELECT role, count(*) AS n, CASE WHEN regexp_matches(role,'^H[1-6]$') THEN CAST(substr(role,2,1) AS INT) WHEN role IN ('H','Title') THEN 1 ELSE 0 END AS level, role NOT IN ('Span','H7') AS block FROM (SELECT ({derived._sql_list(ROLES)})[CAST(l_partkey%8+1 AS INT)] AS role FROM lineitem) GROUP BY role",
)
def _(spark, d):
    r = table(spark, d, "lineitem").groupBy(derived._pick(ROLES, F.col("l_partkey") % 8).alias("role")).agg(F.count("*").alias("n"))
    return r.select("role", "n", L.heading_role(F.col("role")).alias("level"), L.is_block_role(F.col("role")).alias("block"))


@query(
    "decorate",
    """
    WITH m AS (SELECT doc_id, page_no, line_no*100+word_no%10 AS mark_no, x, x+w AS x1, y+h+CASE WHEN text LIKE 'e%' THEN 2.0 ELSE -4.0 END AS my, text LIKE 'e%' AS und FROM fx_words WHERE text LIKE 'e%' OR text LIKE '%on'),
    c AS (SELECT doc_id, page_no, line_no, seq, text, x FROM fx_glyphs), h AS (SELECT c.doc_id, c.page_no, c.seq, bool_or(und) AS u, bool_or(NOT und) AS s FROM c JOIN m ON c.doc_id=m.doc_id AND c.page_no=m.page_no AND c.line_no=m.mark_no//100 AND c.x+3 BETWEEN m.x-0.5 AND m.x1+0.5 GROUP BY ALL),
    f AS (SELECT c.*, coalesce(u,false) AS u, coalesce(s,false) AS s FROM c LEFT JOIN h USING (doc_id,page_no,seq)), g AS (SELECT *, CASE WHEN u<>lag(u) OVER w OR s<>lag(s) OVER w THEN 1 ELSE 0 END AS st FROM f WINDOW w AS (PARTITION BY doc_id,page_no,line_no ORDER BY seq)),
    p AS (SELECT *, CAST(sum(st) OVER (PARTITION BY doc_id,page_no,line_no ORDER BY seq) AS INT) AS piece FROM g)
    SELECT doc_id, page_no, line_no, piece, string_agg(text,'' ORDER BY seq) AS text, bool_or(u) AS underline, bool_or(s) AS strike, min(x) AS x0, max(x+6) AS x1 FROM p GROUP BY ALL
    """,
    "fx_words fx_glyphs",
)
def _(spark, d):
    g = derived.glyphs(spark, d)
    digit = F.col("text").rlike("[0-9]")
    chars = g.select(*L.LINE, F.col("seq").alias("i"), "text", "x", F.lit(6.0).alias("w"), (F.col("y") + F.when(digit, 4.0).otherwise(0.0)).alias("baseline"), F.lit(12.0).alias("size"))
    t = F.col("text")
    w = derived.words(spark, d).filter(t.startswith("e") | t.endswith("on"))
    marks = w.select("doc_id", "page_no", (F.col("line_no") * 100 + F.col("word_no") % 10).alias("mark_no"), F.col("x").alias("x0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h") + F.when(t.startswith("e"), 2.0).otherwise(-4.0)).alias("y"), F.lit(0.5).alias("thickness"))
    return L.decorate(chars, marks)


@query("word_boxes", "SELECT doc_id, page_no, line_no, CAST(row_number() OVER (PARTITION BY doc_id,page_no,line_no ORDER BY word_no)-1 AS INT) AS word_no, text, x, y, w, h FROM fx_words", "fx_words")
def _(spark, d):
    return L.word_boxes(derived.word_lines(spark, d))


@query(
    "deskew_frame",
    f"""
    WITH l AS (SELECT doc_id, page_no, line_no, x, y, w, h, CASE WHEN para_no%3=1 THEN para_no%5*0.3::DOUBLE+89.8::DOUBLE ELSE 0.0 END AS rot FROM fx_lines), a AS (SELECT *, floor(rot*2+0.5)/2 AS angle FROM l WHERE rot<>0),
    u AS (SELECT *, cos(radians(angle))*(x+w/2)+sin(radians(angle))*(y+h/2)-w/2 AS u, cos(radians(angle))*(y+h/2)-sin(radians(angle))*(x+w/2)-h/2 AS v FROM a)
    SELECT doc_id, page_no, line_no, angle, {s2("u")} AS u, {s2("v")} AS v, {s2("min(u) OVER (PARTITION BY doc_id,page_no,angle)")} AS frame_x FROM u
    """,
    "fx_lines",
)
def _(spark, d):
    p = F.col("para_no")
    lines = derived.word_lines(spark, d).withColumn("rotation", F.when(p % 3 == 1, p % 5 * 0.3 + 89.8).otherwise(0.0))
    r2 = lambda c: half_up(F.col(c), 100).alias(c)
    return L.deskew_frame(lines).select(*L.LINE, "angle", r2("u"), r2("v"), r2("frame_x"))


@query(
    "select_region",
    f"""
    WITH r AS (SELECT doc_id*1000+page_no AS region_id, doc_id, page_no, min(x)+50 AS tx, 80.0 AS y0, 200.0 AS ex, 170.0 AS y1 FROM fx_words GROUP BY doc_id, page_no),
    l AS (SELECT doc_id, page_no, line_no, min(x) AS l, max(x+w) AS r, min(y) AS t, max(y+h) AS b, max(size) AS size FROM fx_words GROUP BY ALL),
    j AS (SELECT r.*, line_no, l, l.r AS rr, t, b, size, row_number() OVER (PARTITION BY region_id ORDER BY b,l) AS k, count(*) OVER (PARTITION BY region_id) AS n FROM r JOIN l USING (doc_id,page_no) WHERE b>y0 AND t<y1 AND l.r>tx AND l<ex),
    q AS (SELECT j.*, CASE WHEN k=1 THEN coalesce((SELECT min(x) FROM fx_words f WHERE f.doc_id=j.doc_id AND f.page_no=j.page_no AND f.line_no=j.line_no AND f.x+f.w>greatest(j.l,j.tx)),greatest(l,tx)) ELSE l END AS a, CASE WHEN k=n THEN coalesce((SELECT max(x+w) FROM fx_words f WHERE f.doc_id=j.doc_id AND f.page_no=j.page_no AND f.line_no=j.line_no AND f.x<=least(j.rr,j.ex)),least(rr,ex)) ELSE rr END AS z FROM j)
    SELECT region_id, doc_id, page_no, line_no, a AS x0, z AS x1, {s4("b+0.12*size")} AS underline_y, {s4("t-0.08*size")} AS mark_top FROM q WHERE z-a>1
    """,
    "fx_words",
)
def _(spark, d):
    w = derived.words(spark, d)
    regions = w.groupBy("doc_id", "page_no").agg((F.min("x") + 50).alias("ax")).select((F.col("doc_id") * 1000 + F.col("page_no")).alias("region_id"), "doc_id", "page_no", "ax", F.lit(80.0).alias("ay"), F.lit(200.0).alias("bx"), F.lit(170.0).alias("by"))
    words = w.select(*L.LINE, "word_no", "x", "w", F.col("y").alias("top"), (F.col("y") + F.col("h")).alias("bottom"), (F.col("y") + F.col("h")).alias("baseline"), "size")
    return L.select_region(words, regions).select("region_id", *L.LINE, "x0", "x1", r4(F.col("underline_y")).alias("underline_y"), r4(F.col("mark_top")).alias("mark_top"))
