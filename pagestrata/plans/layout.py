"""Queries of segmentation, paragraphs, lists, headings and page geometry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagestrata.functions import text as T
from pagestrata.operators import docstats as S
from pagestrata.operators import layout as H
from pagestrata.operators.common import r4
from pagestrata.plans.docstats import BODY_SQL
from pagestrata.plans.registry import query, s2, s4
from pagestrata.plans.text import CUE_SQL
from pagestrata.sources import derived

PAGE = ["doc_id", "page_no"]


def lines(spark, d):
    return derived.word_lines(spark, d).withColumn("baseline", F.col("y") + F.col("h"))


@query(
    "bands",
    """
    WITH l AS (SELECT doc_id, page_no, line_no, y-CASE WHEN para_no%2=1 THEN 9 ELSE 0 END AS y, h FROM fx_lines), r AS (SELECT *, max(y+h) OVER (PARTITION BY doc_id,page_no ORDER BY y,line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM l)
    SELECT doc_id, page_no, line_no AS item_no, CAST(sum(CASE WHEN y>=m-least(2,0.25*h) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id,page_no ORDER BY y,line_no) AS INT) AS band FROM r
    """,
    "fx_lines",
)
def _(spark, d):
    y = F.col("y") - F.when(F.col("para_no") % 2 == 1, 9.0).otherwise(0.0)
    return H.bands(lines(spark, d).select(*PAGE, F.col("line_no").alias("item_no"), y.alias("y"), "h")).select(*PAGE, "item_no", "band")


def dealt_lines(spark, d):
    """Lines dealt by page once, for plans whose windows and folds see a page."""
    return derived.by_page(lines(spark, d), derived.table(spark, d, "documents"))


def columned(spark, d, l=None):
    """Pages set in two columns in the lower part: every second line moves up beside the one before it."""
    n = F.col("line_no")
    two = n >= 8
    pair = F.floor((n - 8) / 2)
    y = F.when(two, F.lit(72.0) + 14 * (8 + pair)).otherwise(F.col("y"))
    x = F.when(two & (n % 2 == 1), 330.0).otherwise(72.0)
    w = F.when(two, F.least(F.col("w"), F.lit(230.0))).otherwise(F.col("w"))
    l = lines(spark, d) if l is None else l
    return l.select(*PAGE, n.alias("item_no"), x.alias("x"), y.alias("y"), w.alias("w"), "h", (y + 12).alias("baseline"), "size", F.lit(True).alias("is_text"), F.length(F.regexp_replace("text", r"\s", "")).alias("chars"))


@query("zones")
def _(spark, d):
    return H.zones(columned(spark, d, dealt_lines(spark, d)), laid=True)


@query("zone_kind")
def _(spark, d):
    return H.zones(columned(spark, d, dealt_lines(spark, d)), laid=True).groupBy(*PAGE, "zone_no", "kind").agg(F.count("*").alias("items"), F.count_distinct("region_no").alias("regions"))


@query(
    "reading_order",
    "SELECT doc_id, page_no, line_no AS block_id, CAST(row_number() OVER (PARTITION BY doc_id,page_no ORDER BY para_no%3, row_no%2, y, line_no) AS INT) AS reading_no FROM fx_lines",
    "fx_lines",
)
def _(spark, d):
    b = lines(spark, d).select(*PAGE, F.col("line_no").alias("block_id"), (F.col("para_no") % 3).alias("zone_no"), (F.col("row_no") % 2).alias("region_no"), F.col("y").alias("top"))
    return H.reading_order(b).select(*PAGE, "block_id", "reading_no")


@query("group_rows", "SELECT doc_id, page_no, line_no*100+word_no%10 AS line_no, CAST(dense_rank() OVER (PARTITION BY doc_id,page_no ORDER BY line_no)-1 AS INT) AS row_no FROM fx_words", "fx_words")
def _(spark, d):
    w = derived.words(spark, d)
    return H.group_rows(w.select(*PAGE, (F.col("line_no") * 100 + F.col("word_no") % 10).alias("line_no"), "x", "w", (F.col("y") + F.col("h") + F.col("word_no") % 3).alias("baseline"), F.lit(12.0).alias("size")))


def row_pieces(spark, d):
    """Words as pieces: a column-sized gap after the third word of some rows, dots before the last of others."""
    w = derived.words(spark, d)
    i = F.col("word_no") % 10
    x = F.col("x") + F.when((F.col("para_no") % 3 == 1) & (i >= 3), 40.0).otherwise(0.0)
    text = F.when((F.col("para_no") % 4 == 2) & (i == 8), "........").otherwise(F.col("text"))
    return w.select(*PAGE, F.col("line_no").alias("row_no"), F.col("word_no").alias("piece_no"), text.alias("text"), x.alias("x"), "w", "size", F.lit(500.0).alias("region_right"))


@query(
    "row_text",
    r"""
    WITH p AS (SELECT doc_id, page_no, line_no, word_no, x+CASE WHEN para_no%3=1 AND word_no%10>=3 THEN 40.0 ELSE 0 END AS u, w, size, CASE WHEN para_no%4=2 AND word_no%10=8 THEN '........' ELSE text END AS t FROM fx_words),
    g AS (SELECT *, u-lag(u+w) OVER o AS gap, lead(u) OVER o IS NULL AS lst FROM p WINDOW o AS (PARTITION BY doc_id,page_no,line_no ORDER BY u,word_no)), s AS (SELECT *, CASE WHEN gap IS NULL THEN '' WHEN gap<=1.2*size THEN ' ' ELSE chr(9) END AS sep FROM g),
    r AS (SELECT doc_id, page_no, line_no AS row_no, string_agg(sep||t,'' ORDER BY u,word_no) AS raw, sum(CASE WHEN sep=chr(9) AND NOT (lst AND abs(u+w-500)<=greatest(3,0.3*size)) THEN 1 ELSE 0 END) AS lt, sum(CASE WHEN sep=chr(9) AND lst AND abs(u+w-500)<=greatest(3,0.3*size) THEN 1 ELSE 0 END) AS rt FROM s GROUP BY ALL),
    m AS (SELECT *, regexp_extract(raw,'(?s)^(.+?)(\s*(?:[.·…]{5,}|(?:\. ){5,}\.?|_{5,}|-{6,})\s*)(.*)$',1) AS hd, regexp_extract(raw,'(?s)^(.+?)(\s*(?:[.·…]{5,}|(?:\. ){5,}\.?|_{5,}|-{6,})\s*)(.*)$',2) AS mk, regexp_extract(raw,'(?s)^(.+?)(\s*(?:[.·…]{5,}|(?:\. ){5,}\.?|_{5,}|-{6,})\s*)(.*)$',3) AS tl FROM r),
    f AS (SELECT *, mk<>'' AND trim(tl)<>'' AND length(tl)<=30 AND NOT contains(tl,chr(9)) AS led FROM m)
    SELECT doc_id, page_no, row_no, CASE WHEN led THEN hd||chr(9)||tl ELSE raw END AS text, CAST(lt AS BIGINT) AS left_tabs, CAST(rt AS BIGINT) AS right_tabs, CASE WHEN led THEN CASE WHEN contains(mk,'_') THEN 'underscore' WHEN contains(mk,'-') THEN 'hyphen' ELSE 'dot' END END AS leader FROM f
    """,
    "fx_words",
)
def _(spark, d):
    return H.row_text(row_pieces(spark, d))


MARKS = ["•", "1.", "a)", "-", "iv.", "Then", "(b)", "2.1."]


def marked_rows(spark, d):
    """Rows that begin with a marker by turns; some gaps are measured."""
    l = lines(spark, d)
    k = F.col("line_no") % 8
    item = F.col("row_no") == 0
    return l.select(
        *PAGE, F.col("line_no").alias("row_no"), "baseline", "size", F.when(item, F.concat(derived._pick(MARKS, k), F.lit(" "), "text")).otherwise(F.col("text")).alias("text"),
        F.when(item, F.lit(72.0) + F.col("para_no") % 2 * 18).otherwise(90.0).alias("x0"), F.lit(90.0).alias("text_x"), F.when(F.col("line_no") % 3 == 0, 6.0).when(F.col("line_no") % 3 == 1, 5.0).alias("gap"), "para_no",
    )


@query(
    "detect_marker",
    rf"""
    WITH r AS (SELECT doc_id, page_no, line_no AS row_no, y+h AS b, size, CASE WHEN row_no=0 THEN concat(({derived._sql_list(MARKS)})[line_no%8+1],' ',text) ELSE text END AS t, CASE WHEN row_no=0 THEN 72.0+para_no%2*18 ELSE 90.0 END AS x0, CASE line_no%3 WHEN 0 THEN 6.0 WHEN 1 THEN 5.0 END AS gap FROM fx_lines),
    k AS (SELECT *, regexp_extract(t,'^(\S+)\s',1) AS tok FROM r),
    f AS (SELECT *, regexp_matches(tok,'^[•◦▪▫‣⁃●○■□◆◇►▶▸▹➢➤➣➔→⇒✓✔✗✘❖❑❒⦿⦾∙·*–—-]$') AS bu, regexp_matches(tok,'^(\(?(\d{{1,3}}(?:\.\d{{1,3}})*|[a-zA-Z]|[ivxlcdm]{{1,6}}|[IVXLCDM]{{1,6}})[.)]|\((\d{{1,3}}|[a-zA-Z]|[ivxlcdm]{{1,6}})\))$') AS nu, regexp_matches(tok,'^[*–—·-]$') AS wk FROM k),
    m AS (SELECT *, (bu OR nu) AND NOT (gap IS NOT NULL AND ((NOT (bu AND NOT wk) AND gap<0.45*size) OR (regexp_matches(tok,'^[a-zA-Z][.)]$') AND gap<0.6*size))) AS mk, gap IS NOT NULL OR (bu AND NOT wk) AS strong FROM f),
    g AS (SELECT *, CASE WHEN mk THEN CASE WHEN bu THEN 'b:'||tok ELSE concat('n:',CASE WHEN regexp_matches(regexp_replace(tok,'[().]','','g'),'^\d') THEN 'd' WHEN regexp_matches(regexp_replace(tok,'[().]','','g'),'^[ivxlcdm]+$') THEN 'r' WHEN regexp_matches(regexp_replace(tok,'[().]','','g'),'^[IVXLCDM]+$') THEN 'R' WHEN regexp_matches(regexp_replace(tok,'[().]','','g'),'^[a-z]$') THEN 'a' ELSE 'A' END, CASE WHEN tok LIKE '(%)' THEN '()' WHEN tok LIKE '%)' THEN ')' ELSE '.' END) END END AS family FROM m),
    n AS (SELECT *, lead(mk) OVER w AS nm, lead(x0) OVER w AS nx FROM g WINDOW w AS (PARTITION BY doc_id,page_no ORDER BY b,row_no))
    SELECT doc_id, page_no, row_no, tok AS marker, CASE WHEN bu THEN 'bullet' ELSE 'number' END AS kind, family, x0::DOUBLE AS marker_x, 90.0::DOUBLE AS text_x FROM n WHERE mk AND (strong OR (EXISTS (SELECT 1 FROM g o WHERE o.doc_id=n.doc_id AND o.page_no=n.page_no AND o.mk AND o.family=n.family AND o.row_no<>n.row_no AND abs(o.x0-n.x0)<=2) AND coalesce(NOT nm AND nx>x0+0.5*size AND abs(nx-90)<=0.6*size,false)))
    """,
    "fx_lines",
)
def _(spark, d):
    return H.detect_marker(marked_rows(spark, d))


@query(
    "tab_alignment",
    """
    WITH t AS (SELECT doc_id, page_no, line_no AS tab_no, CASE para_no%3 WHEN 0 THEN 300-(30+length(first_w_)*6)/2 WHEN 1 THEN 500.0-(30+length(first_w_)*6) ELSE 200.0+line_no%7*31 END AS x, 30.0+length(first_w_)*6 AS w FROM (SELECT *, repeat('x',CAST(first_w/6 AS INT)) AS first_w_ FROM fx_lines)),
    c AS (SELECT a.doc_id, a.page_no, a.tab_no, count(*)>=2 AND max(abs(b.x-a.x))>2 AS ce FROM t a JOIN t b ON a.doc_id=b.doc_id AND a.page_no=b.page_no AND abs(a.x+a.w/2-b.x-b.w/2)<=1 GROUP BY ALL), e AS (SELECT a.doc_id, a.page_no, a.tab_no, count(*)>=2 AND max(abs(b.x-a.x))>2 AS fl FROM t a JOIN t b ON a.doc_id=b.doc_id AND a.page_no=b.page_no AND abs(a.x+a.w-b.x-b.w)<=1 GROUP BY ALL)
    SELECT doc_id, page_no, tab_no, CASE WHEN ce THEN 'center' WHEN fl THEN 'right' ELSE 'left' END AS align, (CASE WHEN ce THEN x+w/2 WHEN fl THEN x+w ELSE x END)::DOUBLE AS stop FROM t JOIN c USING (doc_id,page_no,tab_no) JOIN e USING (doc_id,page_no,tab_no)
    """,
    "fx_lines",
)
def _(spark, d):
    p, w = F.col("para_no") % 3, F.col("first_w") + 30
    x = F.when(p == 0, F.lit(300.0) - w / 2).when(p == 1, F.lit(500.0) - w).otherwise(F.lit(200.0) + F.col("line_no") % 7 * 31)
    return H.tab_alignment(lines(spark, d).select(*PAGE, F.col("line_no").alias("tab_no"), x.alias("x"), w.alias("w")))


def region_rows(spark, d, l=None):
    l = lines(spark, d) if l is None else l
    return l.select(
        *PAGE, (F.col("para_no") % 2).alias("region_no"), F.col("line_no").alias("row_no"), "text", F.col("x").alias("x0"), (F.col("x") + F.col("w")).alias("x1"), "baseline", "size", F.col("first_w").alias("first_w"),
        (F.col("para_no") == 0).alias("bold"), F.lit(False).alias("marked"), F.col("x").alias("text_x"), F.lit(0).alias("tabs"), F.lit(0.0).alias("tab_x"), F.lit(72.0).alias("left"), F.lit(540.0).alias("right"), "para_no",
    )


@query(
    "wrap_edge",
    f"""
    WITH r AS (SELECT doc_id, page_no, para_no%2 AS region_no, line_no, x AS x0, x+w AS x1, text, lead(x) OVER o AS nx, lead(text) OVER o AS nt FROM fx_lines WINDOW o AS (PARTITION BY doc_id,page_no,para_no%2 ORDER BY y+h,line_no)),
    e AS (SELECT doc_id, page_no, region_no, list_reverse_sort(list(x1)) AS e FROM r GROUP BY ALL), t AS (SELECT *, CASE WHEN len(e)>=3 AND e[1]-e[2]>20 AND e[2]-e[3]<=3 THEN e[2] ELSE e[1] END AS top FROM e),
    g AS (SELECT t.doc_id, t.page_no, t.region_no, any_value(top) AS top, any_value(len(list_filter(e, lambda v: abs(v-top)<=1.2)))>=2 AS ju, bool_or(coalesce(x1>=top-0.12*(top-72) AND abs(nx-x0)<=2 AND {CUE_SQL.format(a="text", b="nt")},false)) AS ra FROM t JOIN r USING (doc_id,page_no,region_no) GROUP BY ALL)
    SELECT doc_id, page_no, region_no, CASE WHEN NOT (540-top<=greatest(6,0.03*468)) AND (ju OR ra) THEN top ELSE greatest(top,540.0::DOUBLE) END AS wrap_right FROM g
    """,
    "fx_lines",
)
def _(spark, d):
    return H.wrap_edge(region_rows(spark, d))


@query(
    "right_stacks",
    """
    WITH r AS (SELECT doc_id, page_no, line_no, y+h AS b, size, 540.0-length(split_part(text,' ',1))*6-length(split_part(text,' ',2))*6 AS x0, CASE WHEN para_no%4=3 THEN 500.0 ELSE 540.0 END AS x1, first_w AS fw FROM fx_lines),
    p AS (SELECT *, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(b) OVER w AS pb, lag(size) OVER w AS ps FROM r WINDOW w AS (PARTITION BY doc_id,page_no ORDER BY b,line_no)),
    q AS (SELECT *, coalesce(abs(x1-px1)<=greatest(1.5,0.12*greatest(size,ps)) AND b-pb BETWEEN 0.7*greatest(size,ps) AND 2.2*greatest(size,ps) AND px0-72>=greatest(3*greatest(size,ps),70.2) AND x0-72>=greatest(3*greatest(size,ps),70.2) AND px0-72>fw+0.28*ps+greatest(2,0.35*greatest(size,ps)),false) AS ok FROM p),
    s AS (SELECT *, CAST(sum(CASE WHEN ok OR pb IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id,page_no ORDER BY b,line_no) AS INT) AS stack FROM q),
    k AS (SELECT doc_id, page_no, stack FROM s GROUP BY ALL HAVING count(*)>=2 AND max(x0)-min(x0)>greatest(4,0.6*max(size)) AND max((x1-x0)/468)<=0.7)
    SELECT doc_id, page_no, 0 AS region_no, line_no AS row_no, stack FROM s JOIN k USING (doc_id,page_no,stack)
    """,
    "fx_lines",
)
def _(spark, d):
    parts = F.split("text", " ")
    short = lambda k: F.length(F.coalesce(F.try_element_at(parts, F.lit(k)), F.lit(""))) * 6
    r = lines(spark, d).select(
        *PAGE, F.lit(0).alias("region_no"), F.col("line_no").alias("row_no"), (F.lit(540.0) - short(1) - short(2)).alias("x0"), F.when(F.col("para_no") % 4 == 3, 500.0).otherwise(540.0).alias("x1"),
        "baseline", "size", "first_w", F.lit(False).alias("marked"), F.lit(0).alias("tabs"), F.lit(72.0).alias("left"), F.lit(540.0).alias("right"),
    )
    return H.right_stacks(r)


def paragraph_rows(spark, d):
    r = region_rows(spark, d, dealt_lines(spark, d)).withColumn("region_no", F.lit(0)).withColumn("stack", F.lit(-1)).withColumn("leading", F.lit(1.17))
    edge = F.max("x1").over(Window.partitionBy(*PAGE))
    return r.withColumn("wrap_right", edge)


@query("group_paragraphs")
def _(spark, d):
    return H.group_paragraphs(paragraph_rows(spark, d), laid=True)


@query(
    "paragraph_format",
    f"""
    WITH r AS (SELECT doc_id, page_no, para_no AS para_id, row_number() OVER o AS i, count(*) OVER (PARTITION BY doc_id,page_no,para_no) AS n, CASE para_no%4 WHEN 1 THEN 306-w/2 WHEN 2 THEN 540-w ELSE 72.0 END AS x0, CASE para_no%4 WHEN 1 THEN 306-w/2+w WHEN 0 THEN 72+w ELSE 540.0 END AS x1, y+h-lag(y+h) OVER o AS gap, size FROM fx_lines WINDOW o AS (PARTITION BY doc_id,page_no,para_no ORDER BY y+h,line_no)),
    g AS (SELECT doc_id, page_no, para_id, max(n) AS n, max(size) AS sz, max(CASE WHEN i=1 THEN x0 END) AS l0, arg_min(x0,i) FILTER (i>1) AS b0, max(x0) FILTER (i>1)-min(x0) FILTER (i>1) AS vb, max(x0)-min(x0) AS vl, max((x0+x1)/2)-min((x0+x1)/2) AS vm, max(x1)-min(x1) AS vr, max(x1) FILTER (i<n)-min(x1) FILTER (i<n) AS vf, max(x1) FILTER (i<n) AS fu,
      list_sort(list(x0) FILTER (i>1)) AS lb, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS lp, list_sort(list((x0+x1)/2)) AS lm, max(CASE WHEN i=1 THEN x1 END) AS x1, max(x1) AS xm, max(x1-x0) AS wi FROM r GROUP BY ALL),
    j AS (SELECT *, coalesce(n>=2 AND vf<=greatest(1.2,0.08*sz) AND abs(fu-540)<=greatest(3,0.4*sz),false) AS ju, greatest(1.5,0.15*sz) AS tol, lm[len(lm)//2+1] AS mid FROM g), v AS (SELECT doc_id, page_no, sum(CASE WHEN n>=3 THEN 1 ELSE 0 END)>0 AND sum(CASE WHEN n>=3 AND ju THEN 1 ELSE 0 END)>=0.5*sum(CASE WHEN n>=3 THEN 1 ELSE 0 END) AS pref FROM j GROUP BY ALL),
    k AS (SELECT *, l0-b0 AS off, vm<=greatest(2,0.2*sz) AS ce, vr<=tol AS ev, vl>tol AS va FROM j JOIN v USING (doc_id,page_no)), l AS (SELECT *, vb<=tol AND (abs(off)<=tol OR (off>tol AND off<=8*sz AND n>=3) OR (off<-tol AND -off<=12*sz)) AS fl FROM k),
    m AS (SELECT *, CASE WHEN n>=2 THEN CASE WHEN ev AND va AND NOT (fl AND abs(off)>tol AND n>=3) THEN 'right' WHEN fl AND ju AND (n>=3 OR pref) THEN 'justify' WHEN fl AND NOT (va AND ce) THEN 'left' WHEN ce AND va THEN 'center' WHEN ev AND va THEN 'right' ELSE 'left' END
      WHEN abs((l0+x1)/2-306)<=greatest(2,0.015*468) AND l0-72>0.04*468 THEN 'center' WHEN abs(x1-540)<=1.5 AND l0-72>greatest(0.08*468,3*sz) THEN 'right' ELSE 'left' END AS align, CASE WHEN n>=2 THEN lb[len(lb)//2+1] ELSE l0 END AS bx, greatest(least(2*least(mid-72,540-mid),468),wi+2) AS cw FROM l)
    SELECT doc_id, page_no, 0 AS region_no, para_id, n, align, {s2("CASE WHEN align IN ('left','justify') THEN greatest(0,bx-72) WHEN align='center' THEN greatest(0,mid-cw/2-72) ELSE 0 END")} AS indent_left, {s2("CASE align WHEN 'justify' THEN greatest(0,540-fu) WHEN 'right' THEN greatest(0,540-xm) WHEN 'center' THEN greatest(0,540-mid-cw/2) ELSE 0 END")} AS indent_right,
     {s2("CASE WHEN align IN ('left','justify') AND abs(l0-bx)>=1 THEN l0-bx ELSE 0 END")} AS first_indent, {s2("coalesce(lp[len(lp)//2+1],sz*1.2::DOUBLE)")} AS line_spacing FROM m
    """,
    "fx_lines",
)
def _(spark, d):
    p, w = F.col("para_no") % 4, F.col("w")
    x0 = F.when(p == 1, F.lit(306.0) - w / 2).when(p == 2, F.lit(540.0) - w).otherwise(72.0)
    x1 = F.when((p == 3) | (p == 2), F.lit(540.0)).otherwise(x0 + w)
    r = lines(spark, d).select(
        *PAGE, F.lit(0).alias("region_no"), F.col("para_no").alias("para_id"), F.col("line_no").alias("row_no"), x0.alias("x0"), x1.alias("x1"), x0.alias("text_x"), "baseline", "size", F.lit(False).alias("marked"), F.lit(0).alias("tabs"),
        F.lit(False).alias("keep_lines"), F.lit(540.0).alias("wrap_right"), F.lit(72.0).alias("region_x"), F.lit(540.0).alias("region_right"), F.lit(1.2).alias("leading"), F.lit(False).alias("stretched"), F.lit(False).alias("flush"),
    )
    return H.paragraph_format(r)


@query(
    "join_lines",
    r"""
    WITH r AS (SELECT doc_id, page_no, para_no AS para_id, line_no, para_no%3=1 AS kl, CASE WHEN regexp_matches(text,'tion$') THEN text||'-' WHEN regexp_matches(text,'nd$') THEN text||chr(173) ELSE text END AS t FROM fx_lines), n AS (SELECT *, lead(t) OVER (PARTITION BY doc_id,page_no,para_id ORDER BY line_no) AS nx FROM r),
    p AS (SELECT *, CASE WHEN nx IS NULL THEN rtrim(t) WHEN kl THEN t||chr(10) WHEN (regexp_matches(t,'\p{L}[-\x{AD}\x{2010}]$') AND regexp_matches(nx,'^\p{Ll}')) OR regexp_matches(t,'\x{AD}$') THEN left(t,length(t)-1) ELSE t||' ' END AS p FROM n)
    SELECT doc_id, page_no, para_id, string_agg(p,'' ORDER BY line_no) AS text FROM p GROUP BY doc_id, page_no, para_id
    """,
    "fx_lines",
)
def _(spark, d):
    t = F.col("text")
    text = F.when(t.rlike("tion$"), F.concat(t, F.lit("-"))).when(t.rlike("nd$"), F.concat(t, F.lit("­"))).otherwise(t)
    return H.join_lines(lines(spark, d).select(*PAGE, F.col("para_no").alias("para_id"), F.col("line_no").alias("row_no"), text.alias("text"), (F.col("para_no") % 3 == 1).alias("keep_lines")))


def heading_paras(spark, d):
    l = lines(spark, d)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), " ")
    p = l.groupBy("doc_id", "page_no", "para_no").agg(text.alias("text"), F.count("*").alias("rows"), F.max("size").alias("size"))
    n = F.col("para_no")
    return p.select(
        "doc_id", (F.col("page_no") * 100000 + n).alias("para_key"), F.regexp_replace("text", r"\.$", "").alias("text"), "rows", (F.col("size") + F.when(n % 5 == 3, 5.0).otherwise(0.0)).alias("size"), (n % 5 == 3).alias("bold"), F.lit(False).alias("italic"),
        F.lit("Arial").alias("family"), F.lit("000000").alias("color"), F.lit(0).alias("tabs"), F.lit(False).alias("bold_label"),
    )


@query(
    "classify_heading",
    rf"""
    WITH {BODY_SQL}, p AS (SELECT doc_id, page_no*100000+para_no AS para_key, para_no, regexp_replace(string_agg(text,' ' ORDER BY line_no),'\.$','') AS t, count(*) AS rw, max(size)+CASE WHEN para_no%5=3 THEN 5 ELSE 0 END AS size FROM fx_lines GROUP BY doc_id, page_no, para_no),
    q AS (SELECT *, regexp_replace(trim(regexp_replace(t,'\s+',' ','g')),'^(\d{{1,3}}(\.\d{{1,3}})*|[A-Za-z]|[IVXLCivxlc]{{1,6}})[.)]?\s+','') AS pl, size/body AS ra FROM p JOIN body USING (doc_id)),
    v AS (SELECT *, regexp_replace(regexp_extract(pl,'^([^:\t]{{1,40}}):\s*(\S.*)$',2),'\s','','g') AS val FROM q),
    k AS (SELECT *, rw<=CASE WHEN ra>=1.6 THEN 3 ELSE 2 END AND length(pl)<=120 AND regexp_matches(pl,'\p{{L}}{{2}}') AND NOT regexp_matches(pl,'[.,;!]$') AND NOT regexp_matches(pl,'[.!?…][\"»”)]?\s+\S') AND NOT (regexp_matches(pl,'^([^:\t]{{1,40}}):\s*(\S.*)$') AND (length(regexp_replace(val,'[^0-9]','','g'))>=0.25*length(val) OR regexp_matches(val,'(?i)@|https?:|www\.'))) AS ok FROM v)
    SELECT doc_id, para_key, CASE WHEN ok THEN CASE WHEN ra>=1.6 THEN 1 WHEN ra>=1.3 THEN 2 WHEN ra>=1.15 AND para_no%5=3 THEN 3 END END AS level FROM k
    """,
    "fx_lines",
)
def _(spark, d):
    return H.classify_heading(heading_paras(spark, d), None, S.body_font_size(derived.word_lines(spark, d)))


@query(
    "tagged_heading",
    """
    WITH r AS (SELECT doc_id, page_no, para_no AS para_id, line_no%3*(CASE WHEN para_no%2=0 THEN 1 ELSE 0 END) AS lv, length(replace(text,' ','')) AS n FROM fx_lines), v AS (SELECT doc_id, page_no, para_id, lv, sum(n) AS n FROM r GROUP BY ALL), a AS (SELECT doc_id, page_no, para_id, sum(n) AS al, arg_max(CASE WHEN lv>0 THEN lv END, CASE WHEN lv>0 THEN n*10-lv END) AS lv, max(CASE WHEN lv>0 THEN n END) AS n FROM v GROUP BY ALL)
    SELECT doc_id, page_no, para_id, CAST(CASE WHEN n>=0.6*al THEN least(3,lv) END AS INT) AS level FROM a
    """,
    "fx_lines",
)
def _(spark, d):
    level = F.col("line_no") % 3 * F.when(F.col("para_no") % 2 == 0, 1).otherwise(0)
    return H.tagged_heading(lines(spark, d).select(*PAGE, F.col("para_no").alias("para_id"), "text", level.alias("role_level")))


@query(
    "drop_orphan_headings",
    """
    WITH b AS (SELECT doc_id, page_no, para_no AS block_id, CASE WHEN para_no%9=8 THEN 'table' ELSE 'paragraph' END AS kind, CASE WHEN para_no%3=0 THEN 1 END AS level, min(y) AS top, max(y+h) AS bottom FROM fx_lines GROUP BY ALL), w AS (SELECT *, max(CASE WHEN kind='table' OR level IS NULL THEN top END) OVER (PARTITION BY doc_id,page_no) AS low FROM b)
    SELECT doc_id, page_no, block_id, CASE WHEN low>=bottom-2 THEN level END AS level FROM w
    """,
    "fx_lines",
)
def _(spark, d):
    n = F.col("para_no")
    b = lines(spark, d).groupBy(*PAGE, n.alias("block_id")).agg(F.min("y").alias("top"), F.max(F.col("y") + F.col("h")).alias("bottom"))
    b = b.withColumn("kind", F.when(F.col("block_id") % 9 == 8, "table").otherwise("paragraph")).withColumn("level", F.when(F.col("block_id") % 3 == 0, 1))
    return H.drop_orphan_headings(b).select(*PAGE, "block_id", "level")


@query(
    "list_levels",
    """
    WITH p AS (SELECT doc_id, page_no, para_no%2 AS region_no, line_no AS para_id, 72.0+length(text)%5*6.4 AS mx FROM fx_lines WHERE row_no=0), x AS (SELECT doc_id, page_no, region_no, list_distinct(list(floor(mx+0.5))) AS xs FROM p GROUP BY ALL)
    SELECT doc_id, page_no, region_no, para_id, CAST(least(8,greatest(0,len(list_filter(xs, lambda v: mx>=v-2))-1)) AS INT) AS level FROM p JOIN x USING (doc_id,page_no,region_no)
    """,
    "fx_lines",
)
def _(spark, d):
    p = lines(spark, d).filter("row_no = 0").select(*PAGE, (F.col("para_no") % 2).alias("region_no"), F.col("line_no").alias("para_id"), (F.lit(72.0) + F.length("text") % 5 * 6.4).alias("marker_x"))
    return H.list_levels(p)


@query("number_lists")
def _(spark, d):
    m = derived.markers(spark, d).groupBy("doc_id", "item_no").agg(F.min("marker").alias("marker"))
    i = F.col("item_no")
    marker = F.when(i <= 4, F.concat(i.cast("string"), F.lit("."))).otherwise(F.col("marker"))
    return H.number_lists(m.select("doc_id", F.floor(i / 7).alias("closes"), i.alias("ord"), (i % 2 * 0).alias("level"), T.parse_marker(marker).alias("parsed")))


@query("layout_mode")
def _(spark, d):
    c = columned(spark, d)
    src = lines(spark, d)
    l = c.select(*PAGE, F.col("item_no").alias("line_no"), "x", "y", "w", "h", "size", "chars").join(
        src.select(*PAGE, "line_no", F.when(F.col("para_no") % 13 == 7, "FFFFFF").otherwise("000000").alias("color"), (F.col("para_no") % 11 == 9).alias("rotated"), F.lit(False).alias("in_table")), [*PAGE, "line_no"]
    )
    pages = src.groupBy(*PAGE).agg(F.lit(612.0).alias("page_w"), F.lit(792.0).alias("page_h"), F.lit(0).alias("tables"), (F.max("line_no") < 5).alias("ocr"), (F.max("line_no") % 4 == 1).alias("vector"))
    pics = src.filter("para_no % 6 = 4").select(*PAGE, "x", "y", F.lit(120.0).alias("w"), F.lit(60.0).alias("h"))
    z = H.zones(c).withColumnRenamed("item_no", "line_no")
    m = H.layout_mode(l, pages, pics, z, S.body_font_size(derived.word_lines(spark, d)))
    return m.select(*PAGE, F.array_join("reasons", "; ").alias("reasons"), "mode")


@query(
    "page_margins",
    f"""
    WITH b AS (SELECT doc_id, page_no, min(x+para_no%3*40) AS x0, max(x+para_no%3*40+w) AS x1, min(y) AS y0, max(y+h) AS y1 FROM fx_lines GROUP BY ALL)
    SELECT doc_id, page_no, {s2("CASE WHEN x0<=greatest(90,0.18*612) THEN greatest(0,x0) ELSE least(72,x0) END")} AS "left", {s2("CASE WHEN 612-x1<=greatest(90,0.18*612) THEN greatest(0,612-x1) ELSE least(72,612-x1) END")} AS "right", {s2("greatest(0,least(72,y0))")} AS top, {s2("greatest(0,least(48,(792-y1)*0.5))")} AS bottom FROM b
    """,
    "fx_lines",
)
def _(spark, d):
    l = lines(spark, d)
    pages = l.select(*PAGE).distinct().withColumn("page_w", F.lit(612.0)).withColumn("page_h", F.lit(792.0))
    return H.page_margins(l.withColumn("x", F.col("x") + F.col("para_no") % 3 * 40), pages)


@query(
    "column_layout",
    """
    WITH g AS (SELECT doc_id, page_no, para_no%2 AS z, row_no%2 AS rg, sum(length(replace(text,' ',''))) AS chars, min(line_no) AS a, max(line_no) AS b FROM fx_lines GROUP BY ALL), t AS (SELECT doc_id, page_no, sum(chars) AS al FROM g GROUP BY ALL),
    f AS (SELECT doc_id, page_no, min(z) AS z FROM (SELECT g.doc_id, g.page_no, z, sum(chars) AS c, any_value(al) AS al FROM g JOIN t USING (doc_id,page_no) GROUP BY ALL) WHERE c>=0.6*al GROUP BY ALL)
    SELECT doc_id, page_no, z AS zone_no, count(*) AS columns, CASE WHEN count(*)>1 THEN 20.0::DOUBLE END AS gap, min(a) AS first, max(b) AS last, max(CASE WHEN rg=1 THEN a END) AS break_at FROM g JOIN f USING (doc_id,page_no,z) GROUP BY ALL HAVING count(*)>1
    """,
    "fx_lines",
)
def _(spark, d):
    l = lines(spark, d).withColumn("zone_no", F.col("para_no") % 2).withColumn("region_no", F.col("row_no") % 2)
    r = l.groupBy(*PAGE, "zone_no", "region_no").agg(F.sum(T.letter_count(F.col("text"))).alias("chars")).withColumn("kind", F.lit("columns"))
    r = r.withColumn("x0", F.lit(72.0) + F.col("region_no") * 220).withColumn("x1", F.lit(272.0) + F.col("region_no") * 220)
    c = H.column_layout(r, l.select(*PAGE, "zone_no", "region_no", F.col("line_no").alias("reading_no")))
    return c.select(*PAGE, "zone_no", "columns", "gap", "first", "last", F.array_max("breaks").alias("break_at"))


PARA_SQL = "pa AS (SELECT doc_id, page_no, para_no AS para_id, min(y) AS y, max(y+h)-min(y) AS h, max(w) AS w FROM fx_lines GROUP BY ALL)"


def paras(spark, d):
    p = lines(spark, d).groupBy(*PAGE, F.col("para_no").alias("para_id")).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"), F.max("w").alias("w"))
    return p.select(*H.PARA, "x", "y", "w", "h", F.lit(14.0).alias("line_spacing"), F.lit(72.0).alias("area_x0"), F.lit(540.0).alias("area_x1"))


@query(
    "attach_shading",
    f"""
    WITH {PARA_SQL}, f AS (SELECT doc_id, page_no, para_id AS fill_no, CASE WHEN para_id%4=1 THEN 100.0 ELSE 70.0 END AS x, y-1 AS y, CASE WHEN para_id%5=3 THEN 300.0 ELSE 472.0 END AS w, h+CASE WHEN para_id%3=2 THEN 30 ELSE 2 END AS h, para_id%7=6 AS white FROM pa),
    c AS (SELECT f.*, p.para_id, p.h AS ph, 72>=f.x-1.5 AND p.y>=f.y-1.5 AND 72+p.w<=f.x+f.w+1.5 AND p.y+p.h<=f.y+f.h+1.5 AS held, greatest(0,least(f.x+f.w,72+p.w)-greatest(f.x,72))*greatest(0,least(f.y+f.h,p.y+p.h)-greatest(f.y,p.y))>0.2*p.w*p.h AS tou FROM f JOIN pa p ON p.doc_id=f.doc_id AND p.page_no=f.page_no WHERE NOT white AND p.y<=f.y+f.h+1.5 AND p.y+p.h>=f.y-1.5),
    s AS (SELECT doc_id, page_no, fill_no FROM c GROUP BY ALL HAVING sum(CASE WHEN held THEN 1 ELSE 0 END)=1 AND sum(CASE WHEN tou AND NOT held THEN 1 ELSE 0 END)=0)
    SELECT doc_id, page_no, para_id, 'DDDDDD' AS shading, min(fill_no) AS fill_no FROM c JOIN s USING (doc_id,page_no,fill_no) WHERE held AND abs(x-72)<=4 AND abs(x+w-540)<=4 AND h<=ph+1.2*14 GROUP BY doc_id, page_no, para_id
    """,
    "fx_lines",
)
def _(spark, d):
    p, n = paras(spark, d), F.col("para_id")
    f = p.select(*PAGE, n.alias("fill_no"), F.when(n % 4 == 1, 100.0).otherwise(70.0).alias("x"), (F.col("y") - 1).alias("y"), F.when(n % 5 == 3, 300.0).otherwise(472.0).alias("w"), (F.col("h") + F.when(n % 3 == 2, 30.0).otherwise(2.0)).alias("h"), F.when(n % 7 == 6, "FFFFFF").otherwise("DDDDDD").alias("color"), F.lit(1.0).alias("opacity"))
    return H.attach_shading(p, f)


@query(
    "attach_leaders",
    """
    SELECT doc_id, page_no, line_no AS gap_id, CASE line_no%3 WHEN 0 THEN 'dot' WHEN 1 THEN 'hyphen' ELSE 'underscore' END AS leader FROM fx_lines WHERE 500-(72+w)>1.2*size AND NOT (line_no%3=2 AND para_no%2=1) AND line_no%7<>5
    """,
    "fx_lines",
)
def _(spark, d):
    n = F.col("line_no")
    l = lines(spark, d)
    gaps = l.select(*PAGE, n.alias("gap_id"), (F.lit(72.0) + F.col("w")).alias("g0"), F.lit(500.0).alias("g1"), (F.col("line_no") * 30.0).alias("baseline"), "size")
    style = F.when(n % 3 == 0, "dotted").when(n % 3 == 1, "dashed")
    rules = l.filter(n % 7 != 5).select(*PAGE, n.alias("rule_no"), (n * 30.0 - F.when((n % 3 == 2) & (F.col("para_no") % 2 == 1), 5.0).otherwise(0.0)).alias("y"), (F.lit(73.0) + F.col("w")).alias("a"), F.lit(499.0).alias("b"), F.lit(0.5).alias("width"), style.alias("style"))
    return H.attach_leaders(gaps, rules)


@query(
    "attach_borders",
    f"""
    WITH {PARA_SQL}, n AS (SELECT *, lead(y) OVER (PARTITION BY doc_id,page_no ORDER BY y,para_id) AS nx FROM pa), r AS (SELECT doc_id, page_no, para_id AS rule_no, y+h+1 AS ry, CASE WHEN para_id%3=1 THEN 120.0 ELSE 70.0 END AS a, 541.0 AS b, 0.1+para_id%4*0.5 AS width FROM pa),
    j AS (SELECT r.doc_id, r.page_no, rule_no, ry, a, b, width, p.para_id, p.nx, row_number() OVER (PARTITION BY r.doc_id,r.page_no,rule_no ORDER BY p.y DESC, p.para_id DESC) AS k FROM r JOIN n p ON p.doc_id=r.doc_id AND p.page_no=r.page_no AND ry BETWEEN p.y+p.h-1 AND p.y+p.h+greatest(6,0.9*14))
    SELECT doc_id, page_no, para_id, '000000' AS color, {s2("greatest(0.25,arg_min(width,rule_no))")} AS width FROM j WHERE k=1 AND (nx IS NULL OR nx>=ry-0.5) AND abs(a-72)<=6 AND abs(b-540)<=6 GROUP BY doc_id, page_no, para_id
    """,
    "fx_lines",
)
def _(spark, d):
    p, n = paras(spark, d), F.col("para_id")
    r = p.select(*PAGE, n.alias("rule_no"), (F.col("y") + F.col("h") + 1).alias("y"), F.when(n % 3 == 1, 120.0).otherwise(70.0).alias("a"), F.lit(541.0).alias("b"), (F.lit(0.1) + n % 4 * 0.5).alias("width"), F.lit("000000").alias("color"))
    return H.attach_borders(p, r)


@query(
    "dominant_style",
    """
    WITH v AS (SELECT doc_id, page_no, para_no, family, bold, color, sum(length(text)) AS n, min(word_no) AS f FROM fx_runs GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id,page_no,para_no ORDER BY n DESC, f) AS k FROM v)
    SELECT doc_id, page_no, para_no, family, bold, color, CAST(n AS BIGINT) AS chars FROM r WHERE k=1
    """,
    "fx_runs",
)
def _(spark, d):
    return H.dominant_style(derived.runs(spark, d).withColumn("ord", F.col("word_no")), [*PAGE, "para_no"], ["family", "bold", "color"])
