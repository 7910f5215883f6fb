"""Queries of edits, redaction, object graphs, streams (as batches) and caller functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from pagestrata.operators import edits as E
from pagestrata.operators import objects as B
from pagestrata.operators import plug
from pagestrata.operators.common import r4
from pagestrata.plans.registry import query, s4
from pagestrata.sources import derived
from pagestrata.sources.derived import table
from pagestrata.streaming import events as V

TARGET_SQL = """
tg AS (SELECT doc_id*10000000+page_no*1000000+line_no*10000+word_no%10 AS edit_id, doc_id, page_no, x, y+h AS y, CASE WHEN text LIKE '%n' THEN w+20 ELSE w END AS w, size, CASE WHEN text LIKE '_e%' THEN upper(text) ELSE text END AS old FROM fx_words WHERE text LIKE 'th%' OR text LIKE 'en%')
"""


@query(
    "locate_edits",
    f"""
    WITH {TARGET_SQL}, h AS (SELECT edit_id, t.w, t.size, old, g.seq, g.text AS ch, g.ws, g.x-t.x AS u FROM tg t JOIN fx_glyphs g ON g.doc_id=t.doc_id AND g.page_no=t.page_no AND abs(g.size-t.size)<=0.2*t.size+0.3 AND abs(g.y-t.y)<=0.3*t.size
      AND g.x-t.x+3>=-greatest(0.02*t.size,0.05) AND g.x-t.x+3<=t.w+greatest(0.02*t.size,0.05) AND g.x-t.x>=-0.3*t.size),
    c AS (SELECT edit_id, any_value(w) AS w, any_value(size) AS size, any_value(old) AS old, string_agg(CASE WHEN ws THEN '' ELSE ch END, '' ORDER BY seq) AS got, max(u+6)-min(u) AS span, min(seq) AS first_seq FROM h GROUP BY edit_id)
    SELECT tg.edit_id, coalesce(got=tg.old AND abs(span-tg.w)<=greatest(0.03*tg.w,0.25*tg.size),false) AS ok, CASE WHEN got IS NULL THEN 'not found' WHEN got<>tg.old AND got=repeat(tg.old,CAST(length(got)//length(tg.old) AS INT)) THEN 'width mismatch' WHEN got<>tg.old THEN 'text mismatch' WHEN abs(span-tg.w)>greatest(0.03*tg.w,0.25*tg.size) THEN 'width mismatch' END AS reason,
     CASE WHEN got=tg.old AND abs(span-tg.w)<=greatest(0.03*tg.w,0.25*tg.size) THEN 1 END AS copies, CASE WHEN got=tg.old AND abs(span-tg.w)<=greatest(0.03*tg.w,0.25*tg.size) THEN first_seq END AS first_seq FROM tg LEFT JOIN c USING (edit_id)
    """,
    "fx_words fx_glyphs",
)
def _(spark, d):
    t = F.col("text")
    w = derived.words(spark, d).filter(t.startswith("th") | t.startswith("en"))
    targets = w.select(
        (F.col("doc_id") * 10000000 + F.col("page_no") * 1000000 + F.col("line_no") * 10000 + F.col("word_no") % 10).alias("edit_id"),
        "doc_id", "page_no", "x", (F.col("y") + F.col("h")).alias("y"), F.lit(1.0).alias("ux"), F.lit(0.0).alias("uy"),
        F.when(t.endswith("n"), F.col("w") + 20).otherwise(F.col("w")).alias("w"), "size", F.when(t.rlike("^.e"), F.upper(t)).otherwise(t).alias("old"),
    )
    return E.locate_edits(targets, derived.glyphs(spark, d))


NEW_SQL = "CASE WHEN text='the' THEN 'that' WHEN text='que' THEN 'qu' WHEN text='tion' THEN '' END"


def word_edits(words):
    t = F.col("text")
    new = F.when(t == "the", "that").when(t == "que", "qu").when(t == "tion", "")
    return words.select("doc_id", "page_no", "line_no", "word_no", t.alias("old"), new.alias("new_text")).filter("new_text IS NOT NULL")


AFTER_SQL = f"""
nw AS (SELECT *, {NEW_SQL} AS nt FROM fx_words), dl AS (SELECT *, CASE WHEN nt IS NULL THEN 0 ELSE 6.0*length(nt)-w END AS dw FROM nw),
af AS (SELECT doc_id, page_no, line_no, word_no, coalesce(nt,text) AS text, (x+coalesce(sum(dw) OVER (PARTITION BY doc_id,page_no,line_no ORDER BY x,word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0))::DOUBLE AS x, (w+dw)::DOUBLE AS w, y, nt IS NOT NULL AS edited FROM dl)
"""


@query("apply_edits", f"WITH {AFTER_SQL} SELECT doc_id, page_no, line_no, word_no, text, x, w, edited FROM af", "fx_words")
def _(spark, d):
    w = derived.words(spark, d).select("doc_id", "page_no", "line_no", "word_no", "text", "x", "w")
    return E.apply_edits(w, word_edits(w))


@query(
    "verify_edits",
    f"""
    WITH {AFTER_SQL}, dm AS (SELECT *, CASE WHEN text='en' THEN 'EN' WHEN text='that' AND edited AND doc_id%3=0 THEN 'the' ELSE text END AS now FROM af),
    e AS (SELECT doc_id, page_no, line_no, word_no, text AS old, {NEW_SQL} AS nt FROM fx_words WHERE {NEW_SQL} IS NOT NULL), tl AS (SELECT DISTINCT doc_id, page_no, line_no FROM e),
    o AS (SELECT doc_id, page_no, count(*) AS damage FROM dm JOIN fx_words b USING (doc_id,page_no,line_no,word_no) ANTI JOIN tl USING (doc_id,page_no,line_no) WHERE dm.now<>b.text GROUP BY doc_id, page_no),
    k AS (SELECT doc_id, page_no, count(*) AS edits, sum(CASE WHEN now=nt THEN 1 ELSE 0 END) AS applied, sum(CASE WHEN now=old AND old<>nt THEN 1 ELSE 0 END) AS left_over FROM e JOIN dm USING (doc_id,page_no,line_no,word_no) GROUP BY doc_id, page_no)
    SELECT doc_id, page_no, coalesce(edits,0) AS edits, CAST(coalesce(applied,0) AS BIGINT) AS applied, CAST(coalesce(left_over,0) AS BIGINT) AS left_over, coalesce(damage,0) AS damage FROM k FULL JOIN o USING (doc_id,page_no)
    """,
    "fx_words",
)
def _(spark, d):
    w = derived.words(spark, d)
    e = word_edits(w)
    after = E.apply_edits(w, e)
    now = F.when(F.col("text") == "en", "EN").when((F.col("text") == "that") & F.col("edited") & (F.col("doc_id") % 3 == 0), "the").otherwise(F.col("text"))
    return E.verify_edits(w, after.withColumn("text", now), e)


def placed_lines(spark, d):
    """Lines of every fourth paragraph set flush left, centred, flush right and justified."""
    p, w = F.col("para_no") % 4, F.col("w")
    x0 = F.when(p == 1, F.lit(306.0) - w / 2).when(p == 2, F.lit(540.0) - w).otherwise(72.0)
    x1 = F.when(p == 3, F.lit(540.0)).otherwise(x0 + w)
    spaces = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    return derived.word_lines(spark, d).select(
        "doc_id", "page_no", "line_no", x0.alias("x0"), x1.alias("x1"), (F.col("y") + F.col("h")).alias("y"), "size", spaces.alias("spaces"), ((p == 3) & (spaces > 0)).alias("stretched")
    )


ALIGN_SQL = """
pl AS (SELECT doc_id, page_no, line_no, CASE para_no%4 WHEN 1 THEN 306.0-w/2 WHEN 2 THEN 540.0-w ELSE 72.0 END AS x0, CASE para_no%4 WHEN 1 THEN 306.0-w/2+w WHEN 2 THEN 540.0 WHEN 3 THEN 540.0 ELSE 72.0+w END AS x1, y+h AS y, size, length(text)-length(replace(text,' ','')) AS spaces, para_no%4=3 AND contains(text,' ') AS stretched FROM fx_lines),
nb AS (SELECT a.doc_id, a.page_no, a.line_no, abs(b.x0-a.x0)<0.75 AS lm, abs(b.x1-a.x1)<0.75 AS rm, abs((b.x0+b.x1)/2-(a.x0+a.x1)/2)<0.75 AS cm, b.x0 AS l, b.spaces AS ns, b.stretched AS nst FROM pl a JOIN pl b ON a.doc_id=b.doc_id AND a.page_no=b.page_no AND a.line_no<>b.line_no AND abs(a.y-b.y)>=0.5*a.size AND abs(a.y-b.y)<=4*a.size AND b.size/a.size BETWEEN 0.6 AND 1.7),
vt AS (SELECT doc_id, page_no, line_no, sum(CASE WHEN lm AND rm THEN 1 ELSE 0 END) AS bo, sum(CASE WHEN lm AND NOT rm THEN 1 ELSE 0 END) AS le, sum(CASE WHEN rm AND NOT lm THEN 1 ELSE 0 END) AS ri, sum(CASE WHEN NOT lm AND NOT rm AND cm THEN 1 ELSE 0 END) AS ce,
  list_sort(list(CASE WHEN rm AND NOT lm AND ns>=2 THEN l END)) AS ls, bool_or(rm AND NOT lm AND nst) AS ost FROM nb GROUP BY doc_id, page_no, line_no),
al AS (SELECT pl.*, CASE WHEN coalesce(ri,0)>coalesce(le,0) AND coalesce(ri,0)>=coalesce(ce,0) THEN CASE WHEN stretched OR ost OR len(list_filter(range(1,len(list_filter(ls,lambda v: v IS NOT NULL))), lambda i: list_filter(ls,lambda v: v IS NOT NULL)[i+1]-list_filter(ls,lambda v: v IS NOT NULL)[i]<0.75))>0 THEN 'justify' ELSE 'right' END
  WHEN coalesce(ce,0)>coalesce(le,0) AND coalesce(ce,0)>coalesce(ri,0) THEN 'center' WHEN coalesce(bo,0)>=2 OR (coalesce(bo,0)=1 AND stretched) THEN 'justify' WHEN coalesce(le,0)+coalesce(bo,0)>0 THEN 'left' ELSE 'left' END AS align FROM pl LEFT JOIN vt USING (doc_id,page_no,line_no))
"""


@query("line_alignment", f"WITH {ALIGN_SQL} SELECT doc_id, page_no, line_no, align FROM al", "fx_lines")
def _(spark, d):
    return E.line_alignment(placed_lines(spark, d))


@query(
    "keep_alignment",
    f"""
    WITH ln AS (SELECT doc_id, page_no, line_no, CASE line_no%4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'center' ELSE 'justify' END AS align, CASE WHEN line_no%8<4 THEN 12.0::DOUBLE ELSE -7.5::DOUBLE END AS d FROM fx_lines),
    a AS (SELECT *, x-lag(x+w) OVER o AS gap, row_number() OVER o-1 AS nth, length(text)-1 AS pr FROM fx_words JOIN ln USING (doc_id,page_no,line_no) WINDOW o AS (PARTITION BY doc_id,page_no,line_no ORDER BY x,word_no)),
    b AS (SELECT *, count(gap) OVER l AS gaps, min(gap) OVER l AS narrow, sum(pr) OVER l AS pairs, max(size) OVER l AS em, coalesce(sum(pr) OVER (PARTITION BY doc_id,page_no,line_no ORDER BY x,word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS bf FROM a WINDOW l AS (PARTITION BY doc_id,page_no,line_no)),
    c AS (SELECT *, CASE WHEN gaps>0 AND narrow>0 THEN sign(d)*least(abs(d)/gaps,CASE WHEN d>0 THEN 0.45*narrow ELSE 1.6*narrow END) END AS pg FROM b), e AS (SELECT *, CASE WHEN abs(d-pg*gaps)>1e-6 THEN CASE WHEN pairs>0 THEN (d-pg*gaps)/pairs END WHEN pg IS NOT NULL THEN 0 END AS pp FROM c),
    f AS (SELECT *, coalesce(abs(pp)<=0.03*em,false) AS fits FROM e)
    SELECT doc_id, page_no, line_no, word_no, {s4("x+CASE WHEN align='right' THEN -d WHEN align='center' THEN -d/2 WHEN align='justify' AND fits THEN -(nth*pg+bf*pp) ELSE 0 END")} AS x, align IN ('right','center') OR (align='justify' AND fits) AS kept FROM f
    """,
    "fx_words fx_lines",
)
def _(spark, d):
    n = F.col("line_no")
    w = derived.words(spark, d).select("doc_id", "page_no", "line_no", "word_no", "x", "w", "size", F.length("text").alias("chars"))
    lines = derived.word_lines(spark, d).select(
        "doc_id", "page_no", "line_no", F.when(n % 4 == 0, "left").when(n % 4 == 1, "right").when(n % 4 == 2, "center").otherwise("justify").alias("align"), F.when(n % 8 < 4, 12.0).otherwise(-7.5).alias("delta")
    )
    return E.keep_alignment(w, lines).withColumn("x", r4(F.col("x")))


def redactions(spark, d):
    """A box over every word that looks like an address or a number with many digits."""
    w = derived.words(spark, d).filter(F.col("text").rlike("@|[0-9]{4}"))
    return w.select("doc_id", "page_no", (F.col("x") / 1024).alias("fx"), (F.col("y") / 1024).alias("fy"), (F.col("w") / 1024).alias("fw"), (F.col("h") / 1024).alias("fh"))


@query(
    "redact_pages",
    "SELECT doc_id, page_no, count(*) AS words FROM fx_words WHERE (doc_id, page_no) NOT IN (SELECT (doc_id, page_no) FROM fx_words WHERE regexp_matches(text,'@|[0-9]{4}')) GROUP BY doc_id, page_no",
    "fx_words",
)
def _(spark, d):
    return E.redact_pages(derived.words(spark, d), redactions(spark, d)).groupBy("doc_id", "page_no").agg(F.count("*").alias("words"))


@query(
    "redact_boxes",
    """
    WITH p AS (SELECT 72.0::DOUBLE/200 AS px), w AS (SELECT *, line_no*100+word_no%10 AS word_id FROM fx_words), b AS (SELECT doc_id, page_no, (floor(x/px)-1)*px AS a0, (ceil((x+w)/px)+1)*px AS a1, (floor(y/px)-1)*px AS b0, (ceil((y+h)/px)+1)*px AS b1 FROM fx_words, p WHERE regexp_matches(text,'@|[0-9]{4}')),
    g AS (SELECT DISTINCT w.doc_id, w.page_no, w.word_id FROM w JOIN b ON w.doc_id=b.doc_id AND w.page_no=b.page_no AND x<a1 AND x+w.w>a0 AND y<b1 AND y+h>b0)
    SELECT doc_id, page_no, word_id, text FROM w ANTI JOIN g USING (doc_id, page_no, word_id)
    """,
    "fx_words",
)
def _(spark, d):
    w = derived.words(spark, d).withColumn("word_id", F.col("line_no") * 100 + F.col("word_no") % 10)
    pages = w.select("doc_id", "page_no").distinct().withColumn("page_w", F.lit(1024.0)).withColumn("page_h", F.lit(1024.0))
    return E.redact_boxes(w, redactions(spark, d), pages).select("doc_id", "page_no", "word_id", "text")


@query(
    "verify_redaction",
    "SELECT doc_id, count(DISTINCT page_no) AS censored, CAST(0 AS BIGINT) AS left_words FROM fx_words WHERE regexp_matches(text,'@|[0-9]{4}') GROUP BY doc_id",
    "fx_words",
)
def _(spark, d):
    w, boxes = derived.words(spark, d), redactions(spark, d)
    return E.verify_redaction(w, E.redact_pages(w, boxes), boxes)


@query(
    "image_usage",
    """
    WITH i AS (SELECT p_partkey AS image_id, 40+p_size*30 AS px_w, 60+p_size*20 AS px_h, p_partkey%200*100 AS bytes, CASE WHEN p_partkey%7=0 THEN 1 ELSE 8 END AS bits, CASE p_partkey%3 WHEN 0 THEN 'gray' WHEN 1 THEN 'rgb' ELSE CASE WHEN p_partkey%2=0 THEN 'rgb' ELSE 'cmyk' END END AS space, p_partkey%11=0 AS bad, CASE WHEN p_partkey%10=9 THEN p_partkey-4 END AS mask_id FROM part),
    u AS (SELECT l_partkey AS image_id, max(l_quantity*4) AS w, max(l_linenumber*30.0::DOUBLE) AS h FROM lineitem GROUP BY 1),
    j AS (SELECT *, greatest(w/72*150.0::DOUBLE/px_w, h/72*150.0::DOUBLE/px_h) AS need FROM i JOIN u USING (image_id) WHERE space IN ('gray','rgb') AND px_w*px_h BETWEEN 4096 AND 40000000 AND bytes>=8192 AND bits=8 AND NOT bad AND image_id NOT IN (SELECT mask_id FROM i WHERE mask_id IS NOT NULL)),
    k AS (SELECT *, CASE WHEN need>0 AND need<0.85 THEN need ELSE 1.0 END AS scale FROM j)
    SELECT image_id, w, h, floor(scale*10000.0+0.5)/10000.0 AS scale, CAST(greatest(1,floor(px_w*scale+0.5)) AS INT) AS out_w, CAST(greatest(1,floor(px_h*scale+0.5)) AS INT) AS out_h FROM k
    """,
)
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    k = F.col("p_partkey")
    no = F.lit(False)
    images = p.select(
        k.alias("image_id"), (F.col("p_size") * 30 + 40).alias("px_w"), (F.col("p_size") * 20 + 60).alias("px_h"), (k % 200 * 100).alias("bytes"), F.when(k % 7 == 0, 1).otherwise(8).alias("bits"),
        F.when(k % 3 == 0, "gray").when((k % 3 == 1) | (k % 2 == 0), "rgb").otherwise("cmyk").alias("space"), (k % 11 == 0).alias("stencil"), no.alias("has_mask"), no.alias("has_decode"), no.alias("matte"),
        F.when(k % 10 == 9, k - 4).alias("mask_id"),
    )
    placed = table(spark, d, "lineitem").select(F.col("l_partkey").alias("image_id"), (F.col("l_quantity") * 4).alias("w"), (F.col("l_linenumber") * 30.0).alias("h"))
    return B.image_usage(images, placed).withColumn("scale", r4(F.col("scale")))


@query(
    "dedup_streams",
    """
    WITH a AS (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text, lang) AS kept FROM documents), p AS (SELECT 1000000+id AS id, 1000000+min(id) OVER (PARTITION BY kept) AS kept FROM a)
    SELECT id, kept FROM a UNION ALL SELECT id, kept FROM p
    """,
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    parent = (F.col("doc_id") + 1000000).alias("id")
    objects = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("header"), F.col("text").alias("content")).unionByName(docs.select(parent, F.lit("picture").alias("header"), F.lit("").alias("content")))
    refs = docs.select((F.col("doc_id") + 1000000).alias("src"), F.lit(0).alias("pos"), F.col("doc_id").alias("dst"))
    return B.dedup_streams(objects, refs)[0]


@query(
    "reachable",
    "WITH RECURSIVE fx_edges AS (SELECT concat('o',o_orderkey) AS src, concat('c',o_custkey) AS dst FROM orders UNION ALL SELECT concat('c',c_custkey), concat('n',c_nationkey) FROM customer UNION ALL SELECT concat('n',n_nationkey), concat('r',n_regionkey) FROM nation), r AS (SELECT concat('o',o_orderkey) AS node FROM orders WHERE o_orderstatus='P' UNION SELECT dst FROM r JOIN fx_edges ON src=node) SELECT DISTINCT node FROM r",
)
def _(spark, d):
    roots = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    return B.reachable(derived.references(spark, d), roots)


@query(
    "remap_stray_refs",
    """
    WITH p AS (SELECT doc_id AS id, CASE WHEN doc_id%9=4 THEN (doc_id*7)%50 END AS mark, text AS content FROM documents), r AS (SELECT id, row_number() OVER (ORDER BY id)-1 AS index FROM p WHERE id%3<>1),
    c AS (SELECT content, arg_min(id,index) AS t FROM p JOIN r USING (id) GROUP BY content), s AS (SELECT p.id, CASE WHEN mark IS NOT NULL THEN r2.id ELSE c.t END AS t FROM p LEFT JOIN r r2 ON r2.index=p.mark LEFT JOIN c ON c.content=p.content WHERE p.id%3=1),
    e AS (SELECT doc_id AS src, (doc_id*13+1)%200 AS dst FROM documents)
    SELECT src, dst, CASE WHEN s.id IS NOT NULL THEN s.t ELSE dst END AS target FROM e LEFT JOIN s ON s.id=dst
    """,
)
def _(spark, d):
    docs = table(spark, d, "documents")
    i = F.col("doc_id")
    pages = docs.select(i.alias("id"), F.when(i % 9 == 4, i * 7 % 50).alias("mark"), F.col("text").alias("content"))
    # ids of real pages run 0, 2, 3, 5, 6, …: their index follows from the id.
    real = docs.filter(i % 3 != 1).select(i.alias("id"), (F.floor(i / 3) * 2 + F.when(i % 3 == 2, 1).otherwise(0)).alias("index"))
    refs = docs.select(i.alias("src"), ((i * 13 + 1) % 200).alias("dst"))
    return B.remap_stray_refs(refs, pages, real)


@query("replay_editor_events")
def _(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    action = F.when(i % 23 == 0, "reset").when(i % 7 == 3, "undo").when(i % 11 == 5, "remove").when(i % 17 == 9, "clear").otherwise("add")
    item = F.when(i % 11 == 5, (i - 40).cast("string")).otherwise(i.cast("string"))
    return V.replay_editor_events(e.select(F.col("user_id").alias("doc_id"), i.alias("seq"), action.alias("action"), item.alias("item_id")))


@query(
    "progress",
    """
    WITH k AS (SELECT *, sum(CASE WHEN stage='ocr' THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY event_id) AS k FROM fx_stage_events),
    u AS (SELECT *, CASE stage WHEN 'reading' THEN (page-1)+k*12.0 WHEN 'ocr' THEN page+(k-1)*12.0 WHEN 'analysing' THEN pages+k*12.0+(page-1)*1.5 ELSE pages*2.5+k*12.0 END::DOUBLE AS units, (pages*2.5+k*12.0)::DOUBLE+greatest(2.0,pages*0.3)::DOUBLE AS total FROM k)
    SELECT job, CAST(max(least(99,floor(units/total*100+0.5))) AS INT) AS pct, CAST(max(k) AS BIGINT) AS ocr_pages, count(*) AS events FROM u GROUP BY job
    """,
    "fx_stage_events",
)
def _(spark, d):
    return V.progress(derived.stage_events(spark, d))


@query("map_pages", "SELECT doc_id, CAST(length(text) AS INT) AS chars, upper(lang) AS lang FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    return plug.map_pages(docs, lambda p: pd.DataFrame({"doc_id": p["doc_id"], "chars": p["text"].str.len().astype("int32"), "lang": p["lang"].str.upper()}), "doc_id bigint, chars int, lang string")


@query("map_cells", "SELECT doc_id, row_no, CAST(count(*) AS INT) AS n, string_agg(text,'/' ORDER BY col_no, text) AS paragraph FROM fx_cells GROUP BY doc_id, row_no", "fx_cells")
def _(spark, d):
    def join(g: dict) -> list:
        texts = [t for _, t in sorted(zip(g["col_no"], g["text"]), key=lambda v: (v[0], v[1] is None, v[1])) if t is not None]
        return [(g["doc_id"][0], g["row_no"][0], len(g["col_no"]), "/".join(texts) if texts else None)]

    # The line items of an order lie together since they were dealt.
    return plug.map_cells(derived.cells(spark, d).select("doc_id", "row_no", "col_no", "text"), join, "doc_id bigint, row_no int, n int, paragraph string", ["doc_id", "row_no"], laid=True)


@query(
    "fallback_resolver",
    "SELECT font_id, CASE WHEN contains(name,'Arial') THEN 'match' WHEN contains(lower(name),'serif') OR contains(name,'Times') THEN 'standard' ELSE 'universal' END AS fallback FROM fx_fonts",
    "fx_fonts",
)
def _(spark, d):
    def chance(test, answer):
        def resolve(s: pd.Series) -> pd.Series:
            return s.map(lambda v: answer if isinstance(v, str) and test(v) else None)

        return resolve

    chances = [chance(lambda v: "Arial" in v, "match"), chance(lambda v: "serif" in v.lower() or "Times" in v, "standard"), chance(lambda v: True, "universal")]
    return derived.fonts(spark, d).select("font_id", plug.fallback_resolver(F.col("name"), chances).alias("fallback"))
