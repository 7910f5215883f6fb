"""Queries about whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestrata.operators import docstats as S
from pagestrata.plans.registry import query, s4
from pagestrata.plans.text import CUE_SQL
from pagestrata.sources import derived

CHARS = r"length(regexp_replace(text,'\s','','g'))"
BODY_SQL = f"""body AS (SELECT doc_id, arg_max(half, n*1000-half) AS body FROM (SELECT doc_id, floor(size*2+0.5)/2 AS half, sum({CHARS})::DOUBLE AS n FROM fx_lines GROUP BY doc_id, half) GROUP BY doc_id)"""
LEAD_SQL = f"""
p AS (SELECT l.*, body, lag(y+h) OVER q AS up, lag(x) OVER q AS up_x, lag(text) OVER q AS up_text FROM fx_lines l JOIN body USING (doc_id) WHERE abs(size-body)<=0.6 WINDOW q AS (PARTITION BY doc_id,page_no ORDER BY y+h,line_no)),
v AS (SELECT doc_id, page_no, line_no, floor(((y+h-up)/body)*50.0+0.5)/50.0 AS ratio FROM p WHERE abs(x-up_x)<=2 AND {CUE_SQL.format(a="up_text", b="text")}),
c AS (SELECT doc_id, ratio, count(*) AS n, min(page_no*1000+line_no) AS f FROM v WHERE ratio BETWEEN 0.95 AND 2.4 GROUP BY doc_id, ratio),
lead_ AS (SELECT doc_id, arg_max(ratio, n*100000000-f) AS leading_r FROM c GROUP BY doc_id)"""


def lines_of(spark, d):
    return derived.word_lines(spark, d).withColumn("baseline", F.col("y") + F.col("h"))


@query("body_text_facts", f"WITH {BODY_SQL}, {LEAD_SQL} SELECT doc_id, body, coalesce(leading_r,1.2::DOUBLE) AS \"leading\" FROM body LEFT JOIN lead_ USING (doc_id)", "fx_lines")
def _(spark, d):
    lines = lines_of(spark, d)
    body = S.body_font_size(lines)
    return body.join(S.leading_ratio(lines, body), "doc_id")


@query("body_font_size", f"WITH {BODY_SQL} SELECT doc_id, body FROM body", "fx_lines")
def _(spark, d):
    return S.body_font_size(derived.word_lines(spark, d))


@query("leading_ratio", f"WITH {BODY_SQL}, {LEAD_SQL} SELECT doc_id, coalesce(leading_r,1.2::DOUBLE) AS \"leading\" FROM body LEFT JOIN lead_ USING (doc_id)", "fx_lines")
def _(spark, d):
    lines = lines_of(spark, d)
    return S.leading_ratio(lines, S.body_font_size(lines))


@query(
    "document_defaults",
    """
    WITH u AS (SELECT *, page_no*1000000+line_no*10000+word_no%10 AS pos, length(text) AS n FROM fx_runs WHERE NOT lifted),
    f AS (SELECT doc_id, family AS v, sum(n) AS n, min(pos) AS pos FROM u GROUP BY doc_id, family), s AS (SELECT doc_id, size AS v, sum(n) AS n, min(pos) AS pos FROM u GROUP BY doc_id, size),
    c AS (SELECT doc_id, color AS v, sum(n) AS n, min(pos) AS pos FROM u GROUP BY doc_id, color),
    r AS (SELECT doc_id, 'f' AS k, v, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS r FROM f)
    SELECT doc_id, r.v AS family, (SELECT v FROM s WHERE s.doc_id=r.doc_id ORDER BY n DESC, pos LIMIT 1) AS size, (SELECT v FROM c WHERE c.doc_id=r.doc_id ORDER BY n DESC, pos LIMIT 1) AS color FROM r WHERE r=1
    """,
    "fx_runs",
)
def _(spark, d):
    return S.document_defaults(derived.runs(spark, d))


@query(
    "font_usage",
    """
    WITH u AS (SELECT doc_id, lower(family) AS family, bold, italic, fallback, length(text) AS n FROM fx_runs),
    f AS (SELECT doc_id, family, arg_max(fallback, concat(lpad(CAST(n AS VARCHAR),12,'0'),fallback)) AS substitute FROM (SELECT doc_id, family, fallback, sum(n) AS n FROM u WHERE fallback IS NOT NULL GROUP BY ALL) GROUP BY ALL)
    SELECT doc_id, family, CAST(sum(n) AS BIGINT) AS chars, CAST(sum(CASE WHEN NOT bold AND NOT italic THEN n ELSE 0 END) AS BIGINT) AS regular, CAST(sum(CASE WHEN bold AND NOT italic THEN n ELSE 0 END) AS BIGINT) AS bold,
     CAST(sum(CASE WHEN NOT bold AND italic THEN n ELSE 0 END) AS BIGINT) AS italic, CAST(sum(CASE WHEN bold AND italic THEN n ELSE 0 END) AS BIGINT) AS bold_italic, any_value(substitute) AS substitute
    FROM u JOIN f USING (doc_id, family) GROUP BY doc_id, family
    """,
    "fx_runs",
)
def _(spark, d):
    return S.font_usage(derived.runs(spark, d))


TAG = "doc_id*100000+para_no*10+CASE WHEN doc_id%3=0 THEN row_no ELSE 0 END"


@query(
    "is_tagged",
    f"""
    WITH l AS (SELECT *, y+h AS baseline, CASE WHEN doc_id%5<>4 OR para_no%2=0 THEN {TAG} END AS tag_id, line_no=0 AND doc_id%2=0 AS artifact FROM fx_lines),
    p AS (SELECT *, lag(baseline) OVER q AS ub, lag(x) OVER q AS ux, lag(size) OVER q AS us, lag(text) OVER q AS ut, lag(tag_id) OVER q AS ug FROM l WINDOW q AS (PARTITION BY doc_id,page_no ORDER BY baseline,x)),
    r AS (SELECT *, coalesce(abs(x-ux)<=2 AND baseline-ub<=1.8*greatest(size,us) AND abs(size-us)<=0.1*greatest(size,us) AND {CUE_SQL.format(a="ut", b="text")},false) AS run_on FROM p),
    g AS (SELECT doc_id, page_no, sum({CHARS}) AS chars, sum(CASE WHEN tag_id IS NOT NULL OR artifact THEN {CHARS} ELSE 0 END) AS tagged, sum(CASE WHEN run_on THEN 1 ELSE 0 END) AS run_ons,
      sum(CASE WHEN run_on AND tag_id IS NOT NULL AND ug IS NOT NULL AND ug<>tag_id THEN 1 ELSE 0 END) AS splits, count(tag_id)>=12 AND count(DISTINCT tag_id)<=2 AS lumped FROM r GROUP BY doc_id, page_no)
    SELECT doc_id, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(tagged) AS BIGINT) AS tagged, CAST(sum(run_ons) AS BIGINT) AS run_ons, CAST(sum(splits) AS BIGINT) AS splits, bool_or(lumped) AS lumped,
     sum(tagged)>=0.6*sum(chars) AND NOT (sum(run_ons)>=3 AND sum(splits)>=0.5*sum(run_ons)) AND NOT bool_or(lumped) AS is_tagged FROM g GROUP BY doc_id
    """,
    "fx_lines",
)
def _(spark, d):
    tag = F.col("doc_id") * 100000 + F.col("para_no") * 10 + F.when(F.col("doc_id") % 3 == 0, F.col("row_no")).otherwise(0)
    lines = lines_of(spark, d).withColumn("tag_id", F.when((F.col("doc_id") % 5 != 4) | (F.col("para_no") % 2 == 0), tag))
    lines = lines.withColumn("block", F.lit(True)).withColumn("artifact", (F.col("line_no") == 0) & (F.col("doc_id") % 2 == 0))
    return S.is_tagged(lines)


STYLE_RUNS = "SELECT * EXCLUDE (bold,italic,color,lifted), para_no=0 OR (para_no%5=3 AND row_no_=0) AS bold, para_no%7=6 AS italic, CASE WHEN para_no%11=5 THEN 'C00000' ELSE '000000' END AS color, false AS lifted FROM (SELECT *, CAST(floor(word_no/10) AS INT) AS row_no_ FROM fx_runs)"


def heading_runs(spark, d):
    row = F.floor(F.col("word_no") / 10)
    r = derived.runs(spark, d)
    return (
        r.withColumn("bold", (F.col("para_no") == 0) | ((F.col("para_no") % 5 == 3) & (row == 0)))
        .withColumn("italic", F.col("para_no") % 7 == 6)
        .withColumn("color", F.when(F.col("para_no") % 11 == 5, "C00000").otherwise("000000"))
        .withColumn("lifted", F.lit(False))
    )


@query(
    "heading_styles",
    f"""
    WITH {BODY_SQL}, r AS ({STYLE_RUNS}),
    st AS (SELECT doc_id, page_no, line_no, any_value(size) AS size, any_value(bold) AS bold, any_value(italic) AS italic, any_value(family) AS family, any_value(color) AS color, sum(length(text)) AS chars FROM r GROUP BY doc_id, page_no, line_no),
    u AS (SELECT doc_id, page_no, line_no, y+h AS b, size AS s, text, lag(y+h) OVER q AS ub, lag(size) OVER q AS us, lag(text) OVER q AS ut FROM fx_lines WINDOW q AS (PARTITION BY doc_id,page_no ORDER BY y+h,line_no)),
    k AS (SELECT doc_id, page_no, line_no, coalesce(b-ub<2.2*greatest(s,us) AND {CUE_SQL.format(a="ut", b="text")},false) AS cont FROM u),
    a AS (SELECT doc_id, size, bold, italic, family, color, sum(CASE WHEN cont OR chars>90 THEN 1 ELSE 0 END) AS long, sum(CASE WHEN cont OR chars>90 THEN 0 ELSE 1 END) AS short, sum(chars) AS chars, min(page_no*1000+line_no) AS f
      FROM st JOIN k USING (doc_id,page_no,line_no) GROUP BY doc_id, size, bold, italic, family, color),
    n AS (SELECT doc_id, count(*) AS lines FROM fx_lines GROUP BY doc_id),
    bf AS (SELECT * FROM (SELECT doc_id, family AS bfam, color AS bcol, row_number() OVER (PARTITION BY doc_id ORDER BY sum(chars) DESC, min(f)) AS r FROM a JOIN body USING (doc_id) WHERE abs(size-body)<=0.6 AND NOT bold GROUP BY doc_id, family, color) WHERE r=1),
    c AS (SELECT a.*, size/body AS ratio, color='C00000' AND color<>coalesce(bcol,'') AS accent, family<>coalesce(bfam,'') AS other FROM a JOIN body USING (doc_id) JOIN n USING (doc_id) LEFT JOIN bf USING (doc_id) WHERE short>0 AND long=0 AND short<=greatest(4,0.2*lines)),
    o AS (SELECT * FROM c WHERE CASE WHEN ratio>=1.3 THEN true WHEN italic AND NOT bold THEN false WHEN ratio>=1.12 THEN bold OR accent WHEN ratio>=1.08 AND bold THEN true WHEN ratio>=0.95 THEN (bold AND (other OR accent)) OR (other AND accent) ELSE false END),
    w AS (SELECT *, CASE WHEN lag(size) OVER z IS NULL OR abs(lag(size) OVER z-size)>0.6 OR lag(bold) OVER z<>bold THEN 1 ELSE 0 END AS s FROM o WINDOW z AS (PARTITION BY doc_id ORDER BY size DESC, bold DESC, f)),
    v AS (SELECT *, CAST(sum(s) OVER (PARTITION BY doc_id ORDER BY size DESC, bold DESC, f) AS INT) AS level FROM w)
    SELECT doc_id, size, bold, italic, family, color, level, CAST(short AS BIGINT) AS short FROM v WHERE level<=3
    """,
    "fx_lines fx_runs",
)
def _(spark, d):
    lines = lines_of(spark, d)
    styles = S.line_styles(heading_runs(spark, d), ["doc_id", "page_no", "line_no"])
    return S.heading_styles(lines, styles, S.body_font_size(lines))


@query(
    "convert_stats",
    """
    WITH b AS (SELECT doc_id, CASE WHEN row_no=0 AND para_no%6=5 THEN 'table' WHEN row_no=0 AND para_no%9=8 THEN 'image' ELSE 'paragraph' END AS kind FROM fx_lines WHERE row_no=0),
    p AS (SELECT doc_id, page_no, min(confidence)<41 AS ocr, CASE WHEN max(length(text))>40 THEN 'layout' ELSE 'flow' END AS mode, sum(CASE WHEN length(text)>60 THEN 1 ELSE 0 END) AS warnings FROM fx_words GROUP BY doc_id, page_no),
    pb AS (SELECT doc_id, sum(CASE kind WHEN 'paragraph' THEN 1 ELSE 0 END) AS paragraphs, sum(CASE kind WHEN 'table' THEN 1 ELSE 0 END) AS tables, sum(CASE kind WHEN 'image' THEN 1 ELSE 0 END) AS images FROM b GROUP BY doc_id)
    SELECT doc_id, count(*) AS pages, CAST(sum(CASE WHEN ocr THEN 1 ELSE 0 END) AS BIGINT) AS ocr_pages, CAST(sum(CASE WHEN mode='layout' THEN 1 ELSE 0 END) AS BIGINT) AS layout_pages, CAST(sum(warnings) AS BIGINT) AS warnings,
     CAST(any_value(paragraphs) AS BIGINT) AS paragraphs, CAST(any_value(tables) AS BIGINT) AS tables, CAST(any_value(images) AS BIGINT) AS images FROM p LEFT JOIN pb USING (doc_id) GROUP BY doc_id
    """,
    "fx_lines fx_words",
)
def _(spark, d):
    p = F.col("para_no")
    blocks = derived.word_lines(spark, d).filter("row_no = 0").select("doc_id", F.when(p % 6 == 5, "table").when(p % 9 == 8, "image").otherwise("paragraph").alias("kind"))
    n = F.length("text")
    pages = derived.words(spark, d).groupBy("doc_id", "page_no").agg(
        (F.min("confidence") < 41).alias("ocr"), F.when(F.max(n) > 40, "layout").otherwise("flow").alias("mode"), F.count_if(n > 60).alias("warnings")
    )
    return S.convert_stats(blocks, pages)


@query(
    "structure_summary",
    f"""
    WITH p AS (SELECT doc_id, para_no, text, CASE para_no%4 WHEN 1 THEN 'table' WHEN 3 THEN 'textbox' ELSE 'body' END AS place, para_no%10=2 AS frame, CASE WHEN para_no=0 THEN 1 ELSE 0 END AS heading,
      CASE WHEN para_no%5=4 THEN 'bullet' END AS list_kind, length(text)-length(replace(text,'http','')) AS links, 1+para_no%3 AS columns, para_no%8=7 AS landscape
     FROM (SELECT doc_id, unnest(range(len(ps))) AS para_no, unnest(ps) AS text FROM (SELECT doc_id, string_split(text,chr(10)) AS ps FROM documents))),
    q AS (SELECT *, trim(text)='' AS blank, length(trim(text)) AS n FROM p)
    SELECT doc_id, CAST(sum(CASE WHEN blank THEN 0 ELSE 1 END) AS BIGINT) AS paragraphs, CAST(sum(CASE WHEN place='body' AND NOT blank THEN 1 ELSE 0 END) AS BIGINT) AS body, CAST(sum(CASE WHEN place='table' AND NOT blank THEN 1 ELSE 0 END) AS BIGINT) AS in_table,
     CAST(sum(CASE WHEN place='textbox' AND NOT blank THEN 1 ELSE 0 END) AS BIGINT) AS in_textbox, CAST(sum(CASE WHEN blank THEN 1 ELSE 0 END) AS BIGINT) AS empty, CAST(sum(CASE WHEN heading>0 AND NOT blank THEN 1 ELSE 0 END) AS BIGINT) AS headings,
     CAST(sum(CASE WHEN list_kind IS NOT NULL AND NOT blank THEN 1 ELSE 0 END) AS BIGINT) AS list_items, CAST(sum(links) AS BIGINT) AS links, CAST(max(columns) AS INT) AS max_columns, CAST(sum(CASE WHEN landscape THEN 1 ELSE 0 END) AS BIGINT) AS landscape,
     CASE WHEN sum(n)>0 THEN {s4("sum(CASE WHEN NOT frame AND place<>'textbox' THEN n ELSE 0 END)::DOUBLE/sum(n)::DOUBLE")} END AS flow_ratio
    FROM q GROUP BY doc_id
    """,
)
def _(spark, d):
    from pagestrata.sources.derived import table

    p = F.col("para_no")
    paras = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("para_no", "text"))
    paras = paras.select(
        "*",
        F.when(p % 4 == 1, "table").when(p % 4 == 3, "textbox").otherwise("body").alias("place"),
        (p % 10 == 2).alias("frame"),
        F.when(p == 0, 1).otherwise(0).alias("heading"),
        F.when(p % 5 == 4, "bullet").alias("list_kind"),
        (F.length("text") - F.length(F.replace("text", F.lit("http"), F.lit("")))).alias("links"),
        (1 + p % 3).alias("columns"),
        (p % 8 == 7).alias("landscape"),
    )
    return S.structure_summary(paras)
