"""Queries over recognised words."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestrata.operators import ocr as O
from pagestrata.operators.common import r4
from pagestrata.plans.registry import query, s4
from pagestrata.sources import derived

FLAT = rf"NOT regexp_matches(text,'{O.DESCENDS}') AND NOT regexp_matches(text,'{O.DIPS}') AND regexp_matches(text,'{O.ALNUM}')"


@query(
    "scanned_pages",
    """
    WITH p AS (SELECT doc_id, page_no, any_value((doc_id+page_no)%4=0) AS blank, sum(length(text)) AS n, count(*)*3000 AS bytes, bool_or(line_no%2=0) AS drawn FROM fx_words GROUP BY doc_id, page_no),
    q AS (SELECT *, CAST(CASE WHEN blank THEN 0 ELSE n END AS BIGINT) AS chars FROM p)
    SELECT doc_id, page_no, chars, chars=0 AND drawn AS scanned, chars<100 AS needs_ocr, chars>=20 AS has_text, chars<100 AND bytes>102400 AS heavy FROM q
    """,
    "fx_words",
)
def _(spark, d):
    w = derived.words(spark, d)
    pages = w.groupBy("doc_id", "page_no").agg((F.count("*") * 3000).alias("bytes"), F.max(F.col("line_no") % 2 == 0).alias("drawn"))
    return O.scanned_pages(pages, w.filter((F.col("doc_id") + F.col("page_no")) % 4 != 0))


@query(
    "scanned_documents",
    """
    WITH p AS (SELECT doc_id, page_no, CASE WHEN doc_id%3=0 OR any_value((doc_id+page_no)%4=0) THEN 0 ELSE sum(length(text)) END AS n, count(*)*3000 AS bytes FROM fx_words GROUP BY doc_id, page_no),
    d AS (SELECT doc_id, count(*) AS pages, CAST(sum(n) AS BIGINT) AS chars, CAST(sum(bytes) AS BIGINT) AS bytes FROM p GROUP BY doc_id)
    SELECT doc_id, pages, chars, chars>=20 AS has_text, chars/pages<100 AND bytes/pages>102400 AS looks_scanned, CASE WHEN NOT (chars/pages<100 AND bytes/pages>102400) THEN 'light' WHEN chars>=20 THEN 'balanced' ELSE 'strong' END AS level FROM d
    """,
    "fx_words",
)
def _(spark, d):
    """The words of every third document are on its pages as pictures only."""
    w = derived.words(spark, d)
    pages = w.groupBy("doc_id", "page_no").agg((F.count("*") * 3000).alias("bytes"), F.max(F.col("line_no") % 2 == 0).alias("drawn"))
    return O.scanned_documents(pages, w.withColumn("text", F.when((F.col("doc_id") % 3 != 0) & ((F.col("doc_id") + F.col("page_no")) % 4 != 0), F.col("text"))))


@query(
    "ocr_filter",
    rf"""
    WITH f AS (SELECT *, bottom-top AS h FROM fx_ocr WHERE NOT (confidence<25 AND length(text)<=2 AND NOT regexp_matches(text,'{O.ALNUM}'))),
    g AS (SELECT doc_id, page_no, line, coalesce(median(CASE WHEN confidence>=60 AND length(text)>=2 THEN h END), max(h)) AS lh FROM f GROUP BY doc_id, page_no, line),
    n AS (SELECT f.*, lh, least(coalesce(abs(lead(x0) OVER w-x1),1e9),coalesce(abs(x0-lag(x1) OVER w),1e9)) AS near FROM f JOIN g USING (doc_id,page_no,line) WINDOW w AS (PARTITION BY doc_id,page_no,line ORDER BY x0,word_no))
    SELECT doc_id, page_no, line, word_no, text, confidence FROM n WHERE NOT (h<0.45*lh AND confidence<70) AND NOT (h<0.15*lh AND x1-x0<0.15*lh) AND NOT (confidence<30 AND length(text)<=2 AND near>=1.5*lh)
    """,
    "fx_ocr",
)
def _(spark, d):
    return O.ocr_filter(derived.scanned_words(spark, d)).select("doc_id", "page_no", "line", "word_no", "text", "confidence")


SLOPE_SQL = rf"""
fl AS (SELECT doc_id, page_no, line, (x0+x1)/2 AS m, bottom AS bt, x0, x1 FROM fx_ocr WHERE {FLAT}),
lw AS (SELECT doc_id, page_no, line FROM fl GROUP BY ALL HAVING count(*)>=3 AND arg_max(x1,x0)-min(x0)>=100),
ls AS (SELECT a.doc_id, a.page_no, a.line, median((b.bt-a.bt)/(b.m-a.m)) AS s FROM fl a JOIN fl b ON a.doc_id=b.doc_id AND a.page_no=b.page_no AND a.line=b.line AND b.m-a.m>20 JOIN lw ON lw.doc_id=a.doc_id AND lw.page_no=a.page_no AND lw.line=a.line GROUP BY a.doc_id, a.page_no, a.line),
ps AS (SELECT doc_id, page_no, median(s) AS s, count(*) AS n FROM ls GROUP BY doc_id, page_no), pl AS (SELECT doc_id, page_no, count(DISTINCT line) AS lines FROM fx_ocr GROUP BY doc_id, page_no),
sl AS (SELECT doc_id, page_no, CASE WHEN n>=2 OR (n=1 AND lines=1) THEN s ELSE 0.0 END AS slope FROM pl LEFT JOIN ps USING (doc_id,page_no))
"""


@query("page_slope", f"WITH {SLOPE_SQL} SELECT doc_id, page_no, floor(slope*1e8+0.5)/1e8 AS slope FROM sl", "fx_ocr")
def _(spark, d):
    from pagestrata.operators.common import half_up

    return O.page_slope(derived.scanned_words(spark, d)).withColumn("slope", half_up(F.col("slope"), 1e8))


@query(
    "deskew",
    f"""
    WITH {SLOPE_SQL}, z AS (SELECT o.*, CASE WHEN abs(slope)>0.0008 AND abs(slope)<0.08 THEN slope ELSE 0.0 END AS k FROM fx_ocr o JOIN sl USING (doc_id,page_no))
    SELECT doc_id, page_no, line, word_no, {s4("x0+((top+bottom)/2-396.0)*k")} AS x0, {s4("bottom-((x0+x1)/2-306.0)*k")} AS bottom FROM z
    """,
    "fx_ocr",
)
def _(spark, d):
    w = derived.scanned_words(spark, d)
    return O.deskew(w, O.page_slope(w), 612.0, 792.0).select("doc_id", "page_no", "line", "word_no", r4(F.col("x0")).alias("x0"), r4(F.col("bottom")).alias("bottom"))


BASE_SQL = rf"""
bl AS (SELECT doc_id, page_no, line, CASE WHEN count(CASE WHEN {FLAT} THEN bottom END)>=3 THEN median(CASE WHEN {FLAT} THEN bottom END) ELSE median(CASE WHEN regexp_matches(text,'{O.ALNUM}') THEN bottom-(bottom-top)*dp/(ab+dp) END) END AS baseline
 FROM (SELECT *, CASE WHEN regexp_matches(text,'{O.TALL}') THEN 0.705::DOUBLE ELSE 0.49::DOUBLE END AS ab, CASE WHEN regexp_matches(text,'{O.DESCENDS}') THEN 0.21::DOUBLE WHEN regexp_matches(text,'{O.DIPS}') THEN 0.13::DOUBLE ELSE 0.0::DOUBLE END AS dp FROM fx_ocr) GROUP BY doc_id, page_no, line)
"""
SIZE_SQL = rf"""
sz AS (SELECT doc_id, page_no, line, coalesce(median(CASE WHEN regexp_matches(text,'{O.TALL}') AND NOT regexp_matches(text,'{O.ACCENTED_CAPITAL}') AND baseline-top>0.24 THEN (baseline-top-0.12)/CASE WHEN regexp_matches(text,'{O.ASCENDS}') THEN 0.705::DOUBLE ELSE 0.69::DOUBLE END END),
 median(CASE WHEN regexp_matches(text,'{O.ONLY_X}') AND baseline-top>0.24 THEN (baseline-top-0.12)/0.49::DOUBLE END), median(bottom-top)/0.9::DOUBLE) AS size, sum(length(text)) AS chars FROM fx_ocr JOIN bl USING (doc_id,page_no,line) GROUP BY doc_id, page_no, line)
"""


@query("ocr_baseline", f"WITH {BASE_SQL} SELECT doc_id, page_no, line, {s4('baseline')} AS baseline FROM bl", "fx_ocr")
def _(spark, d):
    return O.ocr_baseline(derived.scanned_words(spark, d)).withColumn("baseline", r4(F.col("baseline")))


@query("ocr_size", f"WITH {BASE_SQL}, {SIZE_SQL} SELECT doc_id, page_no, line, {s4('size')} AS size FROM sz", "fx_ocr")
def _(spark, d):
    w = derived.scanned_words(spark, d)
    return O.ocr_size(w, O.ocr_baseline(w)).withColumn("size", r4(F.col("size")))


@query("snap_sizes")
def _(spark, d):
    w = derived.scanned_words(spark, d)
    lines = O.ocr_size(w, O.ocr_baseline(w)).join(w.groupBy(*O.LINE).agg(F.sum(F.length("text")).alias("chars")), O.LINE)
    return O.snap_sizes(lines).select(*O.LINE, r4(F.col("size")).alias("size"), "snapped")


# Rule for a small width table: letters are thin, plain or wide, and each face scales the three differently.
WIDTHS = {"Times New Roman": (0.25, 0.5, 0.75), "Arial": (0.21875, 0.5625, 0.828125), "Courier New": (0.59375, 0.59375, 0.59375)}
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,éèêçüöä"


def width_rows():
    kind = lambda c: 0 if c in "ijlt.,I1" else 2 if c in "mwMW" else 1
    return [(f, c, w[kind(c)]) for f, w in WIDTHS.items() for c in LETTERS]


WIDTH_SQL = "cw(family, ch, em) AS (VALUES " + ",".join(f"('{f}','{c}',{e}::DOUBLE)" for f, c, e in width_rows()) + ")"


@query(
    "page_family",
    f"""
    WITH {WIDTH_SQL}, u AS (SELECT doc_id, page_no, line, word_no, text, x1-x0+CASE WHEN regexp_matches(text,'[mw]') THEN 3 WHEN regexp_matches(text,'[ijlt]') AND doc_id%3=0 THEN -3 ELSE 0 END AS w FROM fx_ocr WHERE length(text)>=2 AND confidence>=60),
    c AS (SELECT doc_id, page_no, line, word_no, any_value(w) AS w, text, unnest(string_split(any_value(text),'')) AS ch FROM u GROUP BY doc_id, page_no, line, word_no, text),
    e AS (SELECT doc_id, page_no, line, word_no, family, any_value(w) AS w, sum(em) AS em, count(*) AS k, any_value(length(text)) AS n FROM c JOIN cw USING (ch) GROUP BY doc_id, page_no, line, word_no, family, text),
    v AS (SELECT *, w/(em-0.05) AS v, count(*) OVER (PARTITION BY doc_id,page_no,line,family) AS m FROM e WHERE k=n AND em>0.3),
    d AS (SELECT *, abs(ln(v/median(v) OVER (PARTITION BY doc_id,page_no,line,family))) AS dev FROM v WHERE m>=2),
    s AS (SELECT doc_id, page_no, family, avg(dev) AS sp, count(*) AS n FROM d GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id,page_no ORDER BY sp, CASE family WHEN 'Times New Roman' THEN 0 WHEN 'Arial' THEN 1 ELSE 2 END) AS r, count(*) OVER (PARTITION BY doc_id,page_no) AS k, min(n) OVER (PARTITION BY doc_id,page_no) AS mn FROM s),
    b AS (SELECT a.doc_id, a.page_no, a.family FROM r a JOIN r b ON a.doc_id=b.doc_id AND a.page_no=b.page_no AND a.r=1 AND b.r=2 WHERE a.k=3 AND a.mn>=4 AND b.sp>=1.25*a.sp)
    SELECT doc_id, page_no, coalesce(family,'Arial') AS family FROM (SELECT DISTINCT doc_id, page_no FROM fx_ocr) LEFT JOIN b USING (doc_id, page_no)
    """,
    "fx_ocr",
)
def _(spark, d):
    t = F.col("text")
    off = F.when(t.rlike("[mw]"), 3.0).when(t.rlike("[ijlt]") & (F.col("doc_id") % 3 == 0), -3.0).otherwise(0.0)
    w = derived.scanned_words(spark, d).withColumn("x1", F.col("x1") + off)
    return O.page_family(w, spark.createDataFrame(width_rows(), "family string, ch string, em double"), laid=True)


@query(
    "split_ocr_pieces",
    """
    WITH f AS (SELECT doc_id, page_no, line, word_no, x0+o AS x0, x1+o AS x1 FROM (SELECT *, coalesce(30*count(*) FILTER (WHERE regexp_matches(text,'^[a-c]')) OVER (PARTITION BY doc_id,page_no,line ORDER BY x0,word_no),0) AS o FROM fx_ocr)),
    g AS (SELECT *, CASE WHEN x0-lag(x1) OVER w>1.6*12 THEN 1 ELSE 0 END AS s FROM f WINDOW w AS (PARTITION BY doc_id,page_no,line ORDER BY x0,word_no))
    SELECT doc_id, page_no, line, word_no, CAST(sum(s) OVER (PARTITION BY doc_id,page_no,line ORDER BY x0,word_no) AS INT) AS piece FROM g
    """,
    "fx_ocr",
)
def _(spark, d):
    """Words from a to c and all after them in their line are moved away from the words before them."""
    from pyspark.sql import Window

    before = Window.partitionBy("doc_id", "page_no", "line").orderBy("x0", "word_no")
    w = derived.scanned_words(spark, d).withColumn("size", F.lit(12.0)).withColumn("off", 30 * F.count_if(F.col("text").rlike("^[a-c]")).over(before))
    w = w.withColumns({"x0": F.col("x0") + F.col("off"), "x1": F.col("x1") + F.col("off")}).drop("off")
    return O.split_ocr_pieces(w).select("doc_id", "page_no", "line", "word_no", "piece")


@query(
    "line_style_vote",
    r"""
    WITH m AS (SELECT *, regexp_matches(text,'\p{L}.*\p{L}') AS ok, length(regexp_replace(text,'[^\p{L}]','','g')) AS letters FROM fx_ocr),
    u AS (SELECT doc_id, page_no, list_sort(list(stem)) AS s FROM m WHERE ok GROUP BY doc_id, page_no HAVING count(*)>=6),
    b AS (SELECT m.*, CASE WHEN ok AND s IS NOT NULL THEN stem>=1.3*s[CAST(floor(0.35*len(s)) AS INT)+1] END AS wb, CASE WHEN ok AND s IS NOT NULL THEN leaning>=1.06 END AS wi FROM m LEFT JOIN u USING (doc_id,page_no)),
    o AS (SELECT *, CASE WHEN letters>=3 AND wb IS NOT NULL THEN {'b':wb,'i':wi} END AS own FROM b),
    p AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(own IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS st,
      sum(CASE WHEN wb THEN letters ELSE 0 END) OVER l AS heavy, sum(letters) OVER l AS total FROM o WINDOW w AS (PARTITION BY doc_id,page_no,line ORDER BY x0,word_no), l AS (PARTITION BY doc_id,page_no,line))
    SELECT doc_id, page_no, line, word_no, text, coalesce(st.b,wb,false) AS bold, coalesce(st.i,wi,false) AS italic, heavy>0.5*total AS line_bold FROM p
    """,
    "fx_ocr",
)
def _(spark, d):
    return O.line_style_vote(derived.scanned_words(spark, d).withColumn("upright", F.lit(1.0)))


@query("palette")
def _(spark, d):
    return O.palette(derived.scanned_words(spark, d))


def page_texts(spark, d):
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), "\n")
    return derived.word_lines(spark, d).groupBy("doc_id", "page_no").agg(lines.alias("text"))


MERGE_SQL = r"""
t AS (SELECT doc_id, page_no, string_agg(text, chr(10) ORDER BY line_no) AS text FROM fx_lines GROUP BY doc_id, page_no),
own AS (SELECT doc_id, page_no, CASE WHEN length(regexp_replace(text,'\s','','g'))>=600 THEN text END AS own FROM t WHERE (doc_id+page_no)%5<>0), oc AS (SELECT doc_id, page_no, replace(text,'e','c') AS ocr FROM t WHERE doc_id%7<>0),
m AS (SELECT doc_id, page_no, coalesce(own,ocr,'') AS text, own IS NOT NULL AS kept, CASE WHEN own IS NULL THEN length(regexp_replace(coalesce(ocr,''),'\s','','g')) ELSE 0 END AS found FROM own FULL JOIN oc USING (doc_id,page_no))
"""


def merged(spark, d):
    t = page_texts(spark, d)
    own = t.filter((F.col("doc_id") + F.col("page_no")) % 5 != 0)
    read = t.filter(F.col("doc_id") % 7 != 0).withColumn("text", F.replace("text", F.lit("e"), F.lit("c")))
    return O.merge_ocr(own, read, 600)


@query("merge_ocr", f"WITH {MERGE_SQL} SELECT doc_id, page_no, md5(text) AS digest, kept, CAST(found AS INT) AS found_chars FROM m", "fx_lines")
def _(spark, d):
    return merged(spark, d).select("doc_id", "page_no", F.md5("text").alias("digest"), "kept", "found_chars")


@query(
    "ocr_outcome",
    f"WITH {MERGE_SQL} SELECT doc_id, CAST(sum(CASE WHEN kept THEN 0 ELSE 1 END) AS BIGINT) AS recognised, CAST(sum(CASE WHEN kept THEN 1 ELSE 0 END) AS BIGINT) AS skipped, sum(found)>0 AS found FROM m GROUP BY doc_id",
    "fx_lines",
)
def _(spark, d):
    return O.ocr_outcome(merged(spark, d))
