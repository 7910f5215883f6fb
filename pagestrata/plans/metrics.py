"""Queries of the conversion scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagestrata.operators import metrics as M
from pagestrata.plans.registry import query, s4
from pagestrata.plans.text import TIDY_SQL
from pagestrata.sources import derived
from pagestrata.sources.derived import table


@query("text_similarity")
def _(spark, d):
    lost = F.regexp_replace(F.regexp_replace("text", " (the|que|der|la|and|of) ", " "), r"tion\b", "cion")
    return M.text_similarity(table(spark, d, "documents").select("doc_id", F.col("text").alias("a"), lost.alias("b")), "a", "b", ["doc_id"])


PARA_PAIRS = "SELECT doc_id, para_no, ps[para_no+1] AS a, replace(replace(ps[para_no+1],' the ',' '),'en','em') AS b FROM (SELECT doc_id, unnest(range(len(ps))) AS para_no, ps FROM (SELECT doc_id, string_split(text,chr(10)) AS ps FROM documents))"


@query(
    "paragraph_similarity",
    f"""
    WITH n AS (SELECT doc_id, para_no, {TIDY_SQL.format("a")} AS a, {TIDY_SQL.format("b")} AS b FROM ({PARA_PAIRS}))
    SELECT doc_id, para_no, CASE WHEN a='' AND b='' THEN NULL ELSE {s4("1.0-levenshtein(a,b)::DOUBLE/greatest(length(a),length(b))")} END AS sim FROM n
    """,
)
def _(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("para_no", "a"))
    p = p.withColumn("b", F.replace(F.replace("a", F.lit(" the "), F.lit(" ")), F.lit("en"), F.lit("em")))
    return M.text_similarity(p, "a", "b", ["doc_id", "para_no"])


@query(
    "bag_f1",
    f"""
    WITH a AS (SELECT doc_id, lower(text) AS t, count(*) AS n FROM fx_words GROUP BY doc_id, t), b AS (SELECT doc_id, lower(text) AS t, count(*) AS n FROM fx_cand GROUP BY doc_id, t),
    j AS (SELECT coalesce(a.doc_id,b.doc_id) AS doc_id, coalesce(a.n,0) AS na, coalesce(b.n,0) AS nb FROM a FULL JOIN b ON a.doc_id=b.doc_id AND a.t=b.t)
    SELECT doc_id, CAST(sum(least(na,nb)) AS BIGINT) AS common, CAST(sum(na) AS BIGINT) AS n_ref, CAST(sum(nb) AS BIGINT) AS n_cand, {s4("2.0*sum(least(na,nb))::DOUBLE/(sum(na)+sum(nb))::DOUBLE")} AS f1 FROM j GROUP BY doc_id
    """,
    "fx_cand",
)
def _(spark, d):
    low = F.lower("text").alias("t")
    return M.bag_f1(derived.words(spark, d).select("doc_id", low), derived.candidate_words(spark, d).select("doc_id", low), "doc_id", "t")


@query("order_score")
def _(spark, d):
    p = derived.document_pairs(spark, d)
    moved = F.concat(F.slice("cand", F.floor(F.size("cand") / 3).cast("int") + 1, F.size("cand")), F.slice("cand", F.lit(1), F.floor(F.size("cand") / 3).cast("int")))
    return M.order_score(p.select("doc_id", "ref", moved.alias("cand")), "ref", "cand", "doc_id")


@query("align_tokens")
def _(spark, d):
    p = M.align_tokens(derived.document_pairs(spark, d), "ref", "cand", "doc_id")
    return p.groupBy("doc_id").agg(F.count("*").alias("pairs"), F.sum("i").alias("sum_i"), F.sum("j").alias("sum_j"))


@query("align_with_moves")
def _(spark, d):
    p = derived.document_pairs(spark, d)
    half = F.floor(F.size("cand") / 2).cast("int")
    moved = F.concat(F.slice("cand", half + 1, F.size("cand")), F.slice("cand", F.lit(1), half))
    pairs = M.align_tokens(p.select("doc_id", "ref", moved.alias("cand")), "ref", "cand", "doc_id", moves=True)
    return pairs.groupBy("doc_id").agg(F.count("*").alias("pairs"), F.sum("i").alias("sum_i"), F.sum("j").alias("sum_j"))


def word_pairs(spark, d):
    """Words of the original and of a restyled conversion that kept them."""
    a = derived.runs(spark, d).filter((F.col("doc_id") + F.col("para_no") * 7 + F.col("word_no")) % 13 != 0)
    t = F.col("text")
    return a.select(
        "doc_id",
        "text",
        (F.col("para_no") * 100000 + F.col("word_no")).alias("pos"),
        F.col("family").alias("a_family"),
        F.when(t.rlike("^[a-e]"), "Helvetica").when(t.rlike("^[A-E]"), "Georgia").otherwise(F.col("family")).alias("b_family"),
        F.col("size").alias("a_size"),
        (F.col("size") + F.when(t.rlike("r$"), 0.5).when(t.rlike("n$"), 1.0).otherwise(0.0)).alias("b_size"),
        F.col("bold").alias("a_bold"),
        F.when(t.rlike("^[M-Z]"), F.lit(None).cast("boolean")).when(t.rlike("^[A-D]"), False).otherwise(F.col("bold")).alias("b_bold"),
        F.col("italic").alias("a_italic"),
        F.lit(False).alias("b_italic"),
        F.col("color").alias("a_color"),
        F.when(t.rlike("^[0-9]"), "E00010").when(t.rlike("ü"), "000000").otherwise("101010").alias("b_color"),
    )


PAIR_SQL = r"""
pr AS (SELECT doc_id, text, para_no*100000+word_no AS pos, family AS a_family, CASE WHEN regexp_matches(text,'^[a-e]') THEN 'Helvetica' WHEN regexp_matches(text,'^[A-E]') THEN 'Georgia' ELSE family END AS b_family,
  size AS a_size, size+CASE WHEN text LIKE '%r' THEN 0.5 WHEN text LIKE '%n' THEN 1.0 ELSE 0.0 END AS b_size, bold AS a_bold, CASE WHEN regexp_matches(text,'^[M-Z]') THEN NULL WHEN regexp_matches(text,'^[A-D]') THEN false ELSE bold END AS b_bold,
  italic AS a_italic, false AS b_italic, color AS a_color, CASE WHEN regexp_matches(text,'^[0-9]') THEN 'E00010' WHEN regexp_matches(text,'ü') THEN '000000' ELSE '101010' END AS b_color
 FROM fx_runs WHERE (doc_id+para_no*7+word_no)%13<>0 AND regexp_matches(text,'[\p{L}\p{N}_]')),
fl AS (SELECT *, b_family=a_family OR (b_family='Helvetica' AND a_family='Arial') AS ok_family, abs(a_size-b_size)<=0.6 AS ok_size, coalesce(a_bold=b_bold,true) AS ok_bold, a_italic=b_italic AS ok_italic,
  (a_color='FF0000' AND b_color='E00010') OR (a_color='000000' AND b_color IN ('000000','101010')) AS ok_color FROM pr)
"""


@query(
    "style_agreement",
    f"""
    WITH {PAIR_SQL}, r AS (SELECT doc_id, count(*) AS ref_words FROM fx_words GROUP BY doc_id),
    g AS (SELECT doc_id, count(*) AS words, {",".join(f"sum(CASE WHEN ok_{k} THEN 1 ELSE 0 END)::DOUBLE AS {k}" for k in M.ATTRIBUTES)}, sum(CASE WHEN ok_family AND ok_size AND ok_bold AND ok_italic AND ok_color THEN 1 ELSE 0 END)::DOUBLE AS al FROM fl GROUP BY doc_id)
    SELECT doc_id, words, ref_words, {s4("words/ref_words::DOUBLE")} AS coverage, {",".join(f"{s4(f'{k}/words')} AS {k}" for k in M.ATTRIBUTES)}, {s4("al/words")} AS "all" FROM g JOIN r USING (doc_id)
    """,
    "fx_runs",
)
def _(spark, d):
    return M.style_agreement(M.style_flags(word_pairs(spark, d)), derived.words(spark, d))


@query(
    "top_mismatches",
    f"""
    WITH {PAIR_SQL}, e AS ({" UNION ALL ".join(f"SELECT doc_id, pos, text, concat('{k}: ',coalesce(CAST(a_{k} AS VARCHAR),'null'),' -> ',coalesce(CAST(b_{k} AS VARCHAR),'null')) AS label FROM fl WHERE NOT ok_{k}" for k in M.ATTRIBUTES)}),
    c AS (SELECT doc_id, label, count(*) AS n, arg_min(text,pos) AS example, min(pos) AS f FROM e GROUP BY doc_id, label),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f, label) AS INT) AS rank FROM c)
    SELECT doc_id, label, n, example, rank FROM r WHERE rank<=6
    """,
    "fx_runs",
)
def _(spark, d):
    return M.top_mismatches(M.style_flags(word_pairs(spark, d)))


def break_pairs(spark, d):
    """Aligned words with their paragraph on both sides: the candidate joins every third paragraph to the one before
    and breaks lines softly after ten words."""
    w = derived.words(spark, d)
    p = F.col("para_no")
    return w.filter((F.col("doc_id") + p * 7 + F.col("word_no")) % 13 != 0).select(
        "doc_id",
        (p * 100000 + F.col("word_no")).alias("i"),
        p.alias("g_para"),
        (p - F.when(p % 3 == 2, 1).otherwise(0)).alias("c_para"),
        (p * 100 + F.when(p % 2 == 0, F.floor(F.col("word_no") / 10)).otherwise(0)).alias("soft_before"),
        "word_no",
    )


@query(
    "paragraph_break_f1",
    f"""
    WITH p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para_no, word_no) AS k, para_no, word_no FROM fx_words),
    a AS (SELECT doc_id, k, para_no AS g, para_no-CASE WHEN para_no%3=2 THEN 1 ELSE 0 END AS c, para_no*100+CASE WHEN para_no%2=0 THEN word_no//10 ELSE 0 END AS s FROM p WHERE (doc_id+para_no*7+word_no)%13<>0),
    l AS (SELECT a.doc_id, b.g<>a.g AS gb, b.c<>a.c AS cb, b.s>a.s AS sb FROM a JOIN a b ON a.doc_id=b.doc_id AND b.k=a.k+1),
    n AS (SELECT doc_id, sum(CASE WHEN gb AND (cb OR sb) THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN NOT gb AND (cb OR sb) THEN 1 ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN gb AND NOT (cb OR sb) THEN 1 ELSE 0 END)::DOUBLE AS fn,
      sum(CASE WHEN gb AND cb THEN 1 ELSE 0 END)::DOUBLE AS tps, sum(CASE WHEN NOT gb AND cb THEN 1 ELSE 0 END)::DOUBLE AS fps, sum(CASE WHEN gb AND NOT cb THEN 1 ELSE 0 END)::DOUBLE AS fns FROM l GROUP BY doc_id),
    q AS (SELECT doc_id, CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 1.0 END AS p, CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 1.0 END AS r, CASE WHEN tps+fps>0 THEN tps/(tps+fps) ELSE 1.0 END AS ps, CASE WHEN tps+fns>0 THEN tps/(tps+fns) ELSE 1.0 END AS rs FROM n)
    SELECT doc_id, {s4("p")} AS precision, {s4("r")} AS recall, CASE WHEN p+r>0 THEN {s4("2*p*r/(p+r)")} ELSE 0.0::DOUBLE END AS f1, CASE WHEN ps+rs>0 THEN {s4("2*ps*rs/(ps+rs)")} ELSE 0.0::DOUBLE END AS f1_strict FROM q
    """,
    "fx_words",
)
def _(spark, d):
    # Positions in the reference: words of earlier lines of the page, pages before it, added up in two steps.
    w = derived.words(spark, d)
    per_page = w.groupBy("doc_id", "page_no").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per_page.select("doc_id", "page_no", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("line_no", "word_no"))
    placed = w.withColumn("r", rank).join(offsets, ["doc_id", "page_no"]).withColumn("i", (F.col("r") + F.col("before")).cast("bigint"))
    p = F.col("para_no")
    pairs = placed.filter((F.col("doc_id") + p * 7 + F.col("word_no")) % 13 != 0).select(
        "doc_id",
        "i",
        p.alias("g_para"),
        (p - F.when(p % 3 == 2, 1).otherwise(0)).alias("c_para"),
        (p * 100 + F.when(p % 2 == 0, F.floor(F.col("word_no") / 10)).otherwise(0)).alias("soft_before"),
    )
    return M.paragraph_breaks(pairs, ["doc_id"], F.floor(F.col("i") / 4096))


def para_facts(spark, d, cand: bool):
    p = F.col("para")
    src = derived.words(spark, d)
    para = F.col("para_no") - (F.when(F.col("para_no") % 3 == 2, 1).otherwise(0) if cand else F.lit(0))
    base = src.groupBy("doc_id", para.alias("para")).agg(F.count("*").alias("n_words"))
    s = 1 if cand else 0
    return base.select(
        "doc_id",
        "para",
        "n_words",
        F.when((p + s) % 4 == 0, "justify").when(p % 4 == 1, "center").otherwise("left").alias("align"),
        F.when(p % (5 + s) == 0, 1).otherwise(0).alias("heading"),
        F.when(p % (4 + s) == 1, "bullet").alias("list_kind"),
        (p % 2).alias("list_level"),
    )


@query(
    "paragraph_props",
    f"""
    WITH a AS (SELECT doc_id, para_no AS g, para_no-CASE WHEN para_no%3=2 THEN 1 ELSE 0 END AS c, min(para_no*100000+word_no) AS f, count(*) AS n FROM fx_words WHERE (doc_id+para_no*7+word_no)%13<>0 GROUP BY doc_id, g, c),
    gp AS (SELECT doc_id, para_no AS g, count(*) AS n_words, CASE WHEN g%4=0 THEN 'justify' WHEN g%4=1 THEN 'center' ELSE 'left' END AS ga, g%5=0 AS gh, g%4=1 AS gl FROM fx_words GROUP BY doc_id, g),
    j AS (SELECT a.doc_id, n_words, ga, gh, gl, a.g%2 AS glv, CASE WHEN (c+1)%4=0 THEN 'justify' WHEN c%4=1 THEN 'center' ELSE 'left' END AS ca, c%6=0 AS ch, c%5=1 AS cl, c%2 AS clv FROM a JOIN gp USING (doc_id, g))
    SELECT doc_id, count(*) AS paragraphs, {s4("sum(CASE WHEN ga=ca OR (n_words<14 AND ga<>'center' AND ca<>'center') THEN 1 ELSE 0 END)/count(*)::DOUBLE")} AS alignment, {s4("sum(CASE WHEN gh=ch THEN 1 ELSE 0 END)/count(*)::DOUBLE")} AS heading,
     CASE WHEN sum(CASE WHEN gl OR cl THEN 1 ELSE 0 END)>0 THEN {s4("sum(CASE WHEN gl AND cl AND glv=clv THEN 1 ELSE 0 END)/sum(CASE WHEN gl OR cl THEN 1 ELSE 0 END)::DOUBLE")} END AS list FROM j GROUP BY doc_id
    """,
    "fx_words",
)
def _(spark, d):
    return M.paragraph_props(break_pairs(spark, d), para_facts(spark, d, False), para_facts(spark, d, True))


def cell_tables(spark, d, cand: bool):
    c = derived.cells(spark, d, F.floor(F.col("l_orderkey") / 8))
    t = F.col("doc_id") % 8
    text = F.when((F.col("row_no") % 3 == 2) & (F.col("col_no") == 1), "?").otherwise(F.col("text")) if cand else F.col("text")
    rows = c.filter("NOT (row_no = 4 AND doc_id % 16 = 3)") if cand else c
    return rows.select(
        F.floor(F.col("doc_id") / 8).alias("doc_id"), (F.lit(7) - t if cand else t).alias("table_no"), (F.col("row_no") - 1).alias("r"), F.col("col_no").alias("c"), text.alias("text")
    )


@query("table_match")
def _(spark, d):
    return M.table_match(cell_tables(spark, d, False), cell_tables(spark, d, True), laid=True)


def raster(spark, d, cand: bool = False):
    """Greys of a page at one pixel per character cell: ink where a letter stands, paper elsewhere."""
    lines = derived.by_page(derived.word_lines(spark, d).filter("length(text) > 0"), table(spark, d, "documents"))
    text = F.col("text")
    if cand:
        text = F.concat(F.lit(" "), F.replace("text", F.lit("tion"), F.lit("    ")))
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(c == " ", 255).otherwise(F.ascii(c) * 2 % 256).cast("int"))
    return lines.select("doc_id", "page_no", F.col("line_no").alias("y"), codes.alias("greys"))


RASTER_SQL = """
wd AS (SELECT doc_id, page_no, line_no AS y, text, max(length(' '||replace(text,'tion','    '))) OVER (PARTITION BY doc_id, page_no) AS w FROM fx_lines WHERE length(text)>0),
px AS (SELECT doc_id, page_no, y, unnest(range(w)) AS x, text FROM wd),
ga AS (SELECT doc_id, page_no, y, x, CASE WHEN substr(text,x+1,1) IN ('',' ') THEN 255 ELSE ascii(substr(text,x+1,1))*2%256 END AS g FROM px),
gb AS (SELECT doc_id, page_no, y, x, CASE WHEN substr(t,x+1,1) IN ('',' ') THEN 255 ELSE ascii(substr(t,x+1,1))*2%256 END AS g FROM (SELECT doc_id, page_no, y, x, ' '||replace(text,'tion','    ') AS t FROM px))
"""
PAGE = ["doc_id", "page_no"]


@query(
    "ink_f1",
    f"""
    WITH {RASTER_SQL}, a AS (SELECT doc_id, page_no, y, x FROM ga WHERE g<170), b AS (SELECT doc_id, page_no, y, x FROM gb WHERE g<170), o AS (SELECT unnest(range(-2,3)) AS dx), n AS (SELECT o.dx, p.dx AS dy FROM o, o p),
    ha AS (SELECT doc_id, page_no, count(*) AS h FROM (SELECT DISTINCT a.doc_id, a.page_no, a.y, a.x FROM a CROSS JOIN n JOIN b ON b.doc_id=a.doc_id AND b.page_no=a.page_no AND b.y=a.y+dy AND b.x=a.x+dx) GROUP BY ALL),
    hb AS (SELECT doc_id, page_no, count(*) AS h FROM (SELECT DISTINCT b.doc_id, b.page_no, b.y, b.x FROM b CROSS JOIN n JOIN a ON b.doc_id=a.doc_id AND b.page_no=a.page_no AND a.y=b.y+dy AND a.x=b.x+dx) GROUP BY ALL),
    na AS (SELECT doc_id, page_no, count(*) AS n_a FROM a GROUP BY ALL), nb AS (SELECT doc_id, page_no, count(*) AS n_b FROM b GROUP BY ALL),
    j AS (SELECT doc_id, page_no, n_a, n_b, coalesce(ha.h,0)/n_a::DOUBLE AS r, coalesce(hb.h,0)/n_b::DOUBLE AS p FROM (SELECT DISTINCT doc_id, page_no FROM ga) LEFT JOIN na USING (doc_id,page_no) LEFT JOIN nb USING (doc_id,page_no) LEFT JOIN ha USING (doc_id,page_no) LEFT JOIN hb USING (doc_id,page_no))
    SELECT doc_id, page_no, coalesce(n_a,0) AS n_a, coalesce(n_b,0) AS n_b, CASE WHEN n_a IS NULL AND n_b IS NULL THEN 1.0::DOUBLE WHEN n_a IS NULL OR n_b IS NULL OR p+r=0 THEN 0.0::DOUBLE ELSE {s4("2*p*r/(p+r)")} END AS f1 FROM j
    """,
    "fx_lines",
)
def _(spark, d):
    a, b = (M.ink_pixels(raster(spark, d, c), PAGE) for c in (False, True))
    return M.ink_f1(a, b, PAGE, 2, raster(spark, d).select(*PAGE))


@query("best_shift")
def _(spark, d):
    return M.best_shift(raster(spark, d), raster(spark, d, True), PAGE, 15)


@query(
    "gray_diff",
    f"""
    WITH {RASTER_SQL}, d AS (SELECT a.doc_id, a.page_no, a.y, a.x, a.g-b.g AS v FROM ga a JOIN gb b USING (doc_id,page_no,y,x)),
    h AS (SELECT doc_id, page_no, y, x, v+coalesce(lag(v) OVER w,v)+coalesce(lead(v) OVER w,v) AS v FROM d WINDOW w AS (PARTITION BY doc_id,page_no,y ORDER BY x)),
    s AS (SELECT doc_id, page_no, v+coalesce(lag(v) OVER w,v)+coalesce(lead(v) OVER w,v) AS v FROM h WINDOW w AS (PARTITION BY doc_id,page_no,x ORDER BY y))
    SELECT doc_id, page_no, {s4("sum(abs(v))::DOUBLE/(2295.0*count(*))")} AS diff FROM s GROUP BY doc_id, page_no
    """,
    "fx_lines",
)
def _(spark, d):
    return M.gray_diff(raster(spark, d), raster(spark, d, True), PAGE)


def results(spark, d):
    """Long metric records of two runs derived from the event values."""
    e = table(spark, d, "events")
    i = F.col("event_id")
    value = F.when(i % 11 == 0, F.lit(None).cast("double")).otherwise(F.floor(F.col("value") * 100) % 1024 / F.lit(1024.0))
    return e.select(
        F.when(i % 2 == 0, "now").otherwise("before").alias("run"),
        F.floor(i / 28).alias("doc_id"),
        F.when(F.col("user_id") % 2 == 0, "ours").otherwise("word").alias("cand"),
        derived._pick(M.REPORTED, F.floor(i / 2) % 14).alias("metric"),
        value.alias("value"),
    )


RESULTS_SQL = f"SELECT CASE WHEN event_id%2=0 THEN 'now' ELSE 'before' END AS run, event_id//28 AS doc_id, CASE WHEN user_id%2=0 THEN 'ours' ELSE 'word' END AS cand, ({derived._sql_list(M.REPORTED)})[CAST((event_id//2)%14+1 AS INT)] AS metric, CASE WHEN event_id%11=0 THEN NULL ELSE CAST(floor(value*100)%1024 AS BIGINT)/1024.0::DOUBLE END AS value FROM events"


@query(
    "composite",
    f"""
    WITH r AS ({RESULTS_SQL}), m AS (SELECT run, doc_id, cand, metric, max(value) AS value FROM r GROUP BY ALL)
    SELECT run, doc_id, cand, CASE WHEN count(CASE WHEN metric IN ({",".join(f"'{h}'" for h in M.HEADLINE)}) THEN value END)>0 THEN {s4(f"avg(CASE WHEN metric IN ({','.join(repr(h) for h in M.HEADLINE)}) THEN value END)")} END AS score FROM m GROUP BY run, doc_id, cand
    """,
)
def _(spark, d):
    wide = results(spark, d).groupBy("run", "doc_id", "cand").pivot("metric", M.HEADLINE).agg(F.max("value"))
    return wide.select("run", "doc_id", "cand", M.composite(M.HEADLINE).alias("score"))


@query(
    "run_summary",
    f"""
    WITH r AS ({RESULTS_SQL}), n AS (SELECT run, cand, count(DISTINCT doc_id) AS documents FROM r GROUP BY run, cand)
    SELECT run, cand, metric, {s4("avg(value)")} AS mean, count(*) AS n, any_value(documents) AS documents FROM r JOIN n USING (run, cand) WHERE value IS NOT NULL GROUP BY run, cand, metric
    """,
)
def _(spark, d):
    return M.run_summary(results(spark, d))


@query(
    "run_compare",
    f"""
    WITH r AS ({RESULTS_SQL}), m AS (SELECT a.cand, a.metric, avg(a.value) AS x, avg(b.value) AS y, count(*) AS n FROM r a JOIN r b ON a.doc_id=b.doc_id AND a.cand=b.cand AND a.metric=b.metric AND a.run='now' AND b.run='before' AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY a.cand, a.metric)
    SELECT cand, metric, n, {s4("x")} AS now, {s4("y")} AS before, CASE WHEN abs(x-y)<0.0005 THEN '' WHEN (metric='visual.diff')=(x<y) THEN 'better' ELSE 'worse' END AS verdict FROM m
    """,
)
def _(spark, d):
    return M.run_compare(results(spark, d), "now", "before")
