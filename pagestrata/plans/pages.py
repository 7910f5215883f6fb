"""Queries of page sets, files, manifests and text export."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestrata.functions import text as T
from pagestrata.operators import pages as P
from pagestrata.plans.registry import query
from pagestrata.sources import derived, files
from pagestrata.sources.derived import table

RANGES_SQL = r"""
tk AS (SELECT doc_id, spec, total, unnest(list_filter(string_split_regex(trim(spec),'[,\s]+'), lambda t: t<>'')) AS t FROM fx_specs WHERE trim(spec)<>''),
sp AS (SELECT *, regexp_matches(t,'^\d+(-\d+)?$') AS ok, TRY_CAST(split_part(t,'-',1) AS INT) AS a, TRY_CAST(CASE WHEN contains(t,'-') THEN split_part(t,'-',2) ELSE t END AS INT) AS b FROM tk),
ag AS (SELECT doc_id, bool_and(ok) AS ok, bool_or(ok AND (least(a,b)<1 OR greatest(a,b)>total)) AS outside FROM sp GROUP BY doc_id)
"""


@query(
    "parse_page_ranges",
    f"""
    WITH {RANGES_SQL}, pg AS (SELECT DISTINCT doc_id, unnest(range(least(a,b),greatest(a,b)+1)) AS p FROM sp JOIN ag USING (doc_id) WHERE ag.ok AND NOT outside),
    l AS (SELECT doc_id, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS pages FROM pg GROUP BY doc_id)
    SELECT doc_id, coalesce(pages,'') AS pages, CASE WHEN trim(spec)='' THEN 'blank' WHEN NOT ok THEN 'invalid' WHEN outside THEN 'out_of_range' END AS error FROM fx_specs LEFT JOIN ag USING (doc_id) LEFT JOIN l USING (doc_id)
    """,
    "fx_specs",
)
def _(spark, d):
    r = derived.page_specs(spark, d).select("doc_id", T.page_ranges(F.col("spec"), F.col("total")).alias("r"))
    return r.select("doc_id", F.array_join(F.col("r.pages").cast("array<string>"), ",").alias("pages"), "r.error")


GROUPS_SQL = r"""
gt AS (SELECT doc_id, total, list_filter(string_split_regex(regexp_replace(replace(replace(spec,'–','-'),'—','-'),'\s*-\s*','-','g'),'[\s,;]+'), lambda t: t<>'') AS ts FROM fx_specs),
gx AS (SELECT doc_id, total, unnest(range(len(ts))) AS i, unnest(ts) AS t FROM gt),
gs AS (SELECT *, regexp_matches(t,'^(\d+|\d+-\d*|-\d+)$') AS ok, CASE WHEN contains(t,'-') THEN coalesce(TRY_CAST(split_part(t,'-',1) AS INT),1) ELSE TRY_CAST(t AS INT) END AS a,
  CASE WHEN contains(t,'-') THEN coalesce(TRY_CAST(split_part(t,'-',2) AS INT),total) ELSE TRY_CAST(t AS INT) END AS b FROM gx),
gr AS (SELECT *, least(a,b) AS lo, greatest(a,b) AS hi, ok AND least(a,b)>=1 AND greatest(a,b)<=total AS good FROM gs)
"""


@query(
    "parse_range_groups",
    f"""
    WITH {GROUPS_SQL}
    SELECT doc_id, coalesce(string_agg(CASE WHEN good THEN concat(lo,'-',hi) END, '|' ORDER BY i),'') AS groups, coalesce(string_agg(CASE WHEN NOT ok THEN t END, '|' ORDER BY i),'') AS invalid, coalesce(bool_or(ok AND NOT good),false) AS out_of_range
    FROM fx_specs LEFT JOIN gr USING (doc_id) GROUP BY doc_id
    """,
    "fx_specs",
)
def _(spark, d):
    r = derived.page_specs(spark, d).select("doc_id", T.range_groups(F.col("spec"), F.col("total")).alias("r"))
    shown = F.transform("r.groups", lambda g: F.concat(F.element_at(g, 1).cast("string"), F.lit("-"), F.element_at(g, -1).cast("string")))
    return r.select("doc_id", F.array_join(shown, "|").alias("groups"), F.array_join("r.invalid", "|").alias("invalid"), "r.out_of_range")


def docs_with_groups(spark, d):
    s = derived.page_specs(spark, d)
    return s.select("doc_id", "total", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("base"), T.range_groups(F.col("spec"), F.col("total"))["groups"].alias("groups"))


@query(
    "split_pages",
    f"""
    WITH {GROUPS_SQL}, g AS (SELECT doc_id, lo, hi, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS file_no FROM gr WHERE good),
    n AS (SELECT *, concat('d',doc_id,CASE WHEN lo=hi THEN concat('-pagina-',lo) ELSE concat('-paginas-',lo,'-',hi) END) AS raw FROM g),
    u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, raw ORDER BY file_no) AS k FROM n)
    SELECT doc_id, CAST(file_no AS INT) AS file_no, CASE WHEN k=1 THEN raw ELSE concat(raw,'-',k) END AS name, CAST(unnest(range(1,hi-lo+2)) AS INT) AS pos, CAST(unnest(range(lo,hi+1)) AS INT) AS page_no FROM u
    """,
    "fx_specs",
)
def _(spark, d):
    return P.split_ranges(docs_with_groups(spark, d))


@query(
    "split_joined",
    f"""
    WITH {GROUPS_SQL}, g AS (SELECT doc_id, i, lo, unnest(range(lo,hi+1)) AS page_no FROM gr WHERE good), n AS (SELECT doc_id, count(*) AS files, min(lo) AS lo, max(hi) AS hi FROM gr WHERE good GROUP BY doc_id),
    f AS (SELECT doc_id, page_no, min(i*10000+page_no) AS k FROM g GROUP BY doc_id, page_no)
    SELECT doc_id, 1 AS file_no, CASE WHEN files>1 THEN concat('d',doc_id,'-extracto') WHEN lo=hi THEN concat('d',doc_id,'-pagina-',lo) ELSE concat('d',doc_id,'-paginas-',lo,'-',hi) END AS name, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INT) AS pos, CAST(page_no AS INT) AS page_no FROM f JOIN n USING (doc_id)
    """,
    "fx_specs",
)
def _(spark, d):
    return P.split_ranges(docs_with_groups(spark, d), joined=True)


@query(
    "split_each",
    "SELECT doc_id, CAST(p AS INT) AS file_no, concat('d',doc_id,'-pagina-',lpad(CAST(p AS VARCHAR),CAST(greatest(2,length(CAST(total AS VARCHAR))) AS INT),'0')) AS name, CAST(p AS INT) AS page_no, 1 AS pos FROM (SELECT doc_id, total, unnest(range(1,total+1)) AS p FROM fx_specs)",
    "fx_specs",
)
def _(spark, d):
    return P.split_each(docs_with_groups(spark, d))


def chosen(pages):
    return pages.filter((F.col("page_no") * 5 + F.col("doc_id")) % 4 == 0).select("doc_id", "page_no")


@query(
    "select_pages",
    "SELECT doc_id, page_no, source_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS pos FROM fx_pages WHERE (page_no*5+doc_id)%4=0",
    "fx_pages",
)
def _(spark, d):
    pages = derived.page_set(spark, d).select("doc_id", "page_no", "source_id")
    return P.select_pages(pages, chosen(pages))


@query(
    "unique_names",
    "SELECT o_orderkey, CASE WHEN k=1 THEN name ELSE concat(name,'-',k) END AS unique_name FROM (SELECT o_orderkey, concat(o_orderstatus,o_orderpriority) AS name, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS k FROM orders)",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat("o_orderstatus", "o_orderpriority").alias("name"))
    return P.unique_names(o, "name", "o_orderkey").select("o_orderkey", "unique_name")


@query(
    "merge_documents",
    "SELECT c_nationkey AS target, doc_id AS file_ord, page_no, source_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY doc_id, page_no) AS new_page FROM fx_pages JOIN customer ON c_custkey=doc_id",
    "fx_pages",
)
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("target"))
    pages = derived.page_set(spark, d).join(c, "doc_id").select("target", F.col("doc_id").alias("file_ord"), "page_no", "source_id")
    return P.merge_documents(pages)


@query(
    "delete_pages",
    """
    WITH s AS (SELECT *, (page_no*5+doc_id)%4=0 AS gone FROM fx_pages), k AS (SELECT doc_id FROM s GROUP BY doc_id HAVING bool_or(gone) AND NOT bool_and(gone))
    SELECT doc_id, page_no, source_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS new_page FROM s JOIN k USING (doc_id) WHERE NOT gone
    """,
    "fx_pages",
)
def _(spark, d):
    pages = derived.page_set(spark, d).select("doc_id", "page_no", "source_id")
    return P.delete_pages(pages, chosen(pages))


@query("invert_selection", "SELECT doc_id, page_no FROM fx_pages WHERE (page_no*5+doc_id)%4<>0", "fx_pages")
def _(spark, d):
    pages = derived.page_set(spark, d)
    return P.invert_selection(pages, chosen(pages))


MOVED_SQL = """
n AS (SELECT doc_id, count(*) AS n FROM fx_pages GROUP BY doc_id), r AS (SELECT doc_id, page_no, source_id, n, n+1-page_no AS pos FROM fx_pages JOIN n USING (doc_id)),
m AS (SELECT doc_id, CASE WHEN doc_id%2=0 THEN n ELSE 1 END AS a, CASE WHEN doc_id%2=0 THEN n-1 ELSE 2 END AS b FROM n WHERE n>=2),
o AS (SELECT r.doc_id, page_no, source_id, CASE WHEN pos=a THEN b WHEN pos=b THEN a ELSE pos END AS pos FROM r LEFT JOIN m USING (doc_id))
"""


def reordered(pages):
    """Reversed, then the first page of the source (now last) moved one up, or the last (now first) one down."""
    order = P.reverse_order(pages)
    n = pages.groupBy("doc_id").agg(F.max("page_no").alias("n"))
    even = F.col("doc_id") % 2 == 0
    moves = n.select("doc_id", F.when(even, F.lit(1)).otherwise(F.col("n")).cast("bigint").alias("page_no"), F.when(even, -1).otherwise(1).alias("delta"))
    return P.move_page(order, moves)


@query("reorder_pages", f"WITH {MOVED_SQL} SELECT doc_id, page_no, source_id, pos FROM o", "fx_pages")
def _(spark, d):
    pages = derived.page_set(spark, d).select("doc_id", "page_no", "source_id")
    return P.reorder_pages(pages, reordered(pages))


@query("moved_pages", f"WITH {MOVED_SQL} SELECT doc_id, CAST(sum(CASE WHEN pos<>page_no THEN 1 ELSE 0 END) AS BIGINT) AS moved FROM o GROUP BY doc_id", "fx_pages")
def _(spark, d):
    return P.moved_pages(reordered(derived.page_set(spark, d).select("doc_id", "page_no")))


@query(
    "rotate_pages",
    "SELECT doc_id, page_no, CAST(((rotate+CASE WHEN (page_no*5+doc_id)%4=0 THEN CASE WHEN page_no%2=0 THEN -90 ELSE 450 END ELSE 0 END)%360+360)%360 AS INT) AS rotate FROM fx_pages",
    "fx_pages",
)
def _(spark, d):
    pages = derived.page_set(spark, d).select("doc_id", "page_no", "rotate")
    deltas = chosen(pages).withColumn("delta", F.when(F.col("page_no") % 2 == 0, -90).otherwise(450))
    return P.rotate_pages(pages, deltas)


@query(
    "to_display",
    """
    WITH b AS (SELECT *, 100.0::DOUBLE+page_no AS x0, 200.0::DOUBLE+page_no AS y0, 180.0::DOUBLE+page_no AS x1, 220.0::DOUBLE+page_no AS y1 FROM fx_pages)
    SELECT doc_id, page_no, CASE rotate WHEN 90 THEN y0-crop_y WHEN 180 THEN crop_x+crop_w-x1 WHEN 270 THEN crop_y+crop_h-y1 ELSE x0-crop_x END AS x,
     CASE rotate WHEN 90 THEN x0-crop_x WHEN 180 THEN y0-crop_y WHEN 270 THEN crop_x+crop_w-x1 ELSE crop_y+crop_h-y1 END AS y, CASE WHEN rotate%180=90 THEN y1-y0 ELSE x1-x0 END AS w, CASE WHEN rotate%180=90 THEN x1-x0 ELSE y1-y0 END AS h,
     CASE WHEN rotate%180=90 THEN crop_h ELSE crop_w END AS page_w, CASE WHEN rotate%180=90 THEN crop_w ELSE crop_h END AS page_h FROM b
    """,
    "fx_pages",
)
def _(spark, d):
    pages = derived.page_set(spark, d)
    n = F.col("page_no").cast("double")
    boxes = pages.select("doc_id", "page_no", (n + 100).alias("x0"), (n + 200).alias("y0"), (n + 180).alias("x1"), (n + 220).alias("y1"))
    return P.to_display(boxes, pages).drop("x0", "y0", "x1", "y1")


@query("wrap_text")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(P.wrap_text(F.col("text"), 40)).alias("line_no", "line"))
    return P.paginate(docs, 792.0).groupBy("doc_id", "page_no").agg(F.count("*").alias("lines"), F.max(F.length("line")).alias("widest"), F.min("y").alias("lowest"))


# ── files, manifests, text ───────────────────────────────────────────────────────────────────────────────────────


@query(
    "read_words",
    """
    WITH r AS (SELECT doc_id, page_no, para_no//4 AS block, para_no AS para, line_no AS line, word_no, text, x, y, CASE WHEN length(text)=2 THEN 0.0 ELSE w END AS w, confidence FROM fx_words WHERE NOT regexp_matches(text,'^[|.,;:-]+$'))
    SELECT doc_id, page_no, word_no, text, x, y, w, confidence, CAST(dense_rank() OVER (PARTITION BY doc_id,page_no ORDER BY block,para,line)-1 AS INT) AS line, CAST(dense_rank() OVER (PARTITION BY doc_id,page_no ORDER BY block,para)-1 AS INT) AS paragraph FROM r WHERE w>0
    """,
    "fx_words",
)
def _(spark, d):
    w = derived.words(spark, d)
    raw = w.select(
        "doc_id", "page_no", F.floor(F.col("para_no") / 4).alias("block"), F.col("para_no").alias("para"), F.col("line_no").alias("line"), "word_no",
        F.when(F.col("text").rlike("^[|.,;:-]+$"), "  ").otherwise(F.concat(F.lit(" "), "text")).alias("text"), "x", "y",
        F.when(F.length("text") == 2, 0.0).otherwise(F.col("w")).alias("w"), "h", "confidence",
    )
    return files.number_words(raw).drop("h")


@query(
    "sniff_kind",
    "SELECT CASE doc_id%5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 4 THEN 'jpeg' ELSE 'other' END AS kind, count(*) AS n FROM documents GROUP BY 1",
)
def _(spark, d):
    heads = F.element_at(F.array(*[F.lit(h) for h in ("89504E470D0A", "FFD8FFE000", "25504446", "", "FFD8FFDB00")]), (F.col("doc_id") % 5 + 1).cast("int"))
    content = F.concat(F.unhex(heads), F.encode("text", "utf-8"))
    return table(spark, d, "documents").groupBy(files.sniff_kind(content).alias("kind")).agg(F.count("*").alias("n"))


@query(
    "read_manifest",
    """
    WITH m AS (SELECT doc_id AS ord, concat(lang,'-',source) AS slug, CASE WHEN doc_id%3=0 THEN concat('g',doc_id%50) END AS gt, CASE WHEN doc_id%4=0 THEN 'c' END AS st, CASE WHEN doc_id%2=0 THEN 1 ELSE 0 END AS nf FROM documents),
    k AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY ord) AS k FROM m), n AS (SELECT *, CASE WHEN k=1 THEN slug ELSE concat(slug,'-',k) END AS id FROM k)
    SELECT ord, id, CASE WHEN gt IN (SELECT concat('g',doc_id%40) FROM documents) THEN gt END AS gt, coalesce(st,'manifest') AS "set", nf AS n_features FROM n WHERE regexp_matches(id,'^(en|fr)')
    """,
)
def _(spark, d):
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    rows = docs.select(
        i.alias("ord"),
        F.concat("lang", F.lit(" / "), "source").alias("id"),
        F.concat(F.lit("p"), i.cast("string")).alias("pdf"),
        F.when(i % 3 == 0, F.concat(F.lit("g"), (i % 50).cast("string"))).alias("gt"),
        F.when(i % 4 == 0, "c").alias("set"),
        F.when(i % 2 == 0, F.array(F.lit("tables"))).alias("features"),
    )
    listing = docs.select(F.concat(F.lit("g"), (i % 40).cast("string")).alias("path"))
    m = files.manifest_documents(rows, "^(en|fr)", listing)
    return m.select("ord", "id", "gt", "set", F.size("features").alias("n_features"))


@query(
    "export_text",
    """
    WITH p AS (SELECT doc_id, page_no, string_agg(text, chr(10) ORDER BY line_no) AS text FROM fx_lines GROUP BY doc_id, page_no)
    SELECT doc_id, page_no, CASE WHEN max(page_no) OVER (PARTITION BY doc_id)>0 THEN concat(CASE WHEN page_no>0 THEN chr(10)||chr(10) ELSE '' END,'— Página ',page_no+1,' —',chr(10),text) ELSE text END AS text FROM p
    """,
    "fx_lines",
)
def _(spark, d):
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), "\n")
    return files.export_text(derived.word_lines(spark, d).groupBy("doc_id", "page_no").agg(lines.alias("text")))


@query(
    "pending_only",
    """
    WITH i AS (SELECT doc_id AS id, left(sha1(text),12) AS sha FROM documents), r AS (SELECT id, sha FROM i WHERE id%3=0), f AS (SELECT id, CASE WHEN id%10=1 THEN 'stale' ELSE sha END AS sha, id%4=1 AS det FROM i WHERE id%5=1)
    SELECT id, sha FROM i WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.id=i.id AND r.sha=i.sha) AND NOT EXISTS (SELECT 1 FROM f WHERE f.id=i.id AND f.sha=i.sha AND det)
    """,
)
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), files.content_key(F.col("text")).alias("sha"))
    done = docs.filter(F.col("id") % 3 == 0)
    failed = docs.filter(F.col("id") % 5 == 1).select("id", F.when(F.col("id") % 10 == 1, "stale").otherwise(F.col("sha")).alias("sha"), (F.col("id") % 4 == 1).alias("deterministic"))
    return files.pending_only(docs, done, failed).select("id", "sha")
