"""Positioned tables derived from the given tables: text set in a fixed-pitch face, one ruled table per order, …

Each table exists twice: as a DataFrame (row-local wherever a row already holds what is needed, so deriving words from a
document needs no shuffle) and as DuckDB SQL for checking. The rules that place defects (dropped words, covered or
doubled glyphs, scanned pages) vary the content; no rule drops rows to make a check cheaper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes of stored documents whose pages share a task: characters set from them fill some 300 MB of rows.
TASK_BYTES = 1 << 20


def by_page(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """Lines dealt by page before they are cut into words or characters, so that what sees a page, or a line of it, finds its
    rows together and only texts are shuffled. The number of parts grows with the stored documents (and is no less
    than the cores), so that a part's characters are sorted in memory. Joins on a page and more use the same parts (Spark's setting for co-partitioned joins)."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    stored = docs.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(F.max("file_size").alias("n")).agg(F.sum("n")).first()[0] or 0
    return lines.repartition(max(spark.sparkContext.defaultParallelism, -(-stored // TASK_BYTES)), "doc_id", "page_no")


#: Line items whose orders share a task: ten pieces drawn for each fill some 100 MB of rows.
TASK_ITEMS = 50_000


def by_order(items: DataFrame, key: str | Column = "l_orderkey") -> DataFrame:
    """Line items dealt by order (the page of a drawn table) before they are cut into cells, bands or pieces of rules, as
    ``by_page`` deals lines. The number of parts grows with the stored rows, which tell more than bytes where columns repeat."""
    spark = items.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return items.repartition(max(spark.sparkContext.defaultParallelism, -(-items.count() // TASK_ITEMS)), key)


SQL: dict[str, str] = {}
NEEDS: dict[str, tuple[str, ...]] = {}

# ── words and lines of text ──────────────────────────────────────────────────────────────────────────────────────


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per set line of at most ten words: key, doc_row, para_no, row_no, ws (array of words)."""
    paras = (
        f"filter(transform(split({text}, '\\n'), (para, p) -> "
        "struct(p AS para_no, filter(split(para, ' '), t -> t <> '') AS ws)), s -> size(s.ws) > 0)"
    )
    rows = (
        f"flatten(transform({paras}, s -> transform(sequence(0, CAST((size(s.ws) - 1) DIV 10 AS INT)), "
        "r -> struct(s.para_no AS para_no, r AS row_no, slice(s.ws, r * 10 + 1, 10) AS ws))))"
    )
    return docs.select(key, F.posexplode(F.expr(rows)).alias("doc_row", "l")).select(key, "doc_row", "l.*")


def words(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rows = text_lines(docs.select("doc_id", "text")).withColumn("page_no", F.floor(F.col("doc_row") / 50).cast("int"))
    each = by_page(rows, docs).select("*", F.posexplode("ws").alias("i", "word"))
    c0 = F.expr("aggregate(slice(ws, 1, i), 0, (n, t) -> n + length(t) + 1)")
    return each.select(
        "doc_id",
        "page_no",
        (F.col("doc_row") % 50).cast("int").alias("line_no"),
        F.col("para_no").cast("int").alias("para_no"),
        (F.col("row_no") * 10 + F.col("i")).cast("int").alias("word_no"),
        F.col("word").alias("text"),
        (F.lit(72.0) + F.lit(6.0) * c0).alias("x"),
        (F.lit(72.0) + F.lit(14.0) * (F.col("doc_row") % 50) + F.lit(4.0) * (F.col("para_no") % 2)).alias("y"),
        (F.lit(6.0) * F.length("word")).alias("w"),
        F.lit(12.0).alias("h"),
        F.when(F.col("para_no") == 0, 18.0).otherwise(12.0).alias("size"),
        ((F.col("doc_id") * 31 + (F.col("row_no") * 10 + F.col("i")) * 17) % 61 + 40).cast("int").alias("confidence"),
    )


SQL["fx_words"] = """
SELECT doc_id, CAST(floor(doc_row/50) AS INT) AS page_no, CAST(doc_row%50 AS INT) AS line_no, CAST(para_no AS INT) AS para_no, CAST(word_no AS INT) AS word_no, word AS text,
 CAST(72.0+6.0*c0 AS DOUBLE) AS x, CAST(72.0+14.0*(doc_row%50)+4.0*(para_no%2) AS DOUBLE) AS y, CAST(6.0*length(word) AS DOUBLE) AS w, CAST(12.0 AS DOUBLE) AS h,
 CAST(CASE WHEN para_no=0 THEN 18.0 ELSE 12.0 END AS DOUBLE) AS size, CAST((doc_id*31+word_no*17)%61+40 AS INT) AS confidence
FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY para_no,row_no)-1 AS doc_row,
  coalesce(sum(length(word)+1) OVER (PARTITION BY doc_id,para_no,row_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS c0
 FROM (SELECT *, CAST(floor(word_no/10) AS INT) AS row_no
  FROM (SELECT doc_id, para_no, unnest(range(len(ws))) AS word_no, unnest(ws) AS word
   FROM (SELECT doc_id, para_no, list_filter(string_split(para,' '), lambda t: t<>'') AS ws
    FROM (SELECT doc_id, unnest(range(len(ps))) AS para_no, unnest(ps) AS para FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents))))))
"""


def word_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per set line, without exploding its words: text, box, size, page position."""
    rows = text_lines(table(spark, folder, "documents").select("doc_id", "text"))
    text = F.array_join("ws", " ")
    return rows.select(
        "doc_id",
        F.floor(F.col("doc_row") / 50).cast("int").alias("page_no"),
        (F.col("doc_row") % 50).cast("int").alias("line_no"),
        F.col("para_no").cast("int").alias("para_no"),
        F.col("row_no").cast("int").alias("row_no"),
        text.alias("text"),
        F.lit(72.0).alias("x"),
        (F.lit(72.0) + F.lit(14.0) * (F.col("doc_row") % 50) + F.lit(4.0) * (F.col("para_no") % 2)).alias("y"),
        (F.lit(6.0) * F.length(text)).alias("w"),
        F.lit(12.0).alias("h"),
        F.when(F.col("para_no") == 0, 18.0).otherwise(12.0).alias("size"),
        (F.lit(6.0) * F.length(F.element_at("ws", 1))).alias("first_w"),
    )


NEEDS["fx_lines"] = ("fx_words",)
SQL["fx_lines"] = """
SELECT doc_id, page_no, line_no, min(para_no) AS para_no, CAST(min(floor(word_no/10)) AS INT) AS row_no, string_agg(text, ' ' ORDER BY word_no) AS text,
 CAST(72.0 AS DOUBLE) AS x, min(y) AS y, max(x+w)-72.0 AS w, CAST(12.0 AS DOUBLE) AS h, min(size) AS size, arg_min(w, word_no) AS first_w
FROM fx_words GROUP BY doc_id, page_no, line_no
"""


def candidate_words(spark: SparkSession, folder: str) -> DataFrame:
    """A conversion result that lost every thirteenth word."""
    w = words(spark, folder)
    return w.filter((F.col("doc_id") + F.col("para_no") * 7 + F.col("word_no")) % 13 != 0).select("doc_id", "para_no", "word_no", "text")


NEEDS["fx_cand"] = ("fx_words",)
SQL["fx_cand"] = "SELECT doc_id, para_no, word_no, text FROM fx_words WHERE (doc_id+para_no*7+word_no)%13<>0"

# ── ruled tables ─────────────────────────────────────────────────────────────────────────────────────────────────


def cells(spark: SparkSession, folder: str, key: str | Column = "l_orderkey") -> DataFrame:
    """``key``: what the line items are dealt by; whole orders."""
    li = by_order(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"), key)
    texts = F.array(
        F.col("l_linenumber").cast("string"),
        F.col("l_partkey").cast("string"),
        F.col("l_quantity").cast("int").cast("string"),
        F.col("l_returnflag"),
    )
    return li.select("l_orderkey", "l_linenumber", F.posexplode(texts).alias("c", "t")).select(
        F.col("l_orderkey").alias("doc_id"),
        F.lit(0).alias("page_no"),
        F.col("l_linenumber").cast("int").alias("row_no"),
        F.col("c").alias("col_no"),
        F.col("t").alias("text"),
        (F.lit(72.0) + F.lit(100.0) * F.col("c")).alias("x"),
        (F.lit(100.0) + F.lit(20.0) * F.col("l_linenumber")).alias("y"),
        F.lit(80.0).alias("w"),
        F.lit(12.0).alias("h"),
    )


SQL["fx_cells"] = """
SELECT l_orderkey AS doc_id, 0 AS page_no, CAST(l_linenumber AS INT) AS row_no, CAST(c AS INT) AS col_no,
 CASE c WHEN 0 THEN CAST(l_linenumber AS VARCHAR) WHEN 1 THEN CAST(l_partkey AS VARCHAR) WHEN 2 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) ELSE l_returnflag END AS text,
 CAST(72+100*c AS DOUBLE) AS x, CAST(100+20*l_linenumber AS DOUBLE) AS y, CAST(80 AS DOUBLE) AS w, CAST(12 AS DOUBLE) AS h
FROM lineitem CROSS JOIN (SELECT unnest(range(4)) AS c)
"""


def table_rules(spark: SparkSession, folder: str) -> DataFrame:
    li = by_order(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"))
    h = li.distinct().select(
        F.col("l_orderkey").alias("doc_id"),
        F.lit(0).alias("page_no"),
        F.lit("h").alias("dir"),
        (F.lit(98.0) + F.lit(20.0) * F.col("l_linenumber")).alias("pos"),
        F.lit(70.0).alias("a"),
        F.lit(470.0).alias("b"),
    )
    span = li.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
    v = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("c")).select(
        F.col("l_orderkey").alias("doc_id"),
        F.lit(0).alias("page_no"),
        F.lit("v").alias("dir"),
        (F.lit(70.0) + F.lit(100.0) * F.col("c")).alias("pos"),
        (F.lit(98.0) + F.lit(20.0) * F.col("lo")).alias("a"),
        (F.lit(118.0) + F.lit(20.0) * F.col("hi")).alias("b"),
    )
    return h.unionByName(v)


SQL["fx_rules"] = """
SELECT DISTINCT l_orderkey AS doc_id, 0 AS page_no, 'h' AS dir, CAST(98+20*l_linenumber AS DOUBLE) AS pos, CAST(70 AS DOUBLE) AS a, CAST(470 AS DOUBLE) AS b FROM lineitem
UNION ALL SELECT l_orderkey, 0, 'v', CAST(70+100*c AS DOUBLE), CAST(min(98+20*l_linenumber) AS DOUBLE), CAST(max(118+20*l_linenumber) AS DOUBLE)
FROM lineitem CROSS JOIN (SELECT unnest(range(5)) AS c) GROUP BY l_orderkey, c
"""

# ── graph and events ─────────────────────────────────────────────────────────────────────────────────────────────


def references(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"))
    c = table(spark, folder, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    n = table(spark, folder, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    return o.unionByName(c).unionByName(n)


SQL["fx_edges"] = """
SELECT concat('o',o_orderkey) AS src, concat('c',o_custkey) AS dst FROM orders
UNION ALL SELECT concat('c',c_custkey), concat('n',c_nationkey) FROM customer UNION ALL SELECT concat('n',n_nationkey), concat('r',n_regionkey) FROM nation
"""


def stage_events(spark: SparkSession, folder: str) -> DataFrame:
    stages = F.array(*[F.lit(s) for s in ("reading", "ocr", "analysing", "writing")])
    return table(spark, folder, "events").select(
        "event_id",
        F.col("user_id").alias("job"),
        "ts",
        F.element_at(stages, (F.col("event_id") % 4 + 1).cast("int")).alias("stage"),
        (F.col("event_id") % 5 + 1).cast("int").alias("page"),
        F.lit(5).alias("pages"),
    )


SQL["fx_stage_events"] = """
SELECT event_id, user_id AS job, ts, CASE event_id%4 WHEN 0 THEN 'reading' WHEN 1 THEN 'ocr' WHEN 2 THEN 'analysing' ELSE 'writing' END AS stage, CAST(1+event_id%5 AS INT) AS page, 5 AS pages FROM events
"""

# ── strings the text functions read ──────────────────────────────────────────────────────────────────────────────

FAMILIES = [
    "TimesNewRomanPS", "Arial", "Helvetica-Condensed", "OpenSans", "EBGaramond", "IBMPlexSans", "Calibri", "SegoeUI",
    "CourierNew", "CMR10", "DejaVu Sans Mono", "Franklin Gothic Medium", "Aptos", "Inter", "Arial Narrow", "Type3_F1",
]
STYLES = ["", "-BoldItalicMT", "-SemiBold", "-Light", "PSMT", "-Black", "-Oblique", " Semilight", "Bold", "-ExtraBold", ",Medium", "-Thin Display"]
ROMANS = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii"]


def _sql_list(items):
    return "[" + ", ".join("'" + i + "'" for i in items) + "]"


def _pick(items, at):
    return F.element_at(F.array(*[F.lit(i) for i in items]), (at + 1).cast("int"))


def fonts(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select("p_partkey", "p_size")
    key = F.col("p_partkey")
    subset = F.when(F.col("p_size") % 2 == 0, "ABCDEF+").otherwise("")
    name = F.concat(subset, _pick(FAMILIES, key % 16), _pick(STYLES, F.floor(key / 16) % 12))
    return p.select(key.alias("font_id"), name.alias("name"))


SQL["fx_fonts"] = f"""
SELECT p_partkey AS font_id, concat(CASE WHEN p_size%2=0 THEN 'ABCDEF+' ELSE '' END, ({_sql_list(FAMILIES)})[CAST(p_partkey%16+1 AS INT)], ({_sql_list(STYLES)})[CAST((p_partkey//16)%12+1 AS INT)]) AS name FROM part
"""


def markers(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"))
    n, q, form = F.col("l_linenumber"), F.col("q"), F.col("l_partkey") % 13
    letter = F.char((96 + n).cast("int"))
    roman = _pick(ROMANS, q % 12)
    text = (
        F.when(form == 0, F.concat(q.cast("string"), F.lit(".")))
        .when(form == 1, F.concat(F.lit("0"), n.cast("string"), F.lit(".")))
        .when(form == 2, F.concat(letter, F.lit(")")))
        .when(form == 3, F.concat(roman, F.lit(".")))
        .when(form == 4, F.concat(F.lit("("), letter, F.lit(")")))
        .when(form == 5, F.concat(F.upper(roman), F.lit(".")))
        .when(form == 6, "•")
        .when(form == 7, "word")
        .when(form == 8, "-")
        .when(form == 9, "")
        .when(form == 10, "")
        .when(form == 11, F.concat(F.lit("["), q.cast("string"), F.lit("]")))
        .otherwise(F.concat(F.upper(letter), F.lit(":")))
    )
    return li.select(F.col("l_orderkey").alias("doc_id"), n.alias("item_no"), text.alias("marker"))


SQL["fx_markers"] = f"""
SELECT l_orderkey AS doc_id, l_linenumber AS item_no, CASE l_partkey%13
 WHEN 0 THEN concat(CAST(l_quantity AS INT),'.') WHEN 1 THEN concat('0',l_linenumber,'.') WHEN 2 THEN concat(chr(CAST(96+l_linenumber AS INT)),')')
 WHEN 3 THEN concat(({_sql_list(ROMANS)})[CAST(l_quantity AS INT)%12+1],'.') WHEN 4 THEN concat('(',chr(CAST(96+l_linenumber AS INT)),')')
 WHEN 5 THEN concat(upper(({_sql_list(ROMANS)})[CAST(l_quantity AS INT)%12+1]),'.') WHEN 6 THEN '•' WHEN 7 THEN 'word' WHEN 8 THEN '-' WHEN 9 THEN '' WHEN 10 THEN chr(61623)
 WHEN 11 THEN concat('[',CAST(l_quantity AS INT),']') ELSE concat(upper(chr(CAST(96+l_linenumber AS INT))),':') END AS marker FROM lineitem
"""


def page_specs(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    a, b, c = (k % 17 + 1).cast("string"), (k % 23 + 3).cast("string"), (k % 31).cast("string")

    def j(*parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    spec = (
        F.when(k % 7 == 0, j(a, "-", b, ", ", c))
        .when(k % 7 == 1, c)
        .when(k % 7 == 2, j(b, "-", a, "  ", c, ",", a))
        .when(k % 7 == 3, "")
        .when(k % 7 == 4, j("x", a, ", ", c))
        .when(k % 7 == 5, j("–", a, "; ", b, "-"))
        .otherwise(j(a, " - ", b, ",", b, "-", a))
    )
    return o.select(k.alias("doc_id"), spec.alias("spec"), (F.lit(20) + F.col("o_custkey") % 15).cast("int").alias("total"))


SQL["fx_specs"] = """
SELECT o_orderkey AS doc_id, CASE o_orderkey%7 WHEN 0 THEN concat(a,'-',b,', ',c) WHEN 1 THEN c WHEN 2 THEN concat(b,'-',a,'  ',c,',',a) WHEN 3 THEN ''
 WHEN 4 THEN concat('x',a,', ',c) WHEN 5 THEN concat('–',a,'; ',b,'-') ELSE concat(a,' - ',b,',',b,'-',a) END AS spec, CAST(20+o_custkey%15 AS INT) AS total
FROM (SELECT *, CAST(o_orderkey%17+1 AS VARCHAR) AS a, CAST(o_orderkey%23+3 AS VARCHAR) AS b, CAST(o_orderkey%31 AS VARCHAR) AS c FROM orders)
"""


def colors(spark: SparkSession, folder: str) -> DataFrame:
    """A colour pair and an opacity per line item."""
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p, s = F.col("l_partkey"), F.col("l_suppkey")

    def hexa(*cs):
        return F.concat(*[F.lpad(F.hex(c.cast("long")), 2, "0") for c in cs])

    return li.select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("item_no"),
        hexa(p * 7 % 256, p * 13 % 256, p * 29 % 256).alias("a"),
        hexa((p * 7 + s) % 256, (p * 13 + s) % 256, p * 29 % 256).alias("b"),
        hexa(p % 80, p % 80 + p % 9, p % 80).alias("dark"),
        hexa(240 + p % 16, 240 + p % 16, 240 + p % 16 - s % 4).alias("light"),
        (p % 101 / F.lit(100.0)).alias("alpha"),
    )


SQL["fx_colors"] = """
SELECT l_orderkey AS doc_id, l_linenumber AS item_no,
 printf('%02X%02X%02X', l_partkey*7%256, l_partkey*13%256, l_partkey*29%256) AS a,
 printf('%02X%02X%02X', (l_partkey*7+l_suppkey)%256, (l_partkey*13+l_suppkey)%256, l_partkey*29%256) AS b,
 printf('%02X%02X%02X', l_partkey%80, l_partkey%80+l_partkey%9, l_partkey%80) AS dark,
 printf('%02X%02X%02X', 240+l_partkey%16, 240+l_partkey%16, 240+l_partkey%16-l_suppkey%4) AS light,
 l_partkey%101/100.0::DOUBLE AS alpha FROM lineitem
"""

# ── styled runs ──────────────────────────────────────────────────────────────────────────────────────────────────

FACES = ["Times New Roman", "Arial", "Courier New"]


def styled(df: DataFrame) -> DataFrame:
    """Style columns read off the words themselves, so that every style occurs on every scale."""
    t = F.col("text")
    return df.select(
        "*",
        _pick(FACES, F.col("para_no") % 3).alias("family"),
        t.rlike(r"^\p{Lu}").alias("bold"),
        t.rlike("[éèê]").alias("italic"),
        F.when(t.rlike("[0-9]"), "FF0000").when(t.rlike("ü"), "0000C0").otherwise("000000").alias("color"),
        (F.length(t) <= 1).alias("lifted"),
        F.when(F.col("para_no") % 3 == 2, F.when(t.rlike("^[a-m]"), "Liberation Mono").otherwise("Cousine")).alias("fallback"),
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    return styled(words(spark, folder))


NEEDS["fx_runs"] = ("fx_words",)
SQL["fx_runs"] = rf"""
SELECT *, ({_sql_list(FACES)})[para_no%3+1] AS family, regexp_matches(text,'^\p{{Lu}}') AS bold, regexp_matches(text,'[éèê]') AS italic,
 CASE WHEN regexp_matches(text,'[0-9]') THEN 'FF0000' WHEN regexp_matches(text,'ü') THEN '0000C0' ELSE '000000' END AS color, length(text)<=1 AS lifted,
 CASE WHEN para_no%3=2 THEN CASE WHEN regexp_matches(text,'^[a-m]') THEN 'Liberation Mono' ELSE 'Cousine' END END AS fallback
FROM fx_words
"""


def document_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Reference text and the candidate that lost words, as two token arrays per document; row-local."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    keep = (
        "flatten(transform(filter(transform(split(text, '\\n'), (para, p) -> struct(p AS p, filter(split(para, ' '), t -> t <> '') AS ws)), s -> size(s.ws) > 0),"
        " s -> filter(transform(s.ws, (t, i) -> struct(s.p AS p, i AS i, t AS t)), w -> {cond})))"
    )
    lost = "(doc_id + w.p * 7 + w.i) % 13 <> 0"
    return docs.select(
        "doc_id",
        F.expr(f"transform({keep.format(cond='true')}, w -> w.t)").alias("ref"),
        F.expr(f"transform({keep.format(cond=lost)}, w -> w.t)").alias("cand"),
    )

# ── page sets: a customer's orders are the pages of one document ─────────────────────────────────────────────────


def page_set(spark: SparkSession, folder: str) -> DataFrame:
    """Written once as a checkpoint, as the stored table it stands for."""
    from pagestrata.operators.common import numbered
    from pagestrata.session import cut_lineage

    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("source_id"))
    k = F.col("source_id")
    pages = numbered(o, ["doc_id"], "source_id", "page_no").select(
        "doc_id",
        "page_no",
        "source_id",
        (k % 4 * 90).cast("int").alias("rotate"),
        (k % 3 * 10.0).alias("crop_x"),
        (k % 5 * 4.0).alias("crop_y"),
        (F.lit(500.0) + k % 7 * 10).alias("crop_w"),
        (F.lit(700.0) + k % 11 * 10).alias("crop_h"),
    )
    return cut_lineage(pages)


SQL["fx_pages"] = """
SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_no, o_orderkey AS source_id, CAST(o_orderkey%4*90 AS INT) AS rotate,
 o_orderkey%3*10.0::DOUBLE AS crop_x, o_orderkey%5*4.0::DOUBLE AS crop_y, 500.0::DOUBLE+o_orderkey%7*10 AS crop_w, 700.0::DOUBLE+o_orderkey%11*10 AS crop_h FROM orders
"""

# ── recognised words of a scan ───────────────────────────────────────────────────────────────────────────────────

DESCENDERS = r"[gjpqyQJçµ()\[\]{}|@$§¿¡]"
DIPS = "[,;]"


def scanned_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words as a recogniser reports them: every other document lies at a slight angle, short words are unsure, some
    marks are specks, bold words have thick stems."""
    w = words(spark, folder)
    t, p = F.col("text"), F.col("para_no")
    slope = F.when(F.col("doc_id") % 2 == 0, 1.0 / 256).otherwise(0.0)
    speck = t.rlike(r"^[^\p{L}\p{N}]+$")
    h = F.when(speck, 3.0).when(F.col("size") == 18.0, 14.0).otherwise(10.0)
    depth = F.when(t.rlike(DESCENDERS), 2.0).when(t.rlike(DIPS), 1.0).otherwise(0.0)
    bottom = F.col("y") + 12.0 + slope * (F.col("x") + F.col("w") / 2)
    return w.select(
        "doc_id", "page_no", F.col("line_no").alias("line"), p.alias("paragraph"), "word_no", "text",
        F.col("x").alias("x0"),
        (F.col("x") + F.col("w")).alias("x1"),
        (bottom - h).alias("top"),
        (bottom + depth).alias("bottom"),
        F.when(F.length(t) <= 2, F.col("confidence") - 30).otherwise(F.col("confidence")).alias("confidence"),
        (F.lit(1.0) + F.length(t) % 4 / F.lit(16.0) + F.when(t.rlike(r"^\p{Lu}"), 0.5).otherwise(0.0)).alias("stem"),
        F.when(t.rlike("^[a-c]"), 1.25).otherwise(0.5).alias("leaning"),
        (p * 16 % 256).cast("int").alias("r"),
        (F.length(t) * 8 % 256).cast("int").alias("g"),
        (p * 40 % 256).cast("int").alias("b"),
    )


NEEDS["fx_ocr"] = ("fx_words",)
SQL["fx_ocr"] = rf"""
SELECT doc_id, page_no, line_no AS line, para_no AS paragraph, word_no, text, x AS x0, x+w AS x1, bt-h0 AS top, bt+CASE WHEN regexp_matches(text,'{DESCENDERS}') THEN 2.0 WHEN regexp_matches(text,'{DIPS}') THEN 1.0 ELSE 0.0 END AS bottom,
 CASE WHEN length(text)<=2 THEN confidence-30 ELSE confidence END AS confidence, 1.0::DOUBLE+length(text)%4/16.0::DOUBLE+CASE WHEN regexp_matches(text,'^\p{{Lu}}') THEN 0.5 ELSE 0.0 END AS stem,
 CASE WHEN regexp_matches(text,'^[a-c]') THEN 1.25::DOUBLE ELSE 0.5::DOUBLE END AS leaning, CAST(para_no*16%256 AS INT) AS r, CAST(length(text)*8%256 AS INT) AS g, CAST(para_no*40%256 AS INT) AS b
FROM (SELECT *, y+12.0+CASE WHEN doc_id%2=0 THEN 1.0::DOUBLE/256 ELSE 0.0 END*(x+w/2) AS bt, CASE WHEN regexp_matches(text,'^[^\p{{L}}\p{{N}}]+$') THEN 3.0::DOUBLE WHEN size=18.0 THEN 14.0 ELSE 10.0 END AS h0 FROM fx_words)
"""

# ── glyphs ───────────────────────────────────────────────────────────────────────────────────────────────────────


def glyphs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per character of the set lines. Digits are raised and small, words that start with a capital are bold."""
    lines = by_page(word_lines(spark, folder), table(spark, folder, "documents"))
    each = lines.select(
        "doc_id", "page_no", "line_no", "para_no", "y", "h", "size", F.posexplode(F.filter(F.split("text", ""), lambda c: c != "")).alias("i", "text")
    )
    t = F.col("text")
    digit = t.between("0", "9")  # one character: no pattern is needed
    ws = t == " "
    return each.select(
        "doc_id", "page_no", "line_no", "para_no",
        (F.col("line_no") * 100000 + F.col("i")).alias("seq"),
        "text",
        ws.alias("ws"),
        (F.lit(72.0) + F.lit(6.0) * F.col("i")).alias("x"),
        (F.col("y") + F.col("h") - F.when(digit, 4.0).otherwise(0.0)).alias("y"),
        F.lit(1.0).alias("dx"),
        F.lit(0.0).alias("dy"),
        F.when(digit, F.col("size") * 0.625).otherwise(F.col("size")).alias("size"),
        F.lit(6.0).alias("adv"),
        F.when(ws, 0.0).otherwise(6.0).alias("ink"),
        _pick(FACES, F.col("para_no") % 3).alias("family"),
        F.when(t.isin("é", "è", "ê"), "FF0000").otherwise("000000").alias("color"),
        t.rlike(r"\p{Lu}").alias("bold"),
    )


NEEDS["fx_glyphs"] = ("fx_lines",)
SQL["fx_glyphs"] = rf"""
SELECT doc_id, page_no, line_no, para_no, line_no*100000+i AS seq, c AS text, c=' ' AS ws, 72.0::DOUBLE+6.0*i AS x, y+h-CASE WHEN regexp_matches(c,'[0-9]') THEN 4.0::DOUBLE ELSE 0.0 END AS y, 1.0::DOUBLE AS dx, 0.0::DOUBLE AS dy,
 CASE WHEN regexp_matches(c,'[0-9]') THEN size*0.625::DOUBLE ELSE size END AS size, 6.0::DOUBLE AS adv, CASE WHEN c=' ' THEN 0.0::DOUBLE ELSE 6.0::DOUBLE END AS ink, ({_sql_list(FACES)})[para_no%3+1] AS family,
 CASE WHEN regexp_matches(c,'[éèê]') THEN 'FF0000' ELSE '000000' END AS color, regexp_matches(c,'\p{{Lu}}') AS bold
FROM (SELECT doc_id, page_no, line_no, para_no, y, h, size, unnest(range(length(text))) AS i, unnest(string_split(text,'')) AS c FROM fx_lines)
"""

# ── drawn graphics: one table per order, its rows unique ─────────────────────────────────────────────────────────


def table_rows(spark: SparkSession, folder: str) -> DataFrame:
    li = by_order(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"))
    return li.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("row_no")).agg(
        F.min("l_partkey").alias("pk"), F.max("l_quantity").cast("int").alias("q"), F.min("l_returnflag").alias("flag")
    )


SQL["fx_rows"] = """
SELECT l_orderkey AS doc_id, l_linenumber AS row_no, min(l_partkey) AS pk, CAST(max(l_quantity) AS INT) AS q, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2
"""


def fills(spark: SparkSession, folder: str) -> DataFrame:
    """A band behind every table row and a badge inside its last cell."""
    r = table_rows(spark, folder)
    y = F.lit(98.0) + F.lit(20.0) * F.col("row_no")
    band = r.select(
        "doc_id", F.lit(0).alias("page_no"), (F.col("row_no") * 10).alias("paint_order"), F.lit(70.0).alias("x"), y.alias("y"), F.lit(400.0).alias("w"), F.lit(20.0).alias("h"),
        F.when(F.col("flag") == "A", "EEEEEE").when(F.col("flag") == "N", "FFFFFF").otherwise("C0C0FF").alias("color"), F.when(F.col("q") % 2 == 0, 1.0).otherwise(0.5).alias("opacity"),
    )
    badge = r.select(
        "doc_id", F.lit(0).alias("page_no"), (F.col("row_no") * 10 + 1).alias("paint_order"), F.lit(380.0).alias("x"), (y + 4).alias("y"), (F.lit(8.0) + F.col("q") % 16).alias("w"), F.lit(12.0).alias("h"),
        F.when(F.col("pk") % 3 == 0, "008000").otherwise("EEEEEE").alias("color"), F.lit(1.0).alias("opacity"),
    )
    return band.unionByName(badge)


NEEDS["fx_fills"] = ("fx_rows",)
SQL["fx_fills"] = """
SELECT doc_id, 0 AS page_no, row_no*10 AS paint_order, 70.0::DOUBLE AS x, 98.0::DOUBLE+20.0*row_no AS y, 400.0::DOUBLE AS w, 20.0::DOUBLE AS h, CASE flag WHEN 'A' THEN 'EEEEEE' WHEN 'N' THEN 'FFFFFF' ELSE 'C0C0FF' END AS color, CASE WHEN q%2=0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS opacity FROM fx_rows
UNION ALL SELECT doc_id, 0, row_no*10+1, 380.0::DOUBLE, 102.0::DOUBLE+20.0*row_no, 8.0::DOUBLE+q%16, 12.0::DOUBLE, CASE WHEN pk%3=0 THEN '008000' ELSE 'EEEEEE' END, 1.0::DOUBLE FROM fx_rows
"""


def rule_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The line over every row drawn in pieces: some touch, some leave steady gaps, some are dots."""
    r = table_rows(spark, folder)
    kind = F.col("pk") % 4
    step = F.when(kind == 0, 10.0).when(kind == 1, 12.0).when(kind == 2, 6.0).otherwise(40.0)
    size = F.when(kind == 0, 10.0).when(kind == 1, 8.0).when(kind == 2, 2.0).otherwise(20.0)
    each = r.select("*", step.alias("step"), size.alias("size"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    return each.select(
        "doc_id", F.lit(0).alias("page_no"), (F.col("row_no") * 100 + F.col("k")).alias("piece_no"), F.lit("h").alias("dir"), (F.lit(98.0) + F.lit(20.0) * F.col("row_no")).alias("pos"),
        (F.lit(70.0) + F.col("step") * F.col("k")).alias("a"), (F.lit(70.0) + F.col("step") * F.col("k") + F.col("size")).alias("b"), F.when(kind == 2, 2.0).otherwise(1.0).alias("width"),
        F.when((F.col("k") >= 6) & (F.col("q") % 5 == 0), "FF0000").otherwise("000000").alias("color"),
    )


NEEDS["fx_pieces"] = ("fx_rows",)
SQL["fx_pieces"] = """
SELECT doc_id, 0 AS page_no, row_no*100+k AS piece_no, 'h' AS dir, 98.0::DOUBLE+20.0*row_no AS pos, 70.0::DOUBLE+step*k AS a, 70.0::DOUBLE+step*k+sz AS b, CASE WHEN pk%4=2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS width, CASE WHEN k>=6 AND q%5=0 THEN 'FF0000' ELSE '000000' END AS color
FROM (SELECT *, CASE pk%4 WHEN 0 THEN 10.0::DOUBLE WHEN 1 THEN 12.0::DOUBLE WHEN 2 THEN 6.0::DOUBLE ELSE 40.0::DOUBLE END AS step, CASE pk%4 WHEN 0 THEN 10.0::DOUBLE WHEN 1 THEN 8.0::DOUBLE WHEN 2 THEN 2.0::DOUBLE ELSE 20.0::DOUBLE END AS sz FROM fx_rows) CROSS JOIN (SELECT unnest(range(10)) AS k)
"""
