"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestrata.functions import text as T
from pagestrata.plans.registry import query
from pagestrata.sources import derived
from pagestrata.sources.derived import table

WORDS_SQL = r"[\p{L}\p{N}_]+"


@query(
    "clean_text",
    r"""
    SELECT doc_id, length(s) AS chars, md5(s) AS digest FROM (
     SELECT doc_id, regexp_replace(translate(replace(replace(replace(replace(replace(replace(replace(dirty,
       chr(64256),'ff'),chr(64257),'fi'),chr(64258),'fl'),chr(64259),'ffi'),chr(64260),'ffl'),chr(64261),'st'),chr(64262),'st'),
       chr(160)||chr(8199)||chr(8239)||chr(8194)||chr(8195)||chr(8201)||chr(8202)||chr(9)||chr(10)||chr(13), '          '),
       '[\x{1}-\x{1F}\x{7F}-\x{9F}\x{FFFD}\x{FEFF}\x{200B}]','','g') AS s
     FROM (SELECT doc_id, replace(replace(replace(replace(text,'ff',chr(64256)),'st',chr(64262)),'. ','.'||chr(160)),'e ','e'||chr(8203)||' '||chr(7)) AS dirty FROM documents))
    """,
)
def _(spark, d):
    dirty = F.col("text")
    for a, b in [("ff", "ﬀ"), ("st", "ﬆ"), (". ", ". "), ("e ", "e​ \u0007")]:
        dirty = F.replace(dirty, F.lit(a), F.lit(b))
    s = T.clean_text(dirty)
    return table(spark, d, "documents").select("doc_id", F.length(s).alias("chars"), F.md5(s).alias("digest"))


BROKEN_SQL = "replace(replace(replace(text,'tion ','ti-'||chr(10)||' on '),'. ','.'||chr(8203)||' '),'er','e'||chr(173)||'r')"
TIDY_SQL = (
    r"trim(regexp_replace(regexp_replace(replace(replace(regexp_replace({0},'[\x{{AD}}\x{{200B}}]','','g'),chr(8208),'-'),chr(8209),'-'),"
    r"'([\p{{L}}\p{{N}}_])-[ \t]*\n[ \t]*([a-záéíóúñü])','\1\2','g'),'\s+',' ','g'))"
)


def broken(c):
    c = F.replace(c, F.lit("tion "), F.lit("ti-\n on "))
    c = F.replace(c, F.lit(". "), F.lit(".​ "))
    return F.replace(c, F.lit("er"), F.lit("e­r"))


@query(
    "norm_text",
    f"SELECT doc_id, length(s) AS chars, md5(s) AS digest FROM (SELECT doc_id, {TIDY_SQL.format(BROKEN_SQL)} AS s FROM documents)",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.norm_text(broken(F.col("text"))).alias("s"))
    return docs.select("doc_id", F.length("s").alias("chars"), F.md5("s").alias("digest"))


@query(
    "tokens_of",
    f"""
    SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, md5(array_to_string(t,' ')) AS digest
    FROM (SELECT doc_id, regexp_extract_all(lower({TIDY_SQL.format("text")}), '{WORDS_SQL}') AS t FROM documents)
    """,
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(
    "slug",
    """
    SELECT slug, count(*) AS n FROM (SELECT CASE WHEN s='' THEN 'doc' ELSE s END AS slug FROM (
      SELECT regexp_replace(regexp_replace(strip_accents(text),'[^A-Za-z0-9._-]+','-','g'),'^-+|-+$','','g') AS s FROM documents)) GROUP BY slug
    """,
)
def _(spark, d):
    return table(spark, d, "documents").groupBy(T.slug(F.col("text")).alias("slug")).agg(F.count("*").alias("n"))


@query(
    "keyword_search",
    """
    SELECT p_partkey, p_name, CAST((CASE WHEN contains(t,'red') THEN 1 ELSE 0 END)+(CASE WHEN contains(t,'economy') THEN 1 ELSE 0 END) AS INT) AS score
    FROM (SELECT *, lower(strip_accents(p_name)) AS t, lower(strip_accents(concat_ws(' ',p_name,p_type,p_brand))) AS h FROM part)
    WHERE contains(h,'red') AND contains(h,'economy')
    """,
)
def _(spark, d):
    return keyword_search(table(spark, d, "part"), "Réd ECONOMY", "p_name", ["p_type", "p_brand"], "p_partkey").select("p_partkey", "p_name", "score")


def keyword_search(df, words: str, title: str, rest: list[str], order: str):
    """Rows holding every word of the query, those with more of them in the title first."""
    wanted = T.fold_query(words)
    if not wanted:
        return df.withColumn("score", F.lit(0)).orderBy(order)
    hay = F.concat_ws(" ", title, *rest)
    for w in wanted:
        df = df.filter(T.has_word(hay, w))
    score = sum((T.has_word(F.col(title), w).cast("int") for w in wanted), F.lit(0))
    return df.withColumn("score", score).orderBy(F.desc("score"), order)


@query(
    "letter_count",
    r"SELECT doc_id, CAST(length(regexp_replace(text,'\s','','g')) AS INT) AS letters, trim(text)<>'' AS has_text FROM documents",
)
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.letter_count(t).alias("letters"), T.has_text(t).alias("has_text"))


def _tail_sql(s: str) -> str:
    tail = f"regexp_extract({s},'(?i){T.STYLE_TAIL}',1)"
    rest = f"left({s},length({s})-length({tail}))"
    return (
        f"CASE WHEN {tail}='' OR length({rest})<3 OR (lower({tail})='roman' AND regexp_matches({rest},'(?i)times\\s*new\\s*$')) THEN {s} "
        f"ELSE regexp_replace({rest},'[\\s,]+$','') END"
    )


_steps = "SELECT font_id, name, trim(replace(split_part(split_part(regexp_replace(name,'^[A-Z]{6}\\+',''),',',1),'-',1),'_',' ')) AS s FROM fx_fonts"
for _ in range(4):
    _steps = f"SELECT font_id, name, {_tail_sql('s')} AS s FROM ({_steps})"
_aliases = " ".join(f"WHEN regexp_matches(k,'{p}') THEN '{f}'" for p, f in T.FAMILY_ALIASES)
FAMILY_SQL = rf"""
SELECT font_id, name, CASE {_aliases} WHEN regexp_matches(s,'\s') THEN regexp_replace(s,'\s+',' ','g') WHEN words='' THEN 'Arial' ELSE words END AS family FROM (
 SELECT *, regexp_replace(lower(s),'[^a-z0-9]','','g') AS k,
  trim(regexp_replace(regexp_replace(regexp_replace(s,'([a-z])([A-Z])','\1 \2','g'),'([A-Z]+)([A-Z][a-z])','\1 \2','g'),'([a-zA-Z])(\d)','\1 \2','g')) AS words FROM ({_steps}))
"""
_weights = " ".join(f"WHEN regexp_matches(r,'{p}') THEN {w}" for p, w in T.WEIGHTS)
WEIGHT_SQL = rf"SELECT *, CASE {_weights} ELSE 400 END AS weight FROM (SELECT *, regexp_replace(lower(name),'[\s_-]','','g') AS r FROM ({FAMILY_SQL}))"


@query("family_from_name", FAMILY_SQL, "fx_fonts")
def _(spark, d):
    return derived.fonts(spark, d).withColumn("family", T.family_from_name(F.col("name")))


@query(
    "weight_from_name",
    f"""
    SELECT font_id, weight, CASE
     WHEN family='Calibri' AND weight<=350 THEN 'Calibri Light'
     WHEN family='Segoe UI' AND contains(r,'semilight') THEN 'Segoe UI Semilight' WHEN family='Segoe UI' AND weight<=300 THEN 'Segoe UI Light'
     WHEN family='Segoe UI' AND weight>=850 THEN 'Segoe UI Black' WHEN family='Segoe UI' AND weight BETWEEN 550 AND 649 THEN 'Segoe UI Semibold'
     WHEN family='Arial' AND contains(r,'narrow') THEN 'Arial Narrow' WHEN family='Arial' AND (contains(r,'black') OR weight>=850) THEN 'Arial Black'
     WHEN family='Aptos' AND contains(r,'display') THEN 'Aptos Display' WHEN family='Aptos' AND contains(r,'narrow') THEN 'Aptos Narrow'
     WHEN family='Aptos' AND weight<=350 THEN 'Aptos Light' WHEN family='Aptos' AND weight BETWEEN 550 AND 649 THEN 'Aptos SemiBold'
     WHEN family='Aptos' AND weight BETWEEN 750 AND 849 THEN 'Aptos ExtraBold' WHEN family='Aptos' AND weight>=850 THEN 'Aptos Black'
     WHEN family='Franklin Gothic' AND contains(r,'medium') THEN 'Franklin Gothic Medium' ELSE family END AS shown
    FROM ({WEIGHT_SQL})
    """,
    "fx_fonts",
)
def _(spark, d):
    f = derived.fonts(spark, d).withColumn("family", T.family_from_name(F.col("name"))).withColumn("weight", T.weight_from_name(F.col("name")))
    return f.select("font_id", "weight", T.weight_family(F.col("family"), F.col("weight"), F.col("name"))["family"].alias("shown"))


@query(
    "font_class",
    f"""
    SELECT font_id, CASE WHEN regexp_matches(n,'{T.MONO}') THEN 'mono' WHEN regexp_matches(n,'{T.SANS}') THEN 'sans' WHEN regexp_matches(n,'{T.SERIF}') THEN 'serif' ELSE 'sans' END AS kind,
     regexp_matches(n,'bold|black|heavy|demi|[ -]?[789]00') AS bold, regexp_matches(n,'italic|oblique') AS italic
    FROM (SELECT font_id, lower(name) AS n FROM fx_fonts)
    """,
    "fx_fonts",
)
def _(spark, d):
    return derived.fonts(spark, d).select("font_id", T.font_class(F.col("name")).alias("c")).select("font_id", "c.*")


_same = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.SAME_FAMILY.items())
_kept = " ".join(f"WHEN contains(st,'{w}') THEN '{w}'" for w in T.KEPT_WEIGHTS)
KEY_SQL = rf"""
SELECT font_id, name, CASE k {_same} ELSE k END AS key FROM (SELECT *, concat(CASE WHEN tail='' OR (tail LIKE 'bold%' AND regexp_matches(stem,'(semi|demi|extra|ultra)$')) THEN base ELSE stem END, CASE {_kept} ELSE '' END) AS k FROM (
 SELECT *, left(base,length(base)-length(tail)) AS stem FROM (SELECT *, regexp_extract(base,'^.{{3,}}?(bolditalic|boldoblique|bold|italic|oblique|regular)$',1) AS tail FROM (
  SELECT font_id, name, regexp_replace(regexp_replace(lower(regexp_replace(CASE WHEN position(',' IN p)+position('-' IN p)>0 THEN regexp_extract(p,'^[^,-]*[,-](.*)$',1) ELSE '' END,'[-_\s]','','g')),'italic|oblique','','g'),' ','') AS st,
   regexp_replace(lower(regexp_replace(regexp_extract(p,'^([^,-]*)',1),'\s+','','g')),'^(.{{3,}}?)(psmt|ps|mt|std|lt|pro)$','\1') AS base
  FROM (SELECT font_id, name, regexp_replace(name,'^[A-Z]{{6}}\+','') AS p FROM fx_fonts)))))
"""


@query("family_key", KEY_SQL, "fx_fonts")
def _(spark, d):
    return derived.fonts(spark, d).withColumn("key", T.family_key(F.col("name")))


@query(
    "same_family",
    rf"""
    WITH k AS ({KEY_SQL}), p AS (SELECT *, regexp_replace(key,'^(.{{3,}}?)(semibold|demibold|extrabold|medium|black)$','\1') AS plain FROM k)
    SELECT a.font_id, (a.key LIKE 'type3%' OR b.key LIKE 'type3%' OR a.key=b.key OR a.plain=b.plain) AS agrees FROM p a JOIN p b ON b.font_id=a.font_id+16
    """,
    "fx_fonts",
)
def _(spark, d):
    f = derived.fonts(spark, d)
    other = f.select((F.col("font_id") - 16).alias("font_id"), F.col("name").alias("other"))
    return f.join(other, "font_id").select("font_id", T.same_family(F.col("name"), F.col("other")).alias("agrees"))


_cnt = lambda s: f"(length(c)-length(replace(c,'{s}','')))//{len(s)}"
ROMAN_SQL = (
    f"({_cnt('i')}+5*{_cnt('v')}+10*{_cnt('x')}+50*{_cnt('l')}+100*{_cnt('c')}+500*{_cnt('d')}+1000*{_cnt('m')}"
    f"-2*({_cnt('iv')}+{_cnt('ix')})-20*({_cnt('xl')}+{_cnt('xc')})-200*({_cnt('cd')}+{_cnt('cm')}))"
)


@query(
    "parse_marker",
    rf"""
    WITH m AS (SELECT marker, count(*) AS n FROM fx_markers GROUP BY marker),
    g AS (SELECT *, regexp_extract(marker,'^([(\[]?)([0-9]{{1,4}}|[A-Za-z]{{1,7}})([.)\]:]?)$',2) AS core, regexp_extract(marker,'^([(\[]?)([0-9]{{1,4}}|[A-Za-z]{{1,7}})([.)\]:]?)$',1) AS prefix,
      regexp_extract(marker,'^([(\[]?)([0-9]{{1,4}}|[A-Za-z]{{1,7}})([.)\]:]?)$',3) AS suffix FROM m),
    r AS (SELECT *, lower(core) AS c FROM g),
    v AS (SELECT *, CASE WHEN core<>'' AND (core=lower(core) OR core=upper(core)) AND regexp_matches(c,'{T.ROMAN}') THEN {ROMAN_SQL} END AS rv,
      CASE WHEN length(core)=1 AND NOT regexp_matches(core,'[0-9]') THEN ascii(c)-96 END AS lv, core=lower(core) AS low FROM r)
    SELECT marker, n, CASE WHEN core<>'' THEN 'number' ELSE 'bullet' END AS kind, CASE WHEN core='' THEN '' ELSE prefix END AS prefix, CASE WHEN core='' THEN '' ELSE suffix END AS suffix,
     CASE WHEN core='' THEN CASE WHEN marker=chr(61623) THEN '•' ELSE marker END
      WHEN regexp_matches(core,'^[0-9]+$') THEN concat(CASE WHEN length(core)=2 AND core LIKE '0%' THEN 'decimalZero' ELSE 'decimal' END,':',CAST(core AS INT))
      ELSE concat_ws('|', CASE WHEN rv IS NOT NULL AND rv<coalesce(lv,999999) THEN concat(CASE WHEN low THEN 'lowerRoman' ELSE 'upperRoman' END,':',rv) END,
        CASE WHEN lv IS NOT NULL THEN concat(CASE WHEN low THEN 'lowerLetter' ELSE 'upperLetter' END,':',lv) END,
        CASE WHEN rv IS NOT NULL AND rv>=coalesce(lv,999999) THEN concat(CASE WHEN low THEN 'lowerRoman' ELSE 'upperRoman' END,':',rv) END) END AS readings
    FROM v WHERE marker<>'' AND CASE WHEN core='' THEN NOT regexp_matches(marker,'[\p{{L}}\p{{N}}]') AND length(marker)<=2 WHEN regexp_matches(core,'^[0-9]+$') THEN true ELSE (prefix<>'' OR suffix<>'') AND (lv IS NOT NULL OR rv IS NOT NULL) END
    """,
    "fx_markers",
)
def _(spark, d):
    m = derived.markers(spark, d).groupBy("marker").agg(F.count("*").alias("n")).withColumn("p", T.parse_marker(F.col("marker")))
    spelled = F.array_join(F.transform("p.candidates", lambda c: F.concat(c["format"], F.lit(":"), c["value"].cast("string"))), "|")
    return m.filter("p IS NOT NULL").select(
        "marker", "n", "p.kind", "p.prefix", "p.suffix", F.when(F.col("p.kind") == "number", spelled).otherwise(F.col("p.text")).alias("readings")
    )


@query(
    "marker_family",
    r"""
    SELECT family, count(*) AS n FROM (SELECT CASE WHEN NOT regexp_matches(marker,'[\p{L}\p{N}]') THEN 'b:'||marker ELSE concat('n:',
      CASE WHEN regexp_matches(c,'^\d') THEN 'd' WHEN regexp_matches(c,'^[ivxlcdm]+$') THEN 'r' WHEN regexp_matches(c,'^[IVXLCDM]+$') THEN 'R' WHEN regexp_matches(c,'^[a-z]$') THEN 'a' ELSE 'A' END,
      CASE WHEN marker LIKE '(%)' THEN '()' WHEN marker LIKE '%)' THEN ')' ELSE '.' END) END AS family
     FROM (SELECT marker, regexp_replace(marker,'[().]','','g') AS c FROM fx_markers)) GROUP BY family
    """,
    "fx_markers",
)
def _(spark, d):
    return derived.markers(spark, d).groupBy(T.marker_family(F.col("marker")).alias("family")).agg(F.count("*").alias("n"))


@query(
    "is_page_number",
    r"""
    SELECT l_orderkey, l_linenumber, s, regexp_matches(s,'(?i)^[-–—\s]*((p(á|a)g(ina)?|page|p\.|hoja|seite)\.?\s*)?\d{1,4}(\s*(de|of|/|von)\s*\d{1,4})?[-–—\s]*$') AS is_number FROM (
     SELECT l_orderkey, l_linenumber, CASE l_partkey%6 WHEN 0 THEN concat('- ',l_suppkey,' -') WHEN 1 THEN concat('Página ',l_linenumber) WHEN 2 THEN concat('PAGE ',l_linenumber,' of ',l_partkey)
      WHEN 3 THEN concat(l_linenumber,' / ',l_partkey) WHEN 4 THEN concat('Line ',l_linenumber) ELSE CAST(l_partkey*7 AS VARCHAR) END AS s FROM lineitem)
    """,
)
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    n, p, k = (F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey"))
    form = F.col("l_partkey") % 6
    s = (
        F.when(form == 0, F.concat(F.lit("- "), k, F.lit(" -")))
        .when(form == 1, F.concat(F.lit("Página "), n))
        .when(form == 2, F.concat(F.lit("PAGE "), n, F.lit(" of "), p))
        .when(form == 3, F.concat(n, F.lit(" / "), p))
        .when(form == 4, F.concat(F.lit("Line "), n))
        .otherwise((F.col("l_partkey") * 7).cast("string"))
    )
    return li.select("l_orderkey", "l_linenumber", s.alias("s")).withColumn("is_number", T.is_page_number(F.col("s")))


CUE_SQL = r"""(regexp_matches({b},'^\s*\p{{Ll}}') AND (regexp_matches({a},'\p{{L}}[-\x{{AD}}\x{{2010}}]\s*$') OR NOT regexp_matches({a},'[.!?:;…][\"»”'')\]]?\s*$')))"""


@query(
    "wrap_cue",
    f"""
    WITH l AS (SELECT *, lead(text) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS below FROM fx_lines)
    SELECT doc_id, page_no, count(*) AS pairs, CAST(sum(CASE WHEN {CUE_SQL.format(a="text", b="below")} THEN 1 ELSE 0 END) AS BIGINT) AS run_on FROM l WHERE below IS NOT NULL GROUP BY doc_id, page_no
    """,
    "fx_lines",
)
def _(spark, d):
    from pyspark.sql import Window

    below = F.lead("text").over(Window.partitionBy("doc_id", "page_no").orderBy("line_no"))
    pairs = derived.word_lines(spark, d).select("doc_id", "page_no", "text", below.alias("below")).filter("below IS NOT NULL")
    cue = T.wrap_cue(F.col("text"), F.col("below"))
    return pairs.groupBy("doc_id", "page_no").agg(F.count("*").alias("pairs"), F.count_if(cue).alias("run_on"))


@query(
    "is_label_value",
    r"""
    SELECT o_orderkey, s, regexp_matches(s,'^([^:\t]{1,40}):\s*(\S.*)$') AND (length(regexp_replace(v,'[^0-9]','','g'))>=0.25*length(v) OR regexp_matches(v,'(?i)@|https?:|www\.')) AS label_value
    FROM (SELECT *, regexp_replace(regexp_extract(s,'^([^:\t]{1,40}):\s*(\S.*)$',2),'\s','','g') AS v FROM (
     SELECT o_orderkey, CASE o_orderkey%4 WHEN 0 THEN concat('Total: ',o_totalprice) WHEN 1 THEN concat('Status: ',o_orderstatus,' ',o_orderpriority) WHEN 2 THEN concat('Mail: c',o_custkey,' clerk@example.com') ELSE concat('Order ',o_orderkey,' of ',o_custkey) END AS s FROM orders))
    """,
)
def _(spark, d):
    o = table(spark, d, "orders")
    key, cust, price = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_totalprice").cast("string")
    s = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("Total: "), price))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("Status: "), "o_orderstatus", F.lit(" "), "o_orderpriority"))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("Mail: c"), cust, F.lit(" clerk@example.com")))
        .otherwise(F.concat(F.lit("Order "), key, F.lit(" of "), cust))
    )
    return o.select("o_orderkey", s.alias("s")).withColumn("label_value", T.is_label_value(F.col("s")))


@query(
    "clean_link",
    r"""
    SELECT page_id, CASE WHEN regexp_matches(t,'(?i)^(https?:|mailto:|tel:|ftp:|www\.)') THEN CASE WHEN regexp_matches(t,'(?i)^www\.') THEN 'http://'||t ELSE t END END AS link
    FROM (SELECT page_id, trim(CASE page_id%4 WHEN 0 THEN url WHEN 1 THEN replace(url,'http://','WWW.') WHEN 2 THEN concat('  mailto:p',page_id,'@example.com ') ELSE concat('javascript:',page_id) END) AS t FROM pages)
    """,
)
def _(spark, d):
    p, i = table(spark, d, "pages").select("page_id", "url"), F.col("page_id")
    raw = (
        F.when(i % 4 == 0, F.col("url"))
        .when(i % 4 == 1, F.replace("url", F.lit("http://"), F.lit("WWW.")))
        .when(i % 4 == 2, F.concat(F.lit("  mailto:p"), i.cast("string"), F.lit("@example.com ")))
        .otherwise(F.concat(F.lit("javascript:"), i.cast("string")))
    )
    return p.select("page_id", T.clean_link(raw).alias("link"))


ERRORS = ["Error: PubSec handler", "PasswordException: no password", "Failed to parse xref", "RangeError: too large", "TypeError: Failed to fetch", "odd"]


@query(
    "classify_error",
    f"""
    SELECT cause, event_type, count(*) AS n FROM (SELECT event_type, CASE {" ".join(f"WHEN regexp_matches(s,'(?i){p}') THEN '{n}'" for n, p in T.ERROR_CLASSES)} ELSE 'other' END AS cause
     FROM (SELECT event_type, concat(({derived._sql_list(ERRORS)})[CAST(event_id%6+1 AS INT)],' in ',event_type,' ',props) AS s FROM events)) GROUP BY cause, event_type
    """,
)
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "props")
    s = F.concat(derived._pick(ERRORS, F.col("event_id") % 6), F.lit(" in "), "event_type", F.lit(" "), "props")
    return e.groupBy(T.classify_error(s).alias("cause"), "event_type").agg(F.count("*").alias("n"))


@query(
    "minimal_diff",
    """
    WITH p AS (SELECT doc_id, text AS a, replace(replace(text,'the ','that '),'. E','! E') AS b FROM documents),
    q AS (SELECT *, coalesce(list_min(list_filter(range(0, least(length(a),length(b))), lambda i: a[i+1]<>b[i+1])), least(length(a),length(b))) AS p0 FROM p),
    s AS (SELECT *, coalesce(list_min(list_filter(range(0, least(length(a),length(b))-p0), lambda i: a[length(a)-i]<>b[length(b)-i])), least(length(a),length(b))-p0) AS s0 FROM q)
    SELECT doc_id, CAST(p0 AS INT) AS kept_before, CAST(s0 AS INT) AS kept_after, md5(substr(a,p0+1,length(a)-p0-s0)) AS removed, md5(substr(b,p0+1,length(b)-p0-s0)) AS inserted FROM s
    """,
)
def _(spark, d):
    new = F.replace(F.replace("text", F.lit("the "), F.lit("that ")), F.lit(". E"), F.lit("! E"))
    m = table(spark, d, "documents").select("doc_id", T.minimal_diff(F.col("text"), new).alias("m"))
    return m.select(
        "doc_id",
        F.length("m.prefix").alias("kept_before"),
        F.length("m.suffix").alias("kept_after"),
        F.md5("m.removed").alias("removed"),
        F.md5("m.inserted").alias("inserted"),
    )
