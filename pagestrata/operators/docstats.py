"""Facts about whole documents. Every one is a two-step aggregate: votes per distinct value (combined map-side), then the
winner, so a document of any length reaches a single task only as its few distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.functions.text import letter_count, wrap_cue
from pagestrata.operators.common import half_up, islands


def body_font_size(runs: DataFrame, key: str = "doc_id", default: float = 11.0) -> DataFrame:
    """Size (half points) that sets most characters; visible text decides when there is any. Smaller wins ties."""
    hidden = F.col("invisible") if "invisible" in runs.columns else F.lit(False)
    lifted = F.col("lifted") if "lifted" in runs.columns else F.lit(False)
    flat = F.col("rotation").isNull() if "rotation" in runs.columns else F.lit(True)
    votes = runs.filter(flat & ~lifted).groupBy(key, half_up(F.col("size"), 2).alias("half"), hidden.alias("hidden")).agg(F.sum(letter_count(F.col("text"))).alias("n"))
    best = votes.groupBy(key).agg(F.max_by("half", F.struct(~F.col("hidden"), F.col("n"), -F.col("half"))).alias("body"))
    return best.withColumn("body", F.coalesce("body", F.lit(default)))


def leading_ratio(lines: DataFrame, body: DataFrame, key: str = "doc_id", default: float = 1.2) -> DataFrame:
    """Commonest baseline distance over body size where one line certainly runs on into the next."""
    sized = lines.join(body, key).filter(F.abs(F.col("size") - F.col("body")) <= 0.6)
    w = Window.partitionBy(key, "page_no").orderBy("baseline", "line_no")
    pairs = sized.select(
        key, "page_no", "line_no", "body", "baseline", "x", "text",
        F.lag("baseline").over(w).alias("up"), F.lag("x").over(w).alias("up_x"), F.lag("text").over(w).alias("up_text"),
    )
    ratio = half_up((F.col("baseline") - F.col("up")) / F.col("body"), 50)
    seen = pairs.filter(F.abs(F.col("x") - F.col("up_x")) <= 2).filter(wrap_cue(F.col("up_text"), F.col("text")))
    votes = seen.select(key, "page_no", "line_no", ratio.alias("ratio")).filter("ratio BETWEEN 0.95 AND 2.4")
    counted = votes.groupBy(key, "ratio").agg(F.count("*").alias("n"), F.min(F.struct("page_no", "line_no")).alias("first"))
    best = counted.groupBy(key).agg(F.min_by("ratio", F.struct(-F.col("n"), F.col("first"))).alias("leading"))
    return body.select(key).join(best, key, "left").withColumn("leading", F.coalesce("leading", F.lit(default)))


def document_defaults(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Family, size and colour that set most characters; the first seen wins ties."""
    inked = runs.select(key, F.struct("page_no", "line_no", "word_no").alias("at"), letter_count(F.col("text")).alias("n"), "lifted", "family", "size", "color")
    usable = inked.filter("n > 0 AND NOT lifted")
    facets = F.explode(
        F.array(
            F.struct(F.lit("family").alias("what"), F.trim("family").alias("value")),
            F.struct(F.lit("size").alias("what"), half_up(F.col("size"), 2).cast("string").alias("value")),
            F.struct(F.lit("color").alias("what"), F.col("color").alias("value")),
        )
    )
    votes = usable.select(key, "at", "n", facets.alias("f")).groupBy(key, "f.what", "f.value").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    best = votes.groupBy(key, "what").agg(F.min_by("value", F.struct(-F.col("n"), F.col("at"))).alias("value"))
    pick = {w: F.max(F.when(F.col("what") == w, F.col("value"))) for w in ("family", "size", "color")}
    return best.groupBy(key).agg(pick["family"].alias("family"), pick["size"].cast("double").alias("size"), pick["color"].alias("color"))


def font_usage(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Characters per family and variant and the commonest substitute, for families that name one."""
    n = letter_count(F.col("text"))
    per = runs.groupBy(key, F.lower("family").alias("family"), "bold", "italic", "fallback").agg(F.sum(n).alias("n")).filter("n > 0")
    votes = per.groupBy(key, "family", "fallback").agg(
        F.sum("n").alias("chars"),
        F.sum(F.when(~F.col("bold") & ~F.col("italic"), F.col("n")).otherwise(0)).alias("regular"),
        F.sum(F.when(F.col("bold") & ~F.col("italic"), F.col("n")).otherwise(0)).alias("bold"),
        F.sum(F.when(~F.col("bold") & F.col("italic"), F.col("n")).otherwise(0)).alias("italic"),
        F.sum(F.when(F.col("bold") & F.col("italic"), F.col("n")).otherwise(0)).alias("bold_italic"),
    )
    sums = {c: F.sum(c).alias(c) for c in ("chars", "regular", "bold", "italic", "bold_italic")}
    named = F.struct(F.col("fallback").isNotNull(), F.col("chars"), F.col("fallback"))
    return votes.groupBy(key, "family").agg(*sums.values(), F.max_by("fallback", named).alias("substitute")).filter("substitute IS NOT NULL")


def is_tagged(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Whether the structure tags of a document can be trusted (share of tagged text, sentences kept in one element,
    no page lumped into one or two elements). ``tag_id`` null is untagged; ``block`` says the tag is block-level."""
    w = Window.partitionBy(key, "page_no").orderBy("baseline", "x")
    chars = letter_count(F.col("text"))
    prev = {c: F.lag(c).over(w) for c in ("baseline", "x", "size", "text", "tag_id", "block")}
    size = F.greatest("size", prev["size"])
    near = (F.abs(F.col("x") - prev["x"]) <= 2) & (F.col("baseline") - prev["baseline"] <= 1.8 * size) & (F.abs(F.col("size") - prev["size"]) <= 0.1 * size)
    run_on = F.coalesce(near & wrap_cue(prev["text"], F.col("text")), F.lit(False))
    split = run_on & F.coalesce(prev["block"] & F.col("block") & (prev["tag_id"] != F.col("tag_id")), F.lit(False))
    flags = lines.select(key, "page_no", "tag_id", "block", "artifact", chars.alias("n"), run_on.alias("run_on"), split.alias("split"))
    told = F.col("tag_id").isNotNull() | F.col("artifact")
    blockline = F.coalesce(F.col("tag_id").isNotNull() & F.col("block"), F.lit(False))
    pages = flags.groupBy(key, "page_no").agg(
        F.sum("n").alias("chars"),
        F.sum(F.when(told, F.col("n")).otherwise(0)).alias("tagged"),
        F.count_if("run_on").alias("run_ons"),
        F.count_if("split").alias("splits"),
        (F.count_if(blockline).__ge__(12) & (F.count_distinct(F.when(blockline, F.col("tag_id"))) <= 2)).alias("lumped"),
    )
    d = pages.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("chars", "tagged", "run_ons", "splits")], F.max("lumped").alias("lumped"))
    ok = (F.col("chars") > 0) & (F.col("tagged") >= 0.6 * F.col("chars")) & ~((F.col("run_ons") >= 3) & (F.col("splits") >= 0.5 * F.col("run_ons"))) & ~F.col("lumped")
    return d.withColumn("is_tagged", ok)


def line_styles(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The style that sets at least 85 % of a line, with the line's characters."""
    n = letter_count(F.col("text"))
    style = [half_up(F.col("size"), 2).alias("size"), "bold", "italic", "family", "color"]
    votes = runs.filter("NOT lifted").groupBy(*keys, *style).agg(F.sum(n).alias("n"), F.min("word_no").alias("first"))
    s = F.struct("size", "bold", "italic", "family", "color")
    best = votes.groupBy(*keys).agg(F.min_by(F.struct(s.alias("s"), "n"), F.struct(-F.col("n"), F.col("first"))).alias("b"), F.sum("n").alias("chars"))
    return best.filter(F.col("b.n") >= 0.85 * F.col("chars")).select(*keys, "b.s.*", "chars")


def heading_styles(lines: DataFrame, styles: DataFrame, body: DataFrame, key: str = "doc_id") -> DataFrame:
    """Styles of short lines that stand out from body text and never set running text, ranked to levels 1..3.
    ``lines`` are single-column lines (x-overlapping neighbours are the lines above), ``styles`` from line_styles."""
    page = [key, "page_no"]
    w = Window.partitionBy(*page).orderBy("baseline", "line_no")
    up = {c: F.lag(c).over(w) for c in ("baseline", "size", "text")}
    goes_on = (F.col("baseline") - up["baseline"] < 2.2 * F.greatest(F.col("size"), up["size"])) & wrap_cue(up["text"], F.col("text"))
    cont = lines.select(*page, "line_no", F.coalesce(goes_on, F.lit(False)).alias("cont"))
    total = lines.groupBy(key).agg(F.count("*").alias("line_count"))
    tagged = styles.join(cont, [*page, "line_no"])
    acc = tagged.groupBy(key, "size", "bold", "italic", "family", "color").agg(
        F.count_if(F.col("cont") | (F.col("chars") > 90)).alias("long"),
        F.count_if(~(F.col("cont") | (F.col("chars") > 90))).alias("short"),
        F.sum("chars").alias("chars"),
        F.min(F.struct("page_no", "line_no")).alias("first"),
    )
    facts = acc.join(body, key).join(total, key)
    face = facts.filter((F.abs(F.col("size") - F.col("body")) <= 0.6) & ~F.col("bold")).groupBy(key, "family", "color").agg(F.sum("chars").alias("n"), F.min("first").alias("f"))
    body_face = face.groupBy(key).agg(F.min_by(F.struct("family", "color"), F.struct(-F.col("n"), F.col("f"))).alias("b"))
    c = facts.join(body_face.select(key, F.col("b.family").alias("body_family"), F.col("b.color").alias("body_color")), key, "left")
    return _rank_levels(_stand_out(c), key)


def _stand_out(c: DataFrame) -> DataFrame:
    from pagestrata.functions.geometry import chroma

    ratio = F.col("size") / F.col("body")
    body_color, body_family = F.coalesce("body_color", F.lit("")), F.coalesce("body_family", F.lit(""))
    accent = (chroma(F.col("color")) >= 40) & (F.col("color") != body_color)
    other = F.col("family") != body_family
    chosen = (
        F.when(ratio >= 1.3, True)
        .when(F.col("italic") & ~F.col("bold"), False)
        .when(ratio >= 1.12, F.col("bold") | accent)
        .when((ratio >= 1.08) & F.col("bold"), True)
        .when(ratio >= 0.95, (F.col("bold") & (other | accent)) | (other & accent))
        .otherwise(False)
    )
    few = F.col("short") <= F.greatest(F.lit(4.0), F.lit(0.2) * F.col("line_count"))
    return c.filter((F.col("short") > 0) & (F.col("long") == 0) & few & chosen)


def _rank_levels(c: DataFrame, key: str) -> DataFrame:
    order = [F.desc("size"), F.desc("bold"), F.asc("first")]
    w = Window.partitionBy(key).orderBy(*order)
    step = (F.abs(F.lag("size").over(w) - F.col("size")) > 0.6) | (F.lag("bold").over(w) != F.col("bold"))
    ranked = islands(c, [key], order, step, "level").withColumn("level", F.col("level") + 1)
    return ranked.filter("level <= 3").select(key, "size", "bold", "italic", "family", "color", "level", "short")


def convert_stats(blocks: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Totals of a conversion: pages, kinds of blocks, OCR pages, positioned pages, warnings."""
    b = blocks.groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("paragraph", "table", "image")])
    p = pages.groupBy(key).agg(
        F.count("*").alias("pages"), F.count_if("ocr").alias("ocr_pages"), F.count_if(F.col("mode") == "layout").alias("layout_pages"), F.sum("warnings").alias("warnings")
    )
    return p.join(b, key, "left").na.fill(0)


def structure_summary(paras: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of a document's paragraphs by place and role, and the share of its text that flows."""
    blank = F.trim("text") == ""
    n = F.when(blank, 0).otherwise(F.length(F.trim("text")))
    place = F.when(F.col("frame"), "frame").otherwise(F.col("place"))
    flow = F.sum(F.when(place.isin("body", "table"), n).otherwise(0))

    def count(cond: Column) -> Column:
        return F.count_if(cond & ~blank)

    return paras.groupBy(key).agg(
        count(F.lit(True)).alias("paragraphs"),
        count(F.col("place") == "body").alias("body"),
        count(F.col("place") == "table").alias("in_table"),
        count(F.col("place") == "textbox").alias("in_textbox"),
        F.count_if(blank).alias("empty"),
        count(F.col("heading") > 0).alias("headings"),
        count(F.col("list_kind").isNotNull()).alias("list_items"),
        F.sum("links").alias("links"),
        F.max("columns").alias("max_columns"),
        F.count_if("landscape").alias("landscape"),
        F.when(F.sum(n) > 0, half_up(flow / F.sum(n), 10000)).alias("flow_ratio"),
    )
