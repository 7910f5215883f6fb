"""Cleaning the word tables a text recogniser returns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.functions.text import letter_count
from pagestrata.operators.common import grouped_rows, half_up, islands, middle_median, schema_of, starts, whole_groups

LINE = ["doc_id", "page_no", "line"]
PAGE = ["doc_id", "page_no"]

# Letters by the height and depth of their ink.
DESCENDS = r"[gjpqyQJçµ()\[\]{}|@$§¿¡]"
DIPS = "[,;]"
TALL = "[A-Z0-9bdfhklßáéíóúàèìòùâêîôûäëïöüñij]"
ASCENDS = "[bdfhklßáéíóúàèìòùâêîôûäëïöüñij]"
ACCENTED_CAPITAL = "[ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜÑÇ]"
ONLY_X = r"^[acemnorsuvwxz]+[.,:;!?]?$"
ALNUM = r"[\p{L}\p{N}]"
# Heights in em, before a face is known and per face.
ANY_FACE = {"cap": 0.69, "asc": 0.705, "x": 0.49}
FACE_HEIGHTS = {
    "Times New Roman": {"cap": 0.662, "asc": 0.693, "x": 0.448},
    "Arial": {"cap": 0.716, "asc": 0.716, "x": 0.519},
    "Courier New": {"cap": 0.571, "asc": 0.613, "x": 0.423},
}
# Sizes documents are usually set in.
USUAL_SIZES = [6, 7, 8, 9, 10, 10.5, 11, 12, 14, 16, 18, 20, 22, 24, 26, 28, 32, 36, 40, 48, 54, 60, 72]


def scanned_pages(pages: DataFrame, words: DataFrame) -> DataFrame:
    """Which pages are scans. ``pages``: doc_id, page_no, drawn (images, undecodable images, art or unmapped glyphs),
    bytes."""
    return _with_chars(pages, words).select(
        *PAGE, "chars",
        ((F.col("chars") == 0) & F.col("drawn")).alias("scanned"),
        (F.col("chars") < 100).alias("needs_ocr"),
        (F.col("chars") >= 20).alias("has_text"),
        ((F.col("chars") < 100) & (F.col("bytes") > 100 * 1024)).alias("heavy"),
    )


def _with_chars(pages: DataFrame, words: DataFrame) -> DataFrame:
    n = words.groupBy(*PAGE).agg(F.sum(letter_count(F.col("text"))).alias("chars"))
    return pages.join(n, PAGE, "left").withColumn("chars", F.coalesce("chars", F.lit(0)))


def scanned_documents(pages: DataFrame, words: DataFrame, first: int | None = None) -> DataFrame:
    """Which documents are heavy scans, and the level of compression to recommend. A document ``has_text`` from 20 characters
    on; it ``looks_scanned`` with fewer than 100 characters a page on average and more than 100 KB a page. Scans without text
    are recommended to become lighter images ("strong"), scans with text to keep it ("balanced"), all others "light". ``first``: count characters only on
    so many pages from the start of a document (null: on all); bytes always count on all.

    ``pages`` as for ``scanned_pages``; a document without words has no characters, null bytes count as none."""
    counted = _with_chars(pages, words)
    if first is not None:
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no"))
        counted = counted.withColumn("chars", F.when(place <= first, F.col("chars")))
    each = counted.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.count("chars").alias("_seen"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    scan = (F.col("chars") / F.col("_seen") < 100) & (F.col("bytes") / F.col("pages") > 100 * 1024)
    return each.select("doc_id", "pages", "chars", (F.col("chars") >= 20).alias("has_text"), scan.alias("looks_scanned"), F.when(~scan, "light").when(F.col("chars") >= 20, "balanced").otherwise("strong").alias("level"))


def ocr_filter(words: DataFrame) -> DataFrame:
    """Drop specks: unsure marks, boxes far smaller than the line, unsure short words standing apart."""
    n, conf = F.length("text"), F.col("confidence")
    first = words.filter(~((conf < 25) & (n <= 2) & ~F.col("text").rlike(ALNUM)))
    w = Window.partitionBy(*LINE)
    o = w.orderBy("x0", "word_no")
    height = F.col("bottom") - F.col("top")
    sure = F.when((conf >= 60) & (n >= 2), height)
    line_h = F.coalesce(F.percentile(sure, F.lit(0.5)).over(w), F.max(height).over(w))
    near = F.least(
        F.coalesce(F.abs(F.lead("x0").over(o) - F.col("x1")), F.lit(1e9)),
        F.coalesce(F.abs(F.col("x0") - F.lag("x1").over(o)), F.lit(1e9)),
    )
    t = first.withColumn("_h", line_h).withColumn("_near", near)
    small = (height < 0.45 * F.col("_h")) & (conf < 70)
    dot = (height < 0.15 * F.col("_h")) & (F.col("x1") - F.col("x0") < 0.15 * F.col("_h"))
    lonely = (conf < 30) & (n <= 2) & (F.col("_near") >= 1.5 * F.col("_h"))
    return t.filter(~(small | dot | lonely)).drop("_h", "_near")


def _flat(text: Column) -> Column:
    return ~text.rlike(DESCENDS) & ~text.rlike(DIPS) & text.rlike(ALNUM)


def _mid(a: Column) -> Column:
    """Averaged median of a sorted array."""
    n = F.size(a)
    lo, hi = F.floor((n + 1) / 2).cast("int"), F.floor(n / 2).cast("int") + 1
    return F.when(n > 0, (F.try_element_at(a, lo) + F.try_element_at(a, hi)) / 2)


def page_slope(words: DataFrame) -> DataFrame:
    """Median over lines of the median slope between the bottoms of a line's level words. The slopes of a line are taken
    inside its own row; a line's few words never meet the words of others."""
    mid = (F.col("x0") + F.col("x1")) / 2
    flat = words.filter(_flat(F.col("text")))
    per = flat.groupBy(*LINE).agg(
        F.array_sort(F.collect_list(F.struct("x0", mid.alias("m"), "bottom", "x1"))).alias("ws")
    ).filter((F.size("ws") >= 3) & (F.element_at("ws", -1)["x1"] - F.element_at("ws", 1)["x0"] >= 100))
    pairs = F.flatten(F.transform("ws", lambda a: F.transform(F.filter("ws", lambda b: b["m"] - a["m"] > 20), lambda b: (b["bottom"] - a["bottom"]) / (b["m"] - a["m"]))))
    lines = per.select(*LINE, F.array_sort(pairs).alias("s")).filter(F.size("s") > 0).select(*PAGE, _mid(F.col("s")).alias("slope"))
    shown = lines.groupBy(*PAGE).agg(middle_median(F.col("slope")).alias("slope"), F.count("*").alias("n"))
    total = words.groupBy(*PAGE).agg(F.count_distinct("line").alias("lines"))
    told = (F.col("n") >= 2) | ((F.col("n") == 1) & (F.col("lines") == 1))
    return total.join(shown, PAGE, "left").select(*PAGE, F.when(told, F.col("slope")).otherwise(0.0).alias("slope"))


def deskew(words: DataFrame, slopes: DataFrame, width: float, height: float) -> DataFrame:
    """Shear slightly turned pages level about the page centre."""
    s = F.when((F.abs("slope") > 0.0008) & (F.abs("slope") < 0.08), F.col("slope")).otherwise(0.0)
    j = words.join(slopes.select(*PAGE, s.alias("_s")), PAGE)
    dx = ((F.col("top") + F.col("bottom")) / 2 - height / 2) * F.col("_s")
    dy = -((F.col("x0") + F.col("x1")) / 2 - width / 2) * F.col("_s")
    moved = j.withColumn("_dx", dx).withColumn("_dy", dy)
    return moved.withColumns(
        {c: F.col(c) + F.col("_dx") for c in ("x0", "x1")} | {c: F.col(c) + F.col("_dy") for c in ("top", "bottom")}
    ).drop("_s", "_dx", "_dy")


def ocr_baseline(words: DataFrame) -> DataFrame:
    """Where the level words of a line end; with fewer than three, the median estimate from every word."""
    t = F.col("text")
    level = F.when(_flat(t), F.col("bottom"))
    above = F.when(t.rlike(TALL), ANY_FACE["asc"]).otherwise(ANY_FACE["x"])
    depth = F.when(t.rlike(DESCENDS), 0.21).when(t.rlike(DIPS), 0.13).otherwise(0.0)
    guess = F.when(t.rlike(ALNUM), F.col("bottom") - (F.col("bottom") - F.col("top")) * depth / (above + depth))
    sides = words.select(*LINE, level.cast("double").alias("a"), guess.cast("double").alias("b"))
    g = sides.groupBy(*LINE).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    return g.select(*LINE, F.when(F.size("a") >= 3, _mid(F.sort_array("a"))).otherwise(_mid(F.sort_array("b"))).alias("baseline"))


def ocr_size(words: DataFrame, baselines: DataFrame, face: dict[str, float] = ANY_FACE, pixel: float = 0.24) -> DataFrame:
    """Size of a line from its tall words, else its x-height words, else the words' heights."""
    j = words.join(baselines, LINE)
    t, rise = F.col("text"), F.col("baseline") - F.col("top")
    ink = rise - 0.5 * pixel
    tall = F.when(t.rlike(TALL) & ~t.rlike(ACCENTED_CAPITAL) & (rise > pixel), ink / F.when(t.rlike(ASCENDS), face["asc"]).otherwise(face["cap"]))
    low = F.when(t.rlike(ONLY_X) & (rise > pixel), ink / F.lit(face["x"]))
    plain = middle_median(F.col("bottom") - F.col("top")) / F.lit(0.9)
    return j.groupBy(*LINE).agg(F.coalesce(middle_median(tall), middle_median(low), plain).alias("size"))


def _snap(sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.empty(len(sizes))
    start = 0
    usual = np.array(USUAL_SIZES)
    for end in range(1, len(sizes) + 1):
        grows = end < len(sizes) and sizes[end] <= 1.04 * sizes[end - 1] and sizes[end] <= 1.12 * sizes[start]
        if grows:
            continue
        share = np.cumsum(weights[start:end])
        value = sizes[start + int(np.searchsorted(share, share[-1] / 2))]
        near = usual[np.argmin(np.abs(usual - value))]
        out[start:end] = near if abs(near - value) <= 0.035 * value else max(4.0, np.floor(value * 2 + 0.5) / 2)
        start = end
    return out


def snap_sizes(lines: DataFrame) -> DataFrame:
    """Sizes of a page's lines drawn to its few sizes; an ordered fold over one page. ``lines``: size, chars."""

    def page(g: dict) -> list:
        order = sorted(zip(g["size"], g["line"], g["chars"]), key=lambda r: [(v is None, v) for v in r])
        size, chars = (np.array([r[i] for r in order], dtype=float) for i in (0, 2))
        key = tuple(g[k][0] for k in PAGE)
        return [(*key, line, own, v) for (own, line, _), v in zip(order, _snap(size, chars).tolist())]

    cols = lines.select(*LINE, "size", F.col("chars").cast("double").alias("chars"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cols.select(*LINE, "size").schema.fields)
    return grouped_rows(cols, PAGE, page, f"{schema}, snapped double")


MOST_WIDTHS = 20_000


def page_family(words: DataFrame, widths: DataFrame, laid: bool = False) -> DataFrame:
    """The face whose width proportions explain every line with one size. ``widths``: family, ch, em — a table of the
    feature, not of the corpus; its size is checked, and it becomes a constant of the plan. A word's characters are
    added up in all faces where it stands, once sorted; words without a width, or of none, tell nothing. ``laid``: a page's
    words already share a partition."""
    told = widths.select("family", "ch", "em").limit(MOST_WIDTHS + 1).collect()
    if len(told) > MOST_WIDTHS:
        raise ValueError(f"more than {MOST_WIDTHS} character widths")
    known = list(FACE_HEIGHTS)
    faces = sorted({r["family"] for r in told}, key=lambda f: (known.index(f) if f in known else -1, f))
    codes = sorted({r["ch"] for r in told if len(r["ch"]) == 1})
    ems = np.full((len(codes) + 1, len(faces)), np.nan)
    for family, ch, em in told:
        if len(ch) == 1 and em is not None:
            ems[codes.index(ch), faces.index(family)] = em

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(0x110000, len(codes), np.int32)
        place[[ord(c) for c in codes]] = np.arange(len(codes))
        for batch in whole_groups(batches, 2):
            first = starts(batch, 2)
            best = _faces_of(batch, first, place, ems)
            names = pa.array([faces[k] if k >= 0 else "Arial" for k in best.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first)), batch.column(1).take(pa.array(first)), names], [*PAGE, "family"])

    usable = (F.length("text") >= 2) & (F.col("confidence") >= 60)
    cols = words.select(*LINE, F.when(usable, F.col("text")).alias("text"), (F.col("x1") - F.col("x0")).cast("double").alias("w"))
    return (cols if laid else cols.repartition(*PAGE)).sortWithinPartitions(*LINE).mapInArrow(pages, schema_of(words, PAGE) + ", family string")


def _faces_of(words: pa.RecordBatch, first: np.ndarray, place: np.ndarray, ems: np.ndarray) -> np.ndarray:
    """Number of the face that explains each page, -1 where none stands out. ``words``: whole pages, each line together;
    ``first``: where pages begin; ``place``: the row of ``ems`` for a code point."""
    n, k = len(first), ems.shape[1]
    line = np.repeat(np.arange(len(at := starts(words, 3))), np.diff(at, append=words.num_rows))
    page = np.repeat(np.arange(n), np.diff(first, append=words.num_rows))
    text = words.column(3)
    keep = np.flatnonzero(text.is_valid().to_numpy(zero_copy_only=False))
    texts, page, line = text.take(pa.array(keep)).to_pylist(), page[keep], line[keep]
    width = words.column(4).to_numpy(zero_copy_only=False)[keep]
    of = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    at = place[chars]
    spread, count = np.full((n, k), np.nan), np.zeros((n, k), np.int64)
    for f in range(k):
        em = np.bincount(of, weights=ems[at, f], minlength=len(texts))
        ok = np.flatnonzero(em > 0.3)
        v, own, where = width[ok] / (em[ok] - 0.05), line[ok], page[ok]
        dev = np.abs(_log_share(v, own))
        pair = np.bincount(own, minlength=1)[own] >= 2
        count[:, f] = np.bincount(where[pair], minlength=n)
        told = pair & ~np.isnan(dev)
        with np.errstate(invalid="ignore"):
            spread[:, f] = np.bincount(where[told], weights=dev[told], minlength=n) / np.bincount(where[told], minlength=n)
    if k < 2:
        return np.full(n, -1)
    order = np.argsort(spread, axis=1, kind="stable")
    best, second = (np.take_along_axis(spread, order[:, i : i + 1], 1)[:, 0] for i in (0, 1))
    with np.errstate(invalid="ignore"):
        clear = (count.min(1) >= 4) & ~np.isnan(spread).any(1) & (second >= 1.25 * best)
    return np.where(clear, order[:, 0], -1)


def _log_share(v: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Logarithm of each value over the middle of its group's (mean of two); ``own`` ascends. Missing values and shares that
    are not above zero give none."""
    seen = np.flatnonzero(~np.isnan(v))
    out = np.full(len(v), np.nan)
    if len(seen):
        first = np.flatnonzero(np.diff(own[seen], prepend=-1))
        many = np.diff(first, append=len(seen))
        ranked = v[seen][np.lexsort((v[seen], own[seen]))]
        low, high = ranked[first + (many - 1) // 2], ranked[first + many // 2]
        with np.errstate(divide="ignore", invalid="ignore"):
            share = v[seen] / np.repeat(np.where(low == high, low, 0.5 * low + 0.5 * high), many)
            out[seen] = np.where((share > 0) & np.isfinite(share), np.log(share), np.nan)
    return out


def split_ocr_pieces(words: DataFrame) -> DataFrame:
    """Piece number along a line: a gap beyond 1.6 sizes starts a new one. ``words`` carry their line's size."""
    w = Window.partitionBy(*LINE).orderBy("x0", "word_no")
    return islands(words, LINE, ["x0", "word_no"], F.col("x0") - F.lag("x1").over(w) > 1.6 * F.col("size"), "piece")


def line_style_vote(words: DataFrame) -> DataFrame:
    """Bold and italic of words from stem thickness and sharpness when leaning against upright (columns stem, upright,
    leaning), of lines by their letters; words too short to judge take their neighbours' style."""
    measured = F.col("text").rlike(r"\p{L}.*\p{L}")
    usual = F.try_element_at("_s", (F.floor(F.lit(0.35) * F.size("_s")) + 1).cast("int"))
    stems = words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.when(measured, F.col("stem")))).alias("_s"))
    j = words.join(stems.select(*PAGE, F.when(F.size("_s") >= 6, usual).alias("_usual")), PAGE)
    bold = F.when(measured & F.col("_usual").isNotNull(), F.col("stem") >= F.lit(1.3) * F.col("_usual"))
    italic = F.when(measured & F.col("_usual").isNotNull(), (F.col("upright") > 0) & (F.col("leaning") >= F.lit(1.06) * F.col("upright")))
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    t = j.withColumns({"w_bold": bold, "w_italic": italic, "letters": letters})
    line = Window.partitionBy(*LINE)
    o = line.orderBy("x0", "word_no")
    own = F.when((F.col("letters") >= 3) & F.col("w_bold").isNotNull(), F.struct("w_bold", "w_italic"))
    before = F.last("own", True).over(o.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("own", True).over(o.rowsBetween(0, Window.unboundedFollowing))
    heavy = F.sum(F.when(F.col("w_bold"), F.col("letters")).otherwise(0)).over(line)
    s = t.withColumn("own", own).withColumn("_s", F.coalesce(before, after))
    return s.select(
        *LINE, "word_no", "text",
        F.coalesce("_s.w_bold", "w_bold", F.lit(False)).alias("bold"),
        F.coalesce("_s.w_italic", "w_italic", F.lit(False)).alias("italic"),
        (heavy > F.lit(0.5) * F.sum("letters").over(line)).alias("line_bold"),
    )


def palette(words: DataFrame, reach: int = 36) -> DataFrame:
    """Ink colours of a page gathered around running means; the order of words decides, so one page is one fold."""

    def page(g: dict) -> list:
        order = sorted(zip(*(g[c] for c in ("line", "x0", "word_no", "r", "g", "b"))), key=lambda r: [(v is None, v) for v in r])
        sums: list[list] = []  # sums of a colour and its words
        member = []
        for *_, r, gr, b in order:
            ink = [math.nan if v is None else float(v) for v in (r, gr, b)]
            near = next((k for k, (x, y, z, n) in enumerate(sums) if abs(x / n - ink[0]) <= reach and abs(y / n - ink[1]) <= reach and abs(z / n - ink[2]) <= reach), len(sums))
            if near < len(sums):
                sums[near] = [*(t + v for t, v in zip(sums[near], ink)), sums[near][3] + 1]
            else:
                sums.append([*ink, 1])
            member.append(near)
        means = [[v / n for v in total] for *total, n in sums]
        names = ["000000" if max(m) - min(m) < 28 and max(m) < 70 else "".join(f"{math.floor(v + 0.5):02X}" for v in m) for m in means]
        key = tuple(g[k][0] for k in PAGE)
        return [(*key, line, word, names[k]) for (line, _, word, *_), k in zip(order, member)]

    cols = words.select(*LINE, "word_no", "x0", "r", "g", "b")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cols.select(*LINE, "word_no").schema.fields)
    return grouped_rows(cols, PAGE, page, f"{schema}, color string")


def merge_ocr(existing: DataFrame, recognised: DataFrame, least: int = 100) -> DataFrame:
    """Pages with real text keep it, the others take the recogniser's. Both: doc_id, page_no, text."""
    keep = existing.select(*PAGE, F.when(letter_count(F.col("text")) >= least, F.col("text")).alias("_own"))
    j = keep.join(recognised.select(*PAGE, F.trim("text").alias("_ocr")), PAGE, "full_outer")
    return j.select(*PAGE, F.coalesce("_own", "_ocr", F.lit("")).alias("text"), F.col("_own").isNotNull().alias("kept"), F.when(F.col("_own").isNull(), letter_count(F.coalesce("_ocr", F.lit("")))).otherwise(0).alias("found_chars"))


def ocr_outcome(merged: DataFrame) -> DataFrame:
    return merged.groupBy("doc_id").agg(
        F.count_if(~F.col("kept")).alias("recognised"), F.count_if("kept").alias("skipped"), (F.sum("found_chars") > 0).alias("found")
    )
