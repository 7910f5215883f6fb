"""Glyphs and words to lines: visibility, links, overprints, chunks, lines, runs and their features."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.functions.text import let
from pagestrata.operators.common import bucket_join, half_up, islands, lower_percentile, upper_median
from pagestrata.operators.pieces import along, chunk_boxes, content_chunks, group_lines, levelled, line_boxes, page_chunks, rows_of_pieces, spacing_stats, word_gaps  # noqa: F401

PAGE = ["doc_id", "page_no"]
LINE = ["doc_id", "page_no", "line_no"]


def _names(df: DataFrame, cols: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*cols).schema.fields)


def visible_glyphs(glyphs: DataFrame, paints: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Drop glyphs under a later opaque paint, outside their clip (columns clip_x0.. when present) or the page, or without
    size; fully transparent ones become invisible. ``paints``: page, op, x0, y0, x1, y1."""
    cx, cy = F.col("x") + F.col("adv") / 2, F.col("y") - F.col("size") * 0.3
    g = glyphs.filter(F.col("size") > 0.2)
    if "alpha" in glyphs.columns:
        g = g.withColumn("invisible", F.col("alpha") <= 0.02)
    g = g.filter((cx >= -1) & (cy >= -1) & (cx <= page_w + 1) & (cy <= page_h + 1))
    if "clip_x0" in glyphs.columns:
        inside = cx.between(F.col("clip_x0") - 0.5, F.col("clip_x1") + 0.5) & cy.between(F.col("clip_y0") - 0.5, F.col("clip_y1") + 0.5)
        g = g.filter(F.coalesce(inside, F.lit(True)))
    box = g.select(*PAGE, "seq", F.col("x").alias("_x0"), (F.col("x") + F.col("adv")).alias("_x1"), (F.col("y") - 0.6 * F.col("size")).alias("_y0"), (F.col("y") + 0.15 * F.col("size")).alias("_y1"))
    p = paints.select(*PAGE, "op", *[F.col(c).alias(f"p_{c}") for c in ("x0", "y0", "x1", "y1")])
    under = (F.col("op") > F.col("seq")) & (F.col("_x0") >= F.col("p_x0") - 0.5) & (F.col("_y0") >= F.col("p_y0") - 0.5) & (F.col("_x1") <= F.col("p_x1") + 0.5) & (F.col("_y1") <= F.col("p_y1") + 0.5)
    hidden = bucket_join(box, p, PAGE, ("_y0", "_y1"), ("p_y0", "p_y1"), 60.0, pad=0.5, extra=under).select(*PAGE, "seq").distinct()
    if "invisible" in g.columns:
        hidden = hidden.join(g.filter("invisible").select(*PAGE, "seq"), [*PAGE, "seq"], "left_anti")
    return g.join(hidden, [*PAGE, "seq"], "left_anti")


def attach_links(glyphs: DataFrame, links: DataFrame) -> DataFrame:
    """Link of the first area that holds a glyph's centre. ``links``: page, link_no, x0, y0, x1, y1, uri."""
    g = glyphs.select(*PAGE, "seq", (F.col("x") + F.col("adv") / 2).alias("_cx"), (F.col("y") - F.col("size") * 0.3).alias("_cy"))
    a = links.select(*PAGE, "link_no", "uri", (F.col("x0") + 1.5).alias("lx0"), (F.col("x1") - 1.5).alias("lx1"), (F.col("y0") - 1).alias("ly0"), (F.col("y1") + 1).alias("ly1"))
    hit = bucket_join(g, a, PAGE, ("_cy", "_cy"), ("ly0", "ly1"), 60.0, extra=F.col("_cx").between(F.col("lx0"), F.col("lx1")))
    first = hit.groupBy(*PAGE, "seq").agg(F.min_by("uri", "link_no").alias("link"))
    return glyphs.join(first, [*PAGE, "seq"], "left")


def replace_spans(glyphs: DataFrame) -> DataFrame:
    """The first glyph of a replacement span carries the span's text, its others nothing (columns span, span_text)."""
    w = Window.partitionBy(*PAGE, "span").orderBy("seq")
    first = F.row_number().over(w) == 1
    return glyphs.withColumn("text", F.when(F.col("span").isNull(), F.col("text")).when(first, F.col("span_text")).otherwise(""))


def dedupe_overprints(glyphs: DataFrame) -> DataFrame:
    """One glyph per overprinted copy, the one on top; copies struck a hair apart become bold. Directions (dx, dy) must agree.

    A glyph meets the earlier ones of its text in the cells around it. A pair at less than 0.06 em is a copy, one at up to
    0.3 em if the next or the last glyph of both is shifted alike. Of a chain of copies each strikes out the one under it, but
    an invisible one never a visible one: it goes itself while that one stands. Blanks go with the struck glyphs around them.
    A page is one group of numbers; where glyphs are dealt by page nothing is shuffled."""
    cols = ["seq", "text", "ws", "x", "y", "size", "color", "bold", "invisible"]
    pages = along(glyphs).select(*PAGE, *cols, "dx", "dy").groupBy(*PAGE).agg(F.collect_list(F.struct(*cols, "dx", "dy")).alias("_g"))

    @F.arrow_udf("binary")
    def told(page: pa.Array) -> bytes:
        every = dict(zip([*cols, "dx", "dy"], page.flatten().flatten()))
        return _told_of_page(*(every[c] for c in ("seq", "text", "color", "ws", "invisible", "x", "y", "size", "dx", "dy"))).tobytes()

    # As a window a page reaches Python alone, and its rows stay where they were dealt.
    pages = pages.withColumn("_k", told("_g").over(Window.partitionBy(*PAGE)))
    flag = lambda i: F.substr("_k", i + 1, F.lit(1))
    each = pages.select(*PAGE, F.explode(F.transform("_g", lambda g, i: F.struct(g.alias("g"), flag(i).alias("k")))).alias("_i")).filter("_i.k <> X'00'")
    bold = F.col("_i.g.bold") | (F.col("_i.k") == F.expr("X'02'"))
    return each.select(*PAGE, *[(bold if c == "bold" else F.col(f"_i.g.{c}")).alias(c) for c in cols])


def _told_of_page(seq, text, color, ws, invisible, x, y, size, dx, dy) -> np.ndarray:
    """Of a page's glyphs, in any order: 0 for one that goes, 1 for one that stays, 2 for one that stays and is bold."""
    by = pc.sort_indices(seq)
    seq, text, color, ws, invisible, *place = (v.take(by) for v in (seq, text, color, ws, invisible, x, y, size, dx, dy))
    blank, hidden = (pc.fill_null(v, False).to_numpy(zero_copy_only=False) for v in (ws, invisible))
    names = [pc.fill_null(v.dictionary_encode().indices, -1).to_numpy() for v in (text, color)]
    inked = ~blank & pc.fill_null(pc.not_equal(text, ""), False).to_numpy(zero_copy_only=False)
    number = np.unique(seq.to_numpy(), return_inverse=True)[1]
    gone, hair = _overprinted(number, *names, inked, hidden, *(pc.cast(v, pa.float64()).to_numpy(zero_copy_only=False) for v in place))
    out = np.empty(len(blank), np.int8)
    out[by.to_numpy()] = _kept(blank, gone) * (1 + hair)
    return out


#: Pairs of glyphs that are looked at together.
PAIRS = 1 << 18


def _near_copies(text: np.ndarray, ink: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (upper, lower) of inked glyphs of one text that lie in neighbouring cells, in portions; each pair once."""
    ink = ink[np.isfinite(x[ink]) & np.isfinite(y[ink]) & np.isfinite(size[ink])]
    if len(ink) < 2:
        return
    most = np.zeros(int(text.max()) + 1)
    np.maximum.at(most, text[ink], size[ink])
    cell = np.maximum(1.0, 0.6 * most)[text[ink]]
    axes = []
    for v in (x[ink], y[ink]):
        own = np.floor(v / cell)
        known = np.unique(own)
        reach = [np.floor((v + d * size[ink]) / cell) for d in (-0.3, 0.3)]
        at = [np.minimum(np.searchsorted(known, r), len(known) - 1) for r in reach]
        ok = [known[a] == r for a, r in zip(at, reach)]
        ok[1] &= reach[0] != reach[1]
        axes.append((np.searchsorted(known, own), at, ok, len(known)))
    (cx, rx, okx, _), (cy, ry, oky, high) = axes
    name = lambda a, b: (text[ink].astype(np.int64) * axes[0][3] + a) * high + b
    under = name(cx, cy)
    by = np.argsort(under, kind="stable")
    under = under[by]
    for i in (0, 1):
        for j in (0, 1):
            tops = np.flatnonzero(okx[i] & oky[j])
            want = name(rx[i], ry[j])[tops]
            begin, end = (np.searchsorted(under, want, side) for side in ("left", "right"))
            many, at = np.cumsum(end - begin), 0
            while at < len(tops):
                to = max(at + 1, int(np.searchsorted(many, (many[at - 1] if at else 0) + PAIRS, side="right")))
                n = (end - begin)[at:to]
                low = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at:to], n)
                yield ink[np.repeat(tops[at:to], n)], ink[by[low]]
                at = to


def _overprinted(seq, text, color, inked, hidden, x, y, size, dx, dy) -> tuple[np.ndarray, np.ndarray]:
    """Which glyphs of a page, in order, are struck out, and which are bold."""
    n = len(seq)

    def alike(u: np.ndarray, t: np.ndarray, step: int, ox: np.ndarray, oy: np.ndarray, slack: np.ndarray) -> np.ndarray:
        a, b = u + step, t + step
        ok = (a >= 0) & (b >= 0) & (a < n) & (b < n)
        a, b = np.where(ok, a, 0), np.where(ok, b, 0)
        ok &= (text[a] == text[b]) & inked[b] & (np.abs(size[a] - size[b]) < 0.15 * size[a])
        return ok & (np.abs(x[b] - x[a] - ox) <= slack) & (np.abs(y[b] - y[a] - oy) <= slack)

    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for t, u in _near_copies(text, np.flatnonzero(inked), x, y, size):
        ox, oy = x[t] - x[u], y[t] - y[u]
        dist = np.hypot(ox, oy)
        copy = (seq[u] < seq[t]) & (np.abs(size[u] - size[t]) <= 0.15 * size[t]) & (np.abs(dx[u] - dx[t]) <= 1e-3) & (np.abs(dy[u] - dy[t]) <= 1e-3) & (dist <= 0.3 * size[t])
        t, u, ox, oy, dist = (v[copy] for v in (t, u, ox, oy, dist))
        slack = 0.02 * size[t] + 0.05
        after = alike(u, t, 1, ox, oy, slack) & (seq[np.minimum(u + 1, n - 1)] != seq[t])
        before = alike(u, t, -1, ox, oy, slack) & (seq[np.maximum(t - 1, 0)] != seq[u])
        real = (dist < 0.06 * size[t]) | after | before
        found.append((t[real], u[real], dist[real]))
    t, u, dist = (np.concatenate(v) for v in zip(*found))
    yields = hidden[t] & ~hidden[u]
    apart = ~hidden[t] & ~hidden[u] & (color[t] >= 0) & (color[t] == color[u]) & (dist > 0.004 * size[t]) & (dist < 0.06 * size[t])
    struck_by = np.full(int(seq.max(initial=-1)) + 1, n)
    np.minimum.at(struck_by, seq[u[~yields]], seq[t[~yields]])
    live = struck_by[seq[u]] >= seq[t]
    gone, hair = np.zeros(len(struck_by), bool), np.zeros(len(struck_by), bool)
    gone[seq[t[live & yields]]] = gone[seq[u[live & ~yields]]] = True
    hair[seq[t[live & apart & ~yields]]] = True
    return gone[seq], hair[seq]


def _kept(ws: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Glyphs that stay: those not struck, and blanks that do not stand among struck ones."""
    n, at = len(ws), np.arange(len(ws))
    before = np.maximum.accumulate(np.where(ws, -1, at))
    after = np.minimum.accumulate(np.where(ws, n, at)[::-1])[::-1]
    left = (before >= 0) & gone[np.maximum(before, 0)]
    right = (after < n) & gone[np.minimum(after, n - 1)]
    to, last, first = np.append(ws[1:], False), at == n - 1, at == 0
    blank = np.where(to, left, (left & (right | last)) | (first & right))
    return ~np.where(ws, blank, gone)


def split_tabs(glyphs: DataFrame) -> DataFrame:
    """Piece number along a line: a jump after a space that stands out from the line's other jumps is a tab. Jumps are measured
    along the text, whichever way it runs."""
    own, glyphs = glyphs.columns, along(glyphs)
    w = Window.partitionBy(*LINE).orderBy("seq")
    prev_ws = F.last(F.when(F.col("ws"), F.struct(F.col("u"), F.col("adv"), F.col("seq"))), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    prev_ink = F.last(F.when(~F.col("ws"), F.struct(F.col("seq"), F.col("size"))), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = glyphs.withColumn("_w", prev_ws).withColumn("_i", prev_ink)
    jump = ~F.col("ws") & F.col("_i").isNotNull() & (F.col("_w.seq") > F.col("_i.seq"))
    extra = F.when(jump, F.col("u") - (F.col("_w.u") + F.col("_w.adv")))
    t = t.withColumn("_e", extra).withColumn("_s", F.greatest("size", "_i.size"))
    line = Window.partitionBy(*LINE)  # of bounded length; all windows share one exchange
    t = t.withColumn("_all", F.array_sort(F.collect_list("_e").over(line)))
    t = t.withColumn("_jumps", F.size("_all")).withColumn("_m", F.get("_all", F.floor(F.size("_all") / 2).cast("int")))
    wide = F.col("_e") > F.greatest(0.3 * F.col("_s"), 2 * F.greatest(F.lit(0.0), F.col("_m")) + 0.1 * F.col("_s"))
    t = t.withColumn("_tab", F.coalesce(wide, F.lit(False)))
    tabs = F.count_if("_tab").over(line)
    real = F.col("_tab") & ~((F.col("_jumps") > 2) & (F.col("_tabs") > 0.5 * F.col("_jumps")))
    out = islands(t.withColumn("_tabs", tabs), LINE, ["seq"], real, "piece")
    return out.select(*own, "piece")


def join_word_spaced_rows(pieces: DataFrame) -> DataFrame:
    """Rows of three or more pieces with regular wide gaps are one line, unless a piece edge lines up with a row nearby.
    ``pieces``: page, row_no, piece_no, x0, x1, baseline, size."""
    row = [*PAGE, "row_no"]
    w = Window.partitionBy(*row).orderBy("x0", "piece_no")
    p = pieces.withColumn("gap", F.col("x0") - F.lag("x1").over(w))
    r = p.groupBy(*row).agg(
        F.count("*").alias("n"), F.max("size").alias("em"), F.min("gap").alias("lo"), F.max("gap").alias("hi"), upper_median(F.col("gap")).alias("med"), F.min("baseline").alias("base")
    )
    regular = (F.col("n") >= 3) & (F.col("lo") > 0) & (F.col("hi") <= 3 * F.col("em")) & (F.col("hi") - F.col("lo") <= F.greatest(0.06 * F.col("em"), 0.08 * F.col("med")))
    cand = r.filter(regular)
    edges = p.filter("gap IS NOT NULL").join(r.select(*row, "base"), row).select(*row, "base", F.col("x0").alias("edge"))
    mine = edges.drop("base").join(cand.select(*row, "em", "base"), row)
    near = edges.select(*PAGE, F.col("row_no").alias("o_row"), F.col("base").alias("o_base"), F.col("edge").alias("o_edge"))
    hit = (F.col("o_row") != F.col("row_no")) & (F.abs(F.col("o_row") - F.col("row_no")) <= 4) & (F.abs(F.col("o_base") - F.col("base")) <= 5 * F.col("em")) & (F.abs(F.col("edge") - F.col("o_edge")) < 1.5)
    span = mine.withColumn("_lo", F.col("edge") - 1.5).withColumn("_hi", F.col("edge") + 1.5)
    tabular = bucket_join(span, near, PAGE, ("_lo", "_hi"), ("o_edge", "o_edge"), 20.0, extra=hit).select(*row).distinct()
    joined = cand.join(tabular, row, "left_anti").select(*row, F.lit(True).alias("joined"))
    return r.select(*row, "n").join(joined, row, "left").select(*row, "n", F.coalesce("joined", F.lit(False)).alias("joined"))


def line_features(glyphs: DataFrame) -> DataFrame:
    """Dominant size, baseline, box and the raised and lowered characters of every line. Glyphs of one size and place across
    are counted first, without sorting; a line's few such kinds are gathered, and all is read from that array. Places are
    along and across the text."""
    glyphs = levelled(glyphs)
    kinds = glyphs.filter(~F.col("ws")).groupBy(*LINE, "size", "y").agg(
        F.sum(F.length("text")).alias("n"), F.count("*").cast("int").alias("k"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("ink")).alias("x1")
    )
    kind = F.struct(half_up(F.col("size"), 4).alias("q"), "n", "k", "size", "y")
    lines = kinds.groupBy(*LINE).agg(F.collect_list(kind).alias("g"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))

    def total(g: Column, of: str) -> Column:
        return F.aggregate(g, F.lit(0).cast("bigint"), lambda n, i: n + i[of])

    sizes = F.transform(F.array_distinct(F.transform("g", lambda i: i["q"])), lambda q: F.struct(total(F.filter("g", lambda i: i["q"] == q), "n").alias("n"), q.alias("q")))
    sized = lines.withColumn("font_size", F.array_max(sizes)["q"])
    of_size = F.filter("g", lambda i: F.abs(i["size"] - F.col("font_size")) <= 0.12 * F.col("font_size"))
    ys = lambda g: F.array_sort(F.flatten(F.transform(g, lambda i: F.array_repeat(i["y"], i["k"]))))
    based = sized.withColumn("_ys", F.when(F.size(of_size) > 0, ys(of_size)).otherwise(ys(F.col("g"))))
    based = based.withColumn("baseline", F.get("_ys", F.floor((F.size("_ys") - 1) / 2).cast("int")))

    def shifted(off) -> Column:
        return total(F.filter("g", lambda i: (i["size"] <= 0.88 * F.col("font_size")) & off(i["y"] - F.col("baseline"))), "k")

    return based.select(
        *LINE, "font_size", "baseline",
        shifted(lambda d: d < -0.12 * F.col("font_size")).alias("superscripts"), shifted(lambda d: d > 0.08 * F.col("font_size")).alias("subscripts"),
        "x0", "x1", total(F.col("g"), "k").alias("inks"),
    )


def style_runs(glyphs: DataFrame, features: DataFrame) -> DataFrame:
    """Glyphs of one style join into runs; a space comes from a space glyph or a clear gap and is never doubled. It
    stays with the run before it, or goes with the text that follows a raised mark. Places are along the text."""
    g = levelled(glyphs).join(features.select(*LINE, "font_size", "baseline"), LINE)
    w = Window.partitionBy(*LINE).orderBy("seq")
    spaces = F.sum(F.col("ws").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    inks = g.withColumn("_k", spaces).filter(~F.col("ws"))
    S, off = F.col("font_size"), F.col("y") - F.col("baseline")
    lifted = F.when((F.col("size") <= 0.88 * S) & (off < -0.12 * S), "super").when((F.col("size") <= 0.88 * S) & (off > 0.08 * S), "sub").otherwise("")
    t = inks.withColumn("lift", lifted)
    prev = {c: F.lag(c).over(w) for c in ("family", "size", "bold", "color", "lift", "x", "ink", "_k")}
    gap = F.col("x") - (prev["x"] + prev["ink"])
    raised = (F.col("lift") != "") | (prev["lift"] != "")
    spaced = (F.col("_k") > prev["_k"]) | (gap > F.when(raised, 0.2 * S).otherwise(0.11 * S))
    same = (F.col("family") == prev["family"]) & (F.abs(F.col("size") - prev["size"]) < 0.25) & (F.col("bold") == prev["bold"]) & (F.col("color") == prev["color"]) & (F.col("lift") == prev["lift"])
    t = t.withColumn("space", F.coalesce(spaced, F.lit(False))).withColumn("_new", ~F.coalesce(same, F.lit(True))).withColumn("_up", prev["lift"] != "")
    t = islands(t, LINE, ["seq"], F.col("_new"), "run")
    lead = F.col("space") & F.col("_new") & F.col("_up")
    nxt = F.lead("space").over(w) & ~(F.lead("_new").over(w) & F.lead("_up").over(w))
    piece = F.concat(F.when(lead, " ").otherwise(""), "text", F.when(F.coalesce(nxt, F.lit(False)), " ").otherwise(""))
    t = t.withColumn("_p", piece)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_p"))), lambda r: r["_p"]), "")
    return t.groupBy(*LINE, "run").agg(
        text.alias("text"), F.first("family").alias("family"), F.first("size").alias("size"), F.first("bold").alias("bold"), F.first("color").alias("color"), F.first("lift").alias("lift"),
        F.min("x").alias("x0"), F.max(F.col("x") + F.col("ink")).alias("x1"),
    )


def line_stretch(words: DataFrame, natural: Column) -> DataFrame:
    """Median ratio of the word gaps to natural ones (two gaps or more) and the width without the positive excess."""
    w = Window.partitionBy(*LINE).orderBy("x", "word_no")
    t = words.withColumn("_g", F.col("x") - F.lag(F.col("x") + F.col("w")).over(w)).withColumn("_n", natural)
    return t.groupBy(*LINE).agg(
        F.when(F.count("_g") >= 2, half_up(lower_percentile(F.col("_g") / F.col("_n"), 0.5), 100)).alias("stretch"),
        half_up(F.max(F.col("x") + F.col("w")) - F.min("x") - F.sum(F.greatest(F.lit(0.0), F.coalesce(F.col("_g") - F.col("_n"), F.lit(0.0)))), 100).alias("natural_width"),
    )


def order_lines(lines: DataFrame) -> DataFrame:
    """Reading order on a page: horizontal lines first, lines on one baseline left to right."""
    rot = (F.coalesce("rotation", F.lit(0.0)) != 0).cast("int")
    t = lines.withColumn("_rot", rot)
    keys = [*PAGE, "_rot"]
    w = Window.partitionBy(*keys).orderBy("baseline", "x", "line_no")
    apart = F.col("baseline") - F.lag("baseline").over(w) > 0.2 * F.least("size", F.lag("size").over(w))
    t = islands(t, keys, ["baseline", "x", "line_no"], apart, "_row")
    o = Window.partitionBy(*PAGE).orderBy("_rot", "_row", "x", "line_no")
    return t.withColumn("reading_no", F.row_number().over(o)).drop("_rot", "_row")


def line_tag(glyphs: DataFrame) -> DataFrame:
    """The structure element of most of a line's characters (30 % at least), or page furniture (over half)."""
    inks = glyphs.filter(~F.col("ws"))
    n = F.length("text")
    votes = inks.groupBy(*LINE, "tag_id", "artifact").agg(F.sum(n).alias("n"), F.min("seq").alias("first"))
    tagged = F.col("tag_id").isNotNull() & ~F.col("artifact")
    agg = votes.groupBy(*LINE).agg(
        F.sum("n").alias("all"), F.sum(F.when(F.col("artifact"), F.col("n")).otherwise(0)).alias("furniture"),
        F.max_by(F.when(tagged, F.struct("tag_id", "n")), F.when(tagged, F.struct("n", -F.col("first")))).alias("best"),
    )
    art = F.col("furniture") > 0.5 * F.col("all")
    return agg.select(*LINE, art.alias("artifact"), F.when(~art & (F.col("best.n") >= 0.3 * F.col("all")), F.col("best.tag_id")).alias("tag_id"))


# Block-level structure roles.
BLOCK_ROLES = [
    "P", "H", "H1", "H2", "H3", "H4", "H5", "H6", "Title", "LI", "Lbl", "LBody", "TD", "TH", "Caption", "BlockQuote", "TOCI", "Note", "BibEntry", "Index", "Figure", "Formula", "Code",
]


def heading_role(role: Column) -> Column:
    n = F.regexp_extract(role, "^H([1-6])$", 1)
    return F.when(n != "", n.cast("int")).when(role.isin("H", "Title"), 1).otherwise(0)


def is_block_role(role: Column) -> Column:
    return role.isin(BLOCK_ROLES)


def decorate(chars: DataFrame, marks: DataFrame) -> DataFrame:
    """Underlined and struck characters cut into pieces where a mark begins or ends. ``chars``: line, i, text, x, w,
    baseline, size; ``marks``: page, mark_no, x0, x1, y, thickness (thin horizontal rules and bars)."""
    line = chars.groupBy(*LINE).agg(F.min("x").alias("lx0"), F.max(F.col("x") + F.col("w")).alias("lx1"), F.max("baseline").alias("b"), F.max("size").alias("s"))
    m = marks.select(*PAGE, "mark_no", F.col("x0").alias("mx0"), F.col("x1").alias("mx1"), F.col("y").alias("my"), "thickness")
    rel = F.col("my") - F.col("b")
    fit = (F.col("thickness") <= F.greatest(F.lit(1.6), 0.14 * F.col("s"))) & (F.col("mx0") >= F.col("lx0") - 1.5) & (F.col("mx1") <= F.col("lx1") + 1.5)
    under, strike = rel.between(0.02 * F.col("s"), 0.32 * F.col("s")), rel.between(-0.5 * F.col("s"), -0.12 * F.col("s"))
    span = line.withColumn("_lo", F.col("b") - 0.5 * F.col("s")).withColumn("_hi", F.col("b") + 0.32 * F.col("s"))
    near = bucket_join(span, m, PAGE, ("_lo", "_hi"), ("my", "my"), 60.0, extra=fit & (under | strike))
    near = near.select(*LINE, "mark_no", "mx0", "mx1", under.alias("under"))
    c = chars.withColumn("_c", F.col("x") + F.col("w") / 2)
    on = (F.col("_c") >= F.col("mx0") - 0.5) & (F.col("_c") <= F.col("mx1") + 0.5)
    hit = c.join(near, LINE).filter(on).groupBy(*LINE, "i").agg(F.max("under").alias("underline"), F.max(~F.col("under")).alias("strike"))
    f = chars.join(hit, [*LINE, "i"], "left").withColumn("underline", F.coalesce("underline", F.lit(False))).withColumn("strike", F.coalesce("strike", F.lit(False)))
    w = Window.partitionBy(*LINE).orderBy("i")
    turn = (F.col("underline") != F.lag("underline").over(w)) | (F.col("strike") != F.lag("strike").over(w))
    p = islands(f, LINE, ["i"], turn, "piece")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda r: r["text"]), "")
    return p.groupBy(*LINE, "piece").agg(text.alias("text"), F.first("underline").alias("underline"), F.first("strike").alias("strike"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"))


def word_boxes(runs: DataFrame) -> DataFrame:
    """Boxes of a run's words, its characters spread evenly. ``runs``: line, text, x, y, w, h."""
    per = F.col("w") / F.length("text")
    chars = F.filter(F.split("text", ""), lambda c: c != "")

    def edges(cs: Column) -> Column:
        solid = lambda i: F.coalesce(F.get(cs, i).rlike(r"\S"), F.lit(False))
        at = F.sequence(F.lit(0), F.size(cs) - 1)
        begins = F.filter(at, lambda i: solid(i) & ((i == 0) | ~solid(i - 1)))
        ends = F.transform(F.filter(at, lambda i: solid(i) & ~solid(i + 1)), lambda i: i + 1)
        return F.arrays_zip(begins.alias("a"), ends.alias("b"))

    spans = let(chars, edges)
    each = runs.select(*LINE, "text", "x", "y", "h", per.alias("_p"), F.posexplode(spans).alias("n", "s"))
    a, b = F.col("s")["a"], F.col("s")["b"]
    return each.select(*LINE, F.col("n").alias("word_no"), F.substr("text", a + 1, b - a).alias("text"), (F.col("x") + a * F.col("_p")).alias("x"), "y", ((b - a) * F.col("_p")).alias("w"), "h")


def deskew_frame(lines: DataFrame) -> DataFrame:
    """Rotated lines in their own unrotated frame: angle to half degrees, position along and across, frame bounds."""
    angle = half_up(F.col("rotation"), 2)
    rad = F.radians("angle")
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    u = F.cos(rad) * cx + F.sin(rad) * cy - F.col("w") / 2
    v = F.cos(rad) * cy - F.sin(rad) * cx - F.col("h") / 2
    t = lines.filter("rotation <> 0").withColumn("angle", angle).withColumn("u", u).withColumn("v", v)
    w = Window.partitionBy(*PAGE, "angle")
    return t.withColumns({"frame_x": F.min("u").over(w), "frame_y": F.min("v").over(w), "frame_x1": F.max(F.col("u") + F.col("w")).over(w), "frame_y1": F.max(F.col("v") + F.col("h")).over(w)})


def select_region(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Spans of a dragged selection: whole words on its first and last line, whole lines between. ``words``: line,
    word_no, x, w, top, bottom, baseline, size; ``regions``: region_id, page, ax, ay, bx, by (start and end)."""
    line = words.groupBy(*LINE).agg(
        F.min("x").alias("l"), F.max(F.col("x") + F.col("w")).alias("r"), F.min("top").alias("t"), F.max("bottom").alias("b"), F.max("baseline").alias("base"), F.max("size").alias("size"),
        F.array_sort(F.collect_list(F.struct("x", (F.col("x") + F.col("w")).alias("e")))).alias("ws"),
    )
    first, last = F.col("ay") <= F.col("by"), F.col("ay") > F.col("by")
    g = regions.select(
        "region_id", *PAGE, F.least("ax", "bx").alias("x0"), F.greatest("ax", "bx").alias("x1"), F.least("ay", "by").alias("y0"), F.greatest("ay", "by").alias("y1"),
        F.when(first, F.col("ax")).otherwise(F.col("bx")).alias("tx"), F.when(last, F.col("ax")).otherwise(F.col("bx")).alias("ex"),
    )
    tiny = (F.col("x1") - F.col("x0") < 3) & (F.col("y1") - F.col("y0") < 3)
    touch = F.when(tiny, (F.col("x0") >= F.col("l") - 2) & (F.col("x0") <= F.col("r") + 2) & (F.col("y0") >= F.col("t") - 2) & (F.col("y0") <= F.col("b") + 2)).otherwise(
        (F.col("b") > F.col("y0")) & (F.col("t") < F.col("y1")) & (F.col("r") > F.col("x0")) & (F.col("l") < F.col("x1"))
    )
    j = bucket_join(g, line, PAGE, ("y0", "y1"), ("t", "b"), 100.0, pad=2.0, extra=touch)
    w = Window.partitionBy("region_id").orderBy("base", "l")
    whole = Window.partitionBy("region_id")
    j = j.withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(whole)).withColumn("tiny", tiny)
    j = j.filter(~F.col("tiny") | (F.col("k") == 1))
    lone = F.col("n") == 1
    begin_at = F.greatest("l", F.when(lone, F.col("x0")).otherwise(F.col("tx")))
    end_at = F.least("r", F.when(lone, F.col("x1")).otherwise(F.col("ex")))
    start = F.coalesce(F.array_min(F.transform(F.filter("ws", lambda v: v["e"] > begin_at), lambda v: v["x"])), begin_at)
    stop = F.coalesce(F.array_max(F.transform(F.filter("ws", lambda v: v["x"] <= end_at), lambda v: v["e"])), end_at)
    a = F.when(~F.col("tiny") & (F.col("k") == 1), start).otherwise(F.col("l"))
    z = F.when(~F.col("tiny") & (F.col("k") == F.col("n")), stop).otherwise(F.col("r"))
    s = j.select("region_id", *LINE, a.alias("sx0"), z.alias("sx1"), "t", "b", "base", "size").filter(F.col("sx1") - F.col("sx0") > 1)
    return s.select(
        "region_id", *LINE, F.col("sx0").alias("x0"), F.col("sx1").alias("x1"),
        (F.col("t") - 0.08 * F.col("size")).alias("mark_top"), (F.col("b") + 0.08 * F.col("size")).alias("mark_bottom"),
        (F.col("base") + 0.12 * F.col("size")).alias("underline_y"), (F.col("base") - 0.28 * F.col("size")).alias("strike_y"),
        F.greatest(F.lit(1.0), half_up(F.col("size") * 0.07, 10)).alias("stroke"),
    )
