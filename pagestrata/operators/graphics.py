"""Fills, rules and vector art of pages."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.functions import geometry as G
from pagestrata.operators.common import bucket_join, grouped_rows, half_up, islands, upper_median

PAGE = ["doc_id", "page_no"]


def _schema(df: DataFrame, cols: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*cols).schema.fields)


def merge_strips(fills: DataFrame) -> DataFrame:
    """Six or more touching narrow bands of slowly changing colour become one fill of their mean colour; a wide change
    is a gradient. Bands along x first, then along y among what is left. A merged fill travels on as a row that meets nothing,
    so that fills are read once and dealt by page once."""
    cols = [*PAGE, "x", "y", "w", "h", "color", "opacity", "paint_order"]
    none = F.lit(None)
    rows = fills.select(*cols, none.cast("bigint").alias("n"), none.cast("boolean").alias("gradient"))
    for along_x in (True, False):
        rows = _strips(rows, along_x)
    return rows.filter("n IS NOT NULL").select(*PAGE, "n", "x", "y", "w", "h", "color", "opacity", "paint_order", "gradient")


def _strips(f: DataFrame, along_x: bool) -> DataFrame:
    """Rows with their bands along one direction merged. ``n`` (bands) and ``gradient`` tell merged fills, and are null on others."""
    lo, size, c0, cs = ("x", "w", "y", "h") if along_x else ("y", "h", "x", "w")
    cols = [c for c in f.columns if c not in PAGE]
    t = f.withColumn("_e0", half_up(F.col(c0), 2)).withColumn("_e1", half_up(F.col(c0) + F.col(cs), 2))
    t = t.withColumn("_own", F.when(F.col("n").isNotNull(), F.col("paint_order")))
    # All windows share keys and order, so a page is sorted once: a part is a stretch of a run, both are told by their first row.
    keys = [*PAGE, "_own", "_e0", "_e1"]
    w = Window.partitionBy(*keys).orderBy(lo, "paint_order")
    far = F.abs(F.col(lo) - (F.lag(lo).over(w) + F.lag(size).over(w))) > 0.6
    t = t.withColumn("_rgb", F.array(*G.channels(F.col("color"))))
    before = F.lag("_rgb").over(w)
    jump = F.greatest(*[F.abs(F.col("_rgb")[i] - before[i]) for i in range(3)]) > 24
    fresh = F.row_number().over(w) == 1
    t = t.withColumn("_start", fresh | F.coalesce(far | jump | (F.col(size) > 15), F.lit(False)))
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.last(F.when(F.col("_start"), F.struct(F.col(size).alias("s"))), True).over(so_far)["s"]
    t = t.withColumn("_odd", F.abs(F.col(size) - head) > F.greatest(F.lit(0.6), 0.25 * head))
    turn = F.col("_start") | F.coalesce(F.col("_odd") != F.lag("_odd").over(w), F.lit(False))
    t = t.withColumn("_turn", turn.cast("int")).withColumn("part", F.sum("_turn").over(so_far))
    a = F.col("w") * F.col("h")
    ch = [F.col("_rgb")[i] for i in range(3)]
    mean = [F.sum(c * a) / F.sum(a) for c in ch]
    spread = F.greatest(*[F.max(c) - F.min(c) for c in ch]) / F.lit(255.0)
    m = t.groupBy(*keys, "part").agg(
        F.count("*").alias("_n"), F.size(F.collect_set("color")).alias("_colors"), F.min(F.struct(lo, size)).alias("_f"),
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_x1"), F.max(F.col("y") + F.col("h")).alias("_y1"),
        F.array(*mean).alias("_mean"), F.min("opacity").alias("opacity"), F.max("paint_order").alias("paint_order"), (spread > 0.1).alias("gradient"), F.collect_list(F.struct(*cols)).alias("_members"),
    )
    ok = F.col("_own").isNull() & (F.col("_n") >= 6) & (F.col("_colors") >= 3) & (F.col(f"_f.{size}") <= 12)
    color = G.hex_of(*[F.floor(F.col("_mean")[i] + 0.5) for i in range(3)])
    one = {"w": F.col("_x1") - F.col("x"), "h": F.col("_y1") - F.col("y"), "color": color, "n": F.col("_n")}
    merged = F.struct(*[one.get(c, F.col(c)).cast(f.schema[c].dataType).alias(c) for c in cols])
    return m.select(*PAGE, F.explode(F.when(F.coalesce(ok, F.lit(False)), F.array(merged)).otherwise(F.col("_members"))).alias("m")).select(*PAGE, "m.*")


#: Fills or boxes of a page up to which lists are faster than arrays.
FEW = 64


def clean_fills(fills: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Fills as they are seen: flattened over what lies beneath in paint order, without repaint and without what later
    paint or opaque pictures hide. Each fill depends on those before it, so a page is one fold."""
    cols = [*PAGE, "paint_order", "x", "y", "w", "h", "color", "opacity"]
    rows = fills.select(*cols, F.lit(False).alias("picture"))
    if images is not None:
        rows = rows.unionByName(images.select(*PAGE, "paint_order", "x", "y", "w", "h", F.lit("000000").alias("color"), F.lit(1.0).alias("opacity"), F.lit(True).alias("picture")))

    def page(g: dict) -> list:
        order = sorted(zip(*(g[c] for c in (*cols, "picture"))), key=lambda r: [(v is None, v) for v in r[2:]])
        box = [[math.nan if v is None else v for v in (x, y, *((None, None) if None in (x, y, w, h) else (x + w, y + h)))] for x, y, w, h in (r[3:7] for r in order)]
        rgb = [[float(int(r[7][k : k + 2], 16)) for k in (0, 2, 4)] for r in order]
        many, live = np.array(box) if len(order) > FEW else None, []

        def unhidden(i: int) -> list[int]:
            if many is not None and len(live) > FEW:
                b = many[live]
                return np.array(live)[~((many[i, :2] <= b[:, :2] + 0.1).all(1) & (many[i, 2:] >= b[:, 2:] - 0.1).all(1))].tolist()
            x0, y0, x1, y1 = box[i]
            return [k for k in live if not (x0 <= box[k][0] + 0.1 and y0 <= box[k][1] + 0.1 and x1 >= box[k][2] - 0.1 and y1 >= box[k][3] - 0.1)]

        for i, r in enumerate(order):
            if r[9]:
                live = unhidden(i)
                continue
            x0, y0, x1, y1 = box[i]
            if max(x1 - x0, y1 - y0) < 0.75:
                continue
            under = next((rgb[k] for k in reversed(live) if box[k][0] <= x0 + 0.25 and box[k][1] <= y0 + 0.25 and box[k][2] >= x1 - 0.25 and box[k][3] >= y1 - 0.25), [255.0] * 3)
            alpha = r[8]
            if alpha is not None and alpha < 0.98:
                rgb[i] = [u + alpha * (c - u) for u, c in zip(under, rgb[i])]
            if max(abs(c - u) for u, c in zip(under, rgb[i])) <= 255 * 0.008:
                continue
            live = [*unhidden(i), i]
        return [(*order[i][:7], "".join(f"{math.floor(v + 0.5):02X}" for v in rgb[i]), 1.0) for i in live]

    return grouped_rows(rows, PAGE, page, _schema(fills, cols))


def dotted_rows(pieces: DataFrame) -> DataFrame:
    """Five or more equal small squares on a line with mostly regular gaps become a dotted rule. ``pieces``: page, dir,
    piece_no, pos, a, b, width, color."""
    keys = [*PAGE, "dir"]
    w = Window.partitionBy(*keys).orderBy("pos", "a", "piece_no")
    t = islands(pieces, keys, ["pos", "a", "piece_no"], F.col("pos") - F.lag("pos").over(w) > 0.3, "line")
    line = [*keys, "line"]
    o = Window.partitionBy(*line).orderBy("a", "piece_no")
    size, prev = F.col("b") - F.col("a"), F.lag(F.col("b") - F.col("a")).over(o)
    gap = F.col("a") - F.lag("b").over(o)
    ok = (G.color_distance(F.col("color"), F.lag("color").over(o)) <= 8) & (F.abs(size - prev) <= 0.3 * prev + 0.1) & gap.between(-0.05, 4 * prev + 0.5)
    t = t.withColumn("_g", gap)
    t = islands(t, line, ["a", "piece_no"], ~ok, "run")
    r = Window.partitionBy(*line, "run").orderBy("a", "piece_no")
    t = t.withColumn("_g", F.when(F.row_number().over(r) > 1, F.col("_g")))
    med = t.groupBy(*line, "run").agg(upper_median(F.col("_g")).alias("med"))
    j = t.join(med, [*line, "run"])
    regular = F.count_if(F.abs(F.col("_g") - F.col("med")) <= 0.35 * F.col("med") + 0.2) >= 0.7 * F.count("_g")
    m = j.groupBy(*line, "run").agg(
        F.count("*").alias("n"), F.first("med").alias("med"), regular.alias("ok"), F.min_by(F.struct("pos", (F.col("b") - F.col("a")).alias("s"), "width", "color"), "a").alias("f"), F.min("a").alias("a"), F.max_by("b", "a").alias("b")
    )
    dots = m.filter((F.col("n") >= 5) & F.col("ok") & (F.col("med") >= 0.1 * F.col("f.s")))
    return dots.select(*keys, F.col("f.pos").alias("pos"), "a", "b", F.col("f.width").alias("width"), F.col("f.color").alias("color"), F.lit("dotted").alias("style"), "n")


def merge_touching(rules: DataFrame) -> DataFrame:
    """Collinear pieces of one colour, width and style that touch or overlap become one rule."""
    style = F.col("style") if "style" in rules.columns else F.lit("")
    t = rules.withColumn("_style", F.coalesce(style, F.lit("")))
    keys = [*PAGE, "dir", "color", "_style", "width"]
    w = Window.partitionBy(*keys).orderBy("pos", "a", "b")
    tol = F.greatest(F.lit(0.6), 0.5 * F.col("width"))
    t = islands(t, keys, ["pos", "a", "b"], F.col("pos") - F.lag("pos").over(w) > tol, "line")
    o = Window.partitionBy(*keys, "line").orderBy("a", "b", "pos")
    reach = F.max("b").over(o.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("_reach", reach)
    t = islands(t, [*keys, "line"], ["a", "b", "pos"], F.col("a") - F.col("_reach") > F.greatest(F.lit(1.0), 1.5 * F.col("width")), "run")
    length = F.greatest(F.col("b") - F.col("a"), F.lit(1e-6))
    m = t.groupBy(*keys, "line", "run").agg((F.sum(F.col("pos") * length) / F.sum(length)).alias("pos"), F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("pieces"))
    return m.select(*PAGE, "dir", "pos", "a", "b", "width", "color", F.col("_style").alias("style"), "pieces")


def merge_dashes(rules: DataFrame) -> DataFrame:
    """Four or more equal pieces of at most 12 pt with a steady gap become one dashed rule; the rest stay."""
    keys = [*PAGE, "dir", "pos", "color", "width"]
    # All windows share keys and order, so the pieces are sorted once; a part is a stretch of a run.
    w = Window.partitionBy(*keys).orderBy("a", "b")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length, gap = F.col("b") - F.col("a"), F.col("a") - F.lag("b").over(w)
    before = F.lag(F.col("b") - F.col("a")).over(w)
    t = rules.withColumn("_g", gap)
    apart = (F.col("_g") <= 0) | (F.col("_g") > F.greatest(F.lit(6.0), 4 * F.col("width"))) | (F.abs(length - before) > 0.35 * before + 0.3)
    t = t.withColumn("_no", F.row_number().over(w)).withColumn("_start", (F.col("_no") == 1) | F.coalesce(apart, F.lit(False)))
    t = t.withColumn("_g", F.when(~F.col("_start"), F.col("_g"))).withColumn("run", F.sum(F.col("_start").cast("int")).over(so_far))
    # The first known gap of the run: least place in the latest run that has one.
    known = F.min(F.when(F.col("_g").isNotNull(), F.struct((-F.col("run")).alias("run"), F.col("_no").alias("no"), F.col("_g").alias("g")))).over(so_far)
    t = t.withColumn("_first", known)
    steady = F.when(F.col("_first.run") == -F.col("run"), F.col("_first.g"))
    off = F.coalesce(F.abs(F.col("_g") - steady) > 0.35 * steady + 0.3, F.lit(False))
    t = t.withColumn("part", F.sum((F.col("_start") | off).cast("int")).over(so_far))
    p = [*keys, "part"]
    m = t.groupBy(*p).agg(F.count("*").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"), F.min_by(F.col("b") - F.col("a"), "a").alias("len"), F.collect_list(F.struct("a", "b")).alias("own"))
    dashed = (F.col("n") >= 4) & (F.col("len") <= 12)
    whole = F.array(F.struct("a", "b"))
    return m.select(*keys, F.when(dashed, "dashed").otherwise("").alias("style"), F.explode(F.when(dashed, whole).otherwise(F.col("own"))).alias("s")).select(*keys, "style", "s.a", "s.b")


def visible_rules(rules: DataFrame, fills: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Rules neither hidden under a later fill nor drawn in the colour beneath, clipped to the page. ``rules``: page,
    rule_no, dir, pos, a, b, width, color, paint_order."""
    h = F.col("dir") == "h"
    half = F.col("width") / 2
    box = rules.select(
        "*", F.when(h, F.col("a")).otherwise(F.col("pos") - half).alias("_x0"), F.when(h, F.col("b")).otherwise(F.col("pos") + half).alias("_x1"),
        F.when(h, F.col("pos") - half).otherwise(F.col("a")).alias("_y0"), F.when(h, F.col("pos") + half).otherwise(F.col("b")).alias("_y1"),
    )
    f = fills.select(*PAGE, F.col("paint_order").alias("f_order"), F.col("color").alias("f_color"), F.col("x").alias("fx0"), (F.col("x") + F.col("w")).alias("fx1"), F.col("y").alias("fy0"), (F.col("y") + F.col("h")).alias("fy1"))

    def within(tol: float) -> Column:
        return (F.col("fx0") <= F.col("_x0") + tol) & (F.col("fx1") >= F.col("_x1") - tol) & (F.col("fy0") <= F.col("_y0") + tol) & (F.col("fy1") >= F.col("_y1") - tol)

    over = bucket_join(box, f, PAGE, ("_y0", "_y1"), ("fy0", "fy1"), 80.0, pad=0.25, extra=within(0.25) & (F.col("f_order") != F.col("paint_order")))
    later = (F.col("f_order") > F.col("paint_order")) & within(0.1)
    seen = over.groupBy(*PAGE, "rule_no").agg(
        F.max(later).alias("hidden"), F.max_by(F.when(F.col("f_order") < F.col("paint_order"), F.col("f_color")), F.when(F.col("f_order") < F.col("paint_order"), F.col("f_order"))).alias("under")
    )
    j = rules.join(seen, [*PAGE, "rule_no"], "left")
    drawn = ~F.coalesce("hidden", F.lit(False)) & (G.color_distance(F.col("color"), F.coalesce("under", F.lit("FFFFFF"))) > 2)
    lo = F.greatest("a", F.lit(0.0))
    hi = F.least("b", F.when(h, page_w).otherwise(page_h))
    return j.filter(drawn).withColumn("a", lo).withColumn("b", hi).filter(F.col("b") - F.col("a") >= 1).drop("hidden", "under")


def _near(b: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of boxes nearer than the gap. Boxes sorted by their left edge meet those that begin before they end, in
    slices of bounded size."""
    last = np.searchsorted(b[:, 0], b[:, 2] + gap, side="right")
    many = np.maximum(last - np.arange(len(b)) - 1, 0)
    found = [(np.zeros(0, np.int64),) * 2]
    ends = np.cumsum(many)
    at = 0
    while at < len(b):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), side="right")))
        n = many[at:to]
        i = np.repeat(np.arange(at, min(to, len(b))), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        ok = (b[j, 1] <= b[i, 3] + gap) & (b[i, 1] <= b[j, 3] + gap)
        found.append((i[ok], j[ok]))
        at = to
    return tuple(np.concatenate(x) for x in zip(*found))


def cluster_boxes(boxes: DataFrame, gap: float = 2.0) -> DataFrame:
    """Boxes nearer than ``gap`` merged to their bounds until none are near; one method for every page."""
    cols = [*PAGE, "x", "y", "x1", "y1", "members"]
    given = boxes.select(*PAGE, "x", "y", (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"), F.lit(1).cast("bigint").alias("members"))

    def page(g: dict) -> list:
        key = tuple(g[k][0] for k in PAGE)
        boxes = list(zip(*(g[c] for c in cols[2:])))
        if len(boxes) > FEW or any(None in b for b in boxes):
            b = _clusters(np.array(boxes, dtype=float), gap)
            return [(*key, *(None if v != v else v for v in r[:4]), int(r[4])) for r in b.tolist()]
        while True:
            boxes.sort()
            root = list(range(len(boxes)))
            for i, (_, y0, x1, y1, _) in enumerate(boxes):
                for j in range(i + 1, len(boxes)):
                    other = boxes[j]
                    if other[0] > x1 + gap:
                        break
                    if other[1] <= y1 + gap and y0 <= other[3] + gap and root[i] != root[j]:
                        low, high = sorted((root[i], root[j]))
                        root = [low if r == high else r for r in root]
            if root == list(range(len(boxes))):
                return [(*key, *b) for b in boxes]
            merged: dict = {}
            for r, b in zip(root, boxes):
                o = merged.get(r)
                merged[r] = b if o is None else (min(o[0], b[0]), min(o[1], b[1]), max(o[2], b[2]), max(o[3], b[3]), o[4] + b[4])
            boxes = list(merged.values())

    return grouped_rows(given.select(*cols), PAGE, page, _schema(given, cols))


def _clusters(b: np.ndarray, gap: float) -> np.ndarray:
    """The same over arrays (x, y, x1, y1, members), for pages of many boxes."""
    while True:
        b = b[np.lexsort((b[:, 1], b[:, 0]))]
        i, j = _near(b, gap)
        if not len(i):
            return b
        root = np.arange(len(b))
        while (root[i] != root[j]).any():
            np.minimum.at(root, np.maximum(root[i], root[j]), np.minimum(root[i], root[j]))
            while (root[root] != root).any():
                root = root[root]
        order = np.argsort(root, kind="stable")
        cut = np.flatnonzero(np.append(True, np.diff(root[order]) > 0))
        low, high = np.minimum.reduceat(b[order, :2], cut), np.maximum.reduceat(b[order, 2:4], cut)
        b = np.hstack([low, high, np.add.reduceat(b[order, 4:], cut)])


def vector_art(areas: DataFrame, words: DataFrame, tables: DataFrame, pictures: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Areas of art worth cropping, with their rank by size on the page; callers that want few filter on it. All tables:
    page and box; ``areas`` with area_no."""
    size = F.col("w") * F.col("h")
    tiny = (F.greatest("w", "h") < 6) | (size < 36) | (F.least("w", "h") < 2)
    big = areas.filter(~tiny & (size <= 0.6 * page_w * page_h))
    span = big.withColumn("_y1", F.col("y") + F.col("h"))

    def covered(other: DataFrame) -> DataFrame:
        o = other.select(*PAGE, *[F.col(c).alias(f"o{c}") for c in "xywh"], (F.col("y") + F.col("h")).alias("o_y1"))
        j = bucket_join(span, o, PAGE, ("y", "_y1"), ("oy", "o_y1"), 100.0)
        return j.withColumn("ov", G.overlap(G.box(), G.box("o")))

    clash = covered(tables).filter(F.col("ov") > 0.05 * F.least(size, F.col("ow") * F.col("oh"))).select(*PAGE, "area_no").distinct()
    photo = covered(pictures).filter(F.col("ov") > 0.05 * size).select(*PAGE, "area_no").distinct()
    text = covered(words).groupBy(*PAGE, "area_no").agg(F.sum("ov").alias("under"))
    kept = big.join(clash, [*PAGE, "area_no"], "left_anti").join(photo, [*PAGE, "area_no"], "left_anti").join(text, [*PAGE, "area_no"], "left")
    kept = kept.filter(F.coalesce("under", F.lit(0.0)) <= 0.3 * size)
    w = Window.partitionBy(*PAGE).orderBy(F.desc(F.col("w") * F.col("h")), "area_no")
    return kept.withColumn("rank", F.row_number().over(w)).select(*PAGE, "area_no", "x", "y", "w", "h", "rank")


def two_colors(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Background and text colour of a region by two means over its colours. Equal pixels are counted before regions
    are gathered, so a region is as large as its palette. ``pixels``: keys, r, g, b."""
    palette = pixels.groupBy(*keys, "r", "g", "b").agg(F.count("*").alias("n"))
    light = np.array([0.299, 0.587, 0.114])

    def region(g: dict) -> list:
        colors = np.array(sorted(zip(g["r"], g["g"], g["b"], g["n"])), dtype=float)
        rgb, n = colors[:, :3], colors[:, 3]
        lum = rgb @ light
        centre = np.array([rgb[np.argmin(lum)], rgb[np.argmax(lum)]])
        side = np.zeros(len(rgb), dtype=int)
        for _ in range(6):
            d = ((rgb[:, None, :] - centre[None]) ** 2).sum(-1)
            side = np.where(d[:, 0] < d[:, 1], 0, 1)
            for k in (0, 1):
                if n[side == k].sum() > 0:
                    centre[k] = (rgb[side == k] * n[side == k, None]).sum(0) / n[side == k].sum()
        weight = [n[side == k].sum() for k in (0, 1)]
        back = 0 if weight[0] >= weight[1] else 1
        d = ((rgb[:, None, :] - centre[None]) ** 2).sum(-1)
        ours = d[:, 1 - back] < d[:, back]
        dark = centre[1 - back] @ light < centre[back] @ light
        pick = centre[1 - back]
        if ours.any():
            idx = np.flatnonzero(ours)
            pick = rgb[idx[np.argmin(lum[idx])] if dark else idx[np.argmax(lum[idx])]]
        if pick.max() - pick.min() < 8:
            pick = np.full(3, 255.0) if np.linalg.norm(255 - pick) < 10 else np.zeros(3) if np.linalg.norm(pick) < 10 else pick
        if pick @ light < 40 and pick.max() - pick.min() < 18:
            pick = np.zeros(3)
        name = lambda c: "".join(f"{int(np.floor(v + 0.5)):02X}" for v in c)
        return [(*(g[k][0] for k in keys), name(centre[back]), name(pick))]

    return grouped_rows(palette, keys, region, _schema(pixels, keys) + ", background string, ink string")
