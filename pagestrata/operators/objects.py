"""Objects and references of files: image use, identical streams, reachability, stray references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.session import cut_lineage

# Which pictures are worth re-encoding.
MIN_PIXELS = 64 * 64
MAX_PIXELS = 40_000_000
MIN_BYTES = 8 * 1024
KEEP_SIZE_ABOVE = 0.85


def image_usage(images: DataFrame, placements: DataFrame, max_dpi: float = 150.0) -> DataFrame:
    """Largest size each picture is painted at, whether it may be re-encoded and at what scale. ``images``: image_id,
    px_w, px_h, bytes, bits, space, stencil, mask_id, has_mask, has_decode, matte; ``placements``: image_id, w, h."""
    used = placements.groupBy("image_id").agg(F.max("w").alias("w"), F.max("h").alias("h"))
    masks = images.select(F.col("mask_id").alias("image_id")).filter("image_id IS NOT NULL").distinct()
    pixels = F.col("px_w") * F.col("px_h")
    ok = (
        F.col("space").isin("gray", "rgb")
        & pixels.between(MIN_PIXELS, MAX_PIXELS)
        & (F.col("bytes") >= MIN_BYTES)
        & (F.col("bits") == 8)
        & ~(F.col("stencil") | F.col("has_mask") | F.col("has_decode") | F.col("matte"))
    )
    need = F.greatest(F.col("w") / 72 * max_dpi / F.col("px_w"), F.col("h") / 72 * max_dpi / F.col("px_h"))
    scale = F.when((need > 0) & (need < KEEP_SIZE_ABOVE), need).otherwise(1.0)
    j = images.join(used, "image_id").join(masks, "image_id", "left_anti").filter(ok).withColumn("scale", scale)

    def side(c: str) -> Column:
        return F.greatest(F.lit(1), F.floor(F.col(c) * F.col("scale") + 0.5)).cast("int")

    return j.select("image_id", "w", "h", "scale", side("px_w").alias("out_w"), side("px_h").alias("out_h"))


def dedup_streams(objects: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Identical objects become the first of them. Returns (id -> kept id for every object, rewritten references).
    ``objects``: id, header, content; ``refs``: src, pos, dst. Merging children can make parents identical, hence the
    passes, until one changes nothing. An object's references enter its identity as two sums of seeded hashes, so no list of them is collected."""
    body = objects.select("id", F.length("content").alias("len"), "header", F.sha2(F.col("content").cast("binary"), 256).alias("sha"))
    alive = cut_lineage(body.withColumn("kept", F.col("id")))
    links = refs
    while True:
        mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), "pos", "dst").cast("decimal(38,0)"))
        shape = links.groupBy(F.col("src").alias("id")).agg(mark(1).alias("m1"), mark(2).alias("m2"))
        firsts = alive.filter("id = kept").join(shape, "id", "left")
        same = ["len", "header", "sha", "m1", "m2"]
        first = firsts.groupBy(*same).agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
        cond = [firsts[c].eqNullSafe(first[c]) for c in same]
        swap = cut_lineage(firsts.join(first, cond).filter("id <> first").select(F.col("id").alias("gone"), F.col("first").alias("to")))
        if swap.limit(1).count() == 0:
            break
        alive = alive.join(swap, F.col("kept") == F.col("gone"), "left").select("id", "len", "header", "sha", F.coalesce("to", "kept").alias("kept"))
        links = links.join(swap, F.col("dst") == F.col("gone"), "left").select("src", "pos", F.coalesce("to", "dst").alias("dst"))
        links = cut_lineage(links.join(swap.select(F.col("gone").alias("src")), "src", "left_anti"))
        alive = cut_lineage(alive)
    return alive.select("id", "kept"), links


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes the roots lead to (column node). Each round carries only nodes seen for the first time."""
    seen = cut_lineage(roots.select("node").distinct())
    front = seen
    while True:
        step = edges.join(front.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct()
        front = cut_lineage(step.join(seen, "node", "left_anti"))
        if front.limit(1).count() == 0:
            return seen
        seen = cut_lineage(seen.unionByName(front))


def remap_stray_refs(refs: DataFrame, pages: DataFrame, real: DataFrame) -> DataFrame:
    """References to stray copies of pages point to the real page, found by the mark of a redacted page or by equal
    content, else to nothing. ``pages``: id, mark, content; ``real``: id, index; refs: src, dst."""
    kept = pages.join(real, "id")
    by_content = kept.filter("content IS NOT NULL").groupBy("content").agg(F.min_by("id", "index").alias("to_content"))
    by_mark = real.select(F.col("index").alias("mark"), F.col("id").alias("to_mark"))
    stray = pages.join(real, "id", "left_anti").join(by_mark, "mark", "left").join(by_content, "content", "left")
    target = F.when(F.col("mark").isNotNull(), F.col("to_mark")).otherwise(F.col("to_content"))
    swap = stray.select(F.col("id").alias("dst"), target.alias("to"), F.lit(True).alias("stray"))
    j = refs.join(swap, "dst", "left")
    return j.select("src", "dst", F.when(F.col("stray"), F.col("to")).otherwise(F.col("dst")).alias("target"))
