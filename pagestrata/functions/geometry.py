"""Colour, box and interval arithmetic on columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.operators.common import islands

# ── colour ───────────────────────────────────────────────────────────────────────────────────────────────────────


def channel(hexa: Column, i: int) -> Column:
    return F.conv(F.substring(hexa, 1 + 2 * i, 2), 16, 10).cast("int")


def channels(hexa: Column) -> list[Column]:
    return [channel(hexa, i) for i in range(3)]


def hex_of(r: Column, g: Column, b: Column) -> Column:
    return F.concat(*[F.lpad(F.hex(c.cast("long")), 2, "0") for c in (r, g, b)])


def luminance(hexa: Column) -> Column:
    def linear(c):
        v = c / F.lit(255.0)
        return F.when(v <= 0.03928, v / F.lit(12.92)).otherwise(F.pow((v + 0.055) / F.lit(1.055), F.lit(2.4)))

    r, g, b = channels(hexa)
    return F.lit(0.2126) * linear(r) + F.lit(0.7152) * linear(g) + F.lit(0.0722) * linear(b)


def chroma(hexa: Column) -> Column:
    c = channels(hexa)
    return F.greatest(*c) - F.least(*c)


def over_white(hexa: Column, alpha: Column) -> Column:
    def blend(c):
        return F.floor(F.lit(255.0) * (F.lit(1.0) - alpha * (F.lit(1.0) - c / F.lit(255.0))) + F.lit(0.5))

    return F.when(alpha >= 0.98, F.upper(hexa)).otherwise(hex_of(*[blend(c) for c in channels(hexa)]))


def color_distance(a: Column, b: Column) -> Column:
    return F.greatest(*[F.abs(x - y) for x, y in zip(channels(a), channels(b))])


def same_color(a: Column, b: Column, tol: int = 40) -> Column:
    return color_distance(a, b) <= tol


def snap_ink(hexa: Column) -> Column:
    """Dark, nearly grey ink is black."""
    return F.when((chroma(hexa) < 28) & (F.greatest(*channels(hexa)) < 70), "000000").otherwise(F.upper(hexa))


def snap_pure(hexa: Column) -> Column:
    """Almost white or black without a tint is pure."""
    c = channels(hexa)
    white = F.sqrt(sum(((F.lit(255.0) - v) * (F.lit(255.0) - v) for v in c), F.lit(0.0)))
    black = F.sqrt(sum((v * v * F.lit(1.0) for v in c), F.lit(0.0)))
    flat = chroma(hexa) < 8
    return F.when(flat & (white < 10), "FFFFFF").when(flat & (black < 10), "000000").otherwise(F.upper(hexa))


# ── boxes: four columns each ─────────────────────────────────────────────────────────────────────────────────────

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(prefix + n) for n in ("x", "y", "w", "h"))


def area(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b[2]) * F.greatest(F.lit(0.0), b[3])


def overlap(a: Box, b: Box) -> Column:
    dx = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    dy = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), dx) * F.greatest(F.lit(0.0), dy)


def contains(outer: Box, inner: Box, tol: float = 1.0) -> Column:
    return (
        (inner[0] >= outer[0] - tol)
        & (inner[1] >= outer[1] - tol)
        & (inner[0] + inner[2] <= outer[0] + outer[2] + tol)
        & (inner[1] + inner[3] <= outer[1] + outer[3] + tol)
    )


def union_box(a: Box, b: Box) -> Box:
    x, y = F.least(a[0], b[0]), F.least(a[1], b[1])
    return x, y, F.greatest(a[0] + a[2], b[0] + b[2]) - x, F.greatest(a[1] + a[3], b[1] + b[3]) - y


# ── intervals: rows with lo and hi ───────────────────────────────────────────────────────────────────────────────


def interval_gaps(spans: DataFrame, keys: Sequence[str], lo: str, hi: str, least: float) -> DataFrame:
    """Free stretches of at least ``least`` between the spans of a key."""
    w = Window.partitionBy(*keys).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    seen = spans.withColumn("_reach", F.max(hi).over(w))
    return seen.filter(F.col(lo) - F.col("_reach") >= least).select(
        *keys, F.col("_reach").alias("gap_lo"), F.col(lo).alias("gap_hi")
    )


def interval_coverage(spans: DataFrame, keys: Sequence[str], lo: str, hi: str, a: str, b: str) -> DataFrame:
    """Length of the union of the spans clipped to [a, b] (columns constant per key), and whether the edge is drawn."""
    c = spans.select(
        *keys, F.greatest(F.col(lo), F.col(a)).alias("_lo"), F.least(F.col(hi), F.col(b)).alias("_hi"), F.col(a).alias("_a"), F.col(b).alias("_b")
    )
    w = Window.partitionBy(*keys).orderBy("_lo", "_hi").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("_hi").over(w), F.col("_a"))
    part = F.greatest(F.lit(0.0), F.col("_hi") - F.greatest(F.col("_lo"), reach))
    sums = c.withColumn("_part", part).groupBy(*keys).agg(F.sum("_part").alias("covered"), (F.max("_b") - F.max("_a")).alias("span"))
    return sums.withColumn("drawn", F.col("covered") >= F.lit(0.6) * F.col("span") - 0.5)


def cluster_1d(points: DataFrame, keys: Sequence[str], pos: str, weight: str, tol: float = 2.0) -> DataFrame:
    """Positions within ``tol`` of the one before join a cluster: weighted mean position and total weight."""
    w = Window.partitionBy(*keys).orderBy(pos, weight)
    apart = F.col(pos) - F.lag(pos).over(w) > tol
    grouped = islands(points, keys, [F.col(pos), F.col(weight)], apart, "cluster")
    return grouped.groupBy(*keys, "cluster").agg(
        (F.sum(F.col(pos) * F.col(weight)) / F.sum(weight)).alias("pos"), F.sum(weight).alias("weight"), F.count("*").alias("n")
    )


def without_slivers(items: Column, least: float = 5.0) -> Column:
    """Of sorted lines (pos, weight) in an array, closer than ``least`` to their neighbour, the heavier stays: a left fold."""

    def step(acc, it):
        close = (F.size(acc) > 0) & (it["pos"] - F.try_element_at(acc, F.lit(-1))["pos"] < least)
        keep_old = F.try_element_at(acc, F.lit(-1))["weight"] >= it["weight"]
        return (
            F.when(~close, F.concat(acc, F.array(it)))
            .when(keep_old, acc)
            .otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(it)))
        )

    return F.aggregate(items, F.array().cast("array<struct<pos:double,weight:double>>"), step)


def drop_slivers(lines: DataFrame, keys: Sequence[str], least: float = 5.0) -> DataFrame:
    """Of lines closer than ``least`` to their neighbour the heavier stays: a left fold over a key's few lines, kept
    inside one array expression."""
    items = F.array_sort(F.collect_list(F.struct("pos", "weight")))
    kept = lines.select(*keys, F.col("pos").cast("double").alias("pos"), F.col("weight").cast("double").alias("weight"))
    out = kept.groupBy(*keys).agg(items.alias("_l")).select(*keys, F.posexplode(without_slivers(F.col("_l"), least)).alias("line_no", "_i"))
    return out.select(*keys, "line_no", "_i.pos", "_i.weight")


def ink_span(text: Column, x: Column, w: Column) -> Column:
    """struct<x0, x1>: extent without leading and trailing spaces."""
    n = F.length(text)
    step = w / n
    lead = n - F.length(F.regexp_replace(text, r"^\s+", ""))
    trail = n - F.length(F.regexp_replace(text, r"\s+$", ""))
    blank = F.trim(text) == ""
    return F.struct(
        F.when(blank, x).otherwise(x + lead * step).alias("x0"), F.when(blank, x + w).otherwise(x + w - trail * step).alias("x1")
    )


def char_xs(text: Column, x: Column, w: Column) -> Column:
    """Start of every character and the end, spread evenly."""
    n = F.length(text)
    return F.transform(F.sequence(F.lit(0), n), lambda i: x + i * (w / n))
