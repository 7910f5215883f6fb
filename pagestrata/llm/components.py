"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris and others)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.llm import shared

#: Parts into which the links of a node are dealt.
SPREAD = 64


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node that it reaches, for every node that is not its own root.

    Both ends are longs. Self-links and repeats count once or not at all; an empty table has no rows. A node's links are spread
    over SPREAD parts, so that the centre of a star is no single task; every round is written to the shared folder."""
    pairs = links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).where("node <> root").distinct()
    now = shared.keep(pairs, "links")
    told = _state(now)
    while told[0]:
        both = now.union(now.select(F.col("root"), F.col("node")))
        told_low = _with_least(both).where("root > node")
        large = shared.keep(told_low.select(F.col("root").alias("node"), F.least("low", "node").alias("root")).distinct(), "large")
        small = _with_least(large).select(F.explode(F.array(F.struct(F.col("root").alias("node"), F.col("low").alias("root")), F.struct("node", F.col("low").alias("root")))).alias("x"))
        now = shared.keep(small.select("x.node", "x.root").where("node <> root").distinct(), "links")
        before, told = told, _state(now)
        if before == told:
            break
    return now


def _with_least(links: DataFrame) -> DataFrame:
    """links with ``low``, the least root of their node. Links meet it by node and part; a node is joined by itself only as its
    parts, SPREAD rows at most."""
    dealt = links.withColumn("part", F.pmod(F.xxhash64("root"), F.lit(SPREAD)).cast("int"))
    parts = dealt.groupBy("node", "part").agg(F.min("root").alias("low"))
    least = parts.groupBy("node").agg(F.min("low").alias("low"))
    return dealt.join(parts.select("node", "part").join(least, "node"), ["node", "part"]).select("node", "root", "low")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first())
