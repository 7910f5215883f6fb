"""Shards by jump consistent hashing (Lamping and Veach): a key and the number of shards decide, no ring table is kept,
and one more shard draws in only the share of keys that it must hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.llm import shared

#: Parts into which the numbering of a shard is cut.
BLOCKS = 1024


def jump(key: Column, shards: int) -> Column:
    """Shard of a key, 0 to shards - 1. Every jump draws 31 fresh bits from the key and the jump's number and goes at
    least one shard on, so ``shards`` steps always reach the end; later steps leave the state as it is."""

    def step(state: Column, number: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(key, number), 33) + 1
        further = F.floor((state["next"] + 1) * (F.lit(float(1 << 31)) / draw))
        return F.when(state["next"] < shards, F.struct(state["next"].alias("at"), further.alias("next"))).otherwise(state)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["at"].cast("int"))


def shard_rows(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: the key, ``size`` (UTF-8 bytes of the text plus 16), ``text_crc32``, ``law`` ("key"),
    ``shard``, ``slot`` (gapless from 0 within the shard) and ``grown_shard`` (with one shard more).

    A null text counts as no bytes, a null key is a key of its own. Rows of one key share a shard and have slots of
    their own; rows equal in key, checksum and size are interchangeable. An empty table gives no rows. Other columns of df,
    whatever their names, are left out. Texts are read once: keys, sizes and checksums are written to the shared folder. A
    shard is numbered in BLOCKS parts by key, checksum and size, so that no task sees a whole shard or all of a hot key."""
    own = df.select(F.col(key).alias("key"), F.col(text).alias("body"))
    rows = own.select(
        "key",
        (F.coalesce(F.octet_length("body"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("body", F.lit("")).cast("binary")).alias("text_crc32"),
        jump(F.col("key"), shards).alias("shard"),
        jump(F.col("key"), shards + 1).alias("grown_shard"),
    ).withColumn("block", F.pmod(F.xxhash64("key", "text_crc32", "size"), F.lit(BLOCKS)).cast("int"))
    rows = shared.keep(rows, "shards")
    sizes = rows.groupBy("shard", "block").agg(F.count("*").alias("held"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "block", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("key", "text_crc32", "size"))
    numbered = rows.withColumn("inside", inside).join(starts, ["shard", "block"])
    return numbered.select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("inside") - 1).cast("long").alias("slot"), "grown_shard")
