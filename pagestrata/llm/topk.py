"""Exact top-k search by inner product with the three-phase uniform threshold (Cao and Wang).

The components of a vector are cut into SLICES lists; a candidate's score is the sum of its scores in them, and lists are kept
in shards of rows. Phase one: every shard names, for each list, the rows with the k best scores there, and their whole scores;
the k-th best of what is gathered for a query is a cutoff that its answer cannot fall below. Phase two: the cutoff is handed to
all shards; what scores below its SLICES-th part in every list cannot reach it, the rest is collected. Phase three: the whole
scores of what was collected are resolved in whole numbers, and those at the cutoff or above compete for the k places.

The cutoff carries the key of the row that set it, so that ties are cut off too: vectors that a third of all rows share
yield k rows a query, not their number. Shards meet blocks of queries in pairs of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.llm import shared

#: Lists that the components are cut into, rows of a shard, and queries of a block.
SLICES, SHARD, QUERIES = 4, 1 << 15, 1 << 13
#: Scores held at once by a task, and the shards that even a small table is cut into, so that there is work for every task.
CELLS, LEAST_SHARDS = 1 << 21, 8


def scaled(table: DataFrame, vector: str, factor: int) -> DataFrame:
    """table with each component x of ``vector`` replaced by floor(factor * x), x as a double; what a long cannot hold, and
    null or not-a-number components, make a vector null."""
    x = F.transform(F.col(vector).cast("array<double>"), lambda v: F.floor(F.lit(float(factor)) * v))
    fits = F.forall(F.col(vector).cast("array<double>"), lambda v: F.coalesce(~F.isnan(v) & (F.abs(F.lit(float(factor)) * v) < 2.0**63), F.lit(False)))
    return table.withColumn(vector, F.when(fits, x))


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of y with those of x, exact: in doubles where they hold every sum, else in longs, and else
    in Python's whole numbers."""
    most = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(y.astype(np.float64)).max(initial=0)) * x.shape[1]
    if most < 2.0**53:
        return (y.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return y @ x.T
    return y.astype(object) @ x.astype(object).T


def longs(scores: np.ndarray) -> np.ndarray:
    """Scores cut off at the bounds of a long."""
    return scores if scores.dtype == np.int64 else np.clip(scores, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, open_to: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``most`` highest scores of each row among the open places, best first; ties to the left."""
    width = scores.shape[1]
    top, bits = min(most, width), width.bit_length()
    if not top:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if np.abs(scores.astype(np.float64)).max(initial=0) < 2.0 ** (62 - bits):  # place and score in one number: no ties are left
        joint = np.where(open_to, (scores << bits) + (width - 1 - np.arange(width)), -(2**63))
        joint = -np.sort(-np.partition(joint, width - top, axis=1)[:, width - top :], axis=1)
        row, place = np.nonzero(joint > -(2**63))
        return row, width - 1 - (joint[row, place] & ((1 << bits) - 1))
    order = np.argsort(~scores, axis=1, kind="stable")
    order = np.take_along_axis(order, np.argsort(~np.take_along_axis(open_to, order, 1), axis=1, kind="stable")[:, :top], 1)
    row, place = np.nonzero(np.take_along_axis(open_to, order, 1))
    return row, order[row, place]


def _matrices(table: pa.Table, *more: str) -> Iterator[tuple]:
    """For each length of vectors: the length, the keys ascending, their vectors, and further columns."""
    table = table.combine_chunks().sort_by("id")
    if not table.num_rows:
        return
    x = table.column("x").combine_chunks()
    sizes, flat, ends = np.diff(x.offsets.to_numpy()), x.flatten().to_numpy(), np.cumsum(np.diff(x.offsets.to_numpy()))
    ids, others = table.column("id").to_numpy(), [table.column(c).to_numpy(zero_copy_only=False) for c in more]
    for size in np.unique(sizes).tolist():
        at = np.nonzero(sizes == size)[0]
        yield size, ids[at], flat[(ends[at] - size)[:, None] + np.arange(size)], *(c[at] for c in others)


def _met(left: pa.Table, right: pa.Table, slices: int, *more: str) -> Iterator[tuple]:
    """Keys of rows, keys of some queries, scores by list (queries x rows each), the places that are not a query's own row,
    and the queries' further columns."""
    rows = {size: rest for size, *rest in _matrices(left)}
    for size, asks, y, *others in _matrices(right, *more):
        if size not in rows:
            continue
        ids, x = rows[size]
        cuts = np.array_split(np.arange(size), min(slices, size))
        step = max(1, CELLS // len(ids))
        for a in range(0, len(asks), step):
            part = slice(a, a + step)
            yield ids, asks[part], [products(x[:, c], y[part][:, c]) for c in cuts], asks[part][:, None] != ids, [c[part] for c in others]


def _found(out: list[tuple[np.ndarray, ...]]) -> pa.Table:
    names = ("query_id", "found", "score")
    return pa.table({n: pa.array(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64), pa.int64()) for i, n in enumerate(names)})


def total(parts: list[np.ndarray]) -> np.ndarray:
    """The sum of the lists' scores, cut off at the bounds of a long."""
    small = sum(float(np.abs(p.astype(np.float64)).max(initial=0)) for p in parts) < 2.0**62
    return longs(sum(parts[1:], parts[0]) if small else sum((p.astype(object) for p in parts[1:]), parts[0].astype(object)))


def gather(left: pa.Table, right: pa.Table, most: int, slices: int) -> pa.Table:
    """Phase one in a shard: of the rows that lead one of the lists, those with the best whole scores."""
    out = []
    for ids, asks, parts, others_rows, _ in _met(left, right, slices):
        named = np.zeros(others_rows.shape, bool)
        for p in parts:
            named[best(longs(p), others_rows, most)] = True
        score = total(parts)
        q, i = best(score, named, most)
        out.append((asks[q], ids[i], score[q, i]))
    return _found(out)


def collect(left: pa.Table, right: pa.Table, most: int, slices: int) -> pa.Table:
    """Phases two and three in a shard: rows that reach the cutoff's share in some list, then those whose whole scores reach it."""
    out = []
    for ids, asks, parts, others_rows, (cutoff, last) in _met(left, right, slices, "cutoff", "last"):
        share = cutoff // len(parts) + (cutoff % len(parts) != 0)  # rounded up: whole scores below it in every list stay below the cutoff
        enough = others_rows & np.logical_or.reduce([p >= share[:, None] for p in parts])
        score = total(parts)
        enough &= (score > cutoff[:, None]) | ((score == cutoff[:, None]) & (ids <= last[:, None]))
        q, i = best(score, enough, most)
        out.append((asks[q], ids[i], score[q, i]))
    return _found(out)


def search(table: DataFrame, queries: Column, most: int = 20, key: str = "vec_id", vector: str = "embedding", slices: int = SLICES, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """For each row where ``queries`` holds: ``query_id``, ``rank`` from 1, the found row's key, and ``score``, the inner product
    of the vectors of whole numbers; highest first, ties to the smaller key, the query's own row left out. All candidates, if
    there are fewer than ``most``.

    Vectors that are null, empty or hold nulls take no part, nor do null keys; vectors of different lengths do not meet. Of
    several vectors under one key the smallest in order counts; repeats count once. Scores beyond a long are cut off at its
    bounds. An empty table has no rows; other columns are left out."""
    whole = F.coalesce((F.size(vector) > 0) & F.forall(F.col(vector), lambda v: v.isNotNull()), F.lit(False)) & F.col(key).isNotNull()
    given = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<long>").alias("x"), F.coalesce(queries, F.lit(False)).alias("asks"), whole.alias("ok")).where("ok")
    vectors = shared.keep(given.groupBy("id").agg(F.min("x").alias("x"), F.max("asks").alias("asks")), "vectors")
    rows, asking = vectors.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(LEAST_SHARDS, -(-rows // shard)), max(1, -(-asking // block))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = vectors.select("id", "x", own(shards).alias("shard"), every(blocks).alias("block"))
    asked = vectors.where("asks").select("id", "x", own(blocks).alias("block"))
    everywhere = lambda df: df.withColumn("shard", every(shards))
    pairs = lambda df: held.groupBy("shard", "block").cogroup(df.groupBy("shard", "block"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "found"))).where(F.col("rank") <= most)
    kind = "query_id long, found long, score long"
    local = ranked(pairs(everywhere(asked)).applyInArrow(lambda a, b: gather(a, b, most, slices), kind))
    # Fewer than k gathered rows are all there are: then nothing is cut off.
    lowest = local.where(F.col("rank") == most).select(F.col("query_id").alias("id"), F.col("score").alias("cutoff"), F.col("found").alias("last"))
    told = shared.keep(asked.join(lowest, "id", "left").fillna({"cutoff": -(2**63), "last": 2**63 - 1}), "cutoffs")
    exact = ranked(pairs(everywhere(told)).applyInArrow(lambda a, b: collect(a, b, most, slices), kind))
    return exact.select("query_id", "rank", F.col("found").alias(key), "score")
