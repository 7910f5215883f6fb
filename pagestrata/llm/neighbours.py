"""Approximate nearest neighbours by learned partitions (Dong and others): the neighbour graph of a sample is cut into balanced
parts, a small classifier learns which part a vector belongs to, every row is indexed in its most probable part, and queries go
to their several most probable parts, where candidates are ranked by exact cosine."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that the index is fitted on at most, its parts, neighbours in the graph, and parts that a query looks into.
SAMPLE, PARTS, NEIGHBOURS, PROBES = 8192, 32, 10, 22
#: Rows of a part that one task ranks at once.
BLOCK = 1 << 15


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safe for very large and very small components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def balanced_parts(x: np.ndarray, parts: int, neighbours: int) -> np.ndarray:
    """Parts of about equal size that cut few edges of the neighbour graph: halved again and again, each half by spreading
    a split along the first differing direction over the graph and cutting at the median."""
    n = len(x)
    near = np.empty((n, min(neighbours, max(1, n - 1))), np.int64)
    for a in range(0, n, 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        near[a : a + 1024] = np.argpartition(-s, near.shape[1] - 1, axis=1)[:, : near.shape[1]] if n > near.shape[1] else np.arange(near.shape[1])
    part = np.zeros(n, np.int64)
    rounds = max(0, int(parts - 1).bit_length())
    for level in range(rounds):
        split = np.empty(n)
        for p in range(1 << level):
            own = np.nonzero(part == p)[0]
            if len(own):
                middle = x[own] - x[own].mean(axis=0)
                direction = np.linalg.svd(middle, full_matrices=False)[2][0] if len(own) > 1 else x[own][0]
                split[own] = middle @ direction
        value = np.zeros(n)
        for p in range(1 << level):
            own = np.nonzero(part == p)[0]
            value[own[np.argsort(split[own], kind="stable")]] = np.linspace(-1, 1, len(own)) if len(own) > 1 else 0
        for _ in range(12):  # neighbours draw a vector to their side
            same = part[near] == part[:, None]
            pull = (value[near] * same).sum(axis=1) / np.maximum(1, same.sum(axis=1))
            value = 0.3 * value + 0.7 * pull
            for p in range(1 << level):
                own = np.nonzero(part == p)[0]
                if len(own) > 1:
                    value[own[np.argsort(value[own], kind="stable")]] = np.linspace(-1, 1, len(own))
        part = part * 2 + (value > 0)
    return part


def fit(x: np.ndarray, parts: int, neighbours: int, steps: int = 250) -> np.ndarray:
    """Weights of a softmax classifier (a row for each component and one for the bias) for the parts of the sample's graph."""
    x = unit(x)
    part = balanced_parts(x, parts, neighbours)
    kinds = 1 << max(0, int(parts - 1).bit_length())
    z, truth = np.hstack([x, np.ones((len(x), 1))]), np.eye(kinds)[part]
    weight, first, second = np.zeros((z.shape[1], kinds)), 0.0, 0.0
    for t in range(1, steps + 1):
        slope = z.T @ (softmax(z @ weight) - truth) / len(z) + 1e-5 * weight
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weight = weight - 0.3 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return weight


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def rows_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def fit_index(vectors: DataFrame, rows: int = SAMPLE, parts: int = PARTS, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """The classifier, fitted in one task on the ``rows`` vectors with the smallest hash of their id. vectors: ``id``, ``x``."""
    drawn = vectors.orderBy(F.xxhash64("id"), "id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [rows_of(b.column(1)) for b in batches if b.num_rows]
        out = io.BytesIO()
        np.save(out, fit(np.concatenate(found), parts, neighbours) if found else np.zeros((1, 1)))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    made = drawn.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").mapInArrow(run, "model binary").first()
    return np.load(io.BytesIO(bytes(made["model"]))) if made else np.zeros((1, 1))  # an empty plan runs no task


def routed(vectors: DataFrame, weight: np.ndarray, probes: int) -> DataFrame:
    """``id``, ``x`` and ``part``: one row for each of a vector's ``probes`` most probable parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = rows_of(batch.column(1))
            told = np.hstack([unit(x), np.ones((len(x), 1))]) @ weight
            best = np.argsort(-told, axis=1, kind="stable")[:, :probes]
            row = pa.array(np.repeat(np.arange(len(x)), best.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(best.ravel().astype(np.int32))], ["id", "x", "part"])

    return vectors.mapInArrow(run, "id long, x array<double>, part int")


def search(table: DataFrame, queries: Column, most: int = 5, key: str = "vec_id", vector: str = "embedding", rows: int = SAMPLE, parts: int = PARTS, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """For each row where ``queries`` holds: ``query_id``, ``rank`` from 1, the neighbour's key, and ``score``, the cosine in
    double precision of the original vectors; nearest first, ties to the smaller key, the query's own row left out.

    Vectors that are null, empty, zero or hold nulls or non-finite numbers take no part, nor do null keys; rows of one key
    with several vectors count with the one that is smallest in order, repeats once. Vectors must have one length. An empty
    table has no rows; other columns are left out. All rows are indexed; a part beyond ``block`` rows is ranked in blocks, so
    that a part holding a third of all rows is spread, and every query meets every block of the parts it looks into."""
    given = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), F.coalesce(queries, F.lit(False)).alias("asks")).where(usable(F.col("x")) & F.col("id").isNotNull())
    single = given.groupBy("id").agg(F.min("x").alias("x"), F.max("asks").alias("asks"))
    weight = fit_index(single.select("id", "x"), rows, parts)
    indexed = routed(single.select("id", "x"), weight, 1)
    asked = routed(single.where("asks").select("id", "x"), weight, probes)
    sizes = {r["part"]: r["count"] for r in indexed.groupBy("part").count().collect()}  # one row a part
    blocks = {p: -(-n // block) for p, n in sizes.items()}
    # A small part is ranked in a few blocks too, so that there is work for every task.
    spread = F.create_map(*[F.lit(x) for p, n in blocks.items() for x in (p, max(n, 2))]) if blocks else F.create_map(F.lit(-1), F.lit(1))
    held = indexed.withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce(spread[F.col("part")], F.lit(1))).cast("int"))
    looks = asked.where(F.col("part").isin(list(blocks))).withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce(spread[F.col("part")], F.lit(1)) - 1)))

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            left = left.combine_chunks()
            ids, x = left.column("id").to_numpy(), unit(rows_of(left.column("x").combine_chunks()))
            for batch in right.to_batches(max_chunksize=max(1, (1 << 18) // len(ids))):
                asks, y = batch.column("id").to_numpy(), unit(rows_of(batch.column("x")))
                s = y @ x.T
                s[asks[:, None] == ids] = -np.inf
                top = min(most, len(ids))
                edge = np.partition(s, len(ids) - top, axis=1)[:, len(ids) - top]
                q, i = np.nonzero((s >= edge[:, None] - 1e-12) & (s > -np.inf))
                exact = np.einsum("ij,ij->i", y[q], x[i])  # the same for equal vectors, wherever they stand
                order = np.lexsort((ids[i], -exact, q))
                q, i, exact = q[order], i[order], exact[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                first = place < top
                out.append((asks[q[first]], ids[i[first]], exact[first]))
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(a, pa.int64()), "found": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    near = held.groupBy("part", "block").cogroup(looks.groupBy("part", "block")).applyInArrow(rank, "query_id long, found long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "found")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return best.select("query_id", "rank", F.col("found").alias(key), "score")
