"""Building blocks shared by the operators: islands, bucketed range joins, running numbers by range, exact medians."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagestrata.session import cut_lineage

PAGE = ["doc_id", "page_no"]


def half_up(c: Column, steps: float) -> Column:
    """Half-up rounding to 1/steps (2 = halves, 100 = two decimals)."""
    return F.floor(c * F.lit(float(steps)) + F.lit(0.5)) / F.lit(float(steps))


def r4(c: Column) -> Column:
    return half_up(c, 10000)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence, start: Column, name: str = "island") -> DataFrame:
    """Number the stretches of rows that begin where ``start`` holds (the first row of a key always begins one)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flag = F.when(F.row_number().over(w) == 1, 0).otherwise(F.coalesce(start, F.lit(False)).cast("int"))
    flagged = df.withColumn("_start", flag)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return flagged.withColumn(name, F.sum("_start").over(run).cast("int")).drop("_start")


def upper_median(c: Column) -> Column:
    """s[floor(n/2)] of the non-null values; for groups bounded by a line, row or page."""
    s = F.array_sort(F.collect_list(c))
    return F.when(F.size(s) > 0, F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int")))


def lower_percentile(c: Column, p: float) -> Column:
    """s[floor(p*(n-1))] of the non-null values; for groups bounded by a line, row or page."""
    s = F.array_sort(F.collect_list(c))
    return F.when(F.size(s) > 0, F.element_at(s, (F.floor(F.lit(p) * (F.size(s) - 1)) + 1).cast("int")))


def middle_median(c: Column) -> Column:
    """Mean of the two middle values."""
    return F.percentile(c, F.lit(0.5))


def weighted_mode(df: DataFrame, keys: Sequence[str], value: str, weight: Column, prefer: str, name: str) -> DataFrame:
    """The value with most weight per key. The first aggregate combines map-side, so a hot key never reaches one
    task as rows: only its distinct values do. ``prefer`` breaks ties: "high" or "low"."""
    votes = df.groupBy(*keys, value).agg(F.sum(weight).alias("_n"))
    tie = F.col(value) if prefer == "high" else -F.col(value)
    return votes.groupBy(*keys).agg(F.max_by(F.col(value), F.struct(F.col("_n"), tie)).alias(name))


def bucket_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    step: float,
    pad: float = 0.0,
    extra: Column | None = None,
) -> DataFrame:
    """Range join of two tables of intervals: both sides are cut into ``step``-wide strips, joined on key and strip,
    and a pair is kept only in the first strip its overlap touches, so no pair is emitted twice and none is lost.
    Columns of both sides must have distinct names apart from ``keys``. ``pad`` widens the left interval. It is an inner
    join: rows with a null bound meet nothing; callers that keep unmatched rows join the pairs back by id."""
    ll, lh = F.col(left_span[0]) - pad, F.col(left_span[1]) + pad
    rl, rh = F.col(right_span[0]), F.col(right_span[1])
    bl = F.explode(F.sequence(F.floor(ll / step), F.floor(lh / step)))
    br = F.explode(F.sequence(F.floor(rl / step), F.floor(rh / step)))
    a = left.withColumn("_strip", bl)
    b = right.withColumn("_rstrip", br)
    for k in keys:
        b = b.withColumnRenamed(k, f"_r_{k}")
    same = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_r_{k}") for k in keys])
    first = F.col("_strip") == F.floor(F.greatest(ll, rl) / step)
    cond = same & (F.col("_strip") == F.col("_rstrip")) & (rl <= lh) & (rh >= ll)
    if extra is not None:
        cond = cond & extra
    drop = [f"_r_{k}" for k in keys] + ["_strip", "_rstrip"]
    # Strips multiply rows beyond what sizes of files tell, so neither side may be held whole.
    return a.hint("merge").join(b, cond & first, "inner").drop(*drop)


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows dealt by range of keys and order and sorted, so that a key of any size is spread by position: the one exchange
    that running numbers need. Written as a checkpoint, because ranges come from samples and must not change between two
    readings. ``_range`` says where a row lies."""
    every = [*keys, *order]
    return cut_lineage(df.repartitionByRange(*every).sortWithinPartitions(*every)).withColumn("_range", F.spark_partition_id())


def _run_sums(batches: Iterator[pa.RecordBatch], keys: list[int], amount: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range with the amounts of their key so far, their own included, in the last column."""
    last, carry = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        fresh = np.zeros(n, dtype=bool)
        for k in keys:
            a, b = batch.column(k).slice(0, n - 1), batch.column(k).slice(1)
            other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
            fresh[1:] |= other.to_numpy(zero_copy_only=False)
        head = [batch.column(k)[0].as_py() for k in keys]
        fresh[0] = head != last
        total = np.cumsum(pc.fill_null(batch.column(amount), 0).to_numpy(zero_copy_only=False))
        begins = np.flatnonzero(fresh)
        before = np.concatenate([[-carry], np.where(begins > 0, total[begins - 1], 0)])
        so_far = total - before[np.cumsum(fresh)]
        last, carry = [batch.column(k)[n - 1].as_py() for k in keys], int(so_far[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(so_far, pa.int64())], [*batch.schema.names, "_n"])


def running(laid: DataFrame, keys: Sequence[str], name: str, amount: Column | None = None) -> DataFrame:
    """Sum of ``amount`` (whole numbers, none negative; by default one a row) over a key's rows so far, for rows that
    ``in_ranges`` has laid out, filtered since or not. A task adds up its own range; only a range's first key can have begun
    in an earlier one, and what lies before it comes from one row per range. Null keys are one key; an empty table has no rows."""
    rows = laid.withColumn("_amount", (F.lit(1) if amount is None else amount).cast("bigint"))
    at = rows.columns

    def summed(df: DataFrame) -> DataFrame:
        places = [df.columns.index(k) for k in keys], df.columns.index("_amount")
        return df.mapInArrow(lambda batches: _run_sums(batches, *places), df.withColumn("_n", F.lit(0).cast("bigint")).schema)

    key = F.struct(*keys)
    ends = summed(rows.select(*keys, "_range", "_amount")).groupBy("_range").agg(F.min(key).alias("_first"), F.max(F.struct(key.alias("k"), "_n")).alias("_end"))
    ends = ends.select("_range", "_first", F.col("_end.k").alias("_last"), F.col("_end._n").alias("_tail"))
    ends = ends.withColumn("_upto", F.sum("_tail").over(Window.partitionBy("_last").orderBy("_range")))
    along = Window.orderBy("_range")  # one row a range
    earlier = F.when(F.lag("_last").over(along).eqNullSafe(F.col("_first")), F.lag("_upto").over(along))
    before = ends.select("_range", "_first", F.coalesce(F.when(F.col("_first").eqNullSafe(F.col("_last")), F.col("_upto") - F.col("_tail")).otherwise(earlier), F.lit(0)).alias("_before"))
    # One row a range: bounded by the partitions of the exchange, however large the table is.
    joined = summed(rows.select(*at)).join(F.broadcast(before), "_range")
    number = F.col("_n") + F.when(key.eqNullSafe(F.col("_first")), F.col("_before")).otherwise(0)
    return joined.select(*[c for c in at if c not in ("_range", "_amount", name)], number.alias(name))


def numbered(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], name: str) -> DataFrame:
    """Row number per key in the given order, from 1. A key holding most rows, at positions however sparse, is numbered by
    as many tasks as its share of the rows asks for."""
    return running(in_ranges(df, keys, [order] if isinstance(order, str) else order), keys, name)


def grouped_map(df: DataFrame, keys: Sequence[str], fn, schema: str) -> DataFrame:
    """A pandas function over groups bounded by a page, table or region. Groups are small and many, so they travel
    sorted in full Arrow batches and are cut apart inside the task; one that a batch end divides waits, and its parts
    are joined once. Null keys are keys like others. The exchange has a fixed number of partitions: such functions cost
    far more than their bytes suggest, and size-based coalescing would put them into few tasks."""
    ks = list(keys)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def starts(pdf: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(pdf), dtype=bool)
        for k in ks:
            v, blank = pdf[k].to_numpy(), pdf[k].isna().to_numpy()
            change[1:] |= np.where(blank[1:] | blank[:-1], blank[1:] != blank[:-1], v[1:] != v[:-1])
        return np.flatnonzero(change)

    def batches(it):
        waiting: list[pd.DataFrame] = []
        for pdf in it:
            if not len(pdf):
                continue
            head = pd.concat([waiting[-1].iloc[-1:], pdf.iloc[:1]]) if waiting else pdf.iloc[:1]
            cuts = [0, *starts(pdf), len(pdf)]
            if waiting and len(starts(head)):
                whole, waiting = pd.concat(waiting, ignore_index=True), []
                yield fn(whole)
            if len(cuts) == 2:
                waiting.append(pdf)
                continue
            first = pd.concat([*waiting, pdf.iloc[: cuts[1]]], ignore_index=True)
            done = [fn(first), *(fn(pdf.iloc[i:j]) for i, j in zip(cuts[1:-2], cuts[2:-1]))]
            waiting = [pdf.iloc[cuts[-2] :]]
            done = [d for d in done if len(d)]
            if done:
                yield pd.concat(done, ignore_index=True)
        if waiting:
            yield fn(pd.concat(waiting, ignore_index=True))

    return df.repartition(n, *ks).sortWithinPartitions(*ks).mapInPandas(batches, schema)


def grouped_rows(df: DataFrame, keys: Sequence[str], fn, schema: str, laid: bool = False) -> DataFrame:
    """Like ``grouped_map``, for groups so small and many that a pandas table for each costs more than the work: the function
    gets a group's columns as lists and gives a list of rows. ``laid``: a group's rows already share a partition."""
    names, places = df.columns, [df.columns.index(k) for k in keys]
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def made(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in it:
            cols, out, at = [c.to_pylist() for c in batch.columns], [], 0
            key = list(zip(*(cols[p] for p in places)))
            while at < len(key):
                end = at + 1
                while end < len(key) and key[end] == key[at]:
                    end += 1
                part = [c[at:end] for c in cols]
                if held is not None and key[at] == now:
                    held = [h + p for h, p in zip(held, part)]
                else:
                    out += fn(dict(zip(names, held))) if held is not None else []
                    now, held = key[at], part
                at = end
            if out:
                yield made(out)
        rows = fn(dict(zip(names, held))) if held is not None else []
        if rows:
            yield made(rows)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (df if laid else df.repartition(n, *keys)).sortWithinPartitions(*keys).mapInArrow(batches, schema)


def starts(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Where the groups (rows alike in the first ``keys`` columns) of sorted rows begin; null keys are alike."""
    fresh = np.ones(batch.num_rows, dtype=bool)
    fresh[1:] = False
    for c in batch.columns[:keys]:
        a, b = c.slice(0, max(0, len(c) - 1)), c.slice(1)
        fresh[1:] |= pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
    return np.flatnonzero(fresh)


def whole_groups(it: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows cut anew so that no group (rows alike in the first ``keys`` columns) is divided; null keys are alike."""
    held: list[pa.RecordBatch] = []

    def like(batch: pa.RecordBatch, one: list) -> np.ndarray:
        same = np.ones(batch.num_rows, dtype=bool)
        for c, v in zip(batch.columns[:keys], one):
            same &= (c.is_null() if v.as_py() is None else pc.fill_null(pc.equal(c, v), False)).to_numpy(zero_copy_only=False)
        return same

    for batch in it:
        if not batch.num_rows:
            continue
        tail = int(like(batch, [c[batch.num_rows - 1] for c in batch.columns[:keys]]).argmax())
        if held and (tail or not like(held[-1].slice(held[-1].num_rows - 1), [c[0] for c in batch.columns[:keys]])[0]):
            yield pa.concat_batches([*held, batch.slice(0, tail)])
            held = [batch.slice(tail)]
            continue
        if tail:
            yield batch.slice(0, tail)
        held.append(batch.slice(tail))
    if held:
        yield pa.concat_batches(held)


def schema_of(df: DataFrame, cols: Sequence[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*cols).schema.fields)
