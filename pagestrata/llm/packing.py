"""Packing of pieces into sequences of fixed capacity.

The lengths' histogram, at most one row a length, goes to the driver. There a configuration linear program (how many sequences
of each mix of lengths) is solved by multiplicative weights, each round pricing all mixes by a knapsack dynamic program; rounding
turns mixes into sequences, and the program is solved again for what is left. Only the last of it, a hundredth or less where
mixes are many, goes by the longest piece that fits. The plan is bounded by the capacity, not by the corpus; every piece then
finds its place from its length and its rank among equals."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.llm import bpe, shared

#: Rounds of the linear program, the share of each length that a round may cover, how fast a length's weight falls with the
#: share covered, how far below the best mix's value a mix may lie, and the share of all sequences at which the
#: program is not solved again for what its rounding left.
ROUNDS, STEP, RATE, NEAR, LEFT = 120, 0.02, 4.0, 0.02, 0.01
#: Parts in which equal lengths are ranked.
BLOCKS = 256


def best_values(price: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The knapsack by size: for every room the most valuable mix of sizes (repeats allowed), and the size to take there (0:
    the mix is that of one less room)."""
    worth = np.where(price > 0, price, -np.inf)
    best, taken = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        value = worth[: c + 1] + best[c::-1]
        value[0] = best[c - 1]
        taken[c] = value.argmax()
        best[c] = value[taken[c]]
    return best, taken


def solve_mixes(demand: np.ndarray) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """How often each mix ((size, how many), largest first) of total size below len(demand) is used, and a lower bound of the
    configuration linear program that covers demand[size]. The result covers every size; its sum over the bound is the gap.

    A size's price starts at the size itself (the dual solution of the bound by total size) and falls exponentially with the
    share covered. Each round prices all mixes by one knapsack; for every size the best mix that holds it is taken if its value
    is near the best, as often as no size is covered by more than a step. Any prices bound the program from below: their worth
    of the demand over the best mix. At the end all is divided by the smallest share covered."""
    room, size = len(demand) - 1, np.arange(len(demand), dtype=float)
    have, need = np.nonzero(demand)[0], demand.astype(float)
    share, times = np.zeros(room + 1), {}
    bound = float((size * need).sum()) / max(1, room)
    done = 0
    while len(have) and (done < ROUNDS or not share[have].all()):
        done += 1
        price = np.zeros(room + 1)
        price[have] = size[have] * np.exp(-RATE * (share[have] - share[have].min()))
        best, taken = best_values(price, room)
        bound = max(bound, float((price * need).sum() / best[room]))
        value, budget = price[have] + best[room - have], STEP * need
        for i in np.lexsort((-have, -value)).tolist():
            if value[i] < (1 - NEAR) * best[room]:
                break
            mix, left = {int(have[i]): 1}, room - int(have[i])
            while left:
                x = int(taken[left])
                if x:
                    mix[x] = mix.get(x, 0) + 1
                left -= max(1, x)
            amount = min(budget[x] / n for x, n in mix.items())
            if amount > 1e-9 * need[have[i]]:
                for x, n in mix.items():
                    budget[x] -= amount * n
                    share[x] += amount * n / need[x]
                key = tuple(sorted(mix.items(), reverse=True))
                times[key] = times.get(key, 0.0) + amount
    least = float(share[have].min()) if len(have) else 1.0
    return {mix: x / least for mix, x in times.items()}, bound


class Stock:
    """Pieces left of each length, with the longest length that fits a gap."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.int64).copy()
        self.below = np.arange(len(counts))

    def longest(self, gap: int) -> int:
        trail = []
        while gap and not self.counts[gap]:
            if self.below[gap] == gap:
                self.below[gap] = gap - 1
            trail.append(gap)
            gap = int(self.below[gap])
        for x in trail:
            self.below[x] = gap
        return gap


def plan_sequences(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Sequences that use up counts[length] pieces of every length up to capacity: ([(length, how many)], sequences alike)."""
    return solve_and_round(counts, capacity)[0]


def solve_and_round(counts: np.ndarray, capacity: int) -> tuple[list[tuple[list[tuple[int, int]], int]], list[dict]]:
    """The sequences of ``plan_sequences``, and for every solution of the program its ``value`` (sequences of the fractional
    cover), its lower ``bound`` and the sequences ``placed`` by its rounding.

    Rounding goes through the mixes in the order of their sizes and gives each the whole part of what has added up, so that
    neighbouring mixes share what their fractions leave; a mix stops where a size of it has run out, and no size is covered
    twice. What is left is solved again until it, or what a solution places, is at most LEFT of all; the longest piece that fits
    then fills the rest. A solution takes time in the square of the capacity, whatever the number of pieces."""
    stock, plan, told = Stock(counts), [], []

    def fill(mix: tuple[tuple[int, int], ...], most: int) -> int:
        held = dict(mix)
        gap = capacity - sum(x * n for x, n in mix)
        look = gap
        while look and (length := stock.longest(look)):
            more = min(gap // length, int(stock.counts[length]) - held.get(length, 0))
            if more > 0:
                held[length] = held.get(length, 0) + more
                gap -= more * length
            look = min(gap, length - 1)
        alike = min([most, *(int(stock.counts[x]) // n for x, n in held.items())])
        for x, n in held.items():
            stock.counts[x] -= n * alike
        plan.append((sorted(held.items(), reverse=True), alike))
        return alike

    lengths = np.arange(capacity + 1)
    whole = int((lengths * stock.counts).sum())
    while int((lengths * stock.counts).sum()) > LEFT * whole:
        mixes, bound = solve_mixes(stock.counts)
        placed, due = 0, 0.5
        for mix, times in sorted(mixes.items(), reverse=True):
            due += times
            most, due = int(due), due % 1
            while most and (most := min([most, *(int(stock.counts[x]) // n for x, n in mix)])):
                alike = fill(mix, most)
                placed, most = placed + alike, most - alike
        told.append({"value": sum(mixes.values()), "bound": bound, "placed": placed})
        if placed * capacity <= LEFT * whole:
            break
    while longest := stock.longest(capacity):
        fill((), int(stock.counts[longest]))
    return plan, told


def token_pieces(docs: DataFrame, path: str, capacity: int, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: key, ``piece`` from 0, ``start`` (ids of the document before it), ``length``, ``ids_crc32`` and,
    if asked for, the ``ids`` (little-endian unsigned 32-bit).

    A document is its ids by the library, then id 0; only one longer than the capacity is cut, into pieces of that length
    and a shorter last one. A null or empty text is one piece of length 1. Repeated rows give pieces of their own."""
    base = docs.select(F.col(key), F.col(text).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in bpe.in_portions(texts):
                rows: list[tuple] = []
                for row, found in enumerate(encode(texts[a:b])):
                    ids = found + bytes(4)
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((row, n, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
                row, n, at, size, crc, part = zip(*rows, strict=True)
                keys = batch.column(0).slice(a, b - a).take(pa.array(row))
                columns = [keys, pa.array(n, pa.int32()), *(pa.array(x, pa.int64()) for x in (at, size, crc)), *([pa.array(part, pa.binary())] if keep_ids else [])]
                yield pa.RecordBatch.from_arrays(columns, [key, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])

    kind = base.schema[0].dataType.simpleString()
    return base.mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def pack(pieces: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """pieces with ``sequence_id`` and ``offset``: no sequence holds more than the capacity, and its pieces lie side by side
    from 0. Lengths must be 1 to capacity; null keys and repeated rows are pieces like any other, an empty table packs into
    nothing, other columns stay (columns named like the two results are replaced).

    Pieces are written once to the shared folder, so that the histogram and the places come from one reading of the texts.
    Equal lengths are ranked in BLOCKS parts by a hash of the row, so that a length held by a third of all rows is spread."""
    held = shared.keep(pieces.drop("sequence_id", "offset"), "pieces")
    found = held.groupBy(F.col(length).alias("size")).count().collect()  # one row a length: capacity rows at most
    counts = np.zeros(capacity + 1, np.int64)
    for r in found:
        if r["size"] is None or not 1 <= r["size"] <= capacity:
            raise ValueError(f"a piece has length {r['size']}; 1 to {capacity} fit")
        counts[r["size"]] = r["count"]
    size, first, each, number, place = _slots(plan_sequences(counts, capacity))
    names = held.columns
    told = [f.name for f in held.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    marked = held.withColumn("_part", F.pmod(F.xxhash64(*told), F.lit(BLOCKS)).cast("int"))
    sums = marked.groupBy(length, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(length).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select(length, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy(length, "_part").orderBy(*told)) - 1
    ranked = marked.withColumn("_inside", inside).join(begins, [length, "_part"]).select(*names, (F.col("_first") + F.col("_inside")).alias("_rank"))
    at = names.index(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, highs = np.searchsorted(size, np.arange(capacity + 1)), np.searchsorted(size, np.arange(capacity + 1), side="right")
        for batch in batches:
            long, rank = batch.column(at).to_numpy(zero_copy_only=False), batch.column(len(names)).to_numpy(zero_copy_only=False)
            low, high = lows[long], highs[long]
            while len(long) and (high - low > 1).any():  # the last slot of this length that starts at or before the rank
                middle = (low + high) // 2
                right = (high - low > 1) & (first[middle] <= rank)
                low, high = np.where(right, middle, low), np.where(right | (high - low <= 1), high, middle)
            past, lane = np.divmod(rank - first[low], each[low]) if len(long) else (rank, rank)
            out = [pa.array(number[low] + past, pa.int64()), pa.array(place[low] + lane * long, pa.int64())] if len(long) else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], [*names, "sequence_id", "offset"])

    kinds = held.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    return ranked.mapInArrow(run, kinds)


def _slots(plan: list[tuple[list[tuple[int, int]], int]]) -> tuple[np.ndarray, ...]:
    """The plan by length: length, rank of its first piece there, pieces a sequence, first sequence, place of the first."""
    rows, used, number = [], {}, 0
    for mix, alike in plan:
        place = 0
        for length, n in mix:
            rows.append((length, used.get(length, 0), n, number, place))
            used[length] = used.get(length, 0) + n * alike
            place += n * length
        number += alike
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(1, np.int64),) * 5
