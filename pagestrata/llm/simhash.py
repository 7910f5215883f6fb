"""SimHash near-duplicates. Fingerprints within a Hamming radius are linked by multi-index hashing: each fingerprint is cut
into segments, small Hamming balls around each segment are enumerated, equal entries of a segment's table are fetched, and
complete distances are verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.llm import bpe, components, shared

SEED, WORDS, RADIUS = 42, 4, 4
#: Segments of a fingerprint: radii 1, 1 and 0, 45 table entries, at every size of the corpus.
SEGMENTS = 3
#: Fingerprints and probes of one table entry that a task compares at once; beyond it, both are cut into blocks met pair by pair.
BLOCK = 1 << 14


def fingerprints(texts: list[str | None], words: int = WORDS) -> np.ndarray:
    """64-bit SimHash of each text: A-Z lower-cased, words parted by ASCII white space, shingles with repeats."""
    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        parts = (text or "").encode().lower().split()
        if not parts:
            continue
        joined = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        begins = np.append(0, ends[:-1])
        to = ends[words - 1 :] - 1 if len(parts) > words else ends[-1:] - 1
        hashes += [digest(joined[a:b], SEED) for a, b in zip(begins[: len(to)].tolist(), to.tolist(), strict=True)]
        sizes[i] = len(to)
    out = np.zeros(len(texts), np.uint64)
    full = np.nonzero(sizes)[0]
    if not len(full):
        return out
    all_hashes = np.array(hashes, np.uint64)
    # Eight bits at a time lie in the eight bytes of a number; up to 255 such numbers add without a carry.
    runs = -(-sizes[full] // 255)
    number = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    cuts = np.repeat(np.cumsum(sizes[full]) - sizes[full], runs) + 255 * number
    first = np.cumsum(runs) - runs
    lanes = np.uint64(0x0101010101010101)
    for k in range(8):
        sums = np.add.reduceat((all_hashes >> np.uint64(k)) & lanes, cuts).astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        set_in = np.add.reduceat(sums, first, axis=0)
        for byte in range(8):
            out[full] |= (2 * set_in[:, byte] > sizes[full]).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` (null: the lowest long) and ``print``, the fingerprint as a long, of every row; whole texts, null is empty."""
    base = docs.select(shared.as_key(F.col(key)).alias("key"), F.col(text).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in bpe.in_portions(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fingerprints(texts[a:b]).view(np.int64))], ["key", "print"])

    return base.mapInArrow(run, "key long, print long")


def balls(segments: int, radius: int = RADIUS) -> list[tuple[int, int, int, list[int]]]:
    """Segments as (number, lowest bit, width, masks within the segment's radius). Two fingerprints that differ in ``radius``
    bits at most lie within one segment's radius at least, because the radii plus one each add up to radius + 1."""
    spare = radius - segments + 1
    reach = [spare // segments + (i < spare % segments) for i in range(segments)]
    widths = [64 // segments + (i >= segments - 64 % segments) for i in range(segments)]
    out, low = [], 0
    for i, (r, w) in enumerate(zip(reach, widths, strict=True)):
        out.append((i, low, w, [sum(1 << b for b in bits) for n in range(r + 1) for bits in combinations(range(w), n)]))
        low += w
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links between nodes: each node but the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            break
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def linked(home: np.ndarray, home_ids: np.ndarray, probe: np.ndarray, probe_ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between a table entry's fingerprints and those that probe it. Stops once all hang together."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    everyone = len(np.unique(np.concatenate([home_ids, probe_ids])))
    step = max(1, (1 << 21) // max(1, len(probe)))
    for at in range(0, len(home), step):
        i, j = np.nonzero(np.bitwise_count(home[at : at + step, None] ^ probe) <= radius)
        a, b = forest(np.concatenate([a, home_ids[at + i]]), np.concatenate([b, probe_ids[j]]))
        if len(a) == everyone - 1 and len(np.unique(b)) == 1:
            break
    return a, b


def link_entries(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by entry (key, left, right) in; links out, as forests. Entries are small or cut into blocks; they are
    compared together, and an entry that a batch does not end waits for the next."""
    names = ["entry", "left", "right", "print", "id", "home", "probes"]
    held: list[pa.RecordBatch] = []

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        entry, left, right, prints, ids, home, probes = (table.column(c).to_numpy() for c in names)
        prints = prints.view(np.uint64)
        cut = np.nonzero(np.append(True, (entry[1:] != entry[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])))[0]
        run = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(entry))))
        h, p = np.nonzero(home)[0], np.nonzero(probes)[0]
        have_h, have_p = np.bincount(run[h], minlength=len(cut)), np.bincount(run[p], minlength=len(cut))
        first_h, first_p = np.cumsum(have_h) - have_h, np.cumsum(have_p) - have_p
        pairs = have_h * have_p
        found: list[tuple[np.ndarray, np.ndarray]] = []
        met = pairs > 1
        one = np.nonzero(pairs == 1)[0]
        met[one] = h[first_h[one]] != p[first_p[one]]  # a lone fingerprint meets itself
        small = np.nonzero(met & (pairs <= 4096))[0]
        for part in np.array_split(small, max(1, int(pairs[small].sum()) >> 22)):
            n = pairs[part]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(have_p[part], n)
            i, j = h[np.repeat(first_h[part], n) + k // np.maximum(wide, 1)], p[np.repeat(first_p[part], n) + k % np.maximum(wide, 1)]
            near = (np.bitwise_count(prints[i] ^ prints[j]) <= radius) & (ids[i] != ids[j])
            found.append((ids[i[near]], ids[j[near]]))
        for r in np.nonzero(pairs > 4096)[0]:
            i, j = h[first_h[r] : first_h[r] + have_h[r]], p[first_p[r] : first_p[r] + have_p[r]]
            found.append(linked(prints[i], ids[i], prints[j], ids[j], radius))
        if found:
            a, b = forest(np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) < 1 << 18:
            continue
        table = pa.Table.from_batches(held)
        last = table.slice(table.num_rows - 1).to_pylist()[0]
        same = np.ones(table.num_rows, bool)
        for c in names[:3]:
            same &= table.column(c).to_numpy() == last[c]
        open_from = int(np.argmax(same))
        yield from work(table.slice(0, open_from)) if open_from else ()
        held = table.slice(open_from).to_batches()
    if held:
        yield from work(pa.Table.from_batches(held))


def near_links(classes: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """Links ``a``, ``b`` that connect whatever of ``classes`` (``print`` and ``id``, both distinct) lies within the radius:
    not every pair, but a forest of each entry's pairs, so that no link between components is lost. Entries whose own
    fingerprints or whose probes may pass a block are cut into blocks of both, met pair by pair."""
    plan = balls(segments, radius)
    key = lambda n, low, width, mask: (F.shiftrightunsigned("print", low).bitwiseAND((1 << width) - 1)).bitwiseXOR(F.lit(mask)) + (n << 40)
    homes = classes.select("print", "id", F.explode(F.array(*[key(n, low, w, 0) for n, low, w, _ in plan])).alias("entry"))
    held = homes.groupBy("entry").count()
    most = max(len(masks) for _, _, _, masks in plan)
    heavy = held.where(F.col("count") > block / most)  # no other entry can be crowded by less than one of these nearby
    balls_of = F.element_at(F.array(*[F.array(*[F.lit(m).cast("long") for m in masks]) for _, _, _, masks in plan]), F.shiftright("entry", 40).cast("int") + 1)
    near = heavy.select(F.explode(F.transform(balls_of, lambda m: F.col("entry").bitwiseXOR(m))).alias("entry"), F.col("count").alias("sent"))
    bound = F.sum("sent") + (most - F.count("*")) * (block / most)  # probes: those of heavy entries, and what the others may send
    probed = near.groupBy("entry").agg(F.ceil(bound / block).cast("int").alias("probe_parts"))
    crowded = held.join(probed, "entry").where("probe_parts > 1").select("entry", F.ceil(F.col("count") / block).cast("int").alias("home_parts"), "probe_parts")
    around = F.array(*[F.struct(key(n, low, w, m).alias("entry"), F.lit(m == 0).alias("home")) for n, low, w, masks in plan for m in masks])
    rows = classes.select("print", "id", F.explode(around).alias("x")).select("print", "id", "x.entry", "x.home")
    spread = rows.join(crowded, "entry", "left")
    mine = lambda parts: F.pmod(F.xxhash64("print"), F.col(parts)).cast("int")
    every_part = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    whole = spread.where("probe_parts IS NULL").select("entry", F.lit(0).alias("left"), F.lit(0).alias("right"), "print", "id", "home", F.lit(True).alias("probes"))
    many = spread.where("probe_parts IS NOT NULL")
    as_home = many.where("home").select("entry", mine("home_parts").alias("left"), every_part("probe_parts").alias("right"), "print", "id", "home", F.lit(False).alias("probes"))
    as_probe = many.select("entry", every_part("home_parts").alias("left"), mine("probe_parts").alias("right"), "print", "id", F.lit(False).alias("home"), F.lit(True).alias("probes"))
    every = whole.union(as_home).union(as_probe) if not crowded.isEmpty() else rows.select("entry", F.lit(0).alias("left"), F.lit(0).alias("right"), "print", "id", "home", F.lit(True).alias("probes"))
    dealt = every.repartition("entry", "left", "right").sortWithinPartitions("entry", "left", "right")
    return dealt.mapInArrow(lambda batches: link_entries(batches, radius), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """One row per document: key, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest key it reaches over
    links of at most ``radius`` differing bits.

    Null and empty texts have fingerprint zero and link like others; a null key is lower than all others and shown as null;
    repeated rows keep a row each; an empty table gives none; other columns are left out. Equal fingerprints are one node of
    the links, so copies cost nothing there."""
    prints = shared.keep(fingerprint_documents(docs, key, text), "prints")
    classes = shared.keep(prints.groupBy("print").agg(F.min("key").alias("id")), "classes")
    links = near_links(classes.select("print", F.col("print").alias("id")), radius, segments, block)
    roots = components.components(links)
    named = classes.join(roots.select(F.col("node").alias("print"), "root"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = named.groupBy("root").agg(F.min("id").alias("component"))
    return _shown(prints.join(named.join(least, "root").select("print", "component"), "print"), key)


def _shown(rows: DataFrame, key: str) -> DataFrame:
    back = lambda c: F.when(F.col(c) != shared.LOWEST, F.col(c))
    return rows.select(back("key").alias(key), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), back("component").alias("component_id"))
