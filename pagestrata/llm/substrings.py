"""Substring dedup: Rabin-Karp hashes of every window of words are counted across the corpus; windows that occur earlier are
merged into maximal intervals of words to remove.

A window's identity is a rolling 64-bit polynomial over word fingerprints together with the bucket number, which comes from a
second polynomial of another base. Buckets grow with the corpus (about BUCKET_WINDOWS windows each), so the identity has 64
bits plus the bits that the corpus needs. Each task first drops what repeats within its own portion, so that a window held by
a third of all documents reaches its bucket a few times a portion at most."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.llm import bpe, shared

WORDS, BUCKET_WINDOWS, LEAST_BUCKETS = 20, 1 << 21, 64
#: Odd bases of the two polynomials modulo 2^64, and the step between a word's two fingerprints.
BASES, STEP = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), 0x165667B19E3779F9
_ROWS = "bucket int, hashes binary, keys binary, marks binary, counts binary, starts binary"


def rolling(values: np.ndarray, words: int, base: int) -> np.ndarray:
    """Hash of every window of so many values: the sum of values times falling powers of the base, modulo 2^64. Windows of
    doubled length are put together from two halves."""
    if len(values) < words:
        return np.zeros(0, np.uint64)
    total, done, power, size, block = None, 0, base, 1, values
    while True:
        if words & size:  # this block comes after what is done
            if total is None:
                total, done = block, size
            else:
                n = len(values) - done - size + 1
                total, done = total[:n] * np.uint64(power) + block[done : done + n], done + size
        if size * 2 > words:
            return total[: len(values) - words + 1]
        n = len(block) - size
        block = block[:n] * np.uint64(power) + block[size : size + n]
        power, size = power * power % (1 << 64), size * 2


def windows(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First hash, second hash of all windows of all texts in order; and how many windows each text has."""
    firsts, seconds, counts = [], [], np.zeros(len(texts), np.int64)
    with np.errstate(over="ignore"):
        for i, text in enumerate(texts):
            parts = text.split()
            if len(parts) < words:
                continue
            prints = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
            firsts.append(rolling(prints, words, BASES[0]))
            seconds.append(rolling(prints * np.uint64(STEP) ^ (prints >> np.uint64(29)), words, BASES[1]))
            counts[i] = len(parts) - words + 1
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(firsts), np.concatenate(seconds), counts) if firsts else (empty, empty, counts)


def _runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and their lengths."""
    cut = np.nonzero(np.append(True, owner[1:] != owner[:-1]))[0] if len(owner) else np.zeros(0, np.int64)
    return cut, np.diff(np.append(cut, len(owner)))


def _packed(bucket: int, hashes: np.ndarray, owner: np.ndarray, start: np.ndarray, keys: np.ndarray, marks: np.ndarray) -> tuple:
    """A row for windows sorted by owner and start: hashes, the owners' keys and marks, how many each has, starts as steps."""
    cut, have = _runs(owner)
    steps = np.diff(start, prepend=0)
    steps[cut] = start[cut]
    narrow = not len(steps) or steps.max() < 1 << 16
    return (bucket, hashes.tobytes(), keys[owner[cut]].tobytes(), marks[owner[cut]].tobytes(), have.astype("<u4").tobytes(), steps.astype("<u2" if narrow else "<u4").tobytes())


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """keys and marks of the owners, and for each window: owner, start; and the hashes (none in rows that only flag)."""
    keys, marks, have = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["marks"], "<i8"), np.frombuffer(row["counts"], "<u4").astype(np.int64)
    n = int(have.sum())
    steps = np.frombuffer(row["starts"], "<u2" if len(row["starts"]) == 2 * n else "<u4").astype(np.int64)
    total = np.cumsum(steps)
    first = np.cumsum(have) - have
    start = total - np.repeat(total[first] - steps[first], have)
    return keys, marks, np.repeat(np.arange(len(keys)), have), start, np.frombuffer(row["hashes"], "<u8")


def _window_rows(batches: Iterator[pa.RecordBatch], words: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of the first windows in each portion by bucket; bucket -1 holds those that already repeat an earlier one there."""
    kind = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("hashes", "keys", "marks", "counts", "starts"))])
    for batch in batches:
        key, mark, body = (batch.column(i) for i in range(3))
        sized = body.to_pylist()
        for a, b in bpe.in_portions(sized, 1 << 23):
            keys, marks = (x.slice(a, b - a).to_numpy() for x in (key, mark))
            order = np.lexsort((marks, keys))
            alike = np.append(False, (keys[order][1:] == keys[order][:-1]) & (marks[order][1:] == marks[order][:-1]))
            order = order[~alike]  # identical rows are one document
            keys, marks = keys[order], marks[order]
            first, second, have = windows([sized[a + i].encode() for i in order.tolist()], words)
            owner = np.repeat(np.arange(len(keys)), have)
            start = np.arange(len(first)) - np.repeat(np.cumsum(have) - have, have)
            by = np.argsort(first, kind="stable")
            again = np.zeros(len(first), bool)
            again[by[1:]] = (first[by[1:]] == first[by[:-1]]) & (second[by[1:]] == second[by[:-1]])
            rows = []
            if again.any():
                rows.append(_packed(-1, np.zeros(0, "<u8"), owner[again], start[again], keys, marks))
            first, second, owner, start = (x[~again] for x in (first, second, owner, start))
            bucket = (second >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
            by = np.argsort(bucket, kind="stable")
            bucket, first, owner, start = (x[by] for x in (bucket, first, owner, start))
            cut, size = _runs(bucket)
            rows += [_packed(int(bucket[c]), first[c : c + n], owner[c : c + n], start[c : c + n], keys, marks) for c, n in zip(cut.tolist(), size.tolist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)


def _flags(rows: Iterator[dict]) -> pa.Table:
    """key, mark, starts of the windows in a bucket that also start earlier."""
    parts = [_unpacked(r) for r in rows]
    base = np.cumsum([0, *(len(p[0]) for p in parts)])
    keys, marks = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    owner, start, hashes = np.concatenate([p[2] + b for p, b in zip(parts, base, strict=False)]), np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
    by = np.argsort(hashes)
    near = hashes[by][1:] == hashes[by][:-1]
    by = by[np.append(near, False) | np.append(False, near)]
    hashes, owner, start = hashes[by], owner[by], start[by]
    by = np.lexsort((start, marks[owner], keys[owner], hashes))
    hashes, owner, start = hashes[by], owner[by], start[by]
    cut, size = _runs(hashes)
    lead = np.repeat(cut, size)
    own, head = owner, owner[lead]
    later = (keys[own] != keys[head]) | (marks[own] != marks[head]) | (start != start[lead])
    return _flag_table(keys, marks, owner[later], start[later])


def _flag_table(keys: np.ndarray, marks: np.ndarray, owner: np.ndarray, start: np.ndarray) -> pa.Table:
    by = np.lexsort((start, marks[owner], keys[owner]))
    owner, start = owner[by], start[by].astype("<u4")
    key, mark = keys[owner], marks[owner]
    cut = np.nonzero(np.append(True, (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])))[0] if len(key) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(key))[: len(cut)]
    return pa.table({"key": pa.array(key[cut], pa.int64()), "mark": pa.array(mark[cut], pa.int64()), "starts": pa.array([start[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist(), strict=True)], pa.binary())})


def repeated_windows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``key``, ``mark`` (which text of that key) and ``starts`` (little-endian unsigned 32-bit) of the windows whose words also
    start earlier; several rows a document. docs: ``key`` and ``mark`` longs, ``body`` a string without nulls."""
    size = docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    bits = max((LEAST_BUCKETS - 1).bit_length(), int(size // 6 // BUCKET_WINDOWS).bit_length())
    rows = docs.mapInArrow(lambda batches: _window_rows(batches, words, bits), _ROWS)

    def bucket(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        if rows[0]["bucket"] >= 0:
            return _flags(rows)
        parts = [_unpacked(r) for r in rows]
        base = np.cumsum([0, *(len(p[0]) for p in parts)])
        cat = lambda i: np.concatenate([p[i] for p in parts])
        return _flag_table(cat(0), cat(1), np.concatenate([p[2] + b for p, b in zip(parts, base, strict=False)]), cat(3))

    # What repeats within a portion is known already; it only needs spreading, so it goes under numbers below zero.
    spread = rows.withColumn("bucket", F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("keys", "marks"), F.lit(1 << bits)).cast("int")).otherwise(F.col("bucket")))
    return spread.groupBy("bucket").applyInArrow(bucket, "key long, mark long, starts binary")


def cut_words(text: bytes, starts: list[bytes], words: int) -> tuple[int, int, bytes, list[tuple[int, int]]]:
    """Words, words removed, the words kept, and the removed intervals, each as long as it can be."""
    parts = text.split()
    if not starts:
        return len(parts), 0, b" ".join(parts), []
    steps = np.zeros(len(parts) + 1, np.int64)
    at = np.frombuffer(b"".join(starts), "<u4").astype(np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + words, -1)
    gone = np.cumsum(steps[:-1]) > 0
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    spans = list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True))
    return len(parts), int(gone.sum()), b" ".join([parts[i] for i in np.nonzero(~gone)[0].tolist()]), spans


def remove_repeats(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with ``text`` cut to its kept words, joined by one space, and the new columns ``n_words``, ``n_removed`` and
    ``removed`` (intervals of word numbers, end excluded); columns so named before are replaced, all others stay.

    A word goes if a window of ``words`` words covers it whose words also start earlier in the corpus: at a smaller key, or
    earlier in the same document. Windows are judged on the given texts. A null text has no words and becomes empty, as do
    blank ones; a text shorter than a window is kept. A null key comes before all others. Of different texts under one key,
    that with the smaller 64-bit hash comes first; identical rows are one document and fare alike. An empty table gives none."""
    own = [c for c in docs.columns if c not in ("n_words", "n_removed", "removed")]
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    plain = docs.select(shared.as_key(F.col(key)).alias("key"), mark.alias("mark"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    found = shared.keep(repeated_windows(plain, words), "repeats")
    flags = found.groupBy("key", "mark").agg(F.collect_list("starts").alias("_starts")).select(F.col("key").alias("_key"), F.col("mark").alias("_mark"), "_starts")
    rows = docs.select(*own, shared.as_key(F.col(key)).alias("_key"), mark.alias("_mark")).join(flags, ["_key", "_mark"], "left").select(*own, "_starts")
    place, last = own.index(text), len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for a, b in bpe.in_portions(texts):
                part = batch.slice(a, b - a)
                out = [cut_words((x or "").encode(), s or [], words) for x, s in zip(texts[a:b], part.column(last).to_pylist(), strict=True)]
                columns = list(part.columns[:last])
                columns[place] = pa.array([x[2].decode() for x in out], pa.string())
                spans = pa.array([[{"first": s, "end": e} for s, e in x[3]] for x in out], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), spans], [*own, "n_words", "n_removed", "removed"])

    shape = docs.select(*own).withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "removed": F.lit(None).cast("array<struct<first:int,end:int>>")}).schema
    return rows.mapInArrow(run, shape)
