"""Phrase collocations from lossless counts of word n-grams.

Texts are cut into blocks. Words are counted by bucket of their hash and numbered; an n-gram is its words' numbers packed into one number of fixed width,
which an invertible permutation of that width spreads evenly. The high bits (quotient) choose a bucket, the other bits
(remainder) are kept whole beside a count: sorted, these are the block's counting quotient filter. A bucket merges the sorted
filters of all blocks, and undoing the permutation gives the n-grams back, so nothing is approximate and no text travels.

n-grams are counted shortest first. One can only reach ``least`` if the two n-grams of one word less inside it do, so a block
counts no other; which of a block's n-grams reached it comes back to the block as one bit each."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.llm import bpe, shared

LEAST, LONGEST, FIRST = 100, 5, 2000
#: Characters of a block, characters of the corpus to a bucket, and buckets at least.
BLOCK, TO_BUCKET, LEAST_BUCKETS = 1 << 21, 1 << 25, 64
#: The characters that part pieces, and those that part words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_CUT = bytes.maketrans(ENDS + BLANKS, b"." * len(ENDS) + b" " * len(BLANKS))
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_ALL = (1 << 64) - 1


# -- numbers of any width, as lanes of 64 bits, the highest lane first


def _widths(bits: int) -> list[int]:
    lanes = -(-bits // 64)
    return [bits - 64 * (lanes - 1)] + [64] * (lanes - 1)


def packed(words: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The words' numbers side by side, ``width`` bits each, the first highest."""
    lanes = [np.zeros(len(words[0]), np.uint64) for _ in _widths(width * len(words))]
    for word in words:
        for i in range(len(lanes) - 1):
            lanes[i] = lanes[i] << np.uint64(width) | lanes[i + 1] >> np.uint64(64 - width)
        lanes[-1] = lanes[-1] << np.uint64(width) | word.astype(np.uint64)
    return lanes


def unpacked(lanes: list[np.ndarray], width: int, words: int) -> list[np.ndarray]:
    out, lanes = [], list(lanes)
    for _ in range(words):
        out.append(lanes[-1] & np.uint64((1 << width) - 1))
        for i in range(len(lanes) - 1, 0, -1):
            lanes[i] = lanes[i] >> np.uint64(width) | lanes[i - 1] << np.uint64(64 - width)
        lanes[0] = lanes[0] >> np.uint64(width)
    return out[::-1]


def _mixed(x: np.ndarray, odd: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(odd)
    return x ^ (x >> np.uint64(29))


def permuted(lanes: list[np.ndarray], bits: int, back: bool = False) -> list[np.ndarray]:
    """A one-to-one mixing of numbers of so many bits; ``back`` undoes it. Each lane takes on a mixture of the next; a single
    lane is folded onto itself and multiplied by odd numbers, within its width."""
    widths, lanes = _widths(bits), list(lanes)
    masks = [np.uint64((1 << w) - 1) for w in widths]
    if len(lanes) > 1:
        steps = [(i, odd) for odd in _ODD for i in range(len(lanes) - 1, -1, -1)]
        for i, odd in reversed(steps) if back else steps:
            turn = _mixed(lanes[(i + 1) % len(lanes)], odd)
            lanes[i] = (lanes[i] - turn if back else lanes[i] + turn) & masks[i]
        return lanes
    x, half = lanes[0], max(1, (bits + 1) // 2)  # a fold by half the width or more is its own inverse
    for odd in reversed(_ODD) if back else _ODD:
        if back:
            x = (x * np.uint64(pow(odd, -1, 1 << 64))) & masks[0]
            x = x ^ (x >> np.uint64(half))
        else:
            x = x ^ (x >> np.uint64(half))
            x = (x * np.uint64(odd)) & masks[0]
    return [x]


def _high(lanes: list[np.ndarray], bits: int) -> np.ndarray:
    """The highest 64 of so many bits, at the left."""
    top = _widths(bits)[0]
    left = lanes[0] << np.uint64(64 - top) if top < 64 else lanes[0]
    return left | lanes[1] >> np.uint64(top) if len(lanes) > 1 and top < 64 else left


def counted(lanes: list[np.ndarray], bits: int, weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct numbers ascending, how often each is there, and which one each given number is."""
    n = len(lanes[0])
    if not n:
        return lanes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    high = _high(lanes, bits) if bits else lanes[0]
    order = np.argsort(high, kind="stable")
    now = [x[order] for x in lanes]
    if len(lanes) > 1 and any((x[1:] != x[:-1])[high[order][1:] == high[order][:-1]].any() for x in now):
        order = np.lexsort(lanes[::-1])
        now = [x[order] for x in lanes]
    new = np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in now]))
    first = np.nonzero(new)[0]
    of = np.empty(n, np.int64)
    of[order] = np.cumsum(new) - 1
    times = np.diff(np.append(first, n)) if weights is None else np.add.reduceat(weights[order], first)
    return [x[first] for x in now], times, of


def _to_bytes(lanes: list[np.ndarray], bits: int) -> bytes:
    flat = np.stack(lanes[::-1], axis=1).astype("<u8").view(np.uint8).reshape(len(lanes[0]), -1)
    return np.ascontiguousarray(flat[:, : -(-bits // 8)]).tobytes()


def _from_bytes(data: bytes, n: int, bits: int, lanes: int) -> list[np.ndarray]:
    wide = np.zeros((n, 8 * lanes), np.uint8)
    wide[:, : -(-bits // 8)] = np.frombuffer(data, np.uint8).reshape(n, -1) if bits else 0
    return list(wide.view("<u8").T[::-1])


def _narrow(counts: np.ndarray) -> bytes:
    most = int(counts.max(initial=0))
    return counts.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


# -- blocks of texts


#: Rows that are no bucket of words: a block's text as numbers, and how many words a language has in it.
TEXT, TOTAL = -1, -2
_WORDS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("lang", pa.string()), ("size", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("locals", pa.binary())])
_NAMED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("lang", pa.string()), ("first", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("size", pa.int64())])


def _blocks(batches: Iterator[pa.RecordBatch], block: int, cut: int) -> Iterator[pa.RecordBatch]:
    """Per block a row with the text as the block's own numbers for its words; per language how many words it has there; and
    per bucket the words, joined by a space, how often each occurs and its number in the block."""
    task, number = TaskContext.get().partitionId(), count()
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in bpe.in_portions(texts, block):
            fresh = count(1)
            known: dict[str, defaultdict[bytes, int]] = {}
            found = []
            for lang, text in zip(langs[a:b], texts[a:b], strict=True):
                if lang not in known:
                    known[lang] = defaultdict(fresh.__next__, {b".": 0})
                parts = text.encode().lower().translate(_CUT).replace(b".", b" . ").split()
                found.append(np.fromiter(map(known[lang].__getitem__, parts), np.uint32, len(parts)))
                found.append(np.zeros(1, np.uint32))
            codes = np.concatenate(found)
            times = np.bincount(codes)
            one = (task << 33) + next(number)
            rows = [(one, TEXT, None, len(codes), codes.astype("<u2" if len(times) < 1 << 16 else "<u4").tobytes(), b"", b"")]
            for lang, words in known.items():
                words.pop(b".")
                if not words:
                    continue
                spelt, local = list(words), np.fromiter(words.values(), np.int64, len(words))
                rows.append((one, TOTAL, lang, int(times[local].sum()), b"", b"", b""))
                bucket = (np.fromiter(map(xxhash.xxh3_64_intdigest, spelt), np.uint64, len(spelt)) >> np.uint64(64 - cut)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                for part in np.split(order, np.nonzero(np.diff(bucket[order]))[0] + 1):
                    rows.append((one, int(bucket[part[0]]), lang, len(part), b" ".join([spelt[i] for i in part.tolist()]), _narrow(times[local[part]]), _narrow(local[part])))
            yield _batch(rows, _WORDS)
            del found, codes, known, rows
    pa.default_memory_pool().release_unused()


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kind.names)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kind.types, strict=True)], schema=kind)


def _merged_words(table: pa.Table, least: int) -> pa.Table:
    """The words of a bucket that reach ``least``, numbered from 0: a row per language without a block, and for each block the
    numbers that it gave to such words beside theirs."""
    rows = table.to_pylist()
    total: dict[str, defaultdict[bytes, int]] = {}
    split = [r["keys"].split(b" ") for r in rows]
    for r, words in zip(rows, split, strict=True):
        sums = total.setdefault(r["lang"], defaultdict(int))
        for word, n in zip(words, _wide(r["counts"], r["size"]).tolist(), strict=True):
            sums[word] += n
    number: dict[str, dict[bytes, int]] = {}
    out, fresh, bucket = [], 0, rows[0]["bucket"]
    for lang in sorted(total):
        words = sorted(w for w, n in total[lang].items() if n >= least)
        number[lang] = {w: fresh + i for i, w in enumerate(words)}
        if words:
            out.append((None, bucket, lang, fresh, b" ".join(words), _narrow(np.array([total[lang][w] for w in words])), len(words)))
        fresh += len(words)
    for r, words in zip(rows, split, strict=True):
        known, local = number[r["lang"]], _wide(r["locals"], r["size"])
        at = [i for i, w in enumerate(words) if w in known]
        if at:
            out.append((r["block"], bucket, None, 0, _narrow(np.array([known[words[i]] for i in at])), _narrow(local[at]), len(at)))
    return pa.Table.from_batches([_batch(out, _NAMED)])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per frequent word: language, spelling, occurrences, and its number among those of all buckets, from 1."""
    for batch in batches:
        for r in batch.to_pylist():
            words = [w.decode() for w in r["keys"].split(b" ")]
            ids = pa.array(r["before"] + r["first"] + 1 + np.arange(len(words)))
            yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(words), pa.string()), pa.array(words), pa.array(_wide(r["counts"], len(words))), ids], ["lang", "word", "f", "id"])


def _runs(alive: np.ndarray) -> np.ndarray:
    """Places where this and the next n-gram are alive."""
    return np.nonzero(alive[:-1] & alive[1:])[0]


def _grams(ids: np.ndarray, places: np.ndarray, words: int, width: int) -> list[np.ndarray]:
    return permuted(packed([ids[places + i] for i in range(words)], width), width * words)


def _filters(batches: Iterator[pa.RecordBatch], words: int, width: int, cut: int) -> Iterator[pa.RecordBatch]:
    """A block's n-grams of so many words: a row per bucket, and a row (bucket -1) that says where shorter ones are frequent."""
    kind = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("size", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    for batch in batches:
        for row in range(batch.num_rows):
            block, codes, places, named, alive, told = (batch.column(c)[row] for c in ("block", "codes", "places", "named", "alive", "told"))
            n = places.as_py()
            data = codes.as_buffer()
            local = np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")
            number = np.zeros(int(local.max(initial=0)) + 1, np.int64)
            for x in named.as_py() or []:
                number[_wide(x["counts"], x["size"])] = x["before"] + 1 + _wide(x["keys"], x["size"])
            ids = number[local]
            now = ids > 0
            if words > 2:
                if alive.is_valid:
                    now = np.unpackbits(np.frombuffer(alive.as_buffer(), np.uint8), count=n).astype(bool)
                at = _runs(now)
                bits = width * (words - 1)
                keys, _, of = counted(_grams(ids, at, words - 1, width), bits)
                frequent = np.zeros(len(keys[0]), bool)
                if told.is_valid and len(at):
                    bucket = _bucket(keys, bits, cut)
                    for x in told.as_py():
                        a, b = np.searchsorted(bucket, [x["bucket"], x["bucket"] + 1])
                        frequent[a:b] = np.unpackbits(np.frombuffer(x["flags"], np.uint8), count=b - a)
                now = np.zeros(n, bool)
                now[at[frequent[of]]] = True
            at, bits = _runs(now), width * words
            keys, times, _ = counted(_grams(ids, at, words, width), bits)
            rows = [(block.as_py(), -1, n, np.packbits(now).tobytes(), b"")]
            if len(at):
                bucket, low = _bucket(keys, bits, cut), bits - min(cut, bits)
                first = np.nonzero(np.append(True, bucket[1:] != bucket[:-1]))[0]
                rest = _without_high(keys, low)
                for a, b in zip(first.tolist(), np.append(first[1:], len(bucket)).tolist(), strict=True):
                    rows.append((block.as_py(), int(bucket[a]), b - a, _to_bytes([x[a:b] for x in rest], low), _narrow(times[a:b])))
            yield _batch(rows, kind)
            del rows, keys, times, at, now, ids, local, data
    pa.default_memory_pool().release_unused()


def _bucket(lanes: list[np.ndarray], bits: int, cut: int) -> np.ndarray:
    return (_high(lanes, bits) >> np.uint64(64 - min(cut, bits))).astype(np.int64)


def _without_high(lanes: list[np.ndarray], low: int) -> list[np.ndarray]:
    """Only the lowest ``low`` bits of each number."""
    out = []
    for i, x in enumerate(lanes):
        left = min(64, max(0, low - 64 * (len(lanes) - 1 - i)))
        out.append(x & np.uint64((1 << left) - 1))
    return out


def _merged(table: pa.Table, bits: int, cut: int, least: int) -> pa.Table:
    """The sorted filters of a bucket merged: for each block one bit per entry (does its n-gram reach ``least``), and one row
    without a block with the n-grams that do."""
    lanes, low = len(_widths(bits)), bits - min(cut, bits)
    rows = table.to_pylist()
    sizes = [r["size"] for r in rows]
    parts = [_from_bytes(r["keys"], r["size"], low, lanes) for r in rows]
    keys = [np.concatenate([p[i] for p in parts]) for i in range(lanes)]
    weights = np.concatenate([_wide(r["counts"], r["size"]) for r in rows])
    distinct, times, of = counted(keys, bits, weights)
    enough = times >= least
    flags, ends = enough[of], np.cumsum(sizes)
    bucket = rows[0]["bucket"]
    out = [(r["block"], bucket, None, None, np.packbits(f).tobytes()) for r, n, e in zip(rows, sizes, ends, strict=True) if (f := flags[e - n : e]).any()]
    if enough.any():
        out.append((None, bucket, _to_bytes([x[enough] for x in distinct], low), _narrow(times[enough]), None))
    columns = list(zip(*out, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["block", "bucket", "keys", "counts", "flags"])


def _word_merger(least: int):
    def run(table: pa.Table) -> pa.Table:
        return _merged_words(table, least)

    return run


def _merger(bits: int, cut: int, least: int):
    def run(table: pa.Table) -> pa.Table:
        return _merged(table, bits, cut, least)

    return run


def _read_back(batches: Iterator[pa.RecordBatch], words: int, width: int, cut: int) -> Iterator[pa.RecordBatch]:
    """Frequent n-grams of a bucket as the numbers of their words, and their counts."""
    bits = width * words
    lanes, low = len(_widths(bits)), bits - min(cut, bits)
    for batch in batches:
        for r in batch.to_pylist():
            n = len(r["keys"]) // -(-low // 8) if low else 1
            keys = _from_bytes(r["keys"], n, low, lanes)
            high, at, off = int(r["bucket"]), lanes - 1 - low // 64, low % 64
            if min(cut, bits):
                keys[at] = keys[at] | np.uint64(high << off & _ALL)
                if off and high >> (64 - off):
                    keys[at - 1] = keys[at - 1] | np.uint64(high >> (64 - off))
            ids = np.stack(unpacked(permuted(keys, bits, back=True), width, words), axis=1).astype(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * words + 1, words), pa.int32()), pa.array(ids.ravel()))
            yield pa.RecordBatch.from_arrays([flat, pa.array(_wide(r["counts"], n))], ["ids", "f"])


# -- counts, scores and ranks in Spark


def count_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, block: int = BLOCK, width: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words that occur ``least`` times or more in their language, as ``ids`` (array of the
    words' numbers) and ``f``; the words' table (``lang``, ``word``, ``f``, ``id``); and ``n``, all word occurrences, by ``lang``.

    width: bits of a word's number, by default as many as the corpus needs."""
    base = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    size = base.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    cut = max((LEAST_BUCKETS - 1).bit_length(), int(size // TO_BUCKET).bit_length())
    told = shared.keep(base.mapInArrow(partial(_blocks, block=block, cut=cut), "block long, bucket int, lang string, size long, keys binary, counts binary, locals binary"), "blocks")
    totals = shared.keep(told.where(F.col("bucket") == TOTAL).groupBy("lang").agg(F.sum("size").alias("n")), "totals")
    words = told.where("bucket >= 0").groupBy("bucket").applyInArrow(_word_merger(least), "block long, bucket int, lang string, first long, keys binary, counts binary, size long")
    words = shared.keep(words, "words")
    # One row a bucket: how many numbers the buckets before it have given.
    found = words.where("block IS NULL").groupBy("bucket").agg(F.sum("size").alias("n"))
    before = found.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    placed = shared.keep(words.join(before, "bucket"), "placed")
    numbers = shared.keep(placed.where("block IS NULL").select("lang", "before", "first", "keys", "counts").mapInArrow(_word_rows, "lang string, word string, f long, id long"), "numbers")
    width = width or max(1, int(numbers.agg(F.max("id")).first()[0] or 0).bit_length())
    named = placed.where("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("before", "keys", "counts", "size")).alias("named"))
    blocks = told.where(F.col("bucket") == TEXT).select("block", F.col("keys").alias("codes"), F.col("size").alias("places"))
    grams = numbers.select(F.array("id").alias("ids"), "f")
    alive = replies = None
    for words in range(2, longest + 1):
        now = blocks.join(named, "block", "left")
        now = now.join(alive, "block", "left") if alive is not None else now.withColumn("alive", F.lit(None).cast("binary"))
        now = now.join(replies, "block", "left") if replies is not None else now.withColumn("told", F.lit(None).cast("array<struct<bucket:int,flags:binary>>"))
        filters = now.mapInArrow(partial(_filters, words=words, width=width, cut=cut), "block long, bucket int, size int, keys binary, counts binary")
        made = shared.keep(filters, f"filters{words}")
        merged = made.where("bucket >= 0").groupBy("bucket").applyInArrow(_merger(width * words, cut, least), "block long, bucket int, keys binary, counts binary, flags binary")
        merged = shared.keep(merged, f"merged{words}")
        found = merged.where("block IS NULL").select("bucket", "keys", "counts").mapInArrow(partial(_read_back, words=words, width=width, cut=cut), "ids array<long>, f long")
        grams = grams.union(found)
        alive = made.where("bucket = -1").select("block", F.col("keys").alias("alive"))
        replies = merged.where("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("bucket", "flags")).alias("told"))
    return shared.keep(grams, "phrases"), numbers, totals


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, first: int = FIRST, cover: int = 100, block: int = BLOCK, width: int | None = None) -> DataFrame:
    """The ``first`` phrases of two to ``longest`` words per language by association: ``lang``, ``rank`` from 1, ``phrase``
    (words joined by one space), ``a`` (its occurrences), ``l`` and ``r`` (those of its parts at the cut), ``n`` (all words of
    the language) and ``score`` = floor(1000 * a * n / (l * r)), exact; ties by ``a`` descending, then the phrase's bytes.

    A-Z are lower-cased, ``ENDS`` part pieces, space and tab part words; phrases lie within a piece and may overlap. A phrase
    needs ``least`` occurrences. Of its cuts into two parts the one with the lowest score counts, ties to the shorter first
    part. A phrase is left out if a longer one that holds it has ``cover`` hundredths of its occurrences or more. A null
    language is ``und``, null texts are empty; repeated rows count each; an empty table gives none; other columns are left out."""
    grams, numbers, totals = count_phrases(docs, text, lang, least, longest, block, width)
    phrases = grams.where(F.size("ids") > 1).select("ids", F.col("f").alias("a"))
    of = numbers.select(F.array("id").alias("lead"), "lang").join(totals, "lang")
    placed = phrases.withColumn("lead", F.slice("ids", 1, 1)).join(of, "lead")
    cuts = placed.select("ids", "a", "lang", "n", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("slice(ids, 1, k)").alias("head"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("rest"))
    known = lambda name, n: grams.select(F.col("ids").alias(name), F.col("f").alias(n))
    scored = cuts.join(known("head", "l"), "head").join(known("rest", "r"), "rest").withColumn("score", F.expr("(cast(1000 AS decimal(4, 0)) * cast(a * cast(n AS decimal(19, 0)) AS decimal(34, 0))) div (cast(l AS decimal(19, 0)) * cast(r AS decimal(18, 0)))"))
    lowest = scored.groupBy("ids").agg(F.min(F.struct("score", "k", "l", "r", "a", "lang", "n")).alias("x")).select("ids", "x.*")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("ids") - n + 1), lambda i: F.slice("ids", i, n))))
    longer = phrases.where(F.size("ids") > 2).select(F.explode(inner).alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("held"))
    left = lowest.join(longer, "ids", "left").where(F.col("held").isNull() | (100 * F.col("held") < cover * F.col("a")))
    near = left.withColumn("near", F.rank().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc()))).where(F.col("near") <= first)
    spelt = near.select("ids", F.posexplode("ids").alias("at", "id")).join(numbers.select("id", "word"), "id").groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    named = near.join(spelt, "ids").withColumn("phrase", F.concat_ws(" ", "words.word"))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same rows for ``documents`` with the default bounds, in DuckDB's SQL.
STATEMENT = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, words FROM (
    SELECT lang, list_filter(string_split_regex(part, '[ \t]+'), lambda w: w <> '') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part FROM documents))),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY lang),
sizes AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
places AS (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM pieces, sizes WHERE len(words) >= k),
counted AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM counted WHERE k > 1),
cuts AS (
  SELECT lang, k, phrase, a, j, array_to_string(words[1:j], ' ') AS head, array_to_string(words[j + 1:k], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates)),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.j, x.f AS l, y.f AS r, t.n,
    CAST(CAST(1000 AS HUGEINT) * c.a * t.n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.head JOIN counted y ON y.lang = c.lang AND y.phrase = c.rest
    JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM scored),
inside AS (
  SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, max(a) AS held
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates)) GROUP BY ALL),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE place = 1 AND (held IS NULL OR 100 * held < 100 * a))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
