"""Periodic runs of words. The grouping of Baier's suffix sorter (its phase one) gives the longest Lyndon word that starts at
each place, under an order of the words and under its reverse; every run has one of them as a root, and extending the roots to
both sides through longest common extensions gives the runs (Bannai and others).

Before that, each text is narrowed without loss: a run of at least ``least`` words that holds its period ``power`` times is
covered by windows of ``least // power`` words that the text repeats, so only stretches covered so are sorted. Equal window
hashes of different words would only widen a stretch."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.llm import bpe
from pagestrata.llm.substrings import rolling

LEAST, POWER = 24, 3
_BASE, _MIX, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_RUN = "struct<start:long,length:long,period:long>"


def lyndon_lengths(text: list[int]) -> list[int]:
    """For each place of a text of small numbers (0, 1, 2, … all used), the length of the longest Lyndon word starting there.

    Groups hold the places whose Lyndon word is known to begin alike, in the order of those words. From the highest group
    down, each member looks left for the nearest place of a lower group; places that c members of the group look back to are
    split off into a group right above their own, their word followed by c times the group's."""
    size = max(text, default=-1) + 1
    group, members = list(text), [[] for _ in range(size)]
    for i, c in enumerate(text):
        members[c].append(i)
    width, below, above = [1] * size, list(range(-1, size - 1)), list(range(1, size + 1))
    back, done, length = [-1] * len(text), [False] * len(text), [0] * len(text)
    now = size - 1
    while now >= 0:
        wide, own = width[now], [i for i in members[now] if group[i] == now]
        looked: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and (done[j] or group[j] == now):
                j = back[j]
            back[i], length[i] = j, wide
            if j >= 0:
                looked[j] = looked.get(j, 0) + 1
        for i in own:
            done[i] = True
        apart: dict[tuple[int, int], list[int]] = {}
        for j, c in looked.items():
            apart.setdefault((c, group[j]), []).append(j)
        for c, old in sorted(apart, reverse=True):  # more repeats stand higher, so they are put right above first
            new, over = len(members), above[old]
            members.append(apart[c, old])
            width.append(width[old] + c * wide)
            below.append(old)
            above.append(over)
            below[over], above[old] = new, new
            for j in apart[c, old]:
                group[j] = new
        now = below[now]
    return length


def block_names(text: np.ndarray, longest: int) -> list[np.ndarray]:
    """For k = 0, 1, 2, …: a number for the 2^k words at each place, equal where the words are, as far as ``longest`` needs."""
    names = [np.unique(text, return_inverse=True)[1].astype(np.int64)]
    while 2 << (len(names) - 1) <= longest:
        half, last = 1 << (len(names) - 1), names[-1]
        names.append(np.unique(last[:-half] * (len(text) + 1) + last[half:], return_inverse=True)[1].astype(np.int64))
    return names


def common(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
    """How many words agree from places a and b on, or up to them where not ``forward``."""
    found = np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        x, y = (a + found, b + found) if forward else (a - found - (1 << k) + 1, b - found - (1 << k) + 1)
        inside = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < len(names[k]))
        same = np.zeros(len(a), bool)
        same[inside] = names[k][x[inside]] == names[k][y[inside]]
        found += same.astype(np.int64) << k
    return found


def repeated_stretches(words: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """True where a word lies in a window of so many words that its text holds elsewhere too. Windows do not pass from one
    owner to the next."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(len(words), bool)
    with np.errstate(over="ignore"):
        spread = words.astype(np.uint64) * _MIX
        hashes = rolling((spread ^ (spread >> np.uint64(31))) * _MIX, window, _BASE) + owner[:n].astype(np.uint64) * _STEP
    whole = np.nonzero(owner[:n] == owner[window - 1 :])[0]
    by = whole[np.argsort(hashes[whole])]
    alike = hashes[by][1:] == hashes[by][:-1]
    again = by[np.append(alike, False) | np.append(False, alike)] if len(by) else by
    steps = np.zeros(len(words) + 1, np.int32)
    np.add.at(steps, again, 1)
    np.add.at(steps, again + window, -1)
    return np.cumsum(steps[:-1]) > 0


def runs_of(words: np.ndarray, owner: np.ndarray, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, ...]:
    """Owner, first place, length and smallest period of every run of at least ``least`` words that holds its period ``power``
    times (2 at least), by owner, place and period. words: numbers of the words of all texts; owner: ascending, the text of each."""
    nothing = (np.zeros(0, np.int64),) * 4
    kept = repeated_stretches(words, owner, max(1, least // max(power, 3)))
    edge = np.nonzero(np.append(True, (kept[1:] != kept[:-1]) | (owner[1:] != owner[:-1])))[0] if len(words) else np.zeros(0, np.int64)
    ends = np.append(edge[1:], len(words))[: len(edge)]
    stretches = [(a, b) for a, b in zip(edge.tolist(), ends.tolist(), strict=True) if kept[a] and b - a >= max(least, power)]
    if not stretches:
        return nothing
    parts, places, rooted, root = [], [], [], []
    at, mark = 0, int(words.max()) + 1
    for a, b in stretches:  # each stretch, then a word of its own that nothing equals
        names = np.unique(words[a:b], return_inverse=True)[1]
        for order in (names, names.max() - names):
            size = np.array(lyndon_lengths(order.tolist()), np.int64)
            fit = np.nonzero(size * power <= b - a)[0]
            rooted.append(at + fit)
            root.append(size[fit])
        parts += [words[a:b], np.array([mark])]
        places.append(np.arange(a, b + 1))
        at, mark = at + b - a + 1, mark + 1
    text, origin = np.concatenate(parts), np.concatenate(places)
    first, period = np.unique(np.stack([np.concatenate(rooted), np.concatenate(root)]), axis=1)
    names = block_names(text, max(b - a for a, b in stretches))
    right = common(names, first, first + period, True)
    left = common(names, first - 1, first + period - 1, False)
    start, length = first - left, left + period + right
    long = length >= np.maximum(least, power * period)
    if not long.any():
        return nothing
    start, length, period = np.unique(np.stack([start[long], length[long], period[long]]), axis=1)
    start = origin[start]
    order = np.lexsort((period, start, owner[start]))
    return owner[start[order]], start[order], length[order], period[order]


def _told(texts: list[bytes], least: int, power: int) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """For each text: words, runs as (start, length, period), and the words kept, joined by one space."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    split = [t.split() for t in texts]
    sizes = np.array([len(p) for p in split], np.int64)
    words = np.fromiter((numbers[w] for parts in split for w in parts), np.int64, int(sizes.sum()))
    begins = np.cumsum(sizes) - sizes
    of, start, length, period = runs_of(words, np.repeat(np.arange(len(texts)), sizes), least, power)
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    for i, parts in enumerate(split):
        mine = slice(bounds[i], bounds[i + 1])
        place, long, step = start[mine] - begins[i], length[mine], period[mine]
        if not len(place):
            yield len(parts), [], b" ".join(parts)
            continue
        change = np.zeros(len(parts) + 1, np.int64)
        np.add.at(change, place + step, 1)
        np.add.at(change, place + long, -1)
        stay = np.nonzero(np.cumsum(change[:-1]) == 0)[0].tolist()
        yield len(parts), list(zip(place.tolist(), long.tolist(), step.tolist(), strict=True)), b" ".join([parts[k] for k in stay])


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST, power: int = POWER) -> DataFrame:
    """docs with the new columns ``n_words``, ``runs`` (array of start, length, period in words, by start, then period),
    ``strongest`` (the run of greatest length / period, compared exactly; ties to the smaller start, then period; null without
    runs) and ``collapsed`` (the words that no run holds after its first period, joined by one space). Columns so named before
    are replaced, all others stay.

    A run is a stretch of words with smallest period q, at least ``least`` words and ``power`` * q long (power 3 at least), that
    no neighbouring word extends. ASCII white space parts words. Null, empty and blank texts have no words, no runs and an
    empty ``collapsed``; repeated rows fare alike; an empty table gives none. Each row is worked on by itself, whole, however
    long or frequent its text is; rows are not shuffled."""
    if power < 3 or least < power:
        raise ValueError("power must be 3 at least, and least no smaller than power")
    own = [c for c in docs.columns if c not in ("n_words", "runs", "strongest", "collapsed")]
    place = own.index(text)
    run_type = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for a, b in bpe.in_portions(texts):
                rows = list(_told([(t or "").encode() for t in texts[a:b]], least, power))
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in r[1]] for r in rows]
                best = [_strongest(r[1]) for r in rows]
                told = [None if r is None else {"start": r[0], "length": r[1], "period": r[2]} for r in best]
                columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array(runs, pa.list_(run_type)), pa.array(told, run_type), pa.array([r[2].decode() for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *columns], [*own, "n_words", "runs", "strongest", "collapsed"])

    made = {"n_words": "long", "runs": f"array<{_RUN}>", "strongest": _RUN, "collapsed": "string"}
    return docs.select(*[f"`{c}`" for c in own]).mapInArrow(run, docs.select(*[f"`{c}`" for c in own]).withColumns({k: F.lit(None).cast(v) for k, v in made.items()}).schema)


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    best = None
    for r in runs:  # by start, then period: the first of equals stays
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs in which a tenth of the texts repeat themselves from some word on. h is the CRC-32 of the key in decimals and g a
    tenth of it; where h is divisible by ten, the n words (parted by ASCII white space) from number a = g % n on become the
    first p = 1 + (n - a) / (3 + g % 8) of them, again and again. Rows without a key or without words stay as they are."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    held = next(c for c in (f"_words{i}" for i in range(len(docs.columns) + 1)) if c not in docs.columns)
    g, n = F.floor(h / 10), F.size(held).cast("long")  # -1 where there is no array
    a = F.when(n > 0, g % n).cast("int")
    tail = (n - a).cast("int")
    p = (1 + F.floor(tail / (3 + g % 8))).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(held, a + 1, p), F.ceil(tail / p).cast("int"))), F.lit(1), tail)
    whole = F.concat_ws(" ", F.concat(F.slice(held, F.lit(1), a), again))
    return docs.withColumn(held, F.when(h % 10 == 0, words)).withColumn(text, F.when(n > 0, whole).otherwise(F.col(text))).drop(held)
