"""Exact token counts at every prefix of a text.

A cut at a token's end splits an encoding into the encodings of its two sides, and a row of tokens is an encoding if every
neighbouring pair is one. So the last token of a prefix follows from the last tokens of shorter prefixes: of the vocabulary
entries that end there, exactly one is compatible with the last token before it. One walk forward over a piece thus gives the
encoding of all its prefixes; pieces add up. Lengths, truncation to a budget and budget checks are then read from the table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.llm import bpe

NEVER = 1 << 40
_SHORT, _BLANKS = ("'re", "'ve", "'ll"), regex.compile(r"\s{2,}")


class Prefixes:
    """Prefix encodings of pieces under one vocabulary."""

    def __init__(self, known: bpe.Vocabulary):
        self.known = known
        texts = [known.text_of[i] for i in range(known.size)]
        ordinary = [(i, t.endswith(known.suffix) if known.suffix else None) for t, i in known.ids.items()]
        # How each token comes about: the merge that makes it when its own text is encoded, if that gives the token back.
        born, lefts, rights = np.full(known.size, NEVER), np.full(known.size, -1), np.full(known.size, -1)
        usable = np.zeros(known.size, bool)
        for closed in (False, True) if known.suffix else (None,):
            ids = np.array([i for i, c in ordinary if c == closed])
            made, counts, last = self._open(known, closed).encode([texts[i] for i in ids])
            ends = np.cumsum(counts) - 1
            whole = (counts == 1) & (made[ends] == ids)
            usable[ids[whole]] = True
            merged = whole & (last >= 0)
            born[ids[whole]] = last[whole]
            lefts[ids[merged]], rights[ids[merged]] = known.left[last[merged]], known.right[last[merged]]
        self.born, self.lefts, self.rights = born, lefts, rights
        # The tree of token texts: a step is (node, byte) -> node; a node names the token it spells inside and at the end of a piece.
        nodes: dict[tuple[int, int], int] = {}
        inner, final = [-1], [-1]
        for i, closed in ordinary:
            if not usable[i]:
                continue
            at = 0
            for b in texts[i]:
                to = nodes.get((at, b))
                if to is None:
                    to = nodes[at, b] = len(inner)
                    inner.append(-1)
                    final.append(-1)
                at = to
            if closed is not True:
                inner[at] = i
            if closed is not False:
                final[at] = i
        self.inner, self.final = np.array(inner), np.array(final)
        keys = np.array([a * 256 + b for a, b in nodes], dtype=np.int64)
        order = np.argsort(keys)
        self.steps, self.targets = keys[order], np.fromiter(nodes.values(), np.int64, len(nodes))[order]

    @staticmethod
    def _open(known: bpe.Vocabulary, closed: bool | None) -> bpe.Vocabulary:
        """The vocabulary as it encodes texts that go on (or end, or either)."""
        if closed is not False:
            return known
        like = object.__new__(bpe.Vocabulary)
        like.__dict__.update(known.__dict__ | {"last": known.first})
        return like

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens a and b, side by side, are the encoding of their joined text.

        Seen backwards, the younger of the two facing parts falls into its halves; as long as both parts stand, a merge of
        the two must not come before the merge that takes one of them away. At equal rank the left place goes first."""
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        until_x, until_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(live):
            joined = self.known.rank(x, y)
            bad = (joined < bpe.NO_RANK) & (joined < until_x) & (joined <= until_y)
            good[live[bad]] = False
            age_x, age_y = np.where(self.lefts[x] >= 0, self.born[x], -1), np.where(self.lefts[y] >= 0, self.born[y], -1)
            go = ~bad & ((age_x >= 0) | (age_y >= 0))
            live, x, y, until_x, until_y, age_x, age_y = (v[go] for v in (live, x, y, until_x, until_y, age_x, age_y))
            of_y = age_y >= age_x
            until_x, until_y = np.where(of_y, until_x, age_x), np.where(of_y, age_y, until_y)
            x, y = np.where(of_y, x, self.rights[x]), np.where(of_y, self.lefts[y], y)
        return good

    def counts(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For all pieces one after another, at each byte: tokens of the prefix that ends there; and the pieces' lengths."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        ends = np.repeat(np.cumsum(size), size)
        begin = np.arange(len(raw))
        node, at, spans = np.zeros(len(raw), np.int64), begin, []
        start = begin
        while len(at):
            want = node * 256 + raw[at]
            k = np.minimum(np.searchsorted(self.steps, want), len(self.steps) - 1)
            there = self.steps[k] == want
            start, at, node = start[there], at[there], self.targets[k[there]]
            named = (self.inner[node] >= 0) | (self.final[node] >= 0)
            spans.append((start[named], at[named], node[named]))
            on = at + 1 < ends[start]
            start, at, node = start[on], at[on] + 1, node[on]
        first, end, node = (np.concatenate(x) if spans else np.zeros(0, np.int64) for x in zip(*spans, strict=True)) if spans else (np.zeros(0, np.int64),) * 3
        begins = np.repeat(np.cumsum(size) - size, size)
        offset = end - begins[end]
        order = np.argsort(offset, kind="stable")
        first, end, node, offset = first[order], end[order], node[order], offset[order]
        token, inside, whole = np.full(len(raw), -1), np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        cuts = np.searchsorted(offset, np.arange(int(size.max(initial=0)) + 1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            f, e, n = first[a:b], end[a:b], node[a:b]
            opens = f == begins[f]
            tail = np.where(opens, -1, token[f - 1])
            ready = opens | (tail >= 0)
            for ids, final in ((self.inner[n], False), (self.final[n], True)):
                if final and not self.known.suffix:
                    break
                use = np.nonzero(ready & (ids >= 0))[0]
                fits = opens[use].copy()
                ask = use[~fits]
                fits[~fits] = self.agree(tail[ask], ids[ask])
                use = use[fits]
                have = np.where(opens[use], 0, inside[f[use] - 1]) + 1
                if final:
                    whole[e[use]] = have
                else:
                    token[e[use]], inside[e[use]] = ids[use], have
        return (whole if self.known.suffix else inside), size


@lru_cache(maxsize=2)
def prefixes(path: str) -> Prefixes:
    return Prefixes(bpe.vocabulary(path))


class Counter:
    """Counts of whole texts and of their prefixes; a task remembers the pieces it has seen."""

    def __init__(self, path: str):
        self.known, self.table = bpe.vocabulary(path), bpe.Remembered(self._work_out)
        self.path = path

    def _work_out(self, pieces: list[str]) -> Iterator[bytes]:
        """Of each piece, at its code points, the tokens of the prefix that ends there: unsigned 32-bit."""
        raw = [p.encode() for p in pieces]
        counts, size = prefixes(self.path).counts(raw)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        closes = np.append(flat[1:] & 0xC0, 0) != 0x80
        ends = np.cumsum(size)
        held = np.append(0, np.cumsum(closes))
        kept = counts[closes].astype("<u4").tobytes()
        return (kept[4 * a : 4 * b] for a, b in zip(held[ends - size].tolist(), held[ends].tolist(), strict=True))

    def learn(self, texts: list[str]) -> list[list[tuple[str, list[str] | None]]]:
        cut = [[(x, self.known.pieces(x) if i is None else None) for x, i in self.known.parts(t)] for t in texts]
        self.table.learn([p for parts in cut for _, p in parts if p is not None])
        return cut

    def totals(self, texts: list[str]) -> list[int]:
        """Counts at the last prefix."""
        out = []
        for parts in self.learn(texts):
            n = 0
            for _, pieces in parts:
                if pieces is None:
                    n += 1
                elif pieces:
                    n += int(np.frombuffer(b"".join([self.table[p][-4:] for p in pieces]), "<u4").sum())
            out.append(n)
        return out

    def along(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for 0 to all of its code points, the tokens of that prefix."""
        shown, counts, n, ordinary = [], [np.zeros(1, np.int64)], 0, ("", 0)
        for x, pieces in self.learn([text])[0]:
            shown.append(x)
            if pieces is None:  # a special token counts once it is whole; before that its letters go on the text before it
                before, base = ordinary
                inner = [base + t for t in self.totals([before + x[: i + 1] for i in range(len(x) - 1)])]
                counts.append(np.array([*inner, n + 1], np.int64))
                n, ordinary = n + 1, ("", n + 1)
                continue
            here = np.zeros(len(x), np.int64)
            at, base = 0, n
            for p in pieces:
                to = x.index(p, at)
                here[at:to] = base
                here[to : to + len(p)] = base + self.inside(p)
                base, at = int(here[to + len(p) - 1]), to + len(p)
            here[at:] = base
            if not self.known.suffix:  # a prefix that ends within white space has that stretch as one piece
                for m in _BLANKS.finditer(x):
                    here[m.start() : m.end()] = (here[m.start() - 1] if m.start() else n) + self.inside(m[0])
            counts.append(here)
            n, ordinary = base, (x, n)
        return "".join(shown), np.concatenate(counts)

    def inside(self, piece: str) -> np.ndarray:
        """Tokens of the prefixes of a piece, each taken as the end of the text."""
        self.table.learn([[piece, *(piece[:2] if piece in _SHORT else "")]])
        found = np.frombuffer(self.table[piece], "<u4").astype(np.int64)
        if piece in _SHORT:  # two characters of it are not yet one piece
            found[1] = found[0] + len(np.frombuffer(self.table[piece[1]], "<u4"))
        return found


def count_tokens(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``n_bytes``, ``n_tokens`` (the count at the last prefix), ``over_limit``.

    A null or empty text has no bytes and no tokens. Rows are counted one by one: repeated rows and null keys keep a row
    each, an empty table gives none, other columns are left out. Nothing is shuffled."""
    base = docs.select(F.col(key), F.col(text).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in bpe.in_portions(texts):
                n = counter.totals(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(x.encode()) for x in texts[a:b]], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], [key, "n_bytes", "n_tokens", "over_limit"]
                )

    return base.mapInArrow(run, f"`{key}` {base.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def prefix_table(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``normal`` (the normalised text) and ``counts``, an array with the tokens of its first
    0, 1, 2 ... code points. Null texts are empty: ``counts`` is then [0]."""
    return _mapped(docs, key, text, "normal string, counts array<int>", lambda counter, x: _row(counter.along(x)), path)


def truncate_to(table: DataFrame, budget: int) -> DataFrame:
    """Rows of a prefix table with ``kept``, the longest prefix of ``normal`` that has at most ``budget`` tokens."""
    fits = F.filter(F.sequence(F.lit(0), F.size("counts") - 1), lambda i: F.get("counts", i) <= budget)
    return table.withColumn("kept", F.substring("normal", F.lit(1), F.array_max(fits)))


def _row(found: tuple[str, np.ndarray]) -> tuple[str, list[int]]:
    return found[0], found[1].tolist()


def _mapped(docs: DataFrame, key: str, text: str, schema: str, work: Callable, path: str) -> DataFrame:
    base = docs.select(F.col(key), F.col(text).alias("body"))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            for i, x in enumerate(batch.column(1).to_pylist()):
                row = work(counter, x or "")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([row[0]]), pa.array([row[1]], pa.list_(pa.int32()))], [key, *names])

    return base.mapInArrow(run, f"`{key}` {base.schema[0].dataType.simpleString()}, {schema}")
