"""Byte-pair encoding and decoding by the files of the tokenizers library.

A piece of text is encoded over a segment tree whose leaves hold (rank, place) of adjacent pairs: the root is the leftmost
lowest-rank merge, and a merge changes three leaves, so it costs a logarithm of the piece's length. All pieces of similar
length go through their merges side by side, one numpy step a level."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

NO_RANK = 1 << 30
#: Text beyond this is cut where a token must end; different pieces that a task remembers; cells of a tree worked at once.
CUT, REMEMBERED, CELLS = 1 << 20, 600_000, 1 << 20
_CUT = re.compile(r"(?<=[^\s]) (?=[A-Za-z])")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


# Latin letters, numbers and white space below U+0180, where the standard pattern engine can take the place of the full one.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾", r"\x09-\x0d\x20\x85\xa0"
_PLAIN = re.compile("[^\x00-ſ]")
# Characters long in Unicode, whose classes the pattern engines agree on; other texts are cut by the library itself.
_FAMILIAR = regex.compile("[^\x00-\u0530\u2000-\u2063\u20a0-\u20bf\u3000-\u303f\u3041-\u3096\u30a0-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")


class Vocabulary:
    """A tokenizer file: ids, merges, special tokens, and how text falls into pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.folds = told["normalizer"] is not None
        letters = byte_letters()
        size = max(chain(self.ids.values(), self.special.values())) + 1
        self.first = np.array([self.ids[c] for c in letters], dtype=np.int32)
        self.last = np.array([self.ids[c + self.suffix] for c in letters], dtype=np.int32)
        pairs = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in model["merges"]]
        self.size = size
        keys = np.array([a * size + b for a, b, _ in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.left, self.right, self.product = (np.array(x, dtype=np.int32) for x in zip(*pairs, strict=True))
        self.back = {c: bytes([b]) for b, c in enumerate(letters)}
        self.text_of: list[bytes] = [b""] * size
        for token, i in self.ids.items():
            self.text_of[i] = b"".join(map(self.back.__getitem__, token.removesuffix(self.suffix)))
        for token, i in self.special.items():
            self.text_of[i] = token.encode()
        if self.suffix:  # one number a piece, white space dropped, case folded
            self.full = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
            self.plain = re.compile(f"'(?:[stmd]|re|ve|ll)|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
        else:
            self.full = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
            self.plain = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
        library = Tokenizer.from_file(path)
        self.normalize: Callable[[str], str] = library.normalizer.normalize_str if self.folds else str
        self.library_cut = library.pre_tokenizer.pre_tokenize_str

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Stretches of a text in order: (special token, its id) or (normalised text, None); long ones cut at sure token ends."""
        for x in self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else [text]:
            if x in self.special:
                yield x, self.special[x]
            elif x:
                at = 0
                while len(x) - at > CUT and (m := _CUT.search(x, at + CUT - 1)):
                    yield self.folded(x[at : m.start()]), None
                    at = m.start()
                yield self.folded(x[at:]), None

    def folded(self, text: str) -> str:
        return text if not self.folds else text.lower() if text.isascii() else self.normalize(text)

    def pieces(self, text: str) -> list[str]:
        if not _PLAIN.search(text):
            return self.plain.findall(text)
        if not _FAMILIAR.search(text):
            return self.full.findall(text)
        return [b"".join(map(self.back.__getitem__, x)).decode() for x, _ in self.library_cut(text)]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NO_RANK)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, how many each has, and the rank of each piece's last merge (-1: none)."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        begins = np.cumsum(size) - size
        counts, lasts = np.zeros(len(pieces), np.int64), np.full(len(pieces), -1, np.int64)
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(order):
            leaves = 1 << max(1, int(size[order[at]] - 1).bit_length())
            end = int(np.searchsorted(size[order], leaves, side="right"))
            end = min(end, at + max(1, CELLS // leaves))
            group = order[at:end]
            ids, have, last = self._merged(raw, begins[group], size[group], leaves)
            counts[group], lasts[group] = have, last
            done.append((group, ids))
            at = end
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        for group, ids in done:
            have = counts[group]
            out[np.repeat(starts[group] - (np.cumsum(have) - have), have) + np.arange(len(ids))] = ids
        return out, counts, lasts

    def _merged(self, raw: np.ndarray, begins: np.ndarray, size: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, width = len(size), int(size.max())
        column = np.arange(width)
        inside = column < size[:, None]
        symbol = np.where(inside, self.first[raw[np.minimum(begins[:, None] + column, len(raw) - 1)]], -1)
        symbol[np.arange(n), size - 1] = self.last[raw[begins + size - 1]]
        after = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        far = NO_RANK * leaves
        tree = np.full((n, 2 * leaves), far, np.int64)
        if width > 1:
            row, place = np.nonzero(inside[:, 1:])
            tree[row, leaves + place] = np.minimum(self.rank(symbol[row, place], symbol[row, place + 1]) * leaves + place, far)
        level = leaves
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        last = np.full(n, -1, np.int64)
        live = np.nonzero(tree[:, 1] < far)[0]
        while len(live):
            rank, place = np.divmod(tree[live, 1], leaves)
            gone = after[live, place]
            symbol[live, place], symbol[live, gone], last[live] = self.product[rank], -1, rank
            follower, leader = after[live, gone], before[live, place]
            after[live, place] = follower
            has_follower, has_leader = follower < size[live], leader >= 0
            before[live[has_follower], follower[has_follower]] = place[has_follower]
            right = np.full(len(live), far)
            at, on, to = live[has_follower], place[has_follower], follower[has_follower]
            right[has_follower] = np.minimum(self.rank(symbol[at, on], symbol[at, to]) * leaves + on, far)
            tree[live, leaves + gone], tree[live, leaves + place] = far, right
            at, on, to = live[has_leader], leader[has_leader], place[has_leader]
            tree[at, leaves + on] = np.minimum(self.rank(symbol[at, on], symbol[at, to]) * leaves + on, far)
            rows = np.concatenate([live, live, at])
            nodes = (leaves + np.concatenate([place, gone, on])) >> 1
            while nodes[0]:
                tree[rows, nodes] = np.minimum(tree[rows, 2 * nodes], tree[rows, 2 * nodes + 1])
                nodes >>= 1
            live = live[tree[live, 1] < far]
        here = symbol >= 0
        return symbol[here], here.sum(axis=1), last


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Remembered(dict):
    """What a task knows of pieces; fresh ones are worked out together, and it starts anew when it holds too many."""

    def __init__(self, work_out: Callable[[list[str]], Iterator]):
        super().__init__()
        self.work_out = work_out

    def learn(self, lists: list[list[str]]) -> None:
        if len(self) > REMEMBERED:
            self.clear()
        fresh = list(set(chain.from_iterable(lists)).difference(self))
        if fresh:
            self.update(zip(fresh, self.work_out(fresh), strict=True))


def in_portions(texts: list[str | None], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about so many characters together."""
    start = held = 0
    for i, x in enumerate(texts):
        held += len(x or "")
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encoder(path: str) -> Callable[[list[str]], Iterator[bytes]]:
    """For texts: their ids as little-endian unsigned 32-bit numbers."""
    known = vocabulary(path)

    def work_out(pieces: list[str]) -> Iterator[bytes]:
        ids, counts, _ = known.encode([p.encode() for p in pieces])
        ends = np.cumsum(counts) * 4
        raw = ids.astype("<u4").tobytes()
        return (raw[e - 4 * c : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True))

    table = Remembered(work_out)

    def encode(texts: list[str]) -> Iterator[bytes]:
        cut = [[(known.pieces(x) if i is None else i) for x, i in known.parts(t)] for t in texts]
        table.learn([x for parts in cut for x in parts if isinstance(x, list)])
        for parts in cut:
            yield b"".join(b"".join(map(table.__getitem__, x)) if isinstance(x, list) else x.to_bytes(4, "little") for x in parts)

    return encode


def decode(path: str, ids: bytes) -> str:
    """The text of ids given as little-endian unsigned 32-bit numbers, special tokens included."""
    known = vocabulary(path)
    return b"".join(map(known.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_texts(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a binary column ``ids``: little-endian unsigned 32-bit ids of each whole text, in place of one so named.

    A null or empty text has no ids. Rows are handled one by one, so repeated rows, null keys and other columns stay
    as they are, and an empty table gives no rows. Special tokens spelled out in a text become their ids, as by default
    in the library. Nothing is shuffled."""
    base = docs.drop(ids)
    place = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for a, b in in_portions(texts):
                found = list(encode([x or "" for x in texts[a:b]]))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(found, pa.binary())], [*batch.schema.names, ids])

    return base.mapInArrow(run, base.withColumn(ids, F.lit(None).cast("binary")).schema)


def decode_texts(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with a string column of the texts that ``ids`` stand for; null ids give the empty text."""
    base = docs.drop(text)
    place = base.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in in_portions(batch.column(place).to_pylist()):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([decode(path, x or b"") for x in part.column(place).to_pylist()], pa.string())], [*batch.schema.names, text])

    return base.mapInArrow(run, base.withColumn(text, F.lit(None).cast("string")).schema)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, from the ids and texts of the two
    functions above, reduced to digests where they are made."""
    base = docs.select(F.col(key), F.col(text).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in in_portions(texts):
                n, i, d = [], [], []
                for ids in encode([x or "" for x in texts[a:b]]):
                    n.append(len(ids) // 4)
                    i.append(digest(ids))
                    d.append(digest(decode(path, ids).encode()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(i), pa.array(d)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = base.schema[0].dataType.simpleString()
    return base.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
