"""Toxic spans and document scores from a linear-chain conditional random field.

Labels are given for documents; the labelled tokens come from them: words of which the whole or a
beginning tells toxic sampled documents from clean ones are toxic tokens there, all others are not. The field has two states,
weights for a word and its beginnings, and transition weights; it is trained by gradient steps on forward-backward expectations. A document's marginals give
its offending offsets, and their expected number and maximum its score."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.llm import bpe

#: Labelled documents of each class that the field is fitted on at most; its feature slots, steps and the decision level.
FIT_ROWS, SLOTS, STEPS, LEVEL = 2000, 1 << 18, 24, 0.7
#: Lengths of the beginnings of a word that are features.
BEGINNINGS = range(3, 9)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def bare(word: str) -> str:
    return _EDGE.sub("", word.lower())


def features(word: str) -> list[str]:
    """Of a bare word: itself and its beginnings."""
    return ["w" + word, *("b" + word[:k] for k in BEGINNINGS if len(word) >= k)]


def slots_of(word: str) -> list[int]:
    """Where the weights of its features lie; the place after the last stands for none."""
    found = [xxhash.xxh3_64_intdigest(x.encode()) % SLOTS for x in features(word)]
    return found + [SLOTS] * (1 + len(BEGINNINGS) - len(found))


@dataclass
class Chains:
    """Sequences laid out step by step, longest first: at each step those that still run lie side by side."""

    size: np.ndarray

    def __post_init__(self):
        self.order = np.argsort(-self.size, kind="stable")
        lengths = self.size[self.order]
        steps = int(lengths[0]) if len(lengths) else 0
        self.running = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")
        self.base = np.append(0, np.cumsum(self.running))
        rank = np.empty(len(self.size), np.int64)
        rank[self.order] = np.arange(len(self.size))
        first = np.cumsum(self.size) - self.size
        step = np.arange(int(self.size.sum())) - np.repeat(first, self.size)
        self.place = self.base[step] + np.repeat(rank, self.size)  # of each token in reading order

    def marginals(self, odds: np.ndarray, move: np.ndarray, start: float, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Chance of the toxic state at each token, and expected transitions. Two states need but the ratio of their weights;
        odds: emission weight of the toxic state over the other, move: transition weights."""
        (oo, ot), (to, tt) = move
        e = np.empty(len(odds))
        e[self.place] = odds
        ahead = np.empty(len(odds))
        base, running = self.base.tolist(), self.running.tolist()
        for t, n in enumerate(running):
            a = base[t]
            if t:
                r = ahead[base[t - 1] : base[t - 1] + n]
                ahead[a : a + n] = e[a : a + n] * (r * tt + ot) / (r * to + oo)
            else:
                ahead[:n] = e[:n] * start
        back, sums = np.ones(len(odds)), np.zeros((2, 2))
        for t in range(len(running) - 1, 0, -1):
            a, b, n = base[t], base[t - 1], running[t]
            q = e[a : a + n] * back[a : a + n]
            back[b : b + n] = (tt * q + to) / (ot * q + oo)
            if pairs:
                r = ahead[b : b + n]
                w = oo + ot * q + r * (to + tt * q)
                sums += [[(oo / w).sum(), (ot * q / w).sum()], [(to * r / w).sum(), (tt * r * q / w).sum()]]
        p = ahead * back
        return (p / (1 + p))[self.place], sums


def telling_features(named: np.ndarray, token: np.ndarray, size: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which features mark toxic documents. named: the features of each kind of word (-1: none); token: kinds in reading order.

    A feature speaks once for a document and once for a word that it follows, so that copies of one document count as one.
    It must be twenty times as frequent in toxic documents and go beyond what the best of so many features has by chance."""
    owner = np.repeat(np.arange(len(size)), size)
    kinds, n_features = len(named), int(named.max(initial=-1)) + 1
    pair = np.unique(owner * kinds + token)
    doc, feature = np.repeat(pair // kinds, named.shape[1]), named[pair % kinds].ravel()
    pair = np.unique((doc * n_features + feature)[feature >= 0])
    in_toxic = toxic[pair // n_features]
    k, c = (np.bincount(pair[x] % n_features, minlength=n_features) for x in (in_toxic, ~in_toxic))
    before = np.append(-1, token[:-1])
    before[(np.cumsum(size) - size)[size > 0]] = -1
    at = np.nonzero(toxic[owner])[0]
    met = np.unique((before[at] + 1) * kinds + token[at])
    word, feature = np.repeat(met // kinds, named.shape[1]), named[met % kinds].ravel()
    met = np.unique((word * n_features + feature)[feature >= 0])
    k = np.minimum(k, np.bincount(met % n_features, minlength=n_features))
    n, m = int(toxic.sum()), int((~toxic).sum())
    told = lambda x, of, p: x * np.log(np.maximum(p, 1e-12)) + (of - x) * np.log(np.maximum(1 - p, 1e-12))
    gain = 2 * (told(k, n, k / n) + told(c, m, c / m) - told(k + c, n + m, (k + c) / (n + m)))
    return (k >= 3) & (k * m >= 20 * c * n) & (gain > 2 * np.log(max(2, n_features)) - 6)


def fit(texts: list[str], toxic: np.ndarray, prior: float) -> dict:
    """The field's weights and the document model, from whole sampled texts. Documents of both classes are weighted to the
    share that all labels show."""
    kinds: dict[str, int] = {}
    tokens, size = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = [bare(w) for w in _WORD.findall(t)]
        size[i] = len(words)
        tokens.append(np.fromiter((kinds.setdefault(w, len(kinds)) for w in words), np.int64, len(words)))
    token = np.concatenate(tokens)
    names: dict[str, int] = {}
    named = np.full((len(kinds), 1 + len(BEGINNINGS)), -1, np.int64)
    for w, i in kinds.items():
        found = [names.setdefault(f, len(names)) for f in features(w)] if w else []
        named[i, : len(found)] = found
    telling = np.append(telling_features(named, token, size, toxic), False)
    truth = telling[named].any(axis=1)[token] & np.repeat(toxic, size)
    slots = np.array([slots_of(w) for w in kinds], np.int64).reshape(-1, 1 + len(BEGINNINGS))
    chains = Chains(size)
    weight, move, bias, start = np.zeros(SLOTS + 1), np.zeros((2, 2)), -2.0, -2.0
    then = np.ones(len(token), bool)
    then[(np.cumsum(size) - size)[size > 0]] = False
    pairs, at = np.zeros((2, 2)), np.nonzero(then)[0]
    np.add.at(pairs, (truth[at - 1].astype(int), truth[at].astype(int)), 1)
    pace, moved = np.full(SLOTS + 1, 1e-3), np.full((2, 2), 1e-3)
    emission = lambda: np.exp(np.clip(bias + weight[slots].sum(axis=1), -30, 30))[token]
    for _ in range(STEPS if len(token) else 0):
        p, expected = chains.marginals(emission(), np.exp(move), float(np.exp(start)), pairs=True)
        pull = np.bincount(token, weights=truth - p, minlength=len(kinds))
        slope = np.bincount(slots.ravel(), weights=np.repeat(pull, slots.shape[1]), minlength=SLOTS + 1) - 0.02 * weight
        pace += slope**2
        weight += 0.5 * slope / np.sqrt(pace)
        weight[SLOTS] = 0
        step = pairs - expected - 0.02 * move
        moved += step**2
        move += 0.5 * step / np.sqrt(moved)
        move -= move[0, 0]  # only differences count
    p, _ = chains.marginals(emission(), np.exp(move), float(np.exp(start)))
    x = summary(p, size)
    share = np.where(toxic, prior / max(1, toxic.sum()), (1 - prior) / max(1, (~toxic).sum()))
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / spread])
    w = np.zeros(z.shape[1])
    for _ in range(40):  # weighted logistic regression by Newton steps, with a small penalty
        s = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (share * (toxic - s)) - 1e-4 * w
        bend = (z * (share * s * (1 - s))[:, None]).T @ z + 1e-4 * np.eye(len(w))
        w += np.clip(np.linalg.solve(bend, slope), -2, 2)
    used = np.nonzero(np.abs(weight) > 0.01)[0]
    return {"slots": used.tolist(), "weights": weight[used].round(4).tolist(), "move": move.tolist(), "bias": bias, "start": start, "mean": mean.tolist(), "spread": spread.tolist(), "document": w.tolist()}


def summary(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each document: logarithm of one plus the expected toxic tokens, and the largest marginal."""
    out = np.zeros((len(size), 2))
    full = np.nonzero(size)[0]
    if len(full):
        first = (np.cumsum(size) - size)[full]
        out[full] = np.stack([np.log1p(np.add.reduceat(p, first)), np.maximum.reduceat(p, first)], axis=1)
    return out


class Field:
    """A fitted model at work; a task remembers the weight of the words it meets."""

    def __init__(self, told: dict):
        self.weight = np.zeros(SLOTS + 1)
        self.weight[np.array(told["slots"], np.int64)] = told["weights"]
        self.told, self.move = told, np.exp(np.array(told["move"]))
        self.known = _Odds(self)

    def emission(self, word: str) -> float:
        return float(np.exp(min(30.0, max(-30.0, self.told["bias"] + self.weight[slots_of(bare(word))].sum()))))

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Scores, and offsets (code points, end excluded) of the words more likely toxic than not, neighbours joined."""
        odds, size = [], np.zeros(len(texts), np.int64)
        if len(self.known) > bpe.REMEMBERED:
            self.known.clear()
        for i, t in enumerate(texts):
            words = _WORD.findall(t)
            size[i] = len(words)
            odds.append(np.fromiter(map(self.known.__getitem__, words), float, len(words)))
        p, _ = Chains(size).marginals(np.concatenate(odds) if odds else np.zeros(0), self.move, float(np.exp(self.told["start"])))
        z = (summary(p, size) - self.told["mean"]) / self.told["spread"]
        w = self.told["document"]
        score = 1 / (1 + np.exp(-np.clip(w[0] + z @ np.array(w[1:]), -30, 30)))
        bad = p > 0.5
        first = np.append(0, np.cumsum(size))
        spans = []
        for i, t in enumerate(texts):
            here = bad[first[i] : first[i + 1]]
            spans.append(_spans(t, here) if here.any() else [])
        return score, spans


class _Odds(dict):
    def __init__(self, field: Field):
        super().__init__()
        self.field = field

    def __missing__(self, word: str) -> float:
        self[word] = x = self.field.emission(word)
        return x


def _spans(text: str, bad: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    before = False
    for m, b in zip(_WORD.finditer(text), bad.tolist(), strict=True):
        if b:
            if before:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append(m.span())
        before = b
    return out


def held_out(key: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the key as text leaves 1 when divided by 3; a null key is one."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit_field(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> dict | None:
    """The model from at most ``rows`` documents of each class, those with the smallest hash of their key; None unless both
    classes are there. A key's labels of 1 outweigh those of 0; nulls are left out. Of rows that share a key only the least text
    is learned from, found before anything is shuffled, so the sample that is fitted in one task keeps its bound."""
    told = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key))).groupBy(F.col(key).alias("_key")).agg((F.max(label) == 1).alias("_toxic"))
    have = {r["_toxic"]: r["count"] for r in told.groupBy("_toxic").count().collect()}
    if len(have) < 2:
        return None
    prior = have[True] / (have[True] + have[False])
    drawn = [told.where(F.col("_toxic") == is_toxic).orderBy(F.xxhash64("_key"), "_key").limit(rows) for is_toxic in (True, False)]
    sample = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("body")).join(F.broadcast(drawn[0].union(drawn[1])), "_key").groupBy("_key").agg(F.min("body").alias("body"), F.first("_toxic").alias("_toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += batch.column(1).to_pylist()
            toxic += batch.column(2).to_pylist()
        told = fit(texts, np.array(toxic, bool), prior) if 0 < sum(toxic) < len(toxic) else None
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(told)])], ["model"])

    one = sample.select(F.xxhash64("_key").alias("place"), "body", "_toxic").repartition(1).sortWithinPartitions("place", "body")
    made = one.mapInArrow(run, "model string").first()
    return json.loads(made["model"]) if made else None  # an empty plan runs no task


def score_documents(docs: DataFrame, model: dict | None, key: str = "doc_id", text: str = "text", level: float = LEVEL) -> DataFrame:
    """docs with ``score`` (0 to 1), ``predicted`` (1 if the score reaches the level) and ``spans`` (offsets of toxic words) in
    place of columns so named.

    A null, empty or blank text has no words and the score of a document without toxic words. Without a model every score
    is 0. Rows are scored one by one from their text alone: repeated rows, null keys and other columns stay; an empty
    table gives none. Nothing is shuffled."""
    own = [c for c in docs.columns if c not in ("score", "predicted", "spans")]
    base, place = docs.select(*own), own.index(text)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(model) if model else None
        for batch in batches:
            texts = [x or "" for x in batch.column(place).to_pylist()]
            for a, b in bpe.in_portions(texts, 1 << 24):
                score, spans = field.score(texts[a:b]) if field else (np.zeros(b - a), [[]] * (b - a))
                told = pa.array([[{"first": s, "end": e} for s, e in x] for x in spans], kind)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(score), pa.array((score >= level).astype(np.int32)), told], [*own, "score", "predicted", "spans"])

    shape = base.withColumns({"score": F.lit(0.0), "predicted": F.lit(0), "spans": F.lit(None).cast("array<struct<first:int,end:int>>")}).schema
    return base.mapInArrow(run, shape)
