"""Periodic runs, held against definitions worked out by brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from pagestrata.llm import periods
from tests.llm.test_operators import BLANK


def runs_by_hand(words, least, power):
    """Every period in turn, smallest first: its maximal stretches, but those that a divisor of the period holds already."""
    out = set()
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            size = i - s + q
            if i > s and size >= max(least, power * q) and not any(a <= s and s + size <= a + n and q % p == 0 for a, n, p in out):
                out.add((s, size, q))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed_by_hand(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def strongest_by_hand(runs):
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def test_lyndon_lengths():
    rng = random.Random(1)
    for _ in range(1500):
        text = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 30))]
        text = np.unique(text, return_inverse=True)[1].tolist()
        want = []
        for i in range(len(text)):
            j = i + 1
            while j < len(text) and text[j:] > text[i:]:
                j += 1
            want.append(j - i)
        assert periods.lyndon_lengths(text) == want
    assert periods.lyndon_lengths([]) == []


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(None, None), (1, ""), (2, " \n\t"), (3, "word"), (4, "a " * 23), (5, "a " * 24), (5, "a " * 24), (None, "b c " * 300), (6, "x y z " * 20), (7, "a b a " * 9000)]
    for i in range(10, 130):
        words = []
        while len(words) < rng.choice((10, 80, 300)):
            step = [rng.choice("abcxyz") for _ in range(rng.randint(1, 25))]
            words += step * rng.randint(1, 5) if rng.random() < 0.5 else [rng.choice("abcdefghijklmnop")]
        rows.append((i, " ".join(words)))
    return spark.createDataFrame([(k, t, 1, "own", 0) for k, t in rows], "doc_id long, text string, runs int, collapsed string, _words0 int").repartition(3)


@pytest.mark.parametrize(("least", "power"), [(24, 3), (6, 3), (10, 4)])
def test_runs_against_brute_force(table, least, power):
    for r in periods.find_runs(table, least=least, power=power).collect():
        words = BLANK.findall(r["text"] or "")
        runs = runs_by_hand(words, least, power) if len(words) < 2000 else [(0, len(words), 3)]
        assert [tuple(x) for x in r["runs"]] == runs and r["n_words"] == len(words)
        assert r["strongest"] == strongest_by_hand(runs) and r["collapsed"] == collapsed_by_hand(words, runs)


def test_shape(table):
    found = periods.find_runs(table)
    assert found.columns == ["doc_id", "text", "_words0", "n_words", "runs", "strongest", "collapsed"]
    assert found.count() == table.count() and periods.find_runs(table.where("false")).count() == 0
    with pytest.raises(ValueError):
        periods.find_runs(table, power=2)


def test_planted(table):
    held = {(r["doc_id"], r["_words0"]): r["text"] for r in table.where("doc_id >= 10").collect()}
    found = periods.planted(table)
    assert found.columns == table.columns and found.count() == table.count()
    for r in found.where("doc_id >= 10").collect():
        text, h = held[r["doc_id"], 0], zlib.crc32(str(r["doc_id"]).encode())
        words, g = BLANK.findall(text), h // 10
        if h % 10 == 0:
            n = len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[i if i < a else a + (i - a) % p] for i in range(n))
        assert r["text"] == text


def test_query(spark):
    from pagestrata.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in periods.planted(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    rows = QUERIES["op11_periodic_runs"](spark, folder).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(rows) == len(texts) and any(r["n_runs"] for r in rows)
    for r in rows:
        words = BLANK.findall(texts[r["doc_id"]] or "")
        if len(words) > 1500:
            continue
        runs = runs_by_hand(words, 24, 3)
        s, n, q = strongest_by_hand(runs) or (None,) * 3
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), s, n, q)
        assert r["exponent_milli"] == (None if n is None else 1000 * n // q)
        assert r["runs_sha256"] == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)) and r["collapsed_sha256"] == sha(collapsed_by_hand(words, runs))
