"""Phrase collocations: the packing both ways, and the rows against brute force with exact fractions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagestrata.llm import phrases


@pytest.mark.parametrize("width", [1, 2, 3, 13, 14, 25, 32, 40])
@pytest.mark.parametrize("words", [2, 3, 4, 5])
def test_packing_is_one_to_one(width, words):
    rng = np.random.default_rng(width)
    given = [rng.integers(0, 1 << width, 2000).astype(np.uint64) for _ in range(words)]
    lanes, bits = phrases.packed(given, width), width * words
    mixed = phrases.permuted(lanes, bits)
    assert all((a == b).all() for a, b in zip(phrases.permuted(mixed, bits, back=True), lanes, strict=True))
    assert all((a == b).all() for a, b in zip(phrases.unpacked(lanes, width, words), given, strict=True))
    numbers = sorted(Counter(zip(*(x.tolist() for x in mixed), strict=True)).items())
    keys, times, of = phrases.counted(mixed, bits)
    assert [*zip(zip(*(x.tolist() for x in keys), strict=True), times.tolist(), strict=True)] == numbers
    assert all((x[of] == y).all() for x, y in zip(keys, mixed, strict=True))
    again = phrases._from_bytes(phrases._to_bytes(mixed, bits), len(given[0]), bits, len(mixed))
    assert all((a == b).all() for a, b in zip(again, mixed, strict=True))


def by_hand(rows, least, longest, first, cover):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in held.items():
            for part in {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)} - {p}:
                inside[part] = max(inside[part], a)
        scored = []
        for p, a in held.items():
            if p in inside and 100 * inside[p] >= cover * a:
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:first])]
    return sorted(out)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(7)
    words = ["Aa", "b", "ç", "dÉ", "e f", "g", "中", "h-i"]
    texts = []
    for _ in range(200):
        text = "".join(rng.choice(words) + rng.choice((" ", " ", " ", "  ", "\t", ". ", ",", "\n", "?!", "\x0b")) for _ in range(rng.randint(0, 60)))
        texts.append((rng.choice(("en", "de", None)), text + rng.choice(("", " b g h-i b g ", "b g h-i b g b"))))
    texts += [("en", None), (None, ""), ("xx", " . "), ("xx", "b " * 5000), ("en", "b g b g"), ("en", "b g b g")]
    return spark.createDataFrame([(lang, t, 1, "x") for lang, t in texts], "lang string, text string, block int, codes string").repartition(3)


@pytest.mark.parametrize("options", [{"least": 3}, {"least": 5, "block": 300}, {"least": 2, "longest": 4, "first": 7, "cover": 60, "width": 40}, {"least": 3, "block": 700, "width": 13}])
def test_rows_against_brute_force(table, options):
    rows = [(r["lang"], r["text"]) for r in table.collect()]
    want = by_hand(rows, **({"longest": 5, "first": 2000, "cover": 100} | {k: v for k, v in options.items() if k not in ("block", "width")}))
    found = phrases.collocations(table, **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 15


def test_nothing(table):
    assert phrases.collocations(table.where("false")).count() == 0
    assert phrases.collocations(table, least=10**6).count() == 0
