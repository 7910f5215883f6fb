"""The training-data operators on small cases: brute force, exact round trips, held-out accuracy and odd inputs."""

from __future__ import annotations

import binascii
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagestrata.llm import bpe, components, minhash, neighbours, packing, prefixes, sharding, simhash, substrings, toxicity, urls

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
#: Odd texts: null, empty, blank, one word, special tokens, contractions, other scripts, white space that does not part words.
TEXTS = [None, "", "  \n\t ", "word", "a<|endoftext|>b !<|startoftext|>", "don't we'll x'''s 'RE  İIΣΑΣ", "中文字 한국어 ёлка 🚀🚀 e\u0301", "a\u00a0b\u2003c\x1cd", "aaaa" * 300, "na " * 500]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, a repeated row, two texts under one key, a null key, and columns whose names operators use themselves."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    long = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(TEXTS + long)] + [(3, "word"), (12, "another text"), (None, "no key"), (None, None)]
    return spark.createDataFrame([(k, t, 1, 2, 3, "x", 4.0) for k, t in rows], "doc_id long, text string, shard int, size int, length int, ids string, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_every_query_is_registered_once():
    from pagestrata.llm.queries import QUERIES

    numbers = sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES if q.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES


# -- sharding


def test_jump_moves_only_into_the_new_shard(spark):
    keys = spark.range(3000)
    found = keys.select(*[sharding.jump(F.col("id"), n).alias(f"s{n}") for n in range(1, 12)]).collect()
    for r in found:
        for n in range(1, 11):
            assert r[f"s{n + 1}"] in (r[f"s{n}"], n) and 0 <= r[f"s{n}"] < n
    sizes = np.bincount([r["s10"] for r in found], minlength=10)
    assert sizes.min() > 200 and sizes.max() < 400


def test_shards_are_numbered_without_gaps(docs, empty):
    out = sharding.shard_rows(docs, 7).collect()
    assert len(out) == docs.count()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 7)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((k if k is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in docs.select("doc_id", "text").collect())
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in out) == want
    assert len({r["shard"] for r in out if r["doc_id"] == 3}) == 1
    assert sharding.shard_rows(empty, 7).count() == 0


# -- URL filters


def test_url_rules(spark):
    rules = spark.createDataFrame([("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("a.b.org", "block"), ("/private/", "block"), (None, "block"), ("com/", "block")], "rule string, verdict string")
    cases = {
        "http://example.com/en/1": ("example.com/en/", "block"), "https://WWW.Example.com/en/x?q=http://z": ("www.example.com/en/", "allow"), "http://badexample.com/en/1": ("com/", "allow"),
        "http://example.com": (None, "allow"), "http://x.net/es": (None, "allow"), "http://x.net/es/": ("net/es/", "block"), "http://net/es/#a": ("net/es/", "block"), "http://q.a.b.org?x": ("a.b.org", "block"),
        "http://axb.org/": (None, "allow"), "http://any.where/private/1": ("/private/", "block"), None: (None, "allow"), "no scheme": (None, "allow"), "": (None, "allow"), "ftp://h.net/es/\n://b.com/": ("net/es/", "block"),
    }
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(cases)] + [(0, "http://example.com/en/1", "x", "y"), (None, None, "x", "y")], "page_id long, url string, rule string, token string")
    out = urls.judge_urls(pages, rules).collect()
    assert len(out) == len(cases) + 2
    listed = list(cases.values())
    for r in out:
        assert (r["rule"], r["verdict"]) == (listed[r["page_id"]] if r["page_id"] is not None else (None, "allow")), r
    assert urls.judge_urls(pages.where("false"), rules).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(pages, rules.where("false"), "block").collect()} == {"block"}


# -- tokenizers


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_those_of_the_library(path):
    rng = random.Random(2)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("abcdefghij 'x\n\té中0١") for _ in range(80)) for _ in range(200)]
    library, encode = Tokenizer.from_file(path), bpe.encoder(path)
    for text, ids in zip(texts, encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        if path == BYTE:
            assert bpe.decode(path, ids) == library.decode(want, skip_special_tokens=False) == text


def test_long_text_is_cut_at_token_ends(monkeypatch):
    monkeypatch.setattr(bpe, "CUT", 10)
    text = "some  words are longer, don't\n you  see 'll  x " * 20
    for path in (WORD, BYTE):
        assert np.frombuffer(next(bpe.encoder(path)([text])), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_round_trip_columns(docs, empty):
    kept = bpe.decode_texts(bpe.encode_texts(docs, BYTE), BYTE)
    assert all(r["decoded"] == (r["text"] or "") and r["score"] == 4.0 for r in kept.collect())
    out = rows_of(bpe.round_trip(docs, BYTE))
    library = Tokenizer.from_file(BYTE)
    want = []
    for k, t in docs.select("doc_id", "text").collect():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert out == sorted(want, key=repr)
    assert bpe.round_trip(empty, BYTE).count() == 0 and bpe.encode_texts(empty, BYTE).count() == 0


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_counts_at_every_prefix(path):
    library, counter = Tokenizer.from_file(path), prefixes.Counter(path)
    for text in ["we'll see   don't\n\n  it, !<|endoftext|> it's 'RE!'re x<|endoftext|", "overwhelmingly antidisestablishmentarianism  ", "été 中文 ", "naïve", ""]:
        shown, counts = counter.along(text)
        assert len(counts) == len(shown) + 1
        for i in range(len(shown) + 1):
            assert counts[i] == len(library.encode(shown[:i], add_special_tokens=False).ids), (text, i)


def test_token_counts_and_truncation(docs, empty):
    library = Tokenizer.from_file(WORD)
    want = []
    for k, t in docs.select("doc_id", "text").collect():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((k, len((t or "").encode()), n, n > 50))
    assert rows_of(prefixes.count_tokens(docs, WORD, 50)) == sorted(want, key=repr)
    assert prefixes.count_tokens(empty, WORD, 50).count() == 0
    for r in prefixes.truncate_to(prefixes.prefix_table(docs, WORD), 20).collect():
        assert len(library.encode(r["kept"], add_special_tokens=False).ids) <= 20
        assert r["kept"] == r["normal"] or all(len(library.encode(r["normal"][:i], add_special_tokens=False).ids) > 20 for i in range(len(r["kept"]) + 1, min(len(r["normal"]), len(r["kept"]) + 4)))


# -- packing


def best_fit_decreasing(counts, capacity):
    gaps, made = [0] * (capacity + 1), 0
    for length in range(capacity, 0, -1):
        for _ in range(int(counts[length])):
            gap = next((g for g in range(length, capacity + 1) if gaps[g]), None)
            if gap is None:
                gap, made = capacity, made + 1
            else:
                gaps[gap] -= 1
            gaps[gap - length] += 1
    return made


def test_plan_uses_every_piece_once():
    rng = np.random.RandomState(3)
    for counts in (rng.randint(0, 3, 129), np.eye(129, dtype=int)[128] * 7, np.eye(129, dtype=int)[1] * 1000, np.zeros(129, int), (rng.zipf(1.4, 129) % 5000)):
        counts[0] = 0
        plan, used = packing.plan_sequences(counts, 128), np.zeros(129, int)
        for mix, alike in plan:
            assert alike > 0 and sum(x * n for x, n in mix) <= 128
            for x, n in mix:
                used[x] += n * alike
        assert (used == counts).all()
        assert sum(n for _, n in plan) <= 1.002 * best_fit_decreasing(counts, 128) + 1


def longest_fit(counts, capacity):
    left, made = counts.copy(), 0
    while left.any():
        gap, made = capacity, made + 1
        while (fits := np.nonzero(left[: gap + 1])[0]).size:
            left[fits[-1]] -= 1
            gap -= int(fits[-1])
    return made


def test_sequences_come_from_the_program():
    """Nine tenths and more are mixes of the program, it is a cover within its gap, and it is never worse than filling alone."""
    rng = np.random.RandomState(5)
    long = np.bincount(np.minimum(rng.lognormal(5.0, 1.0, 9000).astype(int) + 1, 512), minlength=513)
    few = np.bincount(rng.randint(1, 129, 400), minlength=129)
    for counts in (long, few, long * 1000):
        capacity = len(counts) - 1
        plan, told = packing.solve_and_round(counts, capacity)
        made = sum(n for _, n in plan)
        assert sum(x["placed"] for x in told) >= 0.9 * made
        assert made <= longest_fit(counts, capacity) if counts.sum() < 100_000 else made <= 1.001 * -(-(counts * np.arange(capacity + 1)).sum() // capacity)
        mixes, bound = packing.solve_mixes(counts)
        cover = np.zeros(capacity + 1)
        for mix, times in mixes.items():
            assert sum(x * n for x, n in mix) <= capacity
            for x, n in mix:
                cover[x] += times * n
        assert (cover >= counts * (1 - 1e-9)).all() and bound <= made and sum(mixes.values()) <= 1.5 * bound


def test_pieces_lie_side_by_side(docs, empty):
    pieces = packing.token_pieces(docs, WORD, 64, keep_ids=True)
    out = packing.pack(pieces, 64).collect()
    library = Tokenizer.from_file(WORD)
    assert len(out) == sum(-(-(len(library.encode(t or "", add_special_tokens=False).ids) + 1) // 64) for (t,) in docs.select("text").collect())
    held = defaultdict(list)
    for r in out:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] and r["start"] == 64 * r["piece"]
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(packing.token_pieces(empty, WORD, 64), 64).count() == 0
    with pytest.raises(ValueError):
        packing.pack(pieces.withColumn("length", F.lit(65).cast("long")), 64)


def test_equal_lengths_in_one_crowd(spark):
    pieces = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(48).cast("long").alias("length"))
    out = packing.pack(pieces, 100).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == 5000 and len({r["sequence_id"] for r in out}) == 2500


# -- SimHash


def simhash_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = BLANK.findall(lowered)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reached(prints, keys, radius=4):
    root = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j in range(i):
                if (a ^ prints[j]).bit_count() <= radius:
                    root[i] = root[j] = min(root[i], root[j])
    groups = defaultdict(list)
    for i in range(len(prints)):
        r = i
        while root[r] != r:
            r = root[r]
        groups[r].append(i)
    return {i: min(keys[j] for j in g) for g in groups.values() for i in g}


def test_near_duplicates_against_all_pairs(docs, empty):
    rows = [(k, t) for k, t in docs.select("doc_id", "text").collect()]
    keys, prints = [-1 if k is None else k for k, _ in rows], [simhash_of(t) for _, t in rows]
    want = reached(prints, keys)
    expected = sorted(((k, format(p, "016x"), None if want[i] == -1 else want[i]) for i, ((k, _), p) in enumerate(zip(rows, prints, strict=True))), key=repr)
    assert rows_of(simhash.near_duplicates(docs)) == expected
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("segments", "block"), [(3, 1 << 14), (2, 1 << 14), (3, 20), (5, 7)])
def test_no_link_is_lost(spark, segments, block):
    rng = random.Random(segments * block)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:12]:
        for _ in range(25):
            for b in rng.sample(range(64), rng.randint(1, 6)):
                p ^= 1 << b
            prints.add(p)
    prints = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p, p) for p in prints], "print long, id long"), 4, segments, block)
    found = {r["node"]: r["root"] for r in components.components(links).collect()}
    want = reached([p % (1 << 64) for p in prints], prints)
    assert {p: found.get(p, p) for p in prints} == {prints[i]: k for i, k in want.items()}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (5, 6), (6, 5)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 300)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- substrings


def cut_by_hand(rows, words):
    earliest = {}
    for k, t in rows:
        w = BLANK.findall(t or "")
        for i in range(len(w) - words + 1):
            key, at = tuple(w[i : i + words]), (k, i)
            earliest[key] = min(earliest.get(key, at), at)
    out = {}
    for k, t in rows:
        w = BLANK.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - words + 1):
            if earliest[tuple(w[i : i + words])] < (k, i):
                gone[i : i + words] = [True] * words
        out[k] = (" ".join(x for x, g in zip(w, gone, strict=True) if not g), len(w), sum(gone))
    return out


@pytest.mark.parametrize("words", [1, 3, 20])
def test_repeats_against_all_windows(spark, words, monkeypatch):
    rng = random.Random(words)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{rng.randrange(40 if words < 20 else 3000)}" for _ in range(rng.randrange(120))) + (f" {passage} tail{i}" if i % 3 == 0 else "")) for i in range(60)]
    rows += [(100, rows[3][1]), (101, None), (102, ""), (103, "na " * 300), (104, passage + "\u00a0x")]
    monkeypatch.setattr(bpe.in_portions, "__defaults__", (1,))
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, n_words int, key int").repartition(4)
    out = {r["doc_id"]: (r["text"], r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(df, words).collect()}
    assert out == cut_by_hand(rows, words)


def test_repeats_in_odd_rows(docs, empty):
    out = substrings.remove_repeats(docs).collect()
    assert len(out) == docs.count() and all(r["n_removed"] == sum(s["end"] - s["first"] for s in r["removed"]) and r["size"] == 2 for r in out)
    assert len({(r["text"], r["n_removed"]) for r in out if r["doc_id"] == 3}) == 1
    assert substrings.remove_repeats(empty).count() == 0


def test_rolling_hash_is_the_polynomial():
    values = np.random.RandomState(0).randint(0, 1 << 62, 50).astype(np.uint64)
    for words in (1, 2, 5, 20, 31, 50, 51):
        want = [sum(int(v) * pow(substrings.BASES[0], words - 1 - i, 1 << 64) for i, v in enumerate(values[a : a + words])) % (1 << 64) for a in range(max(0, 51 - words))]
        with np.errstate(over="ignore"):
            assert substrings.rolling(values, words, substrings.BASES[0]).tolist() == want


# -- MinHash


def test_likeness_follows_shared_shingles(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(120):
        a = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(30, 500))]
        b = list(a)
        for i in rng.sample(range(len(b)), rng.randint(0, len(b) // 8)):
            b[i] = "other"
        pairs.append((" ".join(a), " ".join(b)))
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    out = spark.createDataFrame(pairs, "a string, b string").select("a", "b", minhash.likeness(minhash.fingerprint(F.col("a")), minhash.fingerprint(F.col("b"))).alias("s")).collect()
    errors = [r["s"] - len(shingles(r["a"]) & shingles(r["b"])) / len(shingles(r["a"]) | shingles(r["b"])) for r in out]
    assert abs(np.mean(errors)) < 0.015 and np.sqrt(np.mean(np.square(errors))) < 0.06


def test_edited_texts(docs, empty, spark):
    out = minhash.edited_and_next(docs).collect()
    assert len(out) == docs.count()
    by = defaultdict(list)
    for k, t in docs.select("doc_id", "text").collect():
        by[-1 if k is None else k].append(t or "")
    order = sorted(by)
    for r in out:
        k = -1 if r["doc_id"] is None else r["doc_id"]
        following = min(by[order[(order.index(k) + 1) % len(order)]])
        edits = {t[: len(t) - len(t) // 4] + following[: len(t) // 4] for t in by[k]}
        assert r["edited_sha256"] in {hashlib.sha256(e.encode()).hexdigest() for e in edits}
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and len(r["fingerprint"]) == minhash.BINS * minhash.BITS // 4
    one = minhash.edited_and_next(spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0
    prints = {r["text"]: r["fingerprint"] for r in minhash.fingerprint_documents(docs).collect()}
    assert prints[None] == prints[""] == prints["  \n\t "]
    assert minhash.edited_and_next(empty).count() == 0


# -- neighbours


def test_search_against_brute_force(spark):
    rng = np.random.RandomState(4)
    x = rng.randn(400, 16)
    x[200:260] = x[200]  # a crowd of equal vectors
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 1), (1050, [0.0] * 16, 1), (1100, [float("nan")] * 16, 1), (1150, [None] + [1.0] * 15, 1), (None, [1.0] * 16, 1), (3, x[3].tolist(), 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    out = neighbours.search(table, F.col("vec_id") % 50 == 0, parts=8, probes=8, block=64).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 400, 50):
        s = (unit[q] * unit).sum(axis=1)
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
        got = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in got] == want and np.allclose([r["score"] for r in got], s[want], atol=1e-12)
    assert {r["query_id"] for r in out} == set(range(0, 400, 50))
    few = neighbours.search(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in few] == [(1, 1)]
    assert neighbours.search(table.where("false"), F.col("vec_id") == 0).count() == 0


def test_recall_of_the_query(spark):
    from pagestrata.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for i in np.nonzero(ids % 50 == 0)[0]:
        s = x @ x[i]
        s[i] = -2
        want[int(ids[i])] = set(ids[np.argsort(-s)[:5]].tolist())
    out = QUERIES["op4_approximate_neighbours"](spark, folder).collect()
    assert len(out) == 5 * len(want) and sum(r["vec_id"] in want[r["query_id"]] for r in out) >= 0.9 * len(out)


# -- toxicity


@pytest.fixture(scope="module")
def toxic_docs(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeioumnrst") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    rows, labels = [], []
    for i in range(900):
        text, bad = [rng.choice(words) for _ in range(rng.randint(5, 150))], i % 7 == 0
        if bad:
            for _ in range(rng.randint(2, 5)):
                text[rng.randrange(len(text))] = rng.choice(["Zonk", "blagh!!", "quxa" + rng.choice(words), "quxa" + rng.choice(words)])
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_field_finds_toxic_spans(toxic_docs):
    docs, labels = toxic_docs
    model = toxicity.fit_field(docs, labels)
    out = toxicity.score_documents(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    for r in out:
        assert r["held"] == (binascii.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in out if r["held"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.97 * len(held)
    marked = [r["text"][s["first"] : s["end"]] for r in held for s in r["spans"]]
    assert sum(bool(re.search("Zonk|blagh|quxa", m)) for m in marked) >= 0.95 * len(marked)


def test_scores_of_odd_rows(toxic_docs, docs, empty, spark):
    model = toxicity.fit_field(*toxic_docs)
    out = toxicity.score_documents(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["shard"] == 1 for r in out)
    assert not any(r["predicted"] for r in out if not (r["text"] or "").strip())
    assert toxicity.score_documents(empty, model).count() == 0
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit_field(docs, none) is None and toxicity.fit_field(empty, toxic_docs[1]) is None
    assert {r["score"] for r in toxicity.score_documents(docs, None).collect()} == {0.0}


def test_marginals_are_those_of_all_paths():
    rng = np.random.RandomState(0)
    size, move, start = np.array([3, 0, 1, 5]), np.exp(rng.randn(2, 2)), 0.4
    odds = np.exp(rng.randn(size.sum()))
    p, pairs = toxicity.Chains(size).marginals(odds, move, start, pairs=True)
    want, expected, at = [], np.zeros((2, 2)), 0
    for n in size:
        total, on, steps = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in range(1 << n if n else 0):
            y = [path >> i & 1 for i in range(n)]
            w = np.prod([odds[at + i] if y[i] else 1 for i in range(n)]) * (start if y[0] else 1) * np.prod([move[a, b] for a, b in zip(y, y[1:], strict=False)])
            total, on = total + w, on + w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                steps[a, b] += w
        if n:
            want += (on / total).tolist()
            expected += steps / total
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, expected)
