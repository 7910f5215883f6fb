"""One key, segment or centre that holds most rows: results stay whole."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from pagestrata.llm import components, sharding, simhash, toxicity
from tests.llm.test_operators import reached


def signed(p):
    return p - (1 << 64) if p >> 63 else p


def test_probes_of_a_crowded_neighbour(spark):
    """Many fingerprints share one segment's value; a few others lie one bit beside it and are met by all of them."""
    rng = random.Random(11)
    low = (1 << simhash.balls(3)[0][2]) - 1
    crowd = [rng.getrandbits(64) & ~low | 5 for _ in range(150)]
    beside = [(p ^ 1) ^ (1 << rng.randrange(40, 64)) for p in crowd[:6]] + [rng.getrandbits(64) & ~low | 4 for _ in range(6)]
    prints = sorted({signed(p) for p in crowd + beside})
    made = spark.createDataFrame([(p, p) for p in prints], "print long, id long")
    want = reached([p % (1 << 64) for p in prints], prints)
    for block in (4, 1 << 14):
        found = {r["node"]: r["root"] for r in components.components(simhash.near_links(made, 4, 3, block)).collect()}
        assert {p: found.get(p, p) for p in prints} == {prints[i]: k for i, k in want.items()}
    assert len(set(want.values())) < len(prints)


def test_slots_of_one_key(spark):
    rows = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("text"))
    out = sharding.shard_rows(rows, 5).collect()
    held = defaultdict(list)
    for r in out:
        held[r["shard"]].append(r["slot"])
    assert len(held) == 1 and sorted(next(iter(held.values()))) == list(range(3000))


def test_repeats_of_a_sampled_key_do_not_change_the_fit(spark):
    rows = [(i, f"you are a {'vile rotten' if i % 4 == 0 else 'kind gentle'} person number {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    hot = docs.where("doc_id = 8 OR doc_id = 9").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("n")
    assert toxicity.fit_field(docs, labels) == toxicity.fit_field(docs.union(hot), labels)
