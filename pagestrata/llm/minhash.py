"""Document fingerprints by one-permutation MinHash: each shingle is hashed once, its highest bits name a bin and a bin keeps its
least hash; empty bins borrow from a random bin that is not empty, the same one for any two documents that both have it (optimal
densification); the low-order bits of the bins are packed, and likeness is corrected for their chance agreement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.llm import shared

#: Words of a shingle, bins (a power of two) and kept bits of each.
WORDS, BINS, BITS = 5, 128, 8
_SHIFT = 64 - (BINS.bit_length() - 1)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column) -> Column:
    """Hashes of the shingles of WORDS words (a shorter text is one shingle, also an empty one), repeats included. Words are
    parted by ASCII white space and count as written."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x09-\x0D\x20]+"), "")

    def joined(h: Column) -> Column:
        several = F.transform(F.slice(h, 1, F.greatest(F.size(h) - (WORDS - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WORDS)]))
        return F.when(F.size(h) >= WORDS, several).otherwise(F.array(F.xxhash64(h)))

    return bind(F.transform(words, lambda w: F.xxhash64(w)), joined)


def bin_of(hashed: Column) -> Column:
    return F.shiftright(hashed, _SHIFT) + BINS // 2


def packed(hashes: Column) -> Column:
    """The fingerprint of shingle hashes: BITS low-order bits of every bin's least hash, as hexadecimal digits."""
    low = lambda x: x.bitwiseAND((1 << BITS) - 1)
    digits = BITS // 4

    def least(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(ordered, i - 1), _SHIFT)))

    def borrowed(first: Column, i: Column) -> Column:
        ranked = F.transform(first, lambda x: F.xxhash64(i, F.shiftright(x, _SHIFT)).bitwiseAND(~((1 << BITS) - 1)).bitwiseOR(low(x)))
        return low(F.array_min(ranked))

    def filled(first: Column) -> Column:
        at = lambda bins: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: one(bins, i))

        def one(bins: Column, i: Column) -> Column:
            return bind(F.array_position(bins, i.cast("long")), lambda p: F.lpad(F.hex(F.when(p > 0, low(F.get(first, p.cast("int") - 1))).otherwise(borrowed(first, i))), digits, "0"))

        return F.array_join(bind(F.transform(first, bin_of), at), "")

    return bind(bind(F.sort_array(hashes), least), filled)


def fingerprint(text: Column) -> Column:
    return packed(shingle_hashes(text))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles of two fingerprints, 0 to 1: bins that agree, less those that agree by chance."""
    digits = BITS // 4
    agree = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(a, i * digits + 1, F.lit(digits)) == F.substring(b, i * digits + 1, F.lit(digits))))
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (agree / F.lit(float(BINS)) - chance) / (1 - chance))


def fingerprint_documents(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with a column of fingerprints, in place of one so named. A null text is empty; equal texts have equal
    fingerprints; repeated rows, null keys and other columns stay; an empty table gives none. Nothing is shuffled."""
    return docs.withColumn(name, fingerprint(F.col(text)))


def next_keys(docs: DataFrame) -> DataFrame:
    """``key``, ``long`` and ``next``: every distinct key, its longest text's code points, and the key after it, after the last
    the first. docs: ``key``, ``n_chars``. Keys are dealt by range; a task sees its range and the first key of each other."""
    ranges = docs.groupBy("key").agg(F.max("n_chars").alias("long")).repartitionByRange("key").withColumn("range", F.spark_partition_id())
    kept = shared.keep(ranges, "keys")
    firsts = kept.groupBy("range").agg(F.min("key").alias("first"))
    in_turn = Window.orderBy("range")  # one row a range
    after = firsts.select("range", F.coalesce(F.lead("first").over(in_turn), F.min("first").over(in_turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("first"))
    inside = F.lead("key").over(Window.partitionBy("range").orderBy("key"))
    return kept.withColumn("inside", inside).join(after, "range").select("key", "long", F.coalesce("inside", "first").alias("next"))


def edited_and_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next``. The edited text has its last quarter replaced by the beginning of the next document, by ascending key.

    A null text is empty, a null key comes before all others. Of several texts under one key the next document is the
    smallest (for ``near_next``: the one with the smallest fingerprint); all rows of a key have the same next. A single document
    follows itself; an empty table gives none; other columns are left out. Texts are shuffled once by key, for the sake of
    the beginnings; all else that moves is keys, beginnings and fingerprints."""
    base = docs.select(shared.as_key(F.col(key)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    order = shared.keep(next_keys(base.select("key", F.length("body").alias("n_chars"))), "order")
    asked = order.select(F.col("next").alias("key"), F.col("key").alias("for"), F.floor(F.col("long") / 4).cast("int").alias("want"))
    begins = base.join(asked, "key").select(F.col("for").alias("key"), F.expr("substring(body, 1, want)").alias("begin")).groupBy("key").agg(F.min("begin").alias("begin"))
    n = F.length("body")
    texts = base.join(begins, "key").select("key", n.alias("n_chars"), "body", F.concat(F.expr("substring(body, 1, length(body) - int(floor(length(body) / 4)))"), F.expr("substring(begin, 1, int(floor(length(body) / 4)))")).alias("edited"))
    prints = shared.keep(texts.select("key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("body")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint")), "prints")
    others = prints.groupBy("key").agg(F.min("fingerprint").alias("other")).withColumnRenamed("key", "next")
    follow = order.select("key", "next").join(others, "next").select("key", "other")
    return prints.join(follow, "key").select(
        F.when(F.col("key") != shared.LOWEST, F.col("key")).alias(key), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("other")).alias("near_next"),
    )
