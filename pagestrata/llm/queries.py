"""Registered queries of the training-data operators, and their SQL where SQL can state the rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pagestrata.llm import bpe, minhash, neighbours, packing, periods, phrases, prefixes, sharding, simhash, substrings, topk, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Fixed values of the URL query: rule and verdict.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_rows(spark.read.parquet(f"{folder}/documents.parquet"), 40)


@query
def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return urls.judge_urls(spark.read.parquet(f"{folder}/pages.parquet"), rules)


SQL["op3_url_filters"] = r"""
WITH rules(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
sited AS (
  SELECT page_id, row_number() OVER () AS n,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
fits AS (
  SELECT n, rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC) AS place
  FROM sited JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
    AND starts_with(path, substr(rule, strpos(rule, '/'))))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM sited LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (n)
"""


@query
def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(spark.read.parquet(f"{folder}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.count_tokens(spark.read.parquet(f"{folder}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2048)


@query
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.token_pieces(spark.read.parquet(f"{folder}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2048)
    return packing.pack(pieces, 2048)


@query
def op10_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))


@query
def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = substrings.remove_repeats(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit_field(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return toxicity.score_documents(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")


@query
def op4_approximate_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


@query
def op6_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.edited_and_next(spark.read.parquet(f"{folder}/documents.parquet"))


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = periods.planted(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    best, line = F.col("strongest"), lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    every = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    return periods.find_runs(docs).select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"), F.sha2(every, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(spark.read.parquet(f"{folder}/documents.parquet").select("text", "lang"))


SQL["op12_phrase_collocations"] = phrases.STATEMENT


@query
def op13_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.scaled(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding"), "embedding", 64)
    return topk.search(vectors, F.col("vec_id") % 20 == 0, 20)


SQL["op13_exact_top_k"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
