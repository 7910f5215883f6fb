"""Reading and writing: word and glyph tables, files, manifests, exported text, results, pending work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagestrata.functions.text import slug
from pagestrata.operators.pages import unique_names


def number_words(raw: DataFrame) -> DataFrame:
    """Words with size and text, numbered by line and paragraph in reading order over the page. ``raw``: doc_id,
    page_no, block, para, line, word_no, text, x, y, w, h, confidence."""
    page = Window.partitionBy("doc_id", "page_no")
    kept = raw.withColumn("text", F.trim("text")).filter("text <> '' AND w > 0 AND h > 0")
    return kept.select(
        "doc_id", "page_no", "word_no", "text", "x", "y", "w", "h", "confidence",
        (F.dense_rank().over(page.orderBy("block", "para", "line")) - 1).alias("line"),
        (F.dense_rank().over(page.orderBy("block", "para")) - 1).alias("paragraph"),
    )


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return number_words(spark.read.parquet(path))


def along_baseline(glyphs: DataFrame) -> DataFrame:
    """Adds u (along) and v (across) the baseline from position and direction."""
    x, y, dx, dy = (F.col(c) for c in ("x", "y", "dx", "dy"))
    return glyphs.withColumn("u", dx * x + dy * y).withColumn("v", dx * y - dy * x)


def read_glyphs(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return along_baseline(reader.parquet(path))


def sniff_kind(content: Column) -> Column:
    """png, jpeg or other by the first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "89504E47", "png").when(head.startswith("FFD8FF"), "jpeg").otherwise("other")


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).withColumn("kind", sniff_kind(F.col("content")))


def accepted(files: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted files and the number of rejected ones."""
    ok = F.col("kind").isin(kinds)
    return files.filter(ok), files.filter(~ok).agg(F.count("*").alias("rejected"))


def manifest_documents(rows: DataFrame, only: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """Documents of a manifest: slugged ids made unique in input order, defaults filled in, an optional filter on the
    id; a ground truth that is not among ``files`` becomes null. ``rows``: ord, id, pdf, gt, set, features."""
    named = rows.withColumn("slug", slug(F.col("id")))
    docs = unique_names(named, "slug", "ord").select(
        "ord",
        F.col("unique_name").alias("id"),
        "pdf",
        "gt",
        F.coalesce("set", F.lit("manifest")).alias("set"),
        F.coalesce("features", F.array().cast("array<string>")).alias("features"),
    )
    if files is not None:
        known = files.select(F.col("path").alias("gt"), F.lit(True).alias("_there")).distinct()
        docs = docs.join(known, "gt", "left").withColumn("gt", F.when(F.col("_there"), F.col("gt"))).drop("_there")
    return docs.filter(F.col("id").rlike(only)) if only else docs


def read_manifest(spark: SparkSession, path: str, only: str | None = None, files: DataFrame | None = None) -> DataFrame:
    entry = "struct<id:string,set:string,pdf:string,gt:string,features:array<string>>"
    raw = spark.read.schema(f"version int, documents array<{entry}>").json(path, multiLine=True)
    rows = raw.select(F.posexplode("documents").alias("ord", "d")).select("ord", "d.*")
    return manifest_documents(rows, only, files)


def export_text(pages: DataFrame) -> DataFrame:
    """Page texts with a page header and a blank line between pages, one row per page in document order, so a document
    of any length is written by many tasks; a single-page document has no header. ``pages``: doc_id, page_no, text."""
    count = pages.groupBy("doc_id").agg(F.max("page_no").alias("_last"))
    j = pages.join(count, "doc_id")
    header = F.concat(F.lit("— Página "), (F.col("page_no") + 1).cast("string"), F.lit(" —\n"))
    gap = F.when(F.col("page_no") > 0, "\n\n").otherwise("")
    return j.select("doc_id", "page_no", F.when(F.col("_last") > 0, F.concat(gap, header, "text")).otherwise(F.col("text")).alias("text"))


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Results by run; a run that is written again takes the place of its earlier rows, other runs stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").format(fmt).save(path)


def content_key(content: Column) -> Column:
    return F.substring(F.sha1(content), 1, 12)


def pending_only(inputs: DataFrame, results: DataFrame, failures: DataFrame, refresh: bool = False) -> DataFrame:
    """Inputs (id, content or sha) without a result or a failure that would only repeat itself."""
    keyed = inputs if "sha" in inputs.columns else inputs.withColumn("sha", content_key(F.col("content")))
    if refresh:
        return keyed
    known = results.select("id", "sha").unionByName(failures.filter("deterministic").select("id", "sha"))
    return keyed.join(known, ["id", "sha"], "left_anti")
