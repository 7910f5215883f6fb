"""Helpers of the training-data operators: tables kept between jobs, and the names that operators reserve."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a missing key where rows must be ordered or joined by key; nulls sort first, so this does too.
LOWEST = -(2**63)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session without that setting gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def freeing_shuffles(spark: SparkSession):
    """Inside, a finished job's shuffle files go at once instead of when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    try:
        spark.conf.set(name, "true")
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def keep(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later jobs neither recompute it nor depend on
    the executors that made it."""
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with freeing_shuffles(spark):
        df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def as_key(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(LOWEST))
