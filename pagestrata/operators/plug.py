"""Places where a caller's own functions run: per page batch, per table cell, per font."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from pagestrata.operators.common import grouped_rows


def map_pages(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """The caller's function over Arrow batches of pages (render, recognise, …)."""

    def batches(it: Iterable):
        for pdf in it:
            yield fn(pdf)

    return df.mapInPandas(batches, schema)


def map_cells(df: DataFrame, fn: Callable, schema: str, keys: list[str], laid: bool = False) -> DataFrame:
    """The caller's function over the lines of one table cell: columns as lists in, rows out, as cells are small and many.
    ``laid``: a cell's lines already share a partition."""
    return grouped_rows(df, keys, fn, schema, laid)


def fallback_resolver(c: Column, chances: list[Callable]) -> Column:
    """First answer of the font resolvers (Series -> Series), asked in turn: a later one sees only what the
    earlier ones left open."""
    found: list[Column] = []
    for fn in chances:
        open_ = F.when(F.coalesce(*found).isNull(), c) if found else c
        found.append(pandas_udf(fn, "string")(open_))
    return F.coalesce(*found)
