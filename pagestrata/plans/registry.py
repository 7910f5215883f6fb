"""Registry of runnable queries and the SQL that states the same result on the raw tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagestrata.sources import derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def with_tables(body: str, tables: tuple[str, ...]) -> str:
    """Put the derived tables a statement names in front of it as common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        for base in derived.NEEDS.get(name, ()):
            need(base)
        if name not in order:
            order.append(name)

    for t in tables:
        need(t)
    body = body.strip()
    if not order:
        return body
    head = ",\n".join(f"{n} AS MATERIALIZED ({derived.SQL[n].strip()})" for n in order)
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None, uses: tuple[str, ...] | str = ()):
    if isinstance(uses, str):
        uses = tuple(uses.split())

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_tables(sql, uses)
        return fn

    return keep


def s4(expr: str) -> str:
    """SQL for half-up rounding to four decimals, the same arithmetic as ``common.r4``."""
    return f"(floor(({expr})*10000.0+0.5)/10000.0)"


def s2(expr: str) -> str:
    return f"(floor(({expr})*100.0+0.5)/100.0)"
