"""Registered queries, grouped as the operators are."""

from pagestrata.plans import text, geometry, docstats, metrics, pages, ocr, edits, lines, graphics, tables, layout  # noqa: F401
from pagestrata.plans.registry import QUERIES, SQL  # noqa: F401
