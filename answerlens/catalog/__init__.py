"""Registered queries with the SQL that checks them."""

from answerlens.catalog import auditing, files, history, linking, measure, sourcing, tables, viewing  # noqa: F401
from answerlens.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
