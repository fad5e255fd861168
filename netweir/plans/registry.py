"""All queries of this package by name: (query, DuckDB SQL or None)."""

from __future__ import annotations

from . import flows, models, rules, tables

QUERIES = {**flows.QUERIES, **tables.QUERIES, **models.QUERIES, **rules.QUERIES}
