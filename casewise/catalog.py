"""Registered queries of the analytics engine and their DuckDB equivalents."""

from .plans import ORACLE_SQL, QUERIES, extras, facts, images, more, profile, ranking, retrieval, serving, texts  # noqa: F401
