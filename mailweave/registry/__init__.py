"""Registered queries: each operator applied to the given tables, with its SQL check."""

from . import aggregates, extraction, graph, joins, pipelines, scalars, sites, streams, tables  # noqa: F401
from .core import QUERIES, oracle_sql  # noqa: F401
