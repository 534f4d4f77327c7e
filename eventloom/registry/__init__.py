"""All registered queries; importing this package fills QUERIES and ORACLE."""

from eventloom.registry import aggregates, joins, loads, models, rows, streams, tables, uniques, versions
from eventloom.registry.base import ORACLE, QUERIES

MODULES = (aggregates, joins, loads, models, rows, streams, tables, uniques, versions)

__all__ = ["MODULES", "ORACLE", "QUERIES"]
