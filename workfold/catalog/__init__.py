"""All queries that run over the given tables, with the SQL each is checked against."""

from workfold.catalog import aggregates, journal, measures, policy, rules, series, streams  # noqa: F401
from workfold.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
