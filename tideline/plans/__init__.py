"""Registered queries: importing the package fills registry.QUERIES and registry.ORACLE_SQL."""

from . import folds, parsing, registry, sequences, values  # noqa: F401
