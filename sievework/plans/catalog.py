"""Every query of the core by name, with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievework.plans import clusters, corpus, general, inventory, items, predictions, questions, reports, rules, selection

_FAMILIES = (corpus, clusters, rules, selection, questions, predictions, reports, items, inventory, general)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for family in _FAMILIES for name, q in family.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for family in _FAMILIES for name, sql in family.ORACLES.items()}
