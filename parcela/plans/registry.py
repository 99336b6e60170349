"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcela.plans import analytics, baselines, cleaning, dictionary, features, inventory, layers, sites, surroundings, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**cleaning.QUERIES, **analytics.QUERIES, **features.QUERIES, **inventory.QUERIES, **variants.QUERIES, **sites.QUERIES, **surroundings.QUERIES, **layers.QUERIES, **baselines.QUERIES, **dictionary.QUERIES}
ORACLE_SQL: dict[str, str] = {**cleaning.ORACLE_SQL, **analytics.ORACLE_SQL, **features.ORACLE_SQL, **inventory.ORACLE_SQL, **variants.ORACLE_SQL, **sites.ORACLE_SQL, **surroundings.ORACLE_SQL, **layers.ORACLE_SQL, **baselines.ORACLE_SQL, **dictionary.ORACLE_SQL}
