"""All registered queries and their SQL twins, gathered from the operator modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import admission, audits, collections, evaluation, neardup, provenance, records, reviews, schedules, similarity, splits, state, textmetrics

MODULES = [admission, audits, evaluation, similarity, records, provenance, neardup, splits, schedules, textmetrics, state, reviews, collections]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next(iter(queries().values()))(spark, sf_dir)
