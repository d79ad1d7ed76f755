"""The engine's own queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.operators import corpus, forensics, judging, resampling
from scriptorium.plans import rows_only
from scriptorium.plans.bound import bound, bound_files
from scriptorium.plans.portable import DUCK, SPARK, with_relations
from scriptorium.plans.relations import RELATIONS

STATEMENTS = {**corpus.OPS, **forensics.OPS, **judging.OPS, **resampling.OPS}


def operator(spark: SparkSession, name: str, **tables: DataFrame) -> DataFrame:
    """The operator of that name over the given tables (documents, folio_tokens, ...)."""
    return bound(spark, STATEMENTS[name](SPARK), **tables)


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return bound_files(spark, STATEMENTS[name](SPARK), folder)

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(name) for name in STATEMENTS} | rows_only.QUERIES
ORACLE = {name: with_relations(DUCK, RELATIONS, statement(DUCK)) for name, statement in (STATEMENTS | rows_only.ORACLES).items()}
