"""Statements bound to tables, with the relations that are computed outside SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from scriptorium.lineage import spread, written
from scriptorium.operators import ngrams
from scriptorium.plans.portable import SPARK, TABLES, run, with_relations
from scriptorium.plans.relations import RELATIONS


def _parted(spark: SparkSession, documents: DataFrame, part: str) -> DataFrame:
    return run(spark, with_relations(SPARK, RELATIONS, f"SELECT doc_id, lang, s FROM parted WHERE part = '{part}'"), documents=documents)


def bound(spark: SparkSession, body: str, **tables: DataFrame) -> DataFrame:
    """The statement ``body`` over the given tables; gram counts and scores are computed if it asks for them."""
    sql = with_relations(SPARK, RELATIONS, body)
    if "{grams_}" in sql or "{scored_}" in sql:
        documents = tables["documents"]
        counts = written(ngrams.gram_counts(_parted(spark, documents, "train")), "grams")
        tables["grams_"] = counts
        if "{scored_}" in sql:
            scored = ngrams.scored_texts(_parted(spark, documents, "heldout"), counts)
            tables["scored_"] = written(scored, "scored") if len(re.findall(r"\{scored_\}", sql)) > 1 or body.count("scored") > 1 else scored
    return run(spark, sql, **tables)


def bound_files(spark: SparkSession, body: str, folder: str) -> DataFrame:
    """The statement over the tables of a folder that it reads."""
    sql = with_relations(SPARK, RELATIONS, body)
    names = {t for t in TABLES if "{" + t + "}" in sql} | ({"documents"} if "{grams_}" in sql or "{scored_}" in sql else set())
    tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in names}
    if "documents" in tables:  # few and long rows: spread before they are exploded
        tables["documents"] = spread(tables["documents"])
    return bound(spark, body, **tables)
