"""The queries of this subpackage, by name; each takes (spark, folder of the tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import cross_split, grouped_splits, languages, mixing, packing, repeated_lines, shared_spans


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines.repeated_lines(_t(spark, folder, "documents"))


def p1_blocks(spark: SparkSession, folder: str) -> DataFrame:
    blocks = repeated_lines.repeated_blocks(_t(spark, folder, "documents"))
    return blocks.select("source", "n_lines", "n_docs", F.sha2(F.concat_ws(",", F.transform("block", lambda x: x.cast("string"))), 256).alias("block"))


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(_t(spark, folder, "documents"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return grouped_splits.tied_pairs(_t(spark, folder, "doc_records"), _t(spark, folder, "forename_forms"))


def p2_splits(spark: SparkSession, folder: str) -> DataFrame:
    return grouped_splits.grouped_splits(_t(spark, folder, "doc_records"), _t(spark, folder, "forename_forms"))


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return grouped_splits.split_report(p2_splits(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return cross_split.overlapping_pairs(_t(spark, folder, "split_members"), _t(spark, folder, "doc_records"), _t(spark, folder, "documents"))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return cross_split.overlap_report(_t(spark, folder, "split_members"), _t(spark, folder, "doc_records"), _t(spark, folder, "documents"))


def p3_edit(spark: SparkSession, folder: str) -> DataFrame:
    pairs = cross_split.edited_pairs(_t(spark, folder, "split_members"), _t(spark, folder, "doc_records"), _t(spark, folder, "documents"))
    return pairs.select("splits_version", "train_doc", "eval_doc", "edits").distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return languages.language_cases(_t(spark, folder, "documents"))


def p4_languages(spark: SparkSession, folder: str) -> DataFrame:
    return languages.languages(_t(spark, folder, "documents"))


def p5_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_t(spark, folder, "documents"), _t(spark, folder, "containers"))


def p5_apart(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_t(spark, folder, "documents"), _t(spark, folder, "containers"), apart_sources=True)


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p5_packed(spark, folder))


def p6_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(_t(spark, folder, "documents"), _t(spark, folder, "mix_targets"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(_t(spark, folder, "documents"), _t(spark, folder, "mix_targets"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.sharing_pairs(_t(spark, folder, "documents"))


def p7_shared(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.shared_share(_t(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_blocks, p1_clean, p2_found, p2_splits, p2_report, p3_found, p3_report, p3_edit, p4_found, p4_languages, p5_packed, p5_apart, p5_report, p6_mixed, p6_report, p7_found, p7_shared)}
