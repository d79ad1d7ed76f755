"""Endless example streams on the rate source.

Every draw is a hash of (seed, example number), so a restarted stream continues with
the same examples. The texts are a static, written table that the stream joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.lineage import shared_path


def uniform(*keys: Column) -> Column:
    """Uniform in [0, 1) from the md5 of the keys."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 8), 16, 10).cast("double") / 4294967296.0


def placed_texts(texts: DataFrame, buckets: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Texts (doc_id, lang, s) laid end to end within their language, and the buckets of that line.

    Returns (lang, bucket, lo, hi, doc_id, s) and (lang, bucket, start, stop, total). Running
    sums go over buckets first, so no task sees all texts of a language; texts without
    letters take no room.
    """
    sized = texts.where("lang is not null and length(s) > 0").select("doc_id", "lang", "s", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"), F.length("s").cast("long").alias("n"))
    sums = sized.groupBy("lang", "bucket").agg(F.sum("n").alias("in_bucket"))
    up = W.partitionBy("lang").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    line = sums.select("lang", "bucket", (F.sum("in_bucket").over(up) - F.col("in_bucket")).alias("start"), F.sum("in_bucket").over(up).alias("stop"), F.sum("in_bucket").over(W.partitionBy("lang")).alias("total"))
    inner = W.partitionBy("lang", "bucket").orderBy("doc_id").rowsBetween(W.unboundedPreceding, 0)
    hi = F.sum("n").over(inner)
    return sized.select("lang", "bucket", (hi - F.col("n")).alias("lo"), hi.alias("hi"), "doc_id", "s"), line


def random_windows(numbers: DataFrame, texts: DataFrame, line: DataFrame, length: int, seed: int = 0) -> DataFrame:
    """(value, lang, doc_id, start, s): for each number a language, a text in proportion to its length, and a window anywhere in it.

    A text that is not longer than the window is repeated until it is. ``texts`` and
    ``line`` come from ``placed_texts``; every draw is a hash of the seed and the number.
    """
    langs = [r[0] for r in line.select("lang").distinct().orderBy("lang").collect()]  # a handful of languages
    key = lambda tag: uniform(F.lit(str(seed)), F.lit(tag), F.col("value").cast("string"))
    pick = F.element_at(F.array(*map(F.lit, langs)), (F.floor(key("lang") * len(langs)) + 1).cast("int"))
    # At most one row per language and bucket.
    drawn = numbers.select("value", pick.alias("lang"), key("text").alias("u")).join(F.broadcast(line), "lang")
    at = F.floor(F.col("u") * F.col("total"))
    drawn = drawn.where((at >= F.col("start")) & (at < F.col("stop"))).select("value", "lang", "bucket", (at - F.col("start")).alias("at"))
    found = drawn.join(texts, ["lang", "bucket"]).where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    n = F.length("s")
    whole = F.when(n > length, F.col("s")).otherwise(F.repeat("s", F.ceil((length + 1) / n).cast("int")))
    start = F.floor(key("start") * (F.length("whole") - length + 1)).cast("int")
    return found.withColumn("whole", whole).select("value", "lang", "doc_id", start.alias("start"), F.substr("whole", start + 1, F.lit(length)).alias("s"))


def examples(numbers: DataFrame, texts: DataFrame, line: DataFrame, length: int = 200, seed: int = 0, mask: float | None = None) -> DataFrame:
    """(value, lang, doc_id, start, t, weight, masked, s): one masked example per number of a stream or table with a column ``value``.

    The mask probability is uniform (at least 0.001) or ``mask``; the weight is its inverse.
    """
    out = random_windows(numbers, texts, line, length, seed)
    key = uniform(F.lit(str(seed)), F.lit("t"), F.col("value").cast("string"))
    out = out.withColumn("t", F.lit(mask) if mask is not None else F.greatest(key, F.lit(0.001)))
    hidden = F.transform(F.split("s", ""), lambda c, i: F.when(uniform(F.lit(str(seed)), F.lit("mask"), F.col("value").cast("string"), i.cast("string")) < F.col("t"), F.lit("_")).otherwise(c))
    return out.select("value", "lang", "doc_id", "start", "t", (1 / F.col("t")).alias("weight"), F.array_join(hidden, "").alias("masked"), "s")


def example_stream(spark: SparkSession, texts: DataFrame, line: DataFrame, rows_per_second: int = 100, length: int = 200, seed: int = 0) -> DataFrame:
    """The examples as a stream."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return examples(rate.select("value"), texts, line, length, seed)


def drained(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over all its source holds now into a table of the shared folder, and read that table."""
    spark = stream.sparkSession
    path, state = shared_path(spark, label), shared_path(spark, label + "-state")
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def batches(stream: DataFrame, size: int = 16) -> DataFrame:
    """(batch, lang, n): examples grouped to batches of consecutive numbers; the batch number follows from the value alone."""
    return stream.groupBy(F.floor(F.col("value") / size).alias("batch"), "lang").count().withColumnRenamed("count", "n")
