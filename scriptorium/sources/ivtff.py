"""Scans of interlinear transcription files.

A file is read whole and split with positions, because the order of its lines carries
meaning. A line belongs to the last page header before it: a running count of headers
numbers the pages of a file (never an ordered scan on the driver).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE, LOCUS = r"^<(f\w+)>\s*(.*)$", r"^<(f\w+)\.([^,>]+),?([^>]*)>\s*(.*)$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of every line under ``path``."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def variable(header: Column, letter: str) -> Column:
    """Value of the page variable ``$<letter>=`` in a header; null if absent."""
    return F.nullif(F.regexp_extract(header, rf"\${letter}=(\w)", 1), F.lit(""))


def parse(lines: DataFrame) -> DataFrame:
    """(file, page, page_no, lang, hand, quire, bifolio, section, line_no, locus, flags, text): the loci with their page's variables.

    Comments, blank lines and lines before the first header are skipped.
    """
    real = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    locus, header = F.col("value").rlike(LOCUS), F.col("value").rlike(PAGE) & ~F.col("value").rlike(LOCUS)
    up_to = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    marked = real.withColumn("header", F.when(header, F.col("value"))).withColumn("locus_line", locus)
    marked = marked.withColumn("page_no", F.count("header").over(up_to)).withColumn("head", F.last("header", ignorenulls=True).over(up_to))
    out = marked.where("locus_line and page_no > 0")
    part = lambda k: F.regexp_extract("value", LOCUS, k)
    return out.select(
        "file", F.regexp_extract("head", PAGE, 1).alias("page"), "page_no", variable(F.col("head"), "L").alias("lang"), variable(F.col("head"), "H").alias("hand"), variable(F.col("head"), "Q").alias("quire"),
        variable(F.col("head"), "B").alias("bifolio"), variable(F.col("head"), "I").alias("section"), "line_no", part(2).alias("locus"), part(3).alias("flags"), clean(part(4)).alias("text"),
    )


def clean(text: Column) -> Column:
    """First reading of [a:b], inline marks and codes removed."""
    first = F.regexp_replace(text, r"\[([^:\]]*):[^\]]*\]", "$1")
    return F.regexp_replace(F.regexp_replace(first, r"<[^>]*>|\{[^}]*\}", ""), r"@\d+;", "")


def tokens(loci: DataFrame) -> DataFrame:
    """The words of each locus with position and a mark for unsure readings; blank words are dropped."""
    words = loci.select("file", "page", "page_no", "lang", "hand", "line_no", F.posexplode(F.split("text", r"[.,\s]+")).alias("idx", "raw"))
    word = F.regexp_replace(F.lower("raw"), "[^a-z]", "")
    return words.select("file", "page", "page_no", "lang", "hand", "line_no", "idx", word.alias("word"), F.col("raw").contains("?").alias("uncertain")).where("word <> ''")


def paragraphs(loci: DataFrame) -> DataFrame:
    """The loci with a paragraph number: a flag with @ or * or a locus type other than P opens one, as does a line after an end mark."""
    order = W.partitionBy("file").orderBy("line_no")
    opens = (F.lag("page").over(order) != F.col("page")) | F.col("flags").rlike(r"[@*]") | ~F.col("flags").contains("P") | F.coalesce(F.lag("text").over(order).rlike(r"=\s*$"), F.lit(True))
    return loci.withColumn("par", F.sum(opens.cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)))


def rendered(folio_tokens: DataFrame, folio_pages: DataFrame) -> DataFrame:
    """(file, line_no, value): a transcription written in the interlinear form, one file per transcription."""
    toks = folio_tokens.select("transcription", "page_id", "par", "line", "idx", "word").distinct()
    text = toks.groupBy("transcription", "page_id", "line").agg(F.min("par").alias("par"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), ".").alias("words"))
    new = F.coalesce(F.lag("par").over(W.partitionBy("transcription", "page_id").orderBy("line")) != F.col("par"), F.lit(True))
    body = text.select("transcription", "page_id", "line", F.concat(F.lit("<f"), "page_id", F.lit("."), "line", F.when(new, F.lit(",@P0> ")).otherwise(F.lit(",+P0> ")), "words").alias("value"))
    heads = folio_pages.groupBy("page_id").agg(F.min("transcription").alias("transcription"), F.min("lang").alias("lang"), F.min("hand").alias("hand"))
    show = lambda letter, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f" ${letter}="), c)).otherwise(F.lit(""))
    heads = heads.select("transcription", "page_id", F.lit(0).alias("line"), F.concat(F.lit("<f"), "page_id", F.lit("> <!"), show("L", "lang"), show("H", "hand"), F.lit(">")).alias("value"))
    every = heads.unionByName(body)
    return every.select(F.col("transcription").alias("file"), F.row_number().over(W.partitionBy("transcription").orderBy("page_id", "line")).alias("line_no"), "value")
