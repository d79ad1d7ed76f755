"""Table functions: rows out of one value, for use in FROM with LATERAL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="no int, start int, stop int", useArrow=True)
class TextWindows:
    """Windows of a length over a text of n characters, most of them: evenly spaced, the last at the end."""

    def eval(self, n: int, length: int, most: int):
        if n is None or length is None or most is None or n < length or length <= 0 or most <= 0:
            return
        count = min(most, n // length)
        for k in range(count):
            start = 0 if count == 1 else round(k * (n - length) / (count - 1))
            yield k, start, start + length


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL: text_windows(n, length, most)."""
    spark.udtf.register("text_windows", TextWindows)
