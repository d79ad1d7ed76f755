"""All pairs within groups of any size, where a result is defined as such pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a group that meet under one key.
BLOCK = 2000


def pairs_within(members: DataFrame, group: str, member: str, block: int | None = None) -> DataFrame:
    """(a, b): every pair of different members of one group, the smaller first; ``members`` has one row per group and member.

    A group is cut into blocks, and each two blocks meet under a key of their own, so no
    key and no task holds a large group; the result itself is quadratic in the group.
    """
    block = block or BLOCK
    sizes = members.groupBy(group).agg(F.count("*").alias("size")).where("size > 1")
    cut = sizes.select(group, F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    placed = members.join(cut, group).withColumn("own", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    left = placed.select(F.col(group).alias("grp"), F.col("own").alias("row"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("col"), F.col(member).alias("x"))
    right = placed.select(F.col(group).alias("grp"), F.explode(F.sequence(F.lit(0), "own")).alias("row"), F.col("own").alias("col"), F.col(member).alias("y"))
    met = left.join(right, ["grp", "row", "col"]).where("row < col or x < y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
