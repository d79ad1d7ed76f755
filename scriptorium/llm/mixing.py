"""Mixing sources to target weights.

Method: Sainte-Laguë apportionment. The wanted size of a mix is cut into blocks of
equal tokens; blocks go one by one to the source with the highest quotient
weight / (2 * seats + 1) among those whose ceiling (``max_repeats`` times the tokens it
holds) still has room, which gives integer quotas. A source's blocks are apportioned to
its shards in the same way, by the tokens each holds, and every shard then takes whole
documents in seeded order: all of them as often as the quota holds the shard whole, and
once more those that fit the rest, the last one taken where that comes nearer.

The blocks of one mix are apportioned in closed form (by a threshold on the quotients)
and a last few by quotient, so the cost depends on the number of sources only.

Defined results: weights are relative; null or negative shares count as 0; names of
sources are read without regard to case and surrounding blanks; a source without
documents or with weight 0 gives nothing and is reported with 0; null ``max_repeats``
is no cap; rows repeated for one source of a mix count once; null or blank texts have no
tokens and are never drawn; repeated documents count once; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.lineage import spread, written
from scriptorium.llm.token_sizes import token_count

#: Tokens of a shard of one source, and blocks per mix.
SHARD_TOKENS, BLOCKS = 2_000_000, 1_000_000
#: Shards that are apportioned together; a larger source is first apportioned to groups of so many.
GROUP_SHARDS = 4096


def sainte_lague(weights: list[float], seats: int, caps: list[float]) -> list[int]:
    """Seats by highest quotients weight / (2 s + 1), no entry beyond its cap (in seats); ties go to the earlier entry."""
    weights = np.asarray(weights, np.float64)
    caps = np.where(weights > 0, np.minimum(np.asarray(caps, np.float64), max(seats, 0)), 0).astype(np.int64)
    seats = min(int(seats), int(caps.sum()))
    got = np.zeros(len(weights), np.int64)
    if seats <= 0:
        return got.tolist()
    low, high = 0.0, 2 * weights.max()
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        won = np.minimum(caps, weights / mid / 2 + 0.5).astype(np.int64)
        low, high = (mid, high) if won.sum() >= seats else (low, mid)
    got = np.minimum(caps, weights / high / 2 + 0.5).astype(np.int64)
    while (rest := seats - int(got.sum())) > 0:
        quotients = np.where(got < caps, weights / (2 * got + 1), -1.0)
        best = np.argsort(-quotients, kind="stable")[:rest]
        got[best[quotients[best] > 0]] += 1
    return got.tolist()


def _sized(documents: DataFrame) -> DataFrame:
    docs = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "n_tokens"))
    docs = docs.where("doc_id is not null and source is not null")
    sized = docs.select("doc_id", F.lower(F.trim("source")).alias("source"), token_count(F.col("text"), F.col("n_tokens")).alias("size"))
    return sized.where("size > 0").groupBy("doc_id").agg(F.max("size").alias("size"), F.min("source").alias("source"))


def _quotas(targets: pd.DataFrame) -> pd.DataFrame:
    targets = targets.sort_values("source", kind="stable").reset_index(drop=True)
    weights = targets["weight"].clip(lower=0).fillna(0.0)
    weights = weights.where(targets["held"] > 0, 0.0)
    wanted = float(targets["held"].sum() * targets["size_ratio"].iloc[0])
    block = max(1.0, wanted / BLOCKS)
    caps = [float("inf") if pd.isna(r) else r * h / block for r, h in zip(targets["max_repeats"], targets["held"])]
    seats = sainte_lague(weights.tolist(), int(round(wanted / block)), caps)
    return targets.assign(wanted=wanted, quota=[min(s * block, c * block) for s, c in zip(seats, caps)])


def quotas(documents_sized: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """(mix_name, source, weight, max_repeats, size_ratio, held, wanted, quota) in tokens, one row per target."""
    held = documents_sized.groupBy("source").agg(F.sum("size").alias("held"))
    wishes = mix_targets.where("mix_name is not null and source is not null").groupBy("mix_name", F.lower(F.trim("source")).alias("source")).agg(
        F.max("target_share").alias("weight"), F.max("max_repeats").cast("double").alias("max_repeats"), F.max("size_ratio").alias("size_ratio")
    )
    targets = wishes.join(held, "source", "left").withColumn("held", F.coalesce("held", F.lit(0)).cast("long"))
    targets = targets.withColumn("size_ratio", F.coalesce(F.max("size_ratio").over(W.partitionBy("mix_name")), F.lit(1.0)))
    schema = "mix_name string, source string, weight double, max_repeats double, size_ratio double, held long, wanted double, quota double"
    return targets.select("mix_name", "source", "weight", "max_repeats", "size_ratio", "held").groupBy("mix_name").applyInPandas(_quotas, schema)


def _apportioned(name: str):
    """Seats (``rest``) of the rows' groups or shards by the tokens they hold."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(name, kind="stable").reset_index(drop=True)
        return rows.assign(rest=sainte_lague(rows["tokens"], int(rows["seats"].iloc[0]), rows["tokens"])).drop(columns=["tokens", "seats"])

    return run


def shard_quotas(wanted: DataFrame, shards: DataFrame) -> DataFrame:
    """(mix_name, source, shard, times, rest): how often a shard is used whole, and the tokens of one more use.

    ``wanted`` has mix_name, source, held and quota, ``shards`` source, shard and tokens.
    A source of more than GROUP_SHARDS shards is apportioned in two levels, so no task
    sees all shards of a source; shards of a group are alike in size, and so are groups.
    """
    shards = shards.withColumn("group", F.floor(F.col("shard") / GROUP_SHARDS))
    times = F.when(F.col("held") > 0, F.floor(F.col("quota") / F.col("held"))).otherwise(0).cast("long")
    plan = wanted.select("mix_name", "source", times.alias("times"), F.round(F.col("quota") - times * F.col("held")).cast("long").alias("seats"))
    groups = plan.join(shards.groupBy("source", "group").agg(F.sum("tokens").alias("tokens")), "source")
    groups = groups.groupBy("mix_name", "source").applyInPandas(_apportioned("group"), "mix_name string, source string, times long, group long, rest long")
    each = groups.withColumnRenamed("rest", "seats").join(shards, ["source", "group"]).select("mix_name", "source", "times", "group", "shard", "tokens", "seats")
    each = each.groupBy("mix_name", "source", "group").applyInPandas(_apportioned("shard"), "mix_name string, source string, times long, group long, shard long, rest long")
    return each.select("mix_name", "source", "shard", "times", "rest")


def mixed(documents: DataFrame, mix_targets: DataFrame, seed: int = 0) -> DataFrame:
    """(mix_name, source, doc_id, n_tokens, repeats): the documents of each mix and how often each is used."""
    sized = written(_sized(documents), "sized")
    plan = written(quotas(sized, mix_targets), "quotas")
    held = sized.groupBy("source").agg(F.sum("size").alias("held"))
    cut = held.select("source", F.ceil(F.col("held") / SHARD_TOKENS).cast("long").alias("shards"))
    placed = sized.join(cut, "source").withColumn("order", F.xxhash64(F.lit(seed), "doc_id"))
    placed = written(placed.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), "shards")).select("doc_id", "source", "size", "shard", "order"), "placed")
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("tokens"))
    # One row per mix, source and shard of two million tokens: small next to the texts.
    by_shard = shard_quotas(plan.where("quota > 0").select("mix_name", "source", "held", "quota"), shards)
    run = F.sum("size").over(W.partitionBy("source", "shard").orderBy("order", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    drawn = placed.withColumn("upto", run).join(by_shard, ["source", "shard"])
    # The document across the end of the rest is taken if most of it lies within.
    once_more = (F.col("upto") - F.col("size") / 2 <= F.col("rest")) & (F.col("rest") > 0)
    limit = plan.select("mix_name", "source", "max_repeats")
    drawn = drawn.withColumn("repeats", F.col("times") + once_more.cast("long")).where("repeats > 0").join(limit, ["mix_name", "source"])
    drawn = drawn.where("max_repeats is null or repeats <= max_repeats or times > 0")
    repeats = F.least("repeats", F.coalesce(F.col("max_repeats").cast("long"), F.col("repeats")))
    return drawn.select("mix_name", "source", "doc_id", F.col("size").alias("n_tokens"), repeats.alias("repeats")).where("repeats > 0")


def mix_report(documents: DataFrame, mix_targets: DataFrame, seed: int = 0) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, held_tokens, quota_tokens, tokens, share, most_repeats): what each source gave."""
    got = mixed(documents, mix_targets, seed).groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    plan = quotas(_sized(documents), mix_targets)
    out = plan.join(got, ["mix_name", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("long"))
    of_mix = W.partitionBy("mix_name")
    weight = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    total = F.sum("tokens").over(of_mix)
    return out.select(
        "mix_name", "source", F.round(weight / F.sum(weight).over(of_mix), 6).alias("target_share"), "max_repeats", F.col("held").alias("held_tokens"), F.round("quota").cast("long").alias("quota_tokens"),
        "tokens", F.round(F.when(total > 0, F.col("tokens") / total).otherwise(0.0), 6).alias("share"), F.coalesce("most_repeats", F.lit(0)).cast("long").alias("most_repeats"),
    )
