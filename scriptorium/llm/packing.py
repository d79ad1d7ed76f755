"""Filling containers of fixed capacity with texts sized in tokens.

Method: conflict-constrained best fit. Items go, largest first, each into the tightest
open container that has room and no conflict; open containers are kept ordered by
residual and carry bitmaps of the sources and the duplicate clusters they hold, and the
search moves to the next larger residual while the container at hand conflicts. Two
copies of one text (equal but for case and anything that is no letter or digit) never
share a container. Items of one source may share it unless ``apart_sources`` is set.

A text is cut only if it alone exceeds the capacity: into full containers and a rest.
Shards of a bounded number of items are packed side by side; containers left far from
full are opened again and packed together in a second round over fewer shards, so
sharding costs a few containers at most.

Defined results: texts without tokens (null, empty, blank) need no room and appear
nowhere; null ``doc_id`` rows are ignored; repeated rows of one ``doc_id`` count once;
kinds with null or non-positive capacity hold nothing; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.lineage import spread, written
from scriptorium.llm.token_sizes import token_count

#: Items that one task packs in the first round; containers it may reopen in the second.
SHARD_ITEMS = 20_000
#: Share of room left from which a container of the first round is opened again.
REOPEN = 0.02


def best_fit(sizes, sources, clusters, capacity: int, apart_sources: bool = False) -> np.ndarray:
    """Container number of each item by best fit in descending size; no two items of one cluster share a container."""
    sizes = np.asarray(sizes)
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(sources))} if apart_sources else {}
    repeated = {c for c, n in zip(*np.unique(np.asarray(clusters), return_counts=True)) if n > 1}
    cluster_bit = {c: 1 << k for k, c in enumerate(repeated)}
    held_sources: list[int] = []
    held_clusters: list[int] = []
    open_: list[tuple[int, int]] = []
    out = np.empty(len(sizes), np.int64)
    for item in np.lexsort((np.arange(len(sizes)), -sizes)):
        size = int(sizes[item])
        cluster, source = cluster_bit.get(clusters[item], 0), source_bit.get(sources[item], 0)
        at = bisect_left(open_, (size, -1))
        while at < len(open_) and (held_clusters[open_[at][1]] & cluster or held_sources[open_[at][1]] & source):
            at += 1
        if at < len(open_):
            room, box = open_.pop(at)
        else:
            room, box = capacity, len(held_sources)
            held_sources.append(0)
            held_clusters.append(0)
        held_sources[box] |= source
        held_clusters[box] |= cluster
        out[item] = box
        if room > size:
            insort(open_, (room - size, box))
    return out


PIECES = "container_kind string, capacity int, container string, doc_id long, piece int, start long, n_tokens int, source string, cluster long"


def _pack(round_: str, apart_sources: bool):
    def run(table: pa.Table) -> pa.Table:
        kind, capacity = table["container_kind"][0].as_py(), table["capacity"][0].as_py()
        order = np.lexsort((table["piece"].to_numpy(), table["doc_id"].to_numpy()))
        table = table.take(pa.array(order))
        boxes = best_fit(table["n_tokens"].to_numpy(), table["source"].to_pylist(), table["cluster"].to_numpy(), capacity, apart_sources)
        shard = table["shard"][0].as_py()
        names = pa.array([f"{kind}-{round_}{shard}-{b}" for b in boxes], pa.string())
        return pa.table({"container_kind": table["container_kind"], "capacity": table["capacity"], "container": names, **{c: table[c] for c in ("doc_id", "piece", "start", "n_tokens", "source", "cluster")}})

    return run


def pieces(documents: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, capacity, doc_id, piece, start, n_tokens, source, cluster): what is to be packed, for each kind."""
    docs = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "n_tokens"))
    bare = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+", "")
    sized = docs.where("doc_id is not null").select("doc_id", "source", token_count(F.col("text"), F.col("n_tokens")).alias("size"), F.xxhash64(bare).alias("cluster"))
    sized = written(sized.where("size > 0").groupBy("doc_id").agg(F.max("size").alias("size"), F.min("source").alias("source"), F.min("cluster").alias("cluster")), "sized")
    # The table of containers has a fixed number of rows.
    kinds = containers.where("capacity > 0 and container_kind is not null").select("container_kind", "capacity").distinct()
    each = sized.crossJoin(F.broadcast(kinds))
    each = each.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / F.col("capacity")).cast("int") - 1)))
    start = F.col("piece").cast("long") * F.col("capacity")
    return each.select("container_kind", "capacity", "doc_id", "piece", start.alias("start"), F.least(F.col("size") - start, F.col("capacity").cast("long")).cast("int").alias("n_tokens"), "source", "cluster")


def packed(documents: DataFrame, containers: DataFrame, apart_sources: bool = False) -> DataFrame:
    """(container_kind, capacity, container, doc_id, piece, start, n_tokens): every piece of every text with its container."""
    todo = written(pieces(documents, containers), "pieces")
    keep = ["container_kind", "capacity", "container", "doc_id", "piece", "start", "n_tokens"]
    full = todo.where("n_tokens = capacity").withColumn("container", F.concat_ws("-", "container_kind", F.lit("f"), "doc_id", "piece")).select(keep)
    part = todo.where("n_tokens < capacity")
    counts = {r[0]: r[1] for r in part.groupBy("container_kind").count().collect()}
    if not counts:
        return full
    shards = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(max(1, -(-n // SHARD_ITEMS))))])
    first = part.withColumn("shard", F.pmod(F.xxhash64("doc_id"), shards[F.col("container_kind")]).cast("long"))
    first = written(first.groupBy("container_kind", "shard").applyInArrow(_pack("a", apart_sources), PIECES), "packed")
    used = first.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.first("capacity").alias("of"), F.first("container_kind").alias("kind"), F.count("*").alias("items"))
    # A kind of one shard is packed as well as it can be, whatever the others are.
    cut = [k for k, n in counts.items() if n > SHARD_ITEMS]
    loose = written(used.where(F.col("kind").isin(cut) & (F.col("used") < F.col("of") * (1 - REOPEN))).select("container", "kind", "items"), "loose")
    many = {r[0]: r[1] for r in loose.groupBy("kind").agg(F.sum("items")).collect()}
    if not many:
        return full.unionByName(first.select(keep))
    again = F.create_map(*[x for k, n in many.items() for x in (F.lit(k), F.lit(max(1, -(-n // SHARD_ITEMS))))])
    second = first.join(loose.select("container"), "container", "left_semi").drop("container")
    second = second.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("again")), again[F.col("container_kind")]).cast("long"))
    second = second.groupBy("container_kind", "shard").applyInArrow(_pack("b", apart_sources), PIECES)
    settled = first.join(loose.select("container"), "container", "left_anti")
    return full.unionByName(settled.select(keep)).unionByName(second.select(keep))


def fill_report(pieces_: DataFrame) -> DataFrame:
    """(container_kind, capacity, containers, tokens, least_containers, unused_share) of a result of ``packed``."""
    boxes = pieces_.groupBy("container_kind", "capacity", "container").agg(F.sum("n_tokens").alias("used"))
    out = boxes.groupBy("container_kind", "capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))
    least = F.ceil(F.col("tokens") / F.col("capacity")).cast("long")
    return out.withColumn("least_containers", least).withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
