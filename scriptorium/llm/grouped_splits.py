"""Splits that never part records of one author or work.

Records are tied by keys read from their paths: an author (a forename in any language
and a surname, in any order) and a work (its title). Components are found on the graph
of keys, not of records: a record with both keys is an edge, equal edges are merged
before any shuffle by key. Method: frontier breadth-first search. The adjacency rows
are hash-partitioned and written; every key that is least by hash among its neighbours
is a seed, so each component has one; all seeds expand one hop at a time; where two
seeds reach the same key their labels become an edge of a smaller graph, which is
solved the same way and, once of a bounded size, by union-find in one task. On either way
a component is named after its least node by hash, so the splits do not depend on the
bound. Adjacency stays as rows, so an author with a third of all records is many rows,
not one list.

Defined results: a record without author and work (null or unreadable path, unknown
author, title of one word) is tied to nothing and is its own group; repeated rows of a
``doc_id`` count once and their keys add up; null ``doc_id`` rows are ignored; null,
empty and unknown languages form the language 'unknown'; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.lineage import forget, written
from scriptorium.llm.group_pairs import pairs_within
from scriptorium.plans.relations import LABELS

# Words that stand for an unknown author.
UNKNOWN_AUTHORS = ("_", "anon", "anonymous", "anonymus", "anonimo", "anonyme", "ignoto", "ignotus", "incerti auctoris", "incertus", "n n", "nn", "sans nom", "senza nome", "unbekannt", "unknown", "inconnu", "sconosciuto")
# Marks of a volume or of processing at the end of a title.
_MARK = re.compile(r"(?:^|\s)(?:(?:vol|bd|band|tom|tome|tomus|tomo|pars|part|parte|partie|teil|v|volume|liber)\s?(?:\d+|[ivxl]+)|firstpass|secondpass|edited|lat\s?\d+|v\d+|raw|clean|final|draft)$")
#: Edges that one task may solve by union-find (16 bytes each).
SMALL_EDGES = 500_000


def fold(text: str) -> str:
    """Lower case without accents; ue, ae and oe are read as ü, ä and ö, so all spellings agree."""
    text = text.casefold()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text.replace("ue", "u").replace("ae", "a").replace("oe", "o")


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold(text))


def path_parts(path: str) -> tuple[str, str]:
    """(author, title) as written in a path; '' where there is none."""
    if re.match(r"[a-z]+://", path, re.I):
        steps = [unquote(x.replace("+", " ")) for x in path.split("?", 1)[0].split("/")[3:]]
        return (steps[-2] if len(steps) >= 3 else "", steps[-1] if steps else "")
    stem = re.sub(r"\.[A-Za-z]{2,4}$", "", path.strip())
    steps = [x for x in re.split(r"[/\\]", stem) if x]
    if not steps:
        return "", ""
    for step in reversed(steps):
        if m := re.match(r"(.*?)\s*\[([^\]]*)\]", step):
            return m[2], m[1]
    if "--" in steps[-1]:
        author, title = steps[-1].split("--")[:2]
        return author, title
    if len(steps) >= 2 and _title(steps[-2]) and _title(steps[-2]) == _title(steps[-1]):
        return "", steps[-1]
    return (steps[-2] if len(steps) >= 4 else ""), steps[-1]


def _title(text: str) -> str:
    words = " ".join(_words(text))
    while m := _MARK.search(words):
        words = words[: m.start()]
    return words.strip()


def _author(text: str, forenames: dict[str, int]) -> str | None:
    words = _words(text)
    if len(words) < 2 or " ".join(words) in UNKNOWN_AUTHORS:
        return None
    named = [w for w in words if w in forenames]
    others = sorted(w for w in words if w not in forenames)
    if not named:
        return " ".join(others)
    if not others:
        return " ".join(sorted(str(forenames[w]) for w in named))
    return f"{' '.join(others)}|{' '.join(sorted({str(forenames[w]) for w in named}))}"


def _key(kind: str, text: str) -> int:
    h = xxhash.xxh3_64_intdigest(f"{kind}:{text}".encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _keys_by_name(forenames: dict[str, int]):
    """Keys of an author and of a title as written; names repeat, so the last 2^16 are kept."""

    @lru_cache(1 << 16)
    def author(text: str) -> int | None:
        name = _author(text, forenames)
        return _key("author", name) if name else None

    @lru_cache(1 << 16)
    def work(text: str) -> int | None:
        title = _title(text)
        return _key("work", title) if " " in title else None

    return author, work


def path_keys(path: str | None, forenames: dict[str, int]) -> tuple[int | None, int | None]:
    """64-bit keys of the author and the work named in a path; None where none is named."""
    named, titled = _keys_by_name(forenames)
    author, title = path_parts(path or "")
    return named(author), titled(title)


def keyed_records(doc_records: DataFrame, forename_forms: DataFrame) -> DataFrame:
    """(rec, author, work): one row per doc_id and path, with 64-bit keys or nulls; written."""
    # The table of forenames has a fixed size.
    forms = {}
    for row in forename_forms.collect():
        for language in ("latin", "italian", "german", "french"):
            if row[language]:
                for w in _words(row[language]):
                    forms.setdefault(w, row["name_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, titled = _keys_by_name(forms)
        for batch in batches:
            parts = [path_parts(p or "") for p in batch.column("path").to_pylist()]
            keys = [(named(a), titled(t)) for a, t in parts]
            yield pa.record_batch([batch.column("rec"), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], names=["rec", "author", "work"])

    paths = doc_records.where("doc_id is not null").select(F.col("doc_id").alias("rec"), F.col("source_path").alias("path")).distinct()
    return written(paths.mapInArrow(run, "rec string, author long, work long"), "keys")


def _union_find(table: pa.Table) -> pa.Table:
    parent: dict[tuple[int, int], tuple[int, int]] = {}

    def find(x: tuple[int, int]) -> tuple[int, int]:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    hu, u, hv, v = (table[c].to_pylist() for c in ("hu", "u", "hv", "v"))
    for a, b in zip(zip(hu, u), zip(hv, v)):
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    return pa.table([pa.array([x[1] for x in nodes], pa.int64()), pa.array([find(x)[1] for x in nodes], pa.int64())], names=["node", "component"])


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def frontier_components(edges: DataFrame, seeds_met: bool = False) -> DataFrame:
    """(node, component) of an undirected graph with rows (u, v); only nodes that have an edge. Written.

    ``component`` is the node least by hash. Self loops give single nodes. ``seeds_met``
    marks a graph of colliding seeds; if small, one task solves it.
    """
    edges = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    if seeds_met and edges.limit(SMALL_EDGES + 1).count() <= SMALL_EDGES:
        hashed = edges.select(F.xxhash64("u").alias("hu"), "u", F.xxhash64("v").alias("hv"), "v")
        return written(hashed.groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: _union_find(t), "node long, component long"), "components")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    adjacency = written(both.repartition("u"), "adjacency")
    order = lambda c: F.struct(F.xxhash64(c), F.col(c))
    seeds = adjacency.groupBy("u").agg(F.min(order("v")).alias("least")).where(order("u") <= F.col("least"))
    # Labels are never rewritten: each hop adds a table of the nodes it reached first.
    labels = [written(seeds.select(F.col("u").alias("node"), F.col("u").alias("seed")), "labels")]
    meetings: list[DataFrame] = []
    while True:
        reach = labels[-1].join(adjacency, F.col("node") == F.col("u")).select(F.col("v").alias("node"), "seed").distinct()
        known = _all(labels).withColumnRenamed("seed", "old")
        reach = written(reach.join(known, "node", "left"), "reach")
        fresh = written(reach.where("old is null").groupBy("node").agg(F.min("seed").alias("seed")), "labels")
        met = reach.join(fresh.withColumnRenamed("seed", "new"), "node", "left")
        met = met.select(F.col("seed").alias("u"), F.coalesce("old", "new").alias("v")).where("u != v").distinct()
        meetings.append(written(met, "met"))
        forget(reach)
        if fresh.isEmpty():
            break
        labels.append(fresh)
    merged = frontier_components(_all(meetings), True)
    out = _all(labels).join(merged.withColumnRenamed("node", "seed"), "seed", "left").select("node", F.coalesce("component", "seed").alias("component"))
    out = written(out, "components")
    forget(edges, adjacency, merged, *labels, *meetings)
    return out


def grouped_records(doc_records: DataFrame, forename_forms: DataFrame) -> DataFrame:
    """(rec, grp): the group of each doc_id; written. Untied records are groups of their own."""
    keys = keyed_records(doc_records, forename_forms)
    # Keys of one record (two keys of a row, keys of its other rows) are tied.
    first = keys.groupBy("rec").agg(F.min(F.coalesce("author", "work")).alias("anchor"))
    ends = keys.where("author is not null and work is not null").select(F.col("author").alias("u"), F.col("work").alias("v"))
    each = keys.select("rec", F.explode(F.array_compact(F.array("author", "work"))).alias("v"))
    chains = each.join(first, "rec").select(F.col("anchor").alias("u"), "v")
    components = frontier_components(ends.unionByName(chains))
    placed = first.join(components.withColumnRenamed("node", "anchor"), "anchor", "left")
    return written(placed.select("rec", F.coalesce("component", F.xxhash64(F.lit("record"), "rec")).alias("grp")), "groups")


def tied_pairs(doc_records: DataFrame, forename_forms: DataFrame) -> DataFrame:
    """(doc_a, doc_b): every pair of different records that belong together, the smaller doc_id first."""
    groups = grouped_records(doc_records, forename_forms)
    return pairs_within(groups, "grp", "rec").select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def plain_language(label):
    """latin, italian, german or french for any spelling of a label, else null."""
    bare = F.regexp_replace(F.lower(label), "[^a-z]", "")
    out = F.lit(None).cast("string")
    for language, spellings in LABELS.items():
        out = F.when(bare.isin(*spellings), language).otherwise(out)
    return out


def grouped_splits(doc_records: DataFrame, forename_forms: DataFrame, train: float = 0.8, dev: float = 0.1, buckets: int = 512) -> DataFrame:
    """(doc_id, language, component, split): each record with the split of its group.

    Groups are ordered by hash within their main language (that of most records) and
    cut at the wanted shares of records; a group lies where its middle falls. Running
    sums go over buckets of the hash first, so no task orders all groups of a language.
    """
    groups = grouped_records(doc_records, forename_forms)
    spoken = doc_records.where("doc_id is not null").groupBy(F.col("doc_id").alias("rec")).agg(F.min(plain_language(F.col("language"))).alias("language"))
    recs = groups.join(spoken, "rec").select("rec", "grp", F.coalesce("language", F.lit("unknown")).alias("language"))
    recs = written(recs, "records")
    by_language = recs.groupBy("grp", "language").agg(F.count("*").alias("n"))
    sized = by_language.groupBy("grp").agg(F.sum("n").alias("n"), F.max_by("language", F.struct("n", "language")).alias("main"))
    sized = written(sized.withColumn("order", F.xxhash64(F.lit("split"), "grp")).withColumn("bucket", F.pmod("order", F.lit(buckets))), "sized")
    sums = sized.groupBy("main", "bucket").agg(F.sum("n").alias("in_bucket"))
    up = W.partitionBy("main").orderBy("bucket")
    sums = sums.select("main", "bucket", F.sum("in_bucket").over(up.rowsBetween(W.unboundedPreceding, 0)).alias("to"), "in_bucket", F.sum("in_bucket").over(W.partitionBy("main")).alias("all"))
    inner = W.partitionBy("main", "bucket").orderBy("order", "grp").rowsBetween(W.unboundedPreceding, 0)
    placed = sized.withColumn("run", F.sum("n").over(inner)).join(sums, ["main", "bucket"])
    middle = (F.col("to") - F.col("in_bucket") + F.col("run") - F.col("n") / 2) / F.col("all")
    split = F.when(middle <= train, "train").when(middle <= train + dev, "dev").otherwise("heldout")
    out = recs.join(placed.select("grp", split.alias("split")), "grp")
    return out.select(F.col("rec").alias("doc_id"), "language", F.col("grp").alias("component"), "split")


def split_report(splits: DataFrame) -> DataFrame:
    """(language, split, n_records, share): what each split got of each language."""
    counted = splits.groupBy("language", "split").agg(F.count("*").alias("n_records"))
    return counted.withColumn("share", F.round(F.col("n_records") / F.sum("n_records").over(W.partitionBy("language")), 6))
