"""Lines that one source repeats across its documents.

Method: suffix arrays. Each source's documents become sequences of line identifiers;
shards of these sequences (a source of any size is cut into shards of a bounded number
of lines) are suffix-sorted by prefix doubling, common prefixes of neighbouring
suffixes give the repeated blocks of one or more lines, and a block that spans at least
the wanted share of a shard's documents becomes a candidate. A block that reaches the
share over the whole source reaches it in at least one shard, so no block is missed;
an exact count over the whole source then settles each candidate.

Lines are equal if their sequences of letter runs and digit runs agree, ignoring case
and taking every digit run as the same.

Defined results: null or empty text has no lines; documents with null ``source`` belong
to no source and have no repeated lines; ``doc_id`` is taken as unique, so a repeated row
counts as a document, but its lines are reported once; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.lineage import spread, written

#: Lines in one suffix-sorted shard.
SHARD_LINES = 150_000
#: Lines to drop up to which their list is broadcast (about 16 bytes each).
BROADCAST_LINES = 1_000_000


def line_keys(text: Column, least_runs: int = 5) -> Column:
    """Array with one 64-bit identifier per line of ``text``.

    The lowest bit tells whether the line has at least ``least_runs`` letter runs.
    """
    digits = F.regexp_replace(F.lower(text), r"\p{Nd}+", " 0 ")
    runs = F.split(F.regexp_replace(digits, r"[^\p{L}0\n]+", " "), "\n")

    def key(line: Column) -> Column:
        line = F.trim(line)
        bare = F.length(F.replace(line, F.lit(" "), F.lit("")))
        letters = F.length(line) - bare + 1 - (F.length(line) - F.length(F.replace(line, F.lit("0"), F.lit(""))))
        flag = F.when((line != "") & (letters >= least_runs), F.lit(1)).otherwise(F.lit(0)).cast("long")
        return F.xxhash64(line).bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(flag)

    return F.transform(runs, key)


def _range_extreme(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, op) -> np.ndarray:
    """op.reduce of values[lo..hi] (inclusive) for arrays of bounds, by a sparse table."""
    table, width = [values], 1
    while 2 * width <= len(values):
        last = table[-1]
        table.append(op(last[:-width], last[width:]))
        width *= 2
    span = hi - lo + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    for k, row in enumerate(table):
        at = level == k
        if at.any():
            out[at] = op(row[lo[at]], row[hi[at] - (1 << k) + 1])
    return out


def block_depths(lines: np.ndarray, doc: np.ndarray, least_docs: int) -> np.ndarray:
    """For each line the length of the longest block starting there that spans ``least_docs`` documents.

    ``lines`` holds the line identifiers of documents one after another, ``doc`` the
    ascending document number of each line. Blocks never cross documents. 0: no block.
    """
    n = len(lines)
    depth = np.zeros(n, np.int64)
    if not n:
        return depth
    if least_docs <= 1:
        return np.ones(n, np.int64)
    ends = np.flatnonzero(np.diff(doc)) + 1
    place = np.arange(n) + np.searchsorted(ends, np.arange(n), "right")
    total = n + len(ends) + 1
    rank0 = np.empty(total, np.int64)
    _, rank0[place] = np.unique(lines, return_inverse=True)
    stops = np.setdiff1d(np.arange(total), place, assume_unique=True)
    rank0[stops] = n + np.arange(len(stops))
    ranks, width = [rank0], 1
    while True:
        now = ranks[-1]
        if np.bincount(now[place]).max() < least_docs or width >= total:
            break
        ahead = np.concatenate([now[width:], np.full(width, now.max() + 1)])
        _, new = np.unique(now * (ahead.max() + 1) + ahead, return_inverse=True)
        ranks.append(new)
        width *= 2
    often = np.bincount(rank0[place], minlength=n)[rank0[place]] >= least_docs
    order = place[often][np.argsort(ranks[-1][place[often]], kind="stable")]
    if not len(order):
        return depth
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + common, b + common
        fits = (x < total) & (y < total)
        same = fits & (ranks[k][np.minimum(x, total - 1)] == ranks[k][np.minimum(y, total - 1)])
        common += same << k
    of_place = np.full(total, -1)
    of_place[place] = doc
    docs = of_place[order].tolist()
    left, first, seen = np.full(len(docs), -1), 0, {}
    for j, d in enumerate(docs):
        seen[d] = seen.get(d, 0) + 1
        while len(seen) >= least_docs and (seen[docs[first]] > 1 or len(seen) > least_docs):
            if seen[docs[first]] == 1:
                del seen[docs[first]]
            else:
                seen[docs[first]] -= 1
            first += 1
        if len(seen) >= least_docs:
            left[j] = first
    good = np.flatnonzero(left >= 0)
    if not len(good):
        return depth
    reach = np.zeros(len(docs), np.int64)
    reach[good] = _range_extreme(common, left[good], good - 1, np.minimum)
    where = np.arange(len(docs))
    last = np.searchsorted(np.where(left < 0, -1, left), where, "right") - 1
    fits = last >= where
    best = np.zeros(len(docs), np.int64)
    best[fits] = _range_extreme(reach, where[fits], last[fits], np.maximum)
    reached, near = best.tolist(), common.tolist()
    for j in range(1, len(reached)):
        reached[j] = max(reached[j], min(reached[j - 1], near[j - 1]))
    for j in range(len(reached) - 2, -1, -1):
        reached[j] = max(reached[j], min(reached[j + 1], near[j]))
    back = np.zeros(total, np.int64)
    back[order] = reached
    return back[place]


def _shard_blocks(share: float, least: int):
    schema = pa.schema([("source", pa.string()), ("block", pa.list_(pa.int64()))])

    def run(table: pa.Table) -> pa.Table:
        column = table["keys"].combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
        values = column.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(column.offsets.to_numpy())
        doc = np.repeat(np.arange(len(sizes)), sizes)
        whole = bool(table["whole"][0].as_py())
        wanted = max(least if whole else 1, int(np.ceil(share * len(sizes) - 1e-9)))
        depth = block_depths(values, doc, wanted)
        cover = np.zeros(len(values) + 1, np.int64)
        starts = np.flatnonzero(depth)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + depth[starts], -1)
        blocks = [[int(x)] for x in np.unique(values[np.cumsum(cover[:-1]) > 0])]
        longer = starts[(depth[starts] > 1) & ~((starts > 0) & (depth[starts - 1] > depth[starts]))]
        blocks += [list(x) for x in {tuple(values[p : p + depth[p]].tolist()) for p in longer}]
        source = table["source"][0].as_py()
        return pa.table([pa.array([source] * len(blocks), pa.string()), pa.array(blocks, schema.field(1).type)], schema=schema)

    return run


def keyed_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, keys): one row per document with the identifiers of its lines; written."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    docs = spread(docs).where(F.col("source").isNotNull() & F.col("doc_id").isNotNull())
    return written(docs.select("doc_id", "source", F.coalesce(line_keys(F.col("text")), F.array().cast("array<bigint>")).alias("keys")), "lines")


def candidate_blocks(lines: DataFrame, sizes: DataFrame, share: float, least: int) -> DataFrame:
    """(source, block): blocks of line identifiers that reach the share in some shard of their source."""
    shards = sizes.select("source", F.ceil(F.col("n_lines") / SHARD_LINES).cast("long").alias("shards"))
    placed = lines.join(shards, "source").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.greatest("shards", F.lit(1))))
    placed = placed.select("source", "shard", (F.col("shards") <= 1).alias("whole"), "keys")
    return placed.groupBy("source", "shard").applyInArrow(_shard_blocks(share, least), "source string, block array<bigint>")


def source_sizes(lines: DataFrame) -> DataFrame:
    """(source, n_docs, n_lines)."""
    return lines.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.size("keys")).alias("n_lines"))


def repeated_keys(lines: DataFrame, share: float = 0.15, least: int = 4) -> DataFrame:
    """(source, key, n_docs, of_docs): lines that stand in enough documents of their source."""
    sizes = written(source_sizes(lines), "sizes")
    blocks = candidate_blocks(lines, sizes, share, least)
    keys = blocks.where(F.size("block") == 1).select("source", F.col("block")[0].alias("key")).distinct()
    standing = lines.select("source", F.explode(F.array_distinct("keys")).alias("key"))
    counted = standing.join(keys, ["source", "key"], "left_semi").groupBy("source", "key").agg(F.count("*").alias("n_docs"))
    total = sizes.select("source", F.col("n_docs").alias("of_docs"))
    return counted.join(total, "source").where((F.col("n_docs") >= least) & (F.col("n_docs") >= share * F.col("of_docs")))


def repeated_lines(documents: DataFrame, share: float = 0.15, least: int = 4, **columns: str) -> DataFrame:
    """(doc_id, line_no): every line of at least 5 letter runs that its source repeats excessively.

    ``line_no`` counts from 1, blank lines included.
    """
    lines = keyed_lines(documents, **columns)
    keys = written(repeated_keys(lines, share, least).select("source", "key"), "repeated")
    each = lines.select("doc_id", "source", F.posexplode("keys").alias("pos", "key")).where(F.col("key").bitwiseAND(F.lit(1).cast("long")) == 1)
    found = each.join(keys, ["source", "key"], "left_semi")
    return found.select("doc_id", (F.col("pos") + 1).cast("int").alias("line_no")).distinct()


def repeated_blocks(documents: DataFrame, share: float = 0.15, least: int = 4, **columns: str) -> DataFrame:
    """(source, n_lines, n_docs, block): repeated blocks with exact document counts over the whole source."""
    lines = keyed_lines(documents, **columns)
    sizes = written(source_sizes(lines), "sizes")
    blocks = candidate_blocks(lines, sizes, share, least).distinct()
    blocks = written(blocks.withColumn("first", F.col("block")[0]), "blocks")
    at = lines.select("doc_id", "source", "keys", F.posexplode("keys").alias("pos", "first"))
    hits = at.join(blocks, ["source", "first"]).where(F.slice("keys", F.col("pos") + 1, F.size("block")) == F.col("block"))
    per_doc = hits.select("source", "block", "doc_id").distinct().groupBy("source", "block").agg(F.count("*").alias("n_docs"))
    kept = per_doc.join(sizes.select("source", F.col("n_docs").alias("of_docs")), "source")
    kept = kept.where((F.col("n_docs") >= least) & (F.col("n_docs") >= share * F.col("of_docs")))
    return kept.select("source", F.size("block").alias("n_lines"), "n_docs", "block")


def _text_key(keys: Column) -> Column:
    """Tells rows with one doc_id and different texts apart."""
    return F.xxhash64(F.coalesce(keys, F.array().cast("array<bigint>")))


def _kept(texts: DataFrame, gone: Column) -> DataFrame:
    """(doc_id, source, text, n_removed): ``gone`` tells for a line number from 0, with its key, whether it goes."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("no")))
    parts = F.filter(lines, lambda x: ~gone(x["no"]))
    cut = F.size(lines) - F.size(parts)
    clean = F.when(F.col("drop").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(F.transform(parts, lambda x: x["line"]), "\n"))
    removed = F.when(F.col("drop").isNull() | F.col("text").isNull(), F.lit(0)).otherwise(cut)
    return texts.select("doc_id", "source", clean.alias("text"), removed.cast("int").alias("n_removed"))


def without_repeated_lines(documents: DataFrame, share: float = 0.15, least: int = 4) -> DataFrame:
    """(doc_id, source, text, n_removed): each text without the lines its source repeats excessively.

    A document without such lines, without text or without source keeps its text as it is.
    The list of lines to drop is broadcast after counting it; where it is too long, texts
    meet the numbers of their own lines by ``doc_id``, never all texts of a source by name.
    """
    lines = keyed_lines(documents)
    keys = written(repeated_keys(lines, share, least).where(F.col("key").bitwiseAND(F.lit(1).cast("long")) == 1).select("source", "key"), "repeated")
    docs = documents.select("doc_id", "source", "text")
    if keys.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        drop = keys.groupBy("source").agg(F.collect_set("key").alias("drop"))
        placed = docs.join(F.broadcast(drop), "source", "left").withColumn("keys", F.when(F.col("drop").isNotNull(), line_keys(F.col("text"))))
        return _kept(placed, lambda i: F.array_contains("drop", F.col("keys")[i]))
    each = lines.select("doc_id", "source", _text_key(F.col("keys")).alias("of"), F.posexplode("keys").alias("no", "key"))
    drop = each.join(keys, ["source", "key"], "left_semi").groupBy("doc_id", "source", "of").agg(F.collect_set("no").alias("drop"))
    return _kept(docs.withColumn("of", _text_key(line_keys(F.col("text")))).join(drop, ["doc_id", "source", "of"], "left"), lambda i: F.array_contains("drop", i))
