"""Long spans that stand verbatim in more than one text.

Method: count-min prefilter. Of each text the windows of ``window`` characters that are
the least by hash among some ``length - window + 1`` successive ones are taken; every
run of ``length`` characters holds at least one, the same in each text with that run,
so nothing is lost. A first pass over the texts sends, per partition, the cells of a
two-row count-min sketch; the merged sketch overestimates how often each window
occurs. A second pass over the texts keeps only the windows estimated as repeated and
groups them exactly. Pairs of equal windows on one diagonal are chained; a chain of
at least ``length`` characters is a case, a shorter one is settled against the texts.
Windows in very many places are not paired: all spans of ``length`` characters around
them are hashed and grouped. Spans with the same set of documents are expanded into
pairs once, in blocks of documents.

The sketch has at most 2^28 cells a row (64 MB as bits for both), whatever the input;
where the input outgrows it, more windows pass on to the exact grouping and none is lost.

Defined results: null texts and texts under ``length`` characters share nothing;
characters are code points; rows repeated with one ``doc_id`` and text count once;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.lineage import spread, written
from scriptorium.llm import texthash as H
from scriptorium.llm.group_pairs import pairs_within

LENGTH, WINDOW = 300, 200
#: Occurrences beyond which a window is settled by hashing the spans around it.
MANY = 64
CHUNK_BITS = 16
MOST_CELL_BITS = 28
#: Document ids up to which a set of them may be broadcast (16 bytes each).
BROADCAST_IDS = 2_000_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def chosen_windows(texts: list[str], length: int, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, position, hash) of the chosen windows of each text."""
    wide = length - window + 1
    for rows, offsets, pieces in H.rounds(texts, overlap=length - 1):
        sizes = np.array([len(p) for p in pieces])
        if sizes.max() < length:
            continue
        starts = np.concatenate([[0], np.cumsum(sizes)])
        sums = H.prefix(H.points("".join(pieces)) + np.uint32(1))
        n = starts[-1] - window + 1
        at = np.arange(n)
        hashes = H.spans(sums, at, at + window) >> np.uint64(1)
        piece = np.repeat(np.arange(len(pieces)), sizes)[:n]
        hashes[at + window > starts[piece + 1]] = _NONE
        if n < wide:
            continue
        least = H.sliding(hashes, wide, np.minimum)
        edge = np.zeros(wide - 1, np.uint64)
        most = H.sliding(np.concatenate([edge, np.where(least == _NONE, 0, least), edge]), wide, np.maximum)
        keep = np.flatnonzero((most == hashes) & (hashes != _NONE) & (sizes[piece] >= length))
        p = piece[keep]
        yield np.asarray(rows)[p], np.asarray(offsets)[p] + keep - starts[p], hashes[keep].view(np.int64)


def _cells(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h, mask = hashes.view(np.uint64), np.uint64((1 << bits) - 1)
    return ((h & mask).astype(np.int64), ((h >> np.uint64(33)) * np.uint64(0x9E3779B1) >> np.uint64(3) & mask).astype(np.int64))


def _partial_sketch(bits: int, chunk_bits: int, length: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: list[list[np.ndarray]] = [[], []]

        def out() -> Iterator[pa.RecordBatch]:
            for row in (0, 1):
                if not cells[row]:
                    continue
                cell, times = np.unique(np.concatenate(cells[row]), return_counts=True)
                cells[row] = []
                chunk = cell >> chunk_bits
                low = (cell & ((1 << chunk_bits) - 1)).astype(np.uint16)
                first = np.flatnonzero(np.diff(chunk, prepend=-1))
                ends = np.append(first[1:], len(chunk))
                once = [low[a:b].tobytes() for a, b in zip(first, ends)]
                more = [low[a:b][times[a:b] > 1].tobytes() for a, b in zip(first, ends)]
                yield pa.record_batch([pa.array((chunk[first] * 2 + row).astype(np.int64)), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["part", "once", "more"])

        held = 0
        for batch in batches:
            for _, _, h in chosen_windows([x or "" for x in batch.column("text").to_pylist()], length, window):
                for row, c in enumerate(_cells(h, bits)):
                    cells[row].append(c)
                held += len(h)
            if held > 4_000_000:
                yield from out()
                held = 0
        yield from out()

    return run


def _merge_sketch(chunk_bits: int):
    def run(table: pa.Table) -> pa.Table:
        seen, twice = np.zeros(1 << chunk_bits, np.int32), np.zeros(1 << chunk_bits, bool)
        for once, more in zip(table["once"].to_pylist(), table["more"].to_pylist()):
            seen[np.frombuffer(once, np.uint16)] += 1
            twice[np.frombuffer(more, np.uint16)] = True
        bits = np.packbits(twice | (seen > 1)).tobytes()
        return pa.table([pa.array([table["part"][0].as_py()], pa.int64()), pa.array([bits], pa.binary())], names=["part", "bits"])

    return run


def repeated_sketch(docs: DataFrame, length: int, window: int):
    """Broadcast pair of bit rows: cells that at least two windows of the corpus fall into, and the cell bits."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    windows = max(1, int(2 * chars / (length - window + 2)))
    bits = min(MOST_CELL_BITS, max(CHUNK_BITS, int(np.ceil(np.log2(4 * windows)))))
    parts = docs.mapInArrow(_partial_sketch(bits, CHUNK_BITS, length, window), "part long, once binary, more binary")
    merged = parts.groupBy("part").applyInArrow(_merge_sketch(CHUNK_BITS), "part long, bits binary")
    flags = np.zeros((2, 1 << (bits - 3)), np.uint8)
    step = 1 << (CHUNK_BITS - 3)
    for part, packed in merged.toLocalIterator():
        flags[part % 2, part // 2 * step : part // 2 * step + step] = np.frombuffer(packed, np.uint8)
    return spark.sparkContext.broadcast(flags), bits


def _estimated_repeated(flags, bits: int, length: int, window: int):
    def hit(row: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return (row[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for row, pos, h in chosen_windows([x or "" for x in batch.column("text").to_pylist()], length, window):
                a, b = _cells(h, bits)
                keep = (hit(flags.value[0], a) & hit(flags.value[1], b)).astype(bool)
                yield pa.record_batch([pa.array(h[keep]), pa.array(ids[row[keep]].astype(np.int64)), pa.array(pos[keep].astype(np.int32))], names=["h", "doc", "pos"])

    return run


def repeated_windows(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """(h, doc, pos, places): the chosen windows that occur in more than one place; written."""
    flags, bits = repeated_sketch(docs, length, window)
    some = written(docs.mapInArrow(_estimated_repeated(flags, bits, length, window), "h long, doc long, pos int"), "windows")
    often = some.groupBy("h").agg(F.count("*").alias("places"), F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b")
    return written(some.join(often.select("h", "places"), "h"), "repeated")


def _around(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the documents in ``ids`` (doc); the ids are broadcast only after counting them."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join((F.broadcast(ids) if few else ids).withColumnRenamed("doc", "doc_id"), "doc_id", "left_semi")


def _spans_around(length: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "places"))):
                starts = np.unique(np.concatenate([np.arange(max(0, p - length + window), min(p, len(text) - length) + 1) for p in places]))
                lo = int(starts[0])
                sums = H.prefix(H.points(text[lo : int(starts[-1]) + length]) + np.uint32(1))
                at = starts - lo
                yield pa.record_batch([pa.array(H.spans(sums, at, at + length).view(np.int64)), pa.array(np.full(len(at), doc, np.int64)), pa.array(starts.astype(np.int32))], names=["h", "doc", "pos"])

    return run


def _common(s: str, i: int, t: str, j: int, step: int) -> int:
    """Characters in which s from i and t from j agree, forwards (step 1) or, before i and j, backwards (step -1)."""
    most = min(len(s) - i, len(t) - j) if step > 0 else min(i, j)
    same = (lambda a, b: s[i + a : i + b] == t[j + a : j + b]) if step > 0 else (lambda a, b: s[i - b : i - a] == t[j - b : j - a])
    low, width = 0, 64
    while low < most:
        high = min(low + width, most)
        if not same(low, high):
            while high - low > 1:  # the first difference lies in [low, high)
                middle = (low + high) // 2
                low, high = (middle, high) if same(low, middle) else (low, middle)
            return low
        low, width = high, 2 * width
    return low


def _extend(length: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, runs, s, t in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "runs", "ta", "tb"))):
                for run_ in runs:
                    i, j, n = run_["pa"], run_["pb"], run_["len"]
                    back = _common(s, i, t, j, -1)
                    n += back + _common(s, i + n, t, j + n, 1)
                    if n >= length:
                        out.append((a, b, i - back, j - back, n))
            names, kinds = ["a", "b", "pa", "pb", "len"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.record_batch([pa.array([x[k] for x in out], kinds[k]) for k in range(5)], names=names)

    return run


def _chains(rep: DataFrame, window: int) -> DataFrame:
    """(a, b, pa, pb, len): runs of equal, overlapping windows on one diagonal, for windows in few places."""
    few = rep.where(F.col("places") <= MANY).select("h", "doc", "pos").distinct()
    x, y = few.select("h", F.col("doc").alias("a"), F.col("pos").alias("pa")), few.select("h", F.col("doc").alias("b"), F.col("pos").alias("pb"))
    seeds = x.join(y, "h").where("a < b").select("a", "b", "pa", (F.col("pb") - F.col("pa")).alias("diag"))
    line = W.partitionBy("a", "b", "diag").orderBy("pa")
    opens = F.when(F.col("pa") - F.lag("pa").over(line) <= window, 0).otherwise(1)
    runs = seeds.withColumn("new", opens).withColumn("run", F.sum("new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    whole = runs.groupBy("a", "b", "diag", "run").agg(F.min("pa").alias("pa"), (F.max("pa") - F.min("pa") + window).alias("len"))
    return whole.select("a", "b", "pa", (F.col("pa") + F.col("diag")).alias("pb"), F.col("len").cast("int").alias("len"))


def _exact_runs(docs: DataFrame, chains: DataFrame, length: int, window: int) -> DataFrame:
    """The chains extended to whole runs against the texts, those of at least ``length`` characters."""
    ids = chains.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    texts = written(_around(docs, ids), "texts")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    # The chains of a pair travel together, so a pair has its two texts once.
    pairs = chains.groupBy("a", "b").agg(F.collect_list(F.struct("pa", "pb", "len")).alias("runs"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "runs", "ta", "tb")
    return both.mapInArrow(_extend(length, window), "a long, b long, pa int, pb int, len int")


def _many_spans(docs: DataFrame, rep: DataFrame, length: int, window: int) -> DataFrame:
    """(h, doc, pos): hashed spans of ``length`` characters around windows in very many places, for spans in several texts."""
    places = rep.where(F.col("places") > MANY).groupBy("doc").agg(F.collect_set("pos").alias("places"))
    places = written(places, "many")
    texts = _around(docs, places.select("doc")).join(places.withColumnRenamed("doc", "doc_id"), "doc_id")
    spans = written(texts.mapInArrow(_spans_around(length, window), "h long, doc long, pos int"), "spans")
    often = spans.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("h")
    return spans.join(often, "h", "left_semi")


def _prepared(documents: DataFrame, length: int) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return spread(docs).where(F.col("doc_id").isNotNull() & (F.length("text") >= length))


def sharing_pairs(documents: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """(doc_a, doc_b): pairs of different documents with a common run of at least ``length`` characters."""
    docs = _prepared(documents, length)
    rep = repeated_windows(docs, length, window)
    chains = written(_chains(rep, window), "chains")
    sure = chains.where(F.col("len") >= length).select("a", "b").distinct()
    open_ = chains.join(sure, ["a", "b"], "left_anti")
    settled = _exact_runs(docs, open_, length, window).select("a", "b")
    many = written(_many_spans(docs, rep, length, window).select("h", "doc").distinct(), "many_spans")
    hashed = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "doc"))
    sets = many.groupBy("h").agg(hashed(1).alias("x"), hashed(2).alias("y"), F.count("*").alias("n"))
    sets = sets.groupBy("x", "y", "n").agg(F.min("h").alias("h")).select("h")
    met = pairs_within(many.join(sets, "h"), "h", "doc")
    return sure.unionByName(settled).unionByName(met).distinct().select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def shared_share(documents: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share, n_spans): how much of each text stands elsewhere too.

    Every document has a row; one without shared spans has zeros, an empty or null text
    a share of 0.
    """
    docs = _prepared(documents, length)
    rep = repeated_windows(docs, length, window)
    runs = _exact_runs(docs, written(_chains(rep, window), "chains"), length, window)
    one = runs.select(F.col("a").alias("doc"), F.col("pa").alias("lo"), (F.col("pa") + F.col("len")).alias("hi"))
    two = runs.select(F.col("b").alias("doc"), F.col("pb").alias("lo"), (F.col("pb") + F.col("len")).alias("hi"))
    three = _many_spans(docs, rep, length, window).select("doc", F.col("pos").alias("lo"), (F.col("pos") + length).alias("hi"))
    spans = one.unionByName(two).unionByName(three).distinct()
    by = W.partitionBy("doc").orderBy("lo", "hi")
    reach = F.max("hi").over(by.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("reach", F.coalesce(reach, F.lit(-1)))
    fresh = F.greatest(F.col("hi") - F.greatest("lo", "reach"), F.lit(0))
    total = spans.groupBy("doc").agg(F.sum(fresh).alias("shared"), F.sum((F.col("lo") > F.col("reach")).cast("long")).alias("n"))
    every = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")).distinct()
    out = every.join(total.withColumnRenamed("doc", "doc_id"), "doc_id", "left")
    shared = F.coalesce("shared", F.lit(0)).cast("long")
    return out.select("doc_id", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("shared_share"), F.coalesce("n", F.lit(0)).cast("long").alias("n_spans"))
