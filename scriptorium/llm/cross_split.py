"""Records of evaluation splits that stand, exactly or nearly, in the training split.

Two texts are nearly the same if at least half of their distinct sequences of three
words are common. The named segment join rests on a pigeonhole: of k + 1 segments of a
text at least one survives k changes. Here it is used on *sets* (`near_classes`), as the
measure is one of sets, and on strings (`edited_pairs`), where it also keeps its banded
dynamic program.

On sets: texts of n and m sequences within the bound have at least (n + m) / 3 in common.
All texts order their sequences by one order, rare before frequent (frequencies from a
count-min sketch over all texts, ties by hash). Then at least l of the common sequences
are among the first n - (n + m) / 3 + l of the one text and the first m - (n + m) / 3 + l
of the other. A text sends the first 9/16 of its sequences, which serves all partners of
half to twice its size with an l of at least a sixteenth; sequences that meet beyond
these allowed positions do not count, and only pairs with l met sequences are compared,
over all their sequences. The order decides about the cost only: nothing is sampled
or cut off, and the result is exact but for collisions of 64-bit hashes. A sequence
so frequent that its texts would make too large a group is met in a grid of cells (rows
hold some evaluation texts, columns some training texts), so each pair meets once.

On strings: word edit distance of at most k. Evaluation texts are cut into k + 1
segments; a training text sends, for each length within k, its substrings at the
positions that k edits allow; candidates are settled by a banded dynamic program.

Texts with equal sets of sequences (equal words on strings) form one class, joined once.

Defined results: null and short texts (under 20 words) are nearly the same as nothing;
a record listed in both sides of a version is a case with itself; rows of unknown
records, unknown split names or null versions do not count; repeated rows count once;
extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.lineage import spread, written
from scriptorium.llm import texthash as H

GRAM, LEAST_WORDS = 3, 20
#: Cells of the frequency sketch (4 MB as levels), in chunks of 2^16; the same at every size.
CELL_BITS, CHUNK_BITS = 22, 16
#: Texts of one sequence beyond which they meet in a grid of cells.
HOT = 50_000
#: Pairs expanded at once in a worker.
PAIRS = 1 << 21
BROADCAST_IDS = 2_000_000
#: Words that may be inserted, dropped or changed between texts of ``edited_pairs``.
EDITS = 3
_classes: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """For each code point 1 for letters and digits, 2 for combining marks, else 0."""
    if not _classes:
        kind = np.zeros(0x110000, np.uint8)
        for c in range(0x32400):
            ch = chr(c)
            if ch.isalnum():
                kind[c] = 1
            elif unicodedata.combining(ch):
                kind[c] = 2
        kind[0xE0100:0xE01F0] = 0
        _classes.append(kind)
    return _classes[0]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each word: runs of letters and digits after NFKD, without marks, in lower case."""
    plain = [unicodedata.normalize("NFKD", x).lower() for x in texts]
    sizes = np.array([len(x) + 1 for x in plain])
    c = H.points("\n".join(plain) + "\n")
    kind = _kinds()[c]
    keep = kind != 2
    owner = np.repeat(np.arange(len(plain)), sizes)[keep]
    c, word = c[keep], (kind == 1)[keep]
    edge = np.diff(word.astype(np.int8), prepend=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return owner[start], H.spans(H.prefix(c), start, stop)


def gram_hashes(owner: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each sequence of n successive words."""
    m = len(words) - n + 1
    if m <= 0:
        return owner[:0], words[:0]
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + m]
    inside = owner[:m] == owner[n - 1 : n - 1 + m]
    return owner[:m][inside], H.mixed(h[inside])


def _unique_pairs(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in ascending order."""
    order = np.argsort(h)
    small = owner.astype(np.uint16) if len(owner) and owner[-1] < 1 << 16 else owner
    order = order[np.argsort(small[order], kind="stable")]
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[new], h[new]


def _rounds(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    at, held = 0, 0
    for i, x in enumerate(texts):
        held += len(x)
        if held >= H.ROUND:
            yield at, texts[at : i + 1]
            at, held = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def _lists(owner: np.ndarray, h: np.ndarray, n: int) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h.view(np.int64)))


def _class_of(owner: np.ndarray, grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the set of sequences, size of the set) of each text; ``owner`` ascends."""
    size = np.bincount(owner, minlength=n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(H.mixed(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    stop = np.cumsum(size)
    return H.mixed(sums[stop] - sums[stop - size] + size.astype(np.uint64)).view(np.int64), size


def _cell(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


ABOUT = "doc long, n_words int, class long, size int, part int, counts binary"


def _describe(bits: int):
    """A row for each text and, at the end, the rows of the partition's part of the sketch."""
    step = 1 << min(CHUNK_BITS, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "n_words", "class", "size", "part", "counts"]
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            ids, texts = batch.column("doc"), [x or "" for x in batch.column("text").to_pylist()]
            for at, some in _rounds(texts):
                n = len(some)
                owner, words = word_hashes(some)
                count = np.bincount(owner, minlength=n)
                o3, g3 = _unique_pairs(*gram_hashes(owner, words, GRAM))
                counts += np.bincount(_cell(g3, bits), minlength=1 << bits).astype(np.uint32)
                cls, size = _class_of(o3, g3, n)
                columns = [ids.slice(at, n).cast(pa.int64()), pa.array(count.astype(np.int32)), pa.array(cls), pa.array(size.astype(np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
                yield pa.record_batch(columns, names=names)
        chunks = counts.reshape(-1, step)
        parts = np.flatnonzero(chunks.any(axis=1))
        m = len(parts)
        packed = pa.array([zlib.compress(chunks[k].tobytes(), 1) for k in parts], pa.binary())
        yield pa.record_batch([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.array(parts.astype(np.int32)), packed], names=names)

    return run


def _merged(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(zlib.decompress(x.as_py()), np.uint32) for x in table["counts"]], axis=0, dtype=np.int64)
    level = np.floor(2 * np.log2(np.maximum(total, 1))).astype(np.uint8)
    return pa.table([pa.array([table["part"][0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary()), pa.array([int(total.sum())], pa.int64())], names=["part", "levels", "total"])


def frequency_levels(about: DataFrame) -> tuple[np.ndarray, int]:
    """Twice the binary logarithm of each cell's count, and the count from which a cell is hot.

    The sketch has a fixed number of cells, so it may go through the driver at any input size.
    """
    merged = about.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(_merged, "part int, levels binary, total long")
    levels, total, step = np.zeros(1 << CELL_BITS, np.uint8), 0, 1 << min(CHUNK_BITS, CELL_BITS)
    for part, packed, n in merged.toLocalIterator():
        levels[part * step : (part + 1) * step] = np.frombuffer(packed, np.uint8)
        total += n
    common = total >> CELL_BITS  # what a cell holds by chance
    levels[levels < 2 * np.log2(8 + 3 * common)] = 0
    return levels, max(HOT, 8 * common)


def _size_code(n: np.ndarray) -> np.ndarray:
    """A size in 12 bits, rounded down to eight significant ones."""
    e = np.maximum(np.frexp(n.astype(np.float64))[1] - 8, 0)
    return e * 128 + (n >> e)


def _size_range(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = np.maximum((code >> 7) - 1, 0)
    low = np.where(code < 256, code, ((code & 127) + 128) << e)
    return low, low + (1 << e) - 1


def _sent(n: np.ndarray) -> np.ndarray:
    return n // 2 + n // 16 + 1


def _first_grams(shared, hot: int, bits: int):
    """(key, class): a text's sequences at allowed positions; the key has 44 bits of hash, then place, size and sides."""

    def keys(h, rank, n, side):
        low = (rank * 64 // n) << 14 | _size_code(n) << 2 | side
        return (h & ~np.uint64(0xFFFFF) | low.astype(np.uint64)).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            classes, sides = batch.column("class").to_numpy(zero_copy_only=False), batch.column("side").to_numpy(zero_copy_only=False)
            for at, some in _rounds([x or "" for x in batch.column("text").to_pylist()]):
                o, g = _unique_pairs(*gram_hashes(*word_hashes(some), GRAM))
                found, size = _class_of(o, g, len(some))
                own = (found == classes[at : at + len(some)])[o]  # not another text under a repeated id
                o, g = o[own], g[own]
                level = levels[_cell(g, bits)].astype(np.int64)
                order = np.argsort(o << 8 | level, kind="stable")
                o, g, level = o[order], g[order], level[order]
                size = np.bincount(o, minlength=len(some))
                rank = np.arange(len(o)) - (np.cumsum(size) - size)[o]
                keep = rank < _sent(size)[o]
                o, g, level, rank = o[keep], g[keep], level[keep], rank[keep]
                cls, side, n = classes[at:][o], sides[at:][o].astype(np.int64), size[o]
                wide = 2.0 ** ((level + 1) / 2)
                grid = np.where(wide > hot, np.ceil(wide / hot), 1).astype(np.int64)
                one = grid == 1
                yield pa.record_batch([pa.array(keys(g[one], rank[one], n[one], side[one])), pa.array(cls[one])], names=["key", "class"])
                for k in np.flatnonzero(~one):
                    r, own = int(grid[k]), int(H.mixed(cls[k : k + 1].view(np.uint64))[0] % np.uint64(grid[k]))
                    for flag in (1, 2):
                        if side[k] & flag:
                            cell = own * r + np.arange(r) if flag == 1 else np.arange(r) * r + own
                            h = H.mixed(g[k] ^ H.mixed(cell.astype(np.uint64) + np.uint64(1)))
                            yield pa.record_batch([pa.array(keys(h, np.full(r, rank[k]), np.full(r, n[k]), np.full(r, flag))), pa.array(np.full(r, cls[k]))], names=["key", "class"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], rows: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, class) arrays of whole groups, from rows sorted by key."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column("key").to_numpy(zero_copy_only=False), batch.column("class").to_numpy(zero_copy_only=False)))
        size += len(held[-1][0])
        if size >= rows:
            key, cls = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(key >> 20, key[-1] >> 20))
            if cut:
                yield key[:cut], cls[:cut]
            held, size = [(key[cut:], cls[cut:])], len(key) - cut
            rows = max(rows, 2 * size)
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _meet(most: int):
    """(a, b, n, need): how often texts meet at allowed positions, and how often they must; ``most`` pairs at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cls in _groups(batches):
            h = key >> 20
            group = np.cumsum(np.diff(h, prepend=h[:1]) != 0)
            often = np.bincount(group)[group] > 1
            key, cls, group = key[often], cls[often], group[often]
            if not len(key):
                continue
            _, group = np.unique(group, return_inverse=True)
            low, high = _size_range(key >> 2 & 0xFFF)
            rank = (key >> 14 & 63) * low >> 6
            room = _sent(high) - high - (high > low)
            left, right = np.flatnonzero(key & 1), np.flatnonzero(key & 2)
            many = np.bincount(group[right], minlength=group[-1] + 1)
            start = np.cumsum(many) - many
            times = many[group[left]]
            ends = np.cumsum(times)
            at = 0
            while at < len(left):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
                some, t = left[at:to], times[at:to]
                at = to
                x = np.repeat(some, t)
                y = right[np.repeat(start[group[some]] - (np.cumsum(t) - t), t) + np.arange(len(x))]
                near = (low[x] <= 2 * high[y]) & (low[y] <= 2 * high[x]) & (cls[x] != cls[y])
                x, y = x[near], y[near]
                common = -(-(low[x] + low[y]) // 3)
                need = np.minimum(np.minimum(room[x], room[y]) + common, 1 + np.maximum(low[x], low[y]) // 16)
                need = np.maximum(need, 1)
                inside = (rank[x] < high[x] - common + need) & (rank[y] < high[y] - common + need)
                a, b, need = cls[x[inside]], cls[y[inside]], need[inside]
                order = np.lexsort((b, a))
                a, b, need = a[order], b[order], need[order]
                new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
                n = np.diff(np.append(new, len(a)))
                yield pa.record_batch([pa.array(a[new]), pa.array(b[new]), pa.array(n.astype(np.int32)), pa.array(need[new].astype(np.int32))], names=["a", "b", "n", "need"])

    return run


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("class"), [x or "" for x in batch.column("text").to_pylist()]
        for at, some in _rounds(texts):
            o3, g3 = _unique_pairs(*gram_hashes(*word_hashes(some), GRAM))
            cls, _ = _class_of(o3, g3, len(some))
            own = pa.array(cls == ids.slice(at, len(some)).to_numpy(zero_copy_only=False))
            yield pa.record_batch([ids.slice(at, len(some)).filter(own), _lists(o3, g3, len(some)).filter(own)], names=["class", "grams"])


def split_side(split: Column) -> Column:
    """'train' or 'eval' for any spelling of train, dev (validation) and heldout; else null."""
    bare = F.regexp_replace(F.lower(split), "[^a-z]", "")
    return F.when(bare.isin("train", "training"), "train").when(bare.isin("dev", "validation", "heldout"), "eval")


def split_name(split: Column) -> Column:
    """train, dev or heldout for any spelling; else null."""
    bare = F.regexp_replace(F.lower(split), "[^a-z]", "")
    return F.when(bare.isin("train", "training"), "train").when(bare.isin("dev", "validation"), "dev").when(bare == "heldout", "heldout")


def listed_records(split_members: DataFrame, doc_records: DataFrame) -> DataFrame:
    """(splits_version, rec, side, split, doc): known records listed on a side of a version, each once."""
    records = doc_records.select(F.col("doc_id").alias("rec"), F.col("document_id").cast("long").alias("doc")).where("rec is not null").distinct()
    members = split_members.select("splits_version", F.col("doc_id").alias("rec"), split_side(F.col("split")).alias("side"), split_name(F.col("split")).alias("split"))
    members = members.where("side is not null and splits_version is not null").distinct()
    return members.join(records, "rec").select("splits_version", "rec", "side", "split", "doc")


def candidate_classes(texts: DataFrame, levels: np.ndarray, hot: int) -> DataFrame:
    """(a, b): evaluation and training classes that meet often enough; ``texts`` has class, side and text, one row per class."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)
    sent = texts.select("class", "side", "text").mapInArrow(_first_grams(shared, hot, int(np.log2(len(levels)))), "key long, class long")
    sent = sent.repartition(F.shiftright("key", 20)).sortWithinPartitions("key")
    met = sent.mapInArrow(_meet(PAIRS), "a long, b long, n int, need int")
    return met.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need")).where("n >= need").select("a", "b")


def _needed(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts of the classes in ``pairs``; the ids are broadcast only after counting them."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return texts.join(F.broadcast(ids) if few else ids, "class", "left_semi").select("class", "text")


def near_classes(texts: DataFrame, levels: np.ndarray, hot: int = HOT) -> DataFrame:
    """(a, b, overlap): pairs of classes, evaluation first, with at least half of their word sequences common."""
    pairs = written(candidate_classes(texts, levels, hot), "candidates")
    grams = written(_needed(texts, pairs).mapInArrow(_grams, "class long, grams array<bigint>"), "grams")
    left = grams.select(F.col("class").alias("a"), F.col("grams").alias("ga"))
    right = grams.select(F.col("class").alias("b"), F.col("grams").alias("gb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("ga", "gb"))
    union = F.size("ga") + F.size("gb") - common
    return both.select("a", "b", common.alias("n"), union.alias("of")).where("2 * n >= of").select("a", "b", (F.col("n") / F.col("of")).alias("overlap"))


def _class_texts(about: DataFrame, docs: DataFrame, listed: DataFrame) -> DataFrame:
    """(class, side, text): the text of one document of each listed class; side 1 evaluation, 2 training, 3 both."""
    sides = listed.groupBy("doc").agg(F.max(F.when(F.col("side") == "eval", 1).otherwise(0)).alias("e"), F.max(F.when(F.col("side") == "train", 2).otherwise(0)).alias("t"))
    classes = about.select("doc", "class").join(sides, "doc").groupBy("class").agg(F.min("doc").alias("doc"), (F.max("e") + F.max("t")).alias("side"))
    classes = written(classes, "classes")
    few = classes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(classes) if few else classes, "doc")


def _expanded(near: DataFrame, listed: DataFrame, about: DataFrame, measure: str, same: float) -> DataFrame:
    """(splits_version, train_doc, eval_doc, eval_split, <measure>): pairs of classes as pairs of listed records."""
    placed = listed.join(about.select("doc", "class").distinct(), "doc").select("splits_version", "rec", "side", "split", "class")
    ev = placed.where("side = 'eval'").select("splits_version", F.col("rec").alias("eval_doc"), F.col("split").alias("eval_split"), F.col("class").alias("a"))
    tr = placed.where("side = 'train'").select("splits_version", F.col("rec").alias("train_doc"), F.col("class").alias("b"))
    apart = near.join(ev, "a").join(tr, ["splits_version", "b"]).select("splits_version", "train_doc", "eval_doc", "eval_split", measure)
    alike = ev.join(tr.withColumnRenamed("b", "a"), ["splits_version", "a"]).where("train_doc != eval_doc")
    alike = alike.select("splits_version", "train_doc", "eval_doc", "eval_split", F.lit(same).alias(measure))
    both = listed.where("side = 'train'").select("splits_version", "rec").join(listed.where("side = 'eval'").select("splits_version", "rec", "split"), ["splits_version", "rec"])
    both = both.select("splits_version", F.col("rec").alias("train_doc"), F.col("rec").alias("eval_doc"), F.col("split").alias("eval_split"), F.lit(same).alias(measure))
    return apart.unionByName(alike).unionByName(both)


def _texts(documents: DataFrame) -> DataFrame:
    return spread(documents.select(F.col("doc_id").cast("long").alias("doc"), "text")).where("doc is not null and text is not null")


def cross_split_pairs(split_members: DataFrame, doc_records: DataFrame, documents: DataFrame) -> DataFrame:
    """(splits_version, train_doc, eval_doc, eval_split, overlap): every listed pair of nearly equal texts, and records with themselves."""
    listed = written(listed_records(split_members, doc_records), "listed")
    docs = _texts(documents)
    described = written(docs.mapInArrow(_describe(CELL_BITS), ABOUT), "about")
    about = described.where(F.col("n_words") >= LEAST_WORDS)
    near = near_classes(_class_texts(about, docs, listed), *frequency_levels(described))
    return _expanded(near, listed, about, "overlap", 1.0)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, class, words): the hashes of a text's words; equal texts have one class."""
    for batch in batches:
        ids, texts = batch.column("doc"), [x or "" for x in batch.column("text").to_pylist()]
        for at, some in _rounds(texts):
            n = len(some)
            owner, words = word_hashes(some)
            count = np.bincount(owner, minlength=n)
            stop = np.cumsum(count)
            kind = np.zeros(n, np.uint64)
            has = count > 0
            kind[has] = H.spans(H.prefix(words), (stop - count)[has], stop[has])
            yield pa.record_batch([ids.slice(at, n).cast(pa.int64()), pa.array(H.mixed(kind + count.astype(np.uint64)).view(np.int64)), _lists(owner, words, n)], names=["doc", "class", "words"])


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 segments of a text of ``length`` words, shorter ones first."""
    base, longer = divmod(length, edits + 1)
    sizes = [base + (k > edits - longer) for k in range(edits + 1)]
    return [(sum(sizes[:k]), sizes[k]) for k in range(edits + 1)]


def allowed_starts(start: int, k: int, shift: int, edits: int, size: int, of: int) -> range:
    """Starts at which segment k (from 0) of a text may stand in one that is ``shift`` words longer.

    If it is the first segment kept, at most k edits lie before it; the rest lie behind.
    """
    low = max(start - k, start + shift - (edits - k), 0)
    high = min(start + k, start + shift + (edits - k), of - size)
    return range(low, high + 1)


def _segment_keys(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, classes, sides = [], [], []
            for cls, side, words in zip(batch.column("class").to_pylist(), batch.column("side").to_pylist(), batch.column("words")):
                words = words.values.to_numpy(zero_copy_only=False).view(np.uint64)
                n, sums = len(words), H.prefix(words)
                for flag in (1, 2):
                    if side & flag:
                        if flag == 1:
                            rows = [(n, k, start, size) for k, (start, size) in enumerate(segments(n, edits))]
                        else:
                            rows = [(m, k, s, size) for m in range(max(edits + 1, n - edits), n + edits + 1) for k, (start, size) in enumerate(segments(m, edits)) for s in allowed_starts(start, k, n - m, edits, size, n)]
                        if not rows:
                            continue
                        of, k, at, size = np.array(rows).T
                        h = H.spans(sums, at, at + size)
                        keys.append(H.mixed(h + (of.astype(np.uint64) << np.uint64(8)) + k.astype(np.uint64)).view(np.int64))
                        classes.append(np.full(len(rows), cls))
                        sides.append(np.full(len(rows), flag, np.int32))
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(classes)), pa.array(np.concatenate(sides))], names=["key", "class", "side"])

    return run


def banded_distances(left: list[np.ndarray], right: list[np.ndarray], edits: int) -> np.ndarray:
    """Edit distance of each pair of sequences, edits + 1 where it is larger: a band of 2 * edits + 1 cells, all pairs at once."""
    far, width = edits + 1, 2 * edits + 1
    n, m = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    x = np.zeros((len(left), n.max(initial=0)), np.int64)
    y = np.zeros((len(left), n.max(initial=0) + 3 * edits + 2), np.int64)
    for k, (s, t) in enumerate(zip(left, right)):
        x[k, : len(s)] = s
        t = t[: y.shape[1] - edits]
        y[k, edits : edits + len(t)] = t
    # Cell d of row i stands for the column j = i + d - edits.
    band = np.where(np.arange(width) >= edits, np.arange(width) - edits, far)[None, :] + np.zeros((len(left), 1), np.int64)
    out = np.where(n == 0, np.minimum(m, far), far)
    for i in range(1, x.shape[1] + 1):
        j = i + np.arange(width) - edits
        differs = x[:, i - 1, None] != y[:, i - 1 : i - 1 + width]
        new = np.minimum(band + differs, np.concatenate([band[:, 1:], np.full((len(left), 1), far)], axis=1) + 1)
        new = np.where((j < 0)[None, :] | (j[None, :] > m[:, None]), far, new)
        new[:, j == 0] = np.minimum(i, far)
        for d in range(1, width):
            inside = (j[d] > 0) & (j[d] <= m)
            new[:, d] = np.where(inside, np.minimum(new[:, d], new[:, d - 1] + 1), new[:, d])
        band = np.minimum(new, far)
        ends = (n == i) & (np.abs(m - n) <= edits)
        out[ends] = band[ends, (m - n + edits)[ends]]
    return out


def _settled(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                wa, wb = ([w.values.to_numpy(zero_copy_only=False) for w in some.column(c)] for c in ("wa", "wb"))
                d = banded_distances(wa, wb, edits)
                keep = pa.array(d <= edits)
                yield pa.record_batch([some.column("a").filter(keep), some.column("b").filter(keep), pa.array(d.astype(np.int32)).filter(keep)], names=["a", "b", "edits"])

    return run


def edited_pairs(split_members: DataFrame, doc_records: DataFrame, documents: DataFrame, edits: int = EDITS) -> DataFrame:
    """(splits_version, train_doc, eval_doc, eval_split, edits): listed pairs whose texts are at most ``edits`` words apart, and records with themselves."""
    listed = written(listed_records(split_members, doc_records), "listed")
    docs = _texts(documents)
    about = written(docs.mapInArrow(_sequences, "doc long, class long, words array<bigint>").where(F.size("words") >= max(LEAST_WORDS, edits + 1)), "sequences")
    sides = listed.groupBy("doc").agg(F.max(F.when(F.col("side") == "eval", 1).otherwise(0)).alias("e"), F.max(F.when(F.col("side") == "train", 2).otherwise(0)).alias("t"))
    classes = about.join(sides, "doc").groupBy("class").agg((F.max("e") + F.max("t")).alias("side"), F.first("words").alias("words"))
    classes = written(classes, "classes")
    keys = written(classes.mapInArrow(_segment_keys(edits), "key long, class long, side int"), "segments")
    left, right = keys.where("side = 1").select("key", F.col("class").alias("a")), keys.where("side = 2").select("key", F.col("class").alias("b"))
    pairs = left.join(right, "key").where("a != b").select("a", "b").distinct()
    both = pairs.join(classes.select(F.col("class").alias("a"), F.col("words").alias("wa")), "a").join(classes.select(F.col("class").alias("b"), F.col("words").alias("wb")), "b")
    near = both.select("a", "b", "wa", "wb").mapInArrow(_settled(edits), "a long, b long, edits int")
    return _expanded(near, listed, about, "edits", 0)


def overlapping_pairs(split_members: DataFrame, doc_records: DataFrame, documents: DataFrame) -> DataFrame:
    """(splits_version, doc_a, doc_b), the smaller doc_id first, each pair once per version."""
    pairs = cross_split_pairs(split_members, doc_records, documents)
    return pairs.select("splits_version", F.least("train_doc", "eval_doc").alias("doc_a"), F.greatest("train_doc", "eval_doc").alias("doc_b")).distinct()


def overlap_report(split_members: DataFrame, doc_records: DataFrame, documents: DataFrame) -> DataFrame:
    """(splits_version, split, source, n_pairs, n_records): overlaps per evaluation split and source of the evaluation record."""
    pairs = cross_split_pairs(split_members, doc_records, documents).select("splits_version", "eval_split", "eval_doc", "train_doc").distinct()
    owner = doc_records.select(F.col("doc_id").alias("eval_doc"), F.col("document_id").alias("doc")).groupBy("eval_doc").agg(F.min("doc").alias("doc"))
    source = documents.select(F.col("doc_id").alias("doc"), "source").groupBy("doc").agg(F.min("source").alias("source"))
    out = pairs.join(owner, "eval_doc").join(source, "doc", "left")
    return out.groupBy("splits_version", F.col("eval_split").alias("split"), "source").agg(F.count("*").alias("n_pairs"), F.countDistinct("eval_doc").alias("n_records"))
