"""Languages of documents and of the lines that leave them.

Method: rank-order profiles. Each language's profile ranks its most frequent letter
trigrams (words padded by one blank, letters folded to a-z); a text's own trigrams are
ranked the same way and its out-of-place distance to a profile is the sum of the rank
differences, a trigram that the profile lacks counting as the profile's length. The
nearest profile names the language; the confidence is one less the ratio of the nearest
to the second-nearest distance.

Profiles are fitted on a sample of labelled documents bounded by ``SAMPLE_DOCS``
(those least by hash, whole texts); classification covers every line of every document
in one pass. Lines of sites are left out: lines that carry the name of any source as
words (texts copied from another site keep that site's lines), and page lines (a word, a
number, a short word, a number at the start). Names travel as 64-bit hashes; beyond
``MOST_NAMES`` a bitmap of fixed size travels instead, lines it lets pass are joined with
the names, and texts meet the numbers of their site lines by ``doc_id``. The confidence of a document is the share of its letters, in
lines of at least 40, that lie in lines of its language; where no line is that long, and
for lines, it is the ratio described above.

Defined results: null, empty and short texts (under 100 letters) get no language; null
``doc_id`` rows are ignored; rows are classified one by one, so repeated rows repeat
(``language_cases`` drops repeats); extra columns are ignored; an empty table or one
without readable labels gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.lineage import spread, written
from scriptorium.llm import texthash as H
from scriptorium.llm.grouped_splits import plain_language

LANGUAGES = ("latin", "italian", "german", "french")
PROFILE, SAMPLE_DOCS = 400, 6000
LEAST_LINE, LEAST_DOC = 40, 100
#: Letters a name of a source must have to be looked for.
LEAST_NAME = 4
#: Names up to which all their hashes are broadcast (8 bytes each), and bits of the bitmap that is used beyond.
MOST_NAMES, BITMAP_BITS = 2_000_000, 28
_PAGE = re.compile(r"[\W_]*[^\W\d_]+[\W_]+\d+[\W_]+[^\W\d_]{1,4}[\W_]+\d+(?!\w)")
_tables: list[np.ndarray] = []
_words: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """0 no letter, 1-26 a-z after folding, 27 another letter, 28 combining mark."""
    if not _tables:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x32400):
            ch = chr(c)
            if ch.isalpha():
                base = unicodedata.normalize("NFKD", {"ß": "s", "æ": "a", "Æ": "a", "œ": "o", "Œ": "o", "ø": "o", "ł": "l"}.get(ch, ch))[0].lower()
                table[c] = ord(base) - 96 if "a" <= base <= "z" else 27
            elif unicodedata.combining(ch):
                table[c] = 28
        _tables.append(table)
    return _tables[0]


def _plain() -> np.ndarray:
    """Lower case of each letter and digit, 0 for all other code points."""
    if not _words:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x32400):
            if chr(c).isalnum():
                table[c] = ord(chr(c).lower()[0])
        _words.append(table)
    return _words[0]


def _runs(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each run of letters and digits, without regard to case."""
    low = _plain()[c]
    edge = np.diff((low > 0).astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return start, H.spans(H.prefix(low), start, stop)


def _joined(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n successive words."""
    h = np.full(max(len(words) - n + 1, 0), n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(h)]
    return H.mixed(h)


def _hash_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_runs(H.points(x))[1] for x in batch.column("name").to_pylist()]
        found = [x for x in found if len(x)]
        hashes = np.array([_joined(x, len(x))[0] for x in found], np.uint64)
        yield pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(np.array([len(x) for x in found], np.int32))], names=["h", "words"])


class _Names:
    """Looks names up by hash: exactly, or in a bitmap that lets all of them and some others pass."""

    def __init__(self, hashes: np.ndarray, words: list[int], bits: int = 0):
        self.words, self.bits = words, bits
        self.table = np.sort(hashes.view(np.uint64)) if not bits else hashes

    def hits(self, c: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(line, hash) of each place where a name stands; names do not cross lines."""
        start, h = _runs(c)
        lines, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for n in self.words:
            whole = _joined(h, n)
            if self.bits:
                at = (whole >> np.uint64(64 - self.bits)).astype(np.int64)
                ok = (self.table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            else:
                at = np.searchsorted(self.table, whole)
                ok = self.table[np.minimum(at, len(self.table) - 1)] == whole
            of = line[start]
            ok &= of[: len(whole)] == of[n - 1 : n - 1 + len(whole)]
            lines.append(of[: len(whole)][ok])
            hashes.append(whole[ok])
        return np.concatenate(lines), np.concatenate(hashes)


def _site_names(documents: DataFrame) -> DataFrame:
    """(h, words): hash and number of words of each name of a source; written."""
    names = documents.select(F.trim("source").alias("name")).where(F.length("name") >= LEAST_NAME).distinct()
    return written(names.mapInArrow(_hash_names, "h long, words int").distinct(), "names")


def _bitmap(names: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the first ``bits`` bits of all names; at most 2^28 bits go through the driver."""
    byte = F.shiftrightunsigned("h", 64 - bits + 3)
    bit = F.expr(f"shiftleft(1, CAST(shiftrightunsigned(h, {64 - bits}) & 7 AS INT))")
    out = np.zeros(1 << (bits - 3), np.uint8)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([batch.column("byte").to_numpy(zero_copy_only=False).astype(np.uint32).tobytes()], pa.binary()), pa.array([batch.column("bits").to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()], pa.binary())], names=["at", "bits"])

    merged = names.select(byte.alias("byte"), bit.alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bits"))
    for at, packed in merged.mapInArrow(pack, "at binary, bits binary").toLocalIterator():
        out[np.frombuffer(at, np.uint32)] |= np.frombuffer(packed, np.uint8)
    return out


def _lines_of(texts: list[str]):
    """(code points, line of each, start and end of each line, offset of each text)."""
    c = H.points("\n".join(texts) + "\n")
    ends = np.flatnonzero(c == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    first_char = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
    return c, np.repeat(np.arange(len(ends)), ends - starts + 1), starts, ends, first_char


def _candidates(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, of = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("doc_id", "of"))
            for at, some, _ in _some(batch):
                c, line, starts, _, first_char = _lines_of(some)
                found, h = shared.value.hits(c, line)
                doc = np.searchsorted(first_char, starts[found], "right") - 1
                first = np.searchsorted(starts, first_char[:-1])
                yield pa.record_batch([pa.array(ids[at:][doc]), pa.array(of[at:][doc]), pa.array((found - first[doc]).astype(np.int32)), pa.array(h.view(np.int64))], names=["doc_id", "of", "no", "h"])

    return run


def _prepared(documents: DataFrame) -> tuple[DataFrame, object]:
    """Documents (doc_id, text, label, site) and what looks names up in them; ``site`` has lines that were looked up before."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", plain_language(F.col("lang")).alias("label"))
    docs = spread(docs).where("doc_id is not null and text is not null")
    names = _site_names(documents)
    words = sorted(r[0] for r in names.select("words").distinct().collect())
    if names.limit(MOST_NAMES + 1).count() <= MOST_NAMES:
        hashes = np.array([r[0] for r in names.select("h").toLocalIterator()], np.int64)
        return docs.withColumn("site", F.lit(None).cast("array<int>")), spark.sparkContext.broadcast(_Names(hashes, words if len(hashes) else []))
    docs = docs.withColumn("of", F.xxhash64("text"))
    shared = spark.sparkContext.broadcast(_Names(_bitmap(names, BITMAP_BITS), words, BITMAP_BITS))
    hits = docs.select("doc_id", "of", "text", F.lit(None).cast("array<int>").alias("site")).mapInArrow(_candidates(shared), "doc_id long, of long, no int, h long")
    site = hits.join(names.select("h"), "h", "left_semi").groupBy("doc_id", "of").agg(F.collect_set("no").alias("site"))
    docs = docs.join(site, ["doc_id", "of"], "left").select("doc_id", "text", "label", "site")
    return docs, spark.sparkContext.broadcast(_Names(np.zeros(0, np.int64), []))


def _trigrams(texts: list[str], sites: list[list[int] | None], names: _Names):
    """(line of each trigram, code, letters per line, document of each line, first line of each document)."""
    c, line, starts, ends, first_char = _lines_of(texts)
    first_line = np.searchsorted(starts, first_char[:-1])
    doc_of = np.searchsorted(first_char, starts, "right") - 1
    kind = _classes()[c]
    letters = np.bincount(line[(kind > 0) & (kind < 28)], minlength=len(ends))
    site = np.zeros(len(ends), bool)
    site[names.hits(c, line)[0]] = True
    for d, known in enumerate(sites):
        if known:
            site[first_line[d] + np.array(known)] = True
    digit = (c >= 48) & (c <= 57)
    for k in np.flatnonzero((np.bincount(line[digit], minlength=len(ends)) >= 2) & ~site & (letters >= 10)):
        d = doc_of[k]
        if _PAGE.match(texts[d][starts[k] - first_char[d] : ends[k] - first_char[d]]):
            site[k] = True
    keep = kind != 28
    kind, line = kind[keep], line[keep]
    kind = np.where(kind == 27, 0, kind)
    keep = (kind > 0) | (np.concatenate([[1], kind[:-1]]) > 0)
    kind, line = kind[keep].astype(np.int32), line[keep]
    code = kind[:-2] * 729 + kind[1:-1] * 27 + kind[2:]
    inner = (kind[1:-1] > 0) & ~site[line[1:-1]]
    return line[1:-1][inner], code[inner], letters, site, doc_of, first_line


def _some(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str], list[list[int] | None]]]:
    texts, sites = [x or "" for x in batch.column("text").to_pylist()], batch.column("site").to_pylist()
    at, held = 0, 0
    for i, x in enumerate(texts):
        held += len(x)
        if held >= H.ROUND:
            yield at, texts[at : i + 1], sites[at : i + 1]
            at, held = i + 1, 0
    if at < len(texts):
        yield at, texts[at:], sites[at:]


def language_profiles(docs: DataFrame, shared, total: int, sample_docs: int = SAMPLE_DOCS, profile: int = PROFILE) -> dict[str, list[int]]:
    """The most frequent trigram codes of each language, most frequent first."""
    docs = docs.where("label is not null")
    if total > sample_docs:
        docs = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.lit(int((1 << 40) * sample_docs / total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(LANGUAGES), 27**3), np.int64)
        for batch in batches:
            labels = np.array([LANGUAGES.index(x) for x in batch.column("label").to_pylist()], np.int64)
            for at, some, sites in _some(batch):
                line, code, _, _, doc_of, _ = _trigrams(some, sites, shared.value)
                np.add.at(sums, (labels[at:][doc_of[line]], code), 1)
        lang, code = np.nonzero(sums)
        yield pa.record_batch([pa.array(lang.astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(sums[lang, code])], names=["lang", "code", "n"])

    counts = docs.select("label", "text", "site").mapInArrow(run, "lang int, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= profile)
    out: dict[str, list[int]] = {}
    for row in ranked.orderBy("lang", "rank").collect():
        out.setdefault(LANGUAGES[row["lang"]], []).append(row["code"])
    return out


def _distances(unit: np.ndarray, gram: np.ndarray, n_units: int, ranks: np.ndarray) -> np.ndarray:
    """Out-of-place distances [unit, language]; ``gram`` numbers the trigrams known to any profile."""
    width = ranks.shape[1]
    key, count = np.unique(unit * width + gram, return_counts=True)
    unit, gram = key // width, key % width
    by = (unit << 40) | ((0xFFFF - np.minimum(count, 0xFFFF)).astype(np.int64) << 20) | gram
    by.sort()
    unit, gram = by >> 40, by & 0xFFFFF
    first = np.searchsorted(unit, np.arange(n_units))
    place = np.minimum(np.arange(len(unit)) - first[unit], ranks.max())
    out = np.empty((n_units, len(ranks)))
    for k, row in enumerate(ranks):
        at = row[gram]
        miss = at == row.max()
        out[:, k] = np.bincount(unit, np.where(miss, row.max(), np.abs(at - place)), minlength=n_units)
    return out


def _best(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(distances, axis=1, kind="stable")
    rows = np.arange(len(distances))
    one, two = distances[rows, order[:, 0]], distances[rows, order[:, 1]]
    return order[:, 0], np.where(two > 0, 1 - one / np.maximum(two, 1e-9), 0.0)


def _classify(profiles: dict[str, list[int]], shared):
    langs = [x for x in LANGUAGES if x in profiles]
    known: dict[int, int] = {}
    for place in range(max(map(len, profiles.values()))):  # numbered by rank, so ties of a text follow general frequency
        for x in langs:
            if place < len(profiles[x]):
                known.setdefault(profiles[x][place], len(known))
    ranks = np.full((len(langs), len(known)), max(map(len, profiles.values())), np.int64)
    for k, x in enumerate(langs):
        ranks[k, [known[c] for c in profiles[x]]] = np.arange(len(profiles[x]))
    gram_of = np.full(27**3, -1, np.int32)
    gram_of[list(known)] = list(known.values())
    names_of = np.array(langs, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column("doc_id").to_numpy(zero_copy_only=False), np.array(batch.column("label").to_pylist(), object)
            for at, some, sites in _some(batch):
                line, code, letters, site, doc_of, first_line = _trigrams(some, sites, shared.value)
                n, m = len(some), len(letters)
                gram = gram_of[code].astype(np.int64)
                line, gram = line[gram >= 0], gram[gram >= 0]
                of_line, sure_line = _best(_distances(line, gram, m, ranks))
                of_doc, sure_doc = _best(_distances(doc_of[line], gram, n, ranks))
                seen = np.bincount(line, minlength=m) > 0
                size = np.bincount(doc_of, np.where(site, 0, letters), minlength=n)
                long_ = (letters >= LEAST_LINE) & ~site & seen
                votes = np.zeros((n, len(langs)))
                np.add.at(votes, (doc_of[long_], of_line[long_]), letters[long_])
                has = votes.max(axis=1) > 0
                top = votes.argmax(axis=1)
                share = np.where(has, votes.max(axis=1) / np.maximum(votes.sum(axis=1), 1), 0)
                of_doc = np.where(has, np.where(votes[np.arange(n), of_doc] == votes.max(axis=1), of_doc, top), of_doc)
                counted = (size >= LEAST_DOC) & (np.bincount(doc_of[line], minlength=n) > 0)
                docs = np.flatnonzero(counted)
                lines = np.flatnonzero(long_ & counted[doc_of] & (of_line != of_doc[doc_of]))
                d = np.concatenate([docs, doc_of[lines]])
                columns = [
                    pa.array(ids[at:][d].astype(np.int64)),
                    pa.array(np.concatenate([np.zeros(len(docs)), lines - first_line[doc_of[lines]] + 1]).astype(np.int32)),
                    pa.array(names_of[np.concatenate([of_doc[docs], of_line[lines]])], pa.string()),
                    pa.array(np.concatenate([np.where(has, share, sure_doc)[docs], sure_line[lines]]), pa.float64()),
                    pa.array(labels[at:][d], pa.string()),
                    pa.array(np.concatenate([size[docs], letters[lines]]).astype(np.int32)),
                ]
                yield pa.record_batch(columns, names=["doc_id", "line_no", "language", "confidence", "label", "letters"])

    return run


SCHEMA = "doc_id long, line_no int, language string, confidence double, label string, letters int"


def languages(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, language, confidence, label, letters).

    ``line_no`` 0 is the document; from 1, lines of at least 40 letters in another
    language than the document. ``label`` is the record's label in plain spelling.
    """
    docs, shared = _prepared(documents)
    profiles = language_profiles(docs, shared, documents.count())
    if len(profiles) < 2:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    return docs.mapInArrow(_classify(profiles, shared), SCHEMA)


def language_cases(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, language): documents whose label is missing or wrong, and lines in another language."""
    out = languages(documents)
    wrong = F.col("label").isNull() | (F.col("label") != F.col("language"))
    return out.where((F.col("line_no") > 0) | wrong).select("doc_id", "line_no", "language").distinct()
