"""Interpolated letter models up to order 5 in two passes over the texts, without a row per position.

The first pass counts the grams of all orders in Arrow batches, so only distinct grams
are shuffled. The model is the table of counts: at most 25 + 625 + ... + 25^5 rows a
language (10.2 million, 12 bytes each), whatever the size of the corpus, and is sent to the workers.
The second pass scores each text under every language where it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = "abcdefghiklmnopqrstuvwxyz"
A, ORDER = len(LETTERS), 5
#: Codes held by a worker before they are counted.
HELD = 1 << 22
_TABLE = np.full(128, -1, np.int64)
_TABLE[[ord(c) for c in LETTERS]] = np.arange(A)


def encoded(texts: list[str]) -> np.ndarray:
    """Letter numbers of all texts, each text closed by -1."""
    return _TABLE[np.frombuffer(("\n".join(texts) + "\n").encode("ascii"), np.uint8)]


def gram_codes(ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(end, code) of each run of k letters that crosses no end of a text."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, inside = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(k):
        part = ids[j : j + n]
        code = code * A + part
        inside &= part >= 0
    at = np.flatnonzero(inside)
    return at + k - 1, code[at]


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[np.ndarray]] = {}
        dense: dict[tuple[str, int], np.ndarray] = {}  # short runs are counted at once
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, k), codes in held.items():
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(code), pa.string()), pa.array(np.full(len(code), k, np.int32)), pa.array(code), pa.array(n)], names=["lang", "k", "code", "n"])
            held.clear()

        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("s").to_pylist()
            for lang in dict.fromkeys(langs):
                ids = encoded([t for t, x in zip(texts, langs) if x == lang])
                for k in range(1, min(order, 3) + 1):
                    dense[lang, k] = dense.get((lang, k), 0) + np.bincount(gram_codes(ids, k)[1], minlength=A**k)
                for k in range(4, order + 1):
                    held.setdefault((lang, k), []).append(gram_codes(ids, k)[1])
                size += max(0, order - 3) * len(ids)
            if size >= HELD:
                yield from out()
                size = 0
        yield from out()
        for (lang, k), n in dense.items():
            code = np.flatnonzero(n)
            yield pa.record_batch([pa.array([lang] * len(code), pa.string()), pa.array(np.full(len(code), k, np.int32)), pa.array(code), pa.array(n[code])], names=["lang", "k", "code", "n"])

    return run


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, k, code, g, n): occurrences of each run g of 1 to ``order`` letters in texts (lang, s); runs never cross texts."""
    counts = texts.select("lang", "s").mapInArrow(_count(order), "lang string, k int, code long, n long").groupBy("lang", "k", "code").agg(F.sum("n").alias("n"))
    letters = [F.expr(f"substr('{LETTERS}', CAST(code DIV {A**j} % {A} + 1 AS INT), 1)") for j in range(order - 1, -1, -1)]
    return counts.select("lang", "k", "code", F.substring(F.concat(*letters), order + 1 - F.col("k"), F.col("k")).alias("g"), "n")


class Model:
    """Witten-Bell interpolation of one language's counts; an unseen context takes the lower order as it is."""

    def __init__(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        codes, n = counts[1]
        self.single = np.ones(A)
        self.single[codes] += n
        self.single /= self.single.sum()
        self.orders = []
        for k in sorted(x for x in counts if x > 1):
            codes, n = counts[k]
            context, first, kinds = np.unique(codes // A, return_index=True, return_counts=True)
            self.orders.append((k, codes, n, context, np.add.reduceat(n, first) if len(n) else n, kinds))

    def probabilities(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability by the full order, by single letters) at each position; 1 where a text ends."""
        letter = ids >= 0
        one = np.where(letter, self.single[np.maximum(ids, 0)], 1.0)
        p = one.copy()
        for k, codes, n, context, total, kinds in self.orders:
            end, code = gram_codes(ids, k)
            if not len(context) or not len(end):
                continue
            at = np.minimum(np.searchsorted(context, code // A), len(context) - 1)
            seen = context[at] == code // A
            end, code, at = end[seen], code[seen], at[seen]
            here = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            times = np.where(codes[here] == code, n[here], 0)
            p[end] = (times + kinds[at] * p[end]) / (total[at] + kinds[at])
        return p, one


def models(counts: DataFrame) -> dict[str, Model]:
    """The model of each language from rows (lang, k, code, n)."""
    table = counts.select("lang", "k", "code", "n").orderBy("lang", "k", "code").toPandas()
    return {lang: Model({k: (x["code"].to_numpy(), x["n"].to_numpy()) for k, x in of.groupby("k")}) for lang, of in table.groupby("lang")}


def scored_texts(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, truth, lang, len, bits, bits1): bits a letter of texts (doc_id, lang, s) under every language, also by single letters."""
    shared = texts.sparkSession.sparkContext.broadcast(models(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, texts = batch.num_rows, batch.column("s").to_pylist()
            ids = encoded(texts)
            of = np.repeat(np.arange(m), [len(t) + 1 for t in texts])
            size = np.array([len(t) for t in texts], np.int64)
            for lang, model in shared.value.items():
                bits, bits1 = (-np.bincount(of, np.log2(p), minlength=m) / np.maximum(size, 1) for p in model.probabilities(ids))
                yield pa.record_batch([batch.column("doc_id"), batch.column("lang"), pa.array([lang] * m, pa.string()), pa.array(size), pa.array(bits), pa.array(bits1)], names=["doc_id", "truth", "lang", "len", "bits", "bits1"])

    return texts.select("doc_id", "lang", "s").mapInArrow(run, "doc_id long, truth string, lang string, len long, bits double, bits1 double")
