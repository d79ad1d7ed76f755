"""Noise families, controls and repeat models on letter streams; draws depend on the row's key and the seed only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.search import A, decode, encode

# Share of one-letter tokens; kinds and families of the mixture with their severities.
P_ONE = 0.476
KINDS = (("clean", 0.5), ("noised", 0.3), ("shuffled", 0.1), ("gibberish", 0.1))
FAMILIES = {"substitution": (0.75, 0.02, 0.5), "segmentation": (0.5, 0.01, 0.2), "transcription": (0.5, 0.01, 0.1)}


def _rng(seed: int, key: int) -> np.random.Generator:
    return np.random.default_rng([seed, key & 0xFFFFFFFF, key >> 32 & 0x7FFFFFFF])


def token_lengths(n: int, rng: np.random.Generator, p_one: float = P_ONE) -> np.ndarray:
    """Lengths 1 or 2 that cover exactly n letters; the last is cut to fit."""
    lengths = np.zeros(0, np.int64)
    while lengths.sum() < n:  # blocks of draws until the letters are covered
        lengths = np.concatenate([lengths, rng.choice([1, 2], size=64 + n // 2, p=[p_one, 1 - p_one])])
    left = n - (np.cumsum(lengths) - lengths)
    return np.minimum(lengths, left)[left > 0]


def substitution_noise(ids: np.ndarray, severity: float, rng: np.random.Generator) -> np.ndarray:
    """A consistent wrong key over letters that cover ``severity`` of the text, thinned to that rate."""
    share = np.bincount(ids, minlength=A) / max(len(ids), 1)
    order = rng.permutation(A)
    upto = np.cumsum(share[order])
    wrong = order[np.concatenate([[0.0], upto[:-1]]) < severity]
    covered = share[wrong].sum()
    key = np.arange(A)
    key[wrong] = (wrong + 1 + rng.integers(0, A - 1, len(wrong))) % A
    hit = rng.random(len(ids)) < (min(1.0, severity / covered) if covered else 0.0)
    return np.where(hit, key[ids], ids)


def segmentation_noise(ids: np.ndarray, severity: float, rng: np.random.Generator, p_copy: float = 0.5) -> np.ndarray:
    """Misread tokens: of two letters the second is lost, after one letter another appears (a copy or a letter of the text)."""
    sizes = token_lengths(len(ids), rng)
    start = np.cumsum(sizes) - sizes
    missed = rng.random(len(sizes)) < min(1.0, severity * (2 - P_ONE))
    extra = np.where(rng.random(len(sizes)) < p_copy, ids[start] if len(start) else start, ids[rng.integers(0, max(len(ids), 1), len(sizes))] if len(ids) else start)
    second = np.where(sizes == 2, ids[np.minimum(start + 1, len(ids) - 1)] if len(ids) else start, extra)
    keep = (sizes == 2) != missed
    both = np.stack([ids[start] if len(ids) else start, second], 1).ravel()
    return both[np.stack([np.ones(len(keep), bool), keep], 1).ravel()]


def transcription_noise(ids: np.ndarray, severity: float, rng: np.random.Generator) -> np.ndarray:
    """Independent events: eight of ten substitute, one deletes, one inserts."""
    event, letter = rng.random(len(ids)), rng.integers(0, A - 1, len(ids))
    other = (ids + 1 + letter) % A
    out = np.stack([np.where(event < 0.8 * severity, other, ids), other], 1)
    keep = np.stack([~((event >= 0.8 * severity) & (event < 0.9 * severity)), (event >= 0.9 * severity) & (event < severity)], 1)
    return out.ravel()[keep.ravel()]


NOISES = {"substitution": substitution_noise, "segmentation": segmentation_noise, "transcription": transcription_noise}
NOISED = "doc_id long, family string, severity double, n_in long, n_out long, text string"


def noised(texts: DataFrame, family: str, severity: float, seed: int = 0) -> DataFrame:
    """The texts (doc_id, s) under one family of noise; an empty or null text stays empty."""

    def run(batches):
        for pdf in batches:
            out = []
            for doc, s in zip(pdf["doc_id"], pdf["s"]):
                ids = encode(s or "")
                got = NOISES[family](ids, severity, _rng(seed, doc)) if len(ids) else ids
                out.append((doc, family, severity, len(ids), len(got), decode(got)))
            yield pd.DataFrame(out, columns=["doc_id", "family", "severity", "n_in", "n_out", "text"])

    return texts.select("doc_id", "s").mapInPandas(run, NOISED)


def noise_mixture(texts: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, kind, severity, n_out, text): each text clean, noised, shuffled or as gibberish, drawn by its id."""
    names, shares = zip(*KINDS)

    def run(batches):
        for pdf in batches:
            out = []
            for doc, s in zip(pdf["doc_id"], pdf["s"]):
                ids, rng, severity = encode(s or ""), _rng(seed, doc), 0.0
                kind = names[int(np.searchsorted(np.cumsum(shares), rng.random(), "right"))] if len(ids) else "clean"
                if kind == "noised":
                    for family, (p, low, high) in FAMILIES.items():
                        if rng.random() < p and len(ids):
                            severity = float(rng.uniform(low, high))
                            ids = NOISES[family](ids, severity, rng)
                elif kind == "shuffled":
                    ids = rng.permutation(ids)
                elif kind == "gibberish":
                    ids = rng.integers(0, A, len(ids))
                out.append((doc, kind, severity, len(ids), decode(ids)))
            yield pd.DataFrame(out, columns=["doc_id", "kind", "severity", "n_out", "text"])

    return texts.select("doc_id", "s").mapInPandas(run, "doc_id long, kind string, severity double, n_out long, text string")


def noise_grid(texts: DataFrame, grid: dict[str, list[float]], seed: int = 0) -> DataFrame:
    """All families at all severities of ``grid`` on the same texts."""
    out = None
    for family, levels in grid.items():
        for severity in levels:
            one = noised(texts, family, severity, seed)
            out = one if out is None else out.unionByName(one)
    return out


def codex_like(ids: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A verbose encryption that reads like a codex: each letter becomes one of three groups of two or three of 14 glyphs.

    A group opens with one of four glyphs and goes on with the other ten, so the stream
    has the low entropy and the repeats of such transcriptions and no letter statistics.
    """
    groups = [[np.concatenate([rng.integers(0, 4, 1), 4 + rng.integers(0, 10, rng.integers(1, 3))]) for _ in range(3)] for _ in range(A)]
    choice = rng.integers(0, 3, len(ids))
    return np.concatenate([groups[x][c] for x, c in zip(ids, choice)]) if len(ids) else np.zeros(0, np.int64)


CONTROLS = ("positive", "shuffled", "gibberish", "codex_like", "contamination")


def control_battery(texts: DataFrame, seed: int = 0, outside: tuple[str, ...] = ("french",)) -> DataFrame:
    """(control, doc_id, text, truth): controls of the same texts (doc_id, lang, s) with their truth where there is one.

    ``outside`` names the languages that a search does not know: their enciphered texts
    are contamination, those of the others positives.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for doc, lang, s in zip(pdf["doc_id"], pdf["lang"], pdf["s"]):
                ids, rng = encode(s or ""), _rng(seed, doc)
                kind = "contamination" if lang in outside else "positive"
                out.append((kind, doc, decode(rng.permutation(A)[ids]), s))
                out.append(("shuffled", doc, decode(rng.permutation(ids)), None))
                out.append(("gibberish", doc, decode(rng.integers(0, A, len(ids))), None))
                out.append(("codex_like", doc, decode(codex_like(ids, rng)), None))
            yield pd.DataFrame(out, columns=["control", "doc_id", "text", "truth"])

    return texts.select("doc_id", "lang", "s").mapInPandas(run, "control string, doc_id long, text string, truth string")


def sticky(tokens: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """(transcription, page_id, line, idx, word): a token repeats the one before it with probability ``share``; a repeat may be repeated.

    A repeat reads as the last token that was not one: within a page, the last row that kept its word.
    """
    from pyspark.sql import Window as W

    from scriptorium.streaming.examples import uniform

    u = uniform(F.lit(str(seed)), "transcription", F.col("page_id").cast("string"), F.col("line").cast("string"), F.col("idx").cast("string"))
    order = W.partitionBy("transcription", "page_id").orderBy("line", "idx")
    own = (u >= share) | (F.row_number().over(order) == 1)
    word = F.last(F.when(own, F.col("word")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return tokens.select("transcription", "page_id", "line", "idx", word.alias("word"))
