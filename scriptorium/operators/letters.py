"""Ciphers and noise over whole texts in Arrow batches; a text is never taken apart into rows.

Draws depend on (seed, doc_id, place) only: two squarings modulo the prime 2^31 - 1, which
any engine with 64-bit integers repeats exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.operators.ngrams import LETTERS, A, encoded

PRIME = 2_147_483_647
_ASCII = np.frombuffer(LETTERS.encode(), np.uint8)


def uniform(seed: int, doc: int, place: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) for the places of a document."""
    h = (doc % PRIME * 48271 + np.asarray(place, np.int64) % PRIME * 69621 + seed) % PRIME
    g = (h * h + h * 40692 + 1) % PRIME
    return (g * g + g * 16807 + h) % PRIME / PRIME


def uniform_sql(seed: int, doc: str, place: str) -> str:
    """The same numbers as an expression of DuckDB."""
    h = f"((({doc}) % {PRIME} * 48271 + ({place}) % {PRIME} * 69621 + {seed}) % {PRIME})"
    g = f"(({h} * {h} + {h} * 40692 + 1) % {PRIME})"
    return f"(CAST(({g} * {g} + {g} * 16807 + {h}) % {PRIME} AS DOUBLE) / {PRIME})"


def wrong_key(doc: int, ids: np.ndarray, severity: float) -> tuple[np.ndarray, float]:
    """(letter each letter reads as, chance that a wrong one does) such that about ``severity`` of the text changes.

    Letters of the text join the wrong ones in random order until they cover the share.
    """
    share = np.bincount(ids, minlength=A) / max(len(ids), 1)
    order = np.argsort(uniform(1, doc, np.arange(A)), kind="stable")
    order = order[share[order] > 0]
    before = np.cumsum(share[order]) - share[order]
    wrong = order[np.round(before, 9) < severity]
    key = np.arange(A)
    key[wrong] = (wrong + 1 + np.floor(uniform(2, doc, wrong) * (A - 1)).astype(np.int64)) % A
    covered = share[wrong].sum()
    return key, min(1.0, severity / covered) if covered else 0.0


def substituted(doc: int, ids: np.ndarray, severity: float = 0.2) -> tuple[np.ndarray, int]:
    """(text, changed letters) under a wrong key of the text's own."""
    key, chance = wrong_key(doc, ids, severity)
    hit = (key[ids] != ids) & (uniform(3, doc, np.arange(len(ids))) < chance)
    return np.where(hit, key[ids], ids), int(hit.sum())


def misread(doc: int, ids: np.ndarray, severity: float = 0.05) -> tuple[np.ndarray, int]:
    """(text, events): of the events eight in ten substitute a letter, one drops it, one puts another behind it."""
    at = np.arange(len(ids))
    u, other = uniform(4, doc, at), np.floor(uniform(5, doc, at) * A).astype(np.int64)
    times = np.where(u >= 0.9 * severity, 1 + (u < severity), u < 0.8 * severity)
    first = np.where(u < 0.8 * severity, other, ids)
    out = np.repeat(first, times)
    second = np.cumsum(times) - 1
    twice = times == 2
    out[second[twice]] = other[twice]
    return out, int((u < severity).sum())


def columned(_: int, ids: np.ndarray) -> tuple[np.ndarray, int]:
    """(text, letters): each letter moved on by seven times its place in a row of 24."""
    return (ids + np.arange(len(ids)) % 24 * 7) % A, len(ids)


def hashed_texts(texts: DataFrame, change: Callable[[int, np.ndarray], tuple[np.ndarray, int]], hash_name: str, count_name: str) -> DataFrame:
    """(doc_id, <hash_name>, <count_name>): SHA-256 of each changed text (doc_id, s), and what the change counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows = batch.column("doc_id").to_pylist(), []
            for doc, s in zip(docs, batch.column("s").to_pylist()):
                ids, n = change(doc, encoded([s])[:-1])
                rows.append((hashlib.sha256(_ASCII[ids].tobytes()).hexdigest(), n))
            yield pa.record_batch([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["doc_id", hash_name, count_name])

    return texts.select("doc_id", "s").mapInArrow(run, f"doc_id long, {hash_name} string, {count_name} long")
