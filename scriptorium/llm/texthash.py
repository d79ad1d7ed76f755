"""Vectorised rolling hashes over many texts at once, for Arrow stages in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Characters hashed at once; the arrays of one round take about fifty bytes each.
ROUND = 1 << 20
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums P with P[j] - P[i] = sum of values[t] * base^t over t in [i, j)."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up, out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of values[start:stop] for each pair, independent of the place."""
    _, down = powers(len(sums))
    return mixed((sums[stop] - sums[start]) * down[start])


def rounds(texts: list[str], size: int = ROUND, overlap: int = 0) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Cut a batch into lists of (row, offset in the text, piece) of about ``size`` characters.

    A longer text comes in pieces that overlap by ``overlap`` characters.
    """
    rows, offsets, pieces, held = [], [], [], 0
    for row, text in enumerate(texts):
        at = 0
        while True:
            piece = text[at : at + size]
            rows.append(row), offsets.append(at), pieces.append(piece)
            held += len(piece)
            if held >= size:
                yield rows, offsets, pieces
                rows, offsets, pieces, held = [], [], [], 0
            if at + size >= len(text):
                break
            at += size - overlap
    if rows:
        yield rows, offsets, pieces


def points(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """op.reduce of each window of ``width`` successive values, by block prefixes and suffixes."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    if width == 1:
        return values
    pad = -len(values) % width
    fill = np.full(pad, values[-1], values.dtype)
    blocks = np.concatenate([values, fill]).reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n], ahead[width - 1 : width - 1 + n])
