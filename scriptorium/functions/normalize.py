"""Unicode normalisation to the 25-letter alphabet with its accounting, in Arrow batches.

Every distinct character is classified once per worker; a text is then a table lookup.
Null text stays null; the counters of a null or empty text are 0.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = frozenset("abcdefghiklmnopqrstuvwxyz")
# Expansions of ligatures, abbreviations and letter variants.
EXPANSIONS = {
    "æ": "ae", "œ": "oe", "ꝛ": "r", "ꝙ": "q", "ꝗ": "q", "ʒ": "z", "ǯ": "z", "ꝟ": "v", "đ": "d", "ð": "d", "ↄ": "c",
    "ø": "o", "ı": "i", "ᵱ": "p", "ꝓ": "p", "ꝑ": "p", "ȝ": "g", "ɔ": "o", "ɯ": "m", "ȣ": "ou", "j": "i", "ſ": "s",
}
KINDS = ("kept", "whitespace", "punct_digit", "dropped", "foreign")


class _Folds(dict):
    """Character -> (kind, letters), filled on demand."""

    def __missing__(self, ch: str) -> tuple[str, str]:
        blank = lambda c: c.isspace() or unicodedata.category(c) == "Zs"
        if blank(ch):
            found = ("whitespace", "")
        else:
            wide = unicodedata.normalize("NFKD", "".join(EXPANSIONS.get(c, c) for c in ch.casefold()))
            marks_off = [EXPANSIONS.get(c, c) if c in "jſ" else c for c in wide if unicodedata.category(c)[0] != "M" and not blank(c)]
            letters = "".join(c for c in marks_off if c in ALPHABET)
            strange = [c for c in marks_off if c not in ALPHABET and unicodedata.category(c)[0] == "L"]
            if letters:
                found = ("kept", letters)
            elif any("LATIN" in unicodedata.name(c, "") for c in strange):
                found = ("dropped", "")
            else:
                found = ("foreign", "") if strange else ("punct_digit", "")
        self[ch] = found
        return found


_folds = _Folds()


def fold_text(text: str) -> tuple[str, Counter]:
    """(letters, counts by kind); ``kept`` counts letters of the result, the others characters of the input."""
    text = unicodedata.normalize("NFC", text)
    counts: Counter = Counter(input=len(text))
    shown = Counter(text)
    for ch, n in shown.items():
        kind, letters = _folds[ch]
        counts[kind] += n * (len(letters) if kind == "kept" else 1)
    return text.translate({ord(ch): _folds[ch][1] for ch in shown}), counts


def normalized(text: Column | str) -> Column:
    """The text reduced to a-z without j."""

    def fold(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else fold_text(t)[0])

    return F.pandas_udf(fold, "string")(text)


def normalization_counts(text: Column | str) -> Column:
    """Struct with the characters of a text by what happens to them."""

    def count(x: pd.Series) -> pd.DataFrame:
        rows = [fold_text(t or "")[1] for t in x]
        return pd.DataFrame({"input_chars": [r["input"] for r in rows], **{k: [r[k] for r in rows] for k in KINDS}})

    return F.pandas_udf(count, "struct<input_chars:long,kept:long,whitespace:long,punct_digit:long,dropped:long,foreign:long>")(text)


def lost_characters(text: Column | str) -> Column:
    """The distinct characters of a text that are dropped or of a foreign script, with their kind."""

    def lost(x: pd.Series) -> pd.Series:
        return x.map(lambda t: [{"ch": c, "kind": _folds[c][0]} for c in sorted(set(unicodedata.normalize("NFC", t or ""))) if _folds[c][0] in ("dropped", "foreign")])

    return F.pandas_udf(lost, "array<struct<ch:string,kind:string>>")(text)


def character_kinds(text: Column | str) -> Column:
    """Each distinct character of a text with its kind and what it becomes."""

    def kinds(x: pd.Series) -> pd.Series:
        return x.map(lambda t: [{"ch": c, "kind": _folds[c][0], "letters": _folds[c][1]} for c in sorted(set(unicodedata.normalize("NFC", t or "")))])

    return F.pandas_udf(kinds, "array<struct<ch:string,kind:string,letters:string>>")(text)
