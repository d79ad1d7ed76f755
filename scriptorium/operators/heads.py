"""Keys of ciphers whose tokens stand for one or two letters, or for a sum.

Mixed: a token is a whole code of one letter, or a prefix and a suffix of one letter each.
Sums: a token is two to six characters whose values add up to the value of a letter; a
token's characters stand in one fixed order, and the stream has no blanks.
Both searches alternate: given a reading of the tokens the key is annealed like that of a
homophonic cipher, and given the key the best reading is found by dynamic programming.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import kernels, noise, search
from scriptorium.operators.search import A

#: Log-probabilities of a code read by its letter and by any other.
RIGHT, WRONG = -0.05, -9.0
#: Characters of the sum cipher and the lengths of its tokens.
CHARACTERS, LENGTHS = 16, (2, 3, 4, 5, 6)


# ---- tokens of one or two letters
def _symbols(tokens: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The codes in order: of each token its whole code or, where ``pair``, its prefix and suffix."""
    both = np.stack([np.where(pair, tokens[:, 1], tokens[:, 0]), np.where(pair, tokens[:, 2], -1)], 1).ravel()
    return both[both >= 0]


def solve_mixed(tokens: np.ndarray, n_codes: int, lm, seed: int, rounds: int = 3, steps: int = 20_000, starts: int = 4) -> tuple[np.ndarray, np.ndarray, float]:
    """(key, pair, log-probability) of tokens [n, 3] of whole code, prefix and suffix; -1 where a token has no such reading.

    ``key`` gives the letter of each code, ``pair`` whether a token is read as two letters.
    """
    can_one, can_two = tokens[:, 0] >= 0, tokens[:, 1] >= 0
    pair, key, value = can_two & ~can_one, None, -np.inf
    for first in dict.fromkeys(map(bytes, (pair, can_two))):  # tokens of two readings as one letter, and as two
        trial = np.frombuffer(first, bool)
        got, score = search.solve_homophonic(_symbols(tokens, trial), n_codes, lm, seed, steps, starts=starts)
        score += trial.sum() * np.log(1 / A)  # two letters must each be worth more than chance
        if score > value:
            pair, key, value = trial, got, score
    for k in range(rounds):
        emissions = []
        for one, two, three in tokens:
            single, double = np.full(A, -1e6), np.full((A, A), -1e6)
            if one >= 0:
                single[:] = WRONG
                single[key[one]] = RIGHT
            if two >= 0:
                double[:] = 2 * WRONG
                double[key[two], :] = double[:, key[three]] = RIGHT + WRONG
                double[key[two], key[three]] = 2 * RIGHT
            emissions.append((single, double))
        _, sizes = search.segment_viterbi(emissions, lm, sizes=True)
        new = np.array(sizes) == 2
        if (new == pair).all():
            break
        pair = new
        key, value = search.anneal(_symbols(tokens, pair), key, lm, seed + k, steps // 2, hot=5.0)
    return key, pair, value


def mixed_tokens(ids: np.ndarray, rng: np.random.Generator, shared: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, true key, true pairs): a text in whole codes, prefixes and suffixes, one of each a letter.

    ``shared`` whole codes are spelled like a prefix and a suffix, so they have two readings.
    """
    truth = np.concatenate([rng.permutation(A) for _ in range(3)])
    code = np.stack([np.argsort(truth[k * A : (k + 1) * A]) + k * A for k in range(3)])
    alike = {int(u): (int(p), int(s)) for u, p, s in zip(rng.permutation(A)[:shared], A + rng.permutation(A), 2 * A + rng.permutation(A))}
    spelled = {v: k for k, v in alike.items()}
    sizes = noise.token_lengths(len(ids), rng)
    start = np.cumsum(sizes) - sizes
    tokens = np.full((len(sizes), 3), -1)
    for k, (at, size) in enumerate(zip(start, sizes)):
        if size == 1:
            one = int(code[0, ids[at]])
            tokens[k] = (one, *alike.get(one, (-1, -1)))
        else:
            two = int(code[1, ids[at]]), int(code[2, ids[at + 1]])
            tokens[k] = (spelled.get(two, -1), *two)
    return tokens, truth, sizes == 2


# ---- tokens that are sums
def linear_order(w: np.ndarray) -> np.ndarray:
    """The order of n things that maximises the sum of w[x, y] over x before y; exact, over all sets of things."""
    n = len(w)
    sets = np.arange(1 << n)
    before = np.zeros((n, 1 << n))  # before[x, S]: what x gains behind the set S
    for y in range(n):
        low = 1 << y
        before[:, low : 2 * low] = before[:, :low] + w[y][:, None]
    best, last = np.full(1 << n, -np.inf), np.zeros(1 << n, np.int64)
    best[0] = 0
    size = np.zeros(1 << n, np.int64)
    for y in range(n):
        size += sets >> y & 1
    for k in range(1, n + 1):
        layer = sets[size == k]
        for x in range(n):
            has = layer[(layer >> x & 1) == 1]
            value = best[has ^ (1 << x)] + before[x, has ^ (1 << x)]
            better = value > best[has]
            best[has[better]], last[has[better]] = value[better], x
    order, at = [], (1 << n) - 1
    while at:
        order.append(int(last[at]))
        at ^= 1 << last[at]
    return np.array(order[::-1])


def character_order(stream: np.ndarray) -> np.ndarray:
    """The fixed order of characters within tokens, from which neighbour follows which.

    Neighbours tell the order but for its beginning, since a boundary leads from late to
    early characters once a token. A run that never falls is made of whole tokens, so the
    right beginning leaves no run of a single character.
    """
    w = np.zeros((CHARACTERS, CHARACTERS))
    np.add.at(w, (stream[:-1], stream[1:]), 1.0)
    found, best = linear_order(w - w.T), (np.inf, np.zeros(0, np.int64))
    for k in range(CHARACTERS):
        order = np.roll(found, -k)
        place = np.argsort(order)
        falls = np.flatnonzero(place[stream[:-1]] > place[stream[1:]])
        single = int((np.diff(falls) == 1).sum())
        if single < best[0]:
            best = (single, order)
    return best[1]


def sums_in_order(order: np.ndarray, negatives: int) -> np.ndarray:
    """Values of the characters if the first ``negatives`` in order count -1, -2, ... and the others down to 0."""
    values = np.empty(CHARACTERS, np.int64)
    values[order] = np.concatenate([-1 - np.arange(negatives), np.arange(CHARACTERS - negatives)[::-1]])
    return values


def segment_sums(stream: np.ndarray, order: np.ndarray, values: np.ndarray) -> dict[int, np.ndarray]:
    """Per length the sum of the characters from each position; a value below all sums where the order is broken or the stream ends."""
    place = np.empty(CHARACTERS, np.int64)
    place[order] = np.arange(CHARACTERS)
    total = np.concatenate([[0], np.cumsum(values[stream])])
    breaks = np.concatenate([[0], np.cumsum(place[stream[:-1]] > place[stream[1:]]), [0]])
    out = {}
    for size in LENGTHS:
        n = len(stream) - size + 1
        if n > 0:
            whole = breaks[size - 1 : size - 1 + n] == breaks[:n]
            out[size] = np.full(len(stream), -999)
            out[size][:n] = np.where(whole, total[size : size + n] - total[:n], -999)
    return out


def solve_sums(stream: np.ndarray, lm, seed: int, splits: tuple[int, ...] = (2, 1, 3), rounds: int = 5, steps: int = 15_000, length_prior: dict[int, float] | None = None) -> dict:
    """Values, letters of the sums and the reading of a stream of characters 0..15.

    For each way to split the inferred order into negative and other values the stream is
    first cut at broken orders and by the lengths' prior, then key and cut alternate.
    """
    prior = length_prior or {2: 0.10, 3: 0.22, 4: 0.26, 5: 0.26, 6: 0.16}
    order = character_order(stream)
    best: dict = {"score": -np.inf}
    for negatives in splits:
        values = sums_in_order(order, negatives)
        sums = segment_sums(stream, order, values)
        low, high = min(x[x > -999].min() for x in sums.values() if (x > -999).any()), max(x.max() for x in sums.values())
        often = np.zeros(high - low + 1)
        for size, x in sums.items():
            np.add.at(often, x[x > -999] - low, prior[size])
        # A sum read as no letter yet: by how often it is seen.
        emit = {size: np.where((x > -999)[:, None], np.log(prior[size]) + np.log(often[np.maximum(x - low, 0)] / often.sum())[:, None] + np.zeros(A), -1e6) for size, x in sums.items()}
        flat = (np.zeros(A), np.zeros((A, A)), np.zeros((A, A, A)))
        _, cut = search.lattice_viterbi(emit, flat)
        key, rounds_left = None, 1
        for k in range(rounds):
            if not cut or not rounds_left:
                break
            at = np.cumsum([0] + [c[0] for c in cut])[:-1]
            seen, ids = np.unique([sums[c[0]][p] for c, p in zip(cut, at)], return_inverse=True)
            start = search.quota_key(np.bincount(ids), lm) if key is None else np.array([key.get(int(x), int(np.argmax(lm[0]))) for x in seen])
            letters, _ = search.anneal(ids, start, lm, seed + k, steps, hot=80.0 if k == 0 else 8.0)
            key = dict(zip(seen.tolist(), letters.tolist()))
            emit = {}
            for size, x in sums.items():
                table = np.full((high - low + 1, A), WRONG)
                for value, letter in key.items():
                    if value >= low:
                        table[value - low, letter] = RIGHT
                emit[size] = np.where((x > -999)[:, None], table[np.maximum(x - low, 0)] + np.log(prior[size]), -1e6)
            old, (score, cut) = cut, search.lattice_viterbi(emit, lm)
            if [c[0] for c in cut] == [c[0] for c in old]:
                rounds_left = 0
            if score > best["score"]:
                best = {"score": score, "values": values, "key": key, "letters": np.array([c[1] for c in cut]), "order": order}
    return best


def sum_stream(ids: np.ndarray, rng: np.random.Generator, negatives: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, true values, true order): each letter as characters in order whose values add up to its value, 3 to 27."""
    order = rng.permutation(CHARACTERS)
    values, targets = sums_in_order(order, negatives), 3 + rng.permutation(A)
    place = np.argsort(order)
    spelled: dict[int, list[np.ndarray]] = {}
    while min((len(spelled.get(t, ())) for t in targets)) < 12:
        drawn = rng.integers(0, CHARACTERS, rng.integers(LENGTHS[0], LENGTHS[-1] + 1))
        kept = spelled.setdefault(int(values[drawn].sum()), [])
        if len(kept) < 40:
            kept.append(drawn[np.argsort(place[drawn], kind="stable")])
    parts = [spelled[int(targets[x])][rng.integers(len(spelled[int(targets[x])]))] for x in ids]
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), values, order


def mixed_searches(texts: DataFrame, models: dict) -> DataFrame:
    """Each text (doc_id, lang, s) in tokens of one or two letters, solved under its language."""

    def encipher(batches):
        for pdf in batches:
            made = [mixed_tokens(search.encode(s), np.random.default_rng(doc)) for doc, s in zip(pdf["doc_id"], pdf["s"])]
            yield pdf.assign(tokens=[t.astype("<i2").tobytes() for t, _, _ in made], truth=[k.astype(np.int8).tobytes() for _, k, _ in made])

    spark = texts.sparkSession
    solved = kernels.function(spark, "Mixed", models, 3, 20_000, 4)("lang", "s", "tokens", "truth", "doc_id")
    jobs = texts.select("doc_id", "lang", "s").where("length(s) >= 40").repartition(spark.sparkContext.defaultParallelism * 4, "doc_id")
    each = jobs.mapInPandas(encipher, "doc_id long, lang string, s string, tokens binary, truth binary").select("doc_id", "lang", solved.alias("got"))
    return each.select("doc_id", "lang", *[F.col("got")[k].alias(name) for k, name in enumerate(("bits", "ser", "key_accuracy"))])


def sum_searches(texts: DataFrame, models: dict, splits: tuple[int, ...] = (2, 1, 3)) -> DataFrame:
    """Each text (doc_id, lang, s) as a stream of sums, solved under its language; ``key_accuracy`` is that of the values."""

    spark = texts.sparkSession
    solved = kernels.function(spark, "Sums", models, " ".join(map(str, splits)), 5, 15_000)("lang", "s", "doc_id")
    each = texts.where("length(s) >= 40").repartition(spark.sparkContext.defaultParallelism * 4, "doc_id").select("doc_id", "lang", solved.alias("got"))
    return each.select("doc_id", "lang", *[F.col("got")[k].alias(name) for k, name in enumerate(("bits", "ser", "key_accuracy"))])
