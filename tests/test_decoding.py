"""Models, decodes, searches and letter passes against plain re-computation."""

import itertools
import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium import queries
from scriptorium.operators import decoding, letters, mechanisms, ngrams, noise, search

SMALL = "/root/testdata/sf0.001"


def toy_model(seed=0):
    rng = np.random.default_rng(seed)
    one, two, three = rng.dirichlet(np.ones(25)), rng.dirichlet(np.full(25, 0.3), 25), rng.dirichlet(np.full(25, 0.2), (25, 25))
    return tuple(np.log(x + 1e-9) for x in (one, two, three))


def stream(lm, n, seed=0):
    rng, out = np.random.default_rng(seed), [0, 1]
    p = np.exp(lm[2])
    p /= p.sum(-1, keepdims=True)
    while len(out) < n:
        out.append(int(rng.choice(25, p=p[out[-2], out[-1]])))
    return np.array(out)


def plain_score(ids, lm):
    total = lm[0][ids[0]] + (lm[1][ids[0], ids[1]] if len(ids) > 1 else 0)
    return total + sum(lm[2][a, b, c] for a, b, c in zip(ids, ids[1:], ids[2:]))


# ---- counts and scores
def test_order_five_counts_and_scores(spark):
    texts = [(1, "a", "abracadabra"), (2, "a", "abba"), (3, "b", "cadabra"), (4, "b", "x"), (5, "a", "abrac")]
    counts = ngrams.gram_counts(spark.createDataFrame(texts, "doc_id long, lang string, s string"))
    want = Counter((lang, k, s[i : i + k]) for _, lang, s in texts for k in range(1, 6) for i in range(len(s) - k + 1))
    assert {(r["lang"], r["k"], r["g"]): r["n"] for r in counts.collect()} == dict(want)
    asked = [(7, "a", "abracab"), (8, "b", "zz"), (9, "a", "")]
    got = {(r["doc_id"], r["lang"]): (r["bits"], r["bits1"]) for r in ngrams.scored_texts(spark.createDataFrame(asked, "doc_id long, lang string, s string"), counts).collect()}
    for lang in "ab":
        total = sum(n for (x, k, _), n in want.items() if x == lang and k == 1)

        def p(text, lang=lang, total=total):
            if len(text) == 1:
                return (want[lang, 1, text] + 1) / (total + 25)
            after = [n for (x, k, g), n in want.items() if x == lang and k == len(text) and g[:-1] == text[:-1]]
            return p(text[1:]) if not after else (want[lang, len(text), text] + len(after) * p(text[1:])) / (sum(after) + len(after))

        for doc, _, s in asked:
            bits = -sum(math.log2(p(s[max(0, i - 4) : i + 1])) for i in range(len(s))) / max(len(s), 1)
            one = -sum(math.log2(p(c)) for c in s) / max(len(s), 1)
            assert got[doc, lang] == pytest.approx((bits, one))


# ---- posteriors, sensitivity, swaps
def test_position_posterior_brute_force():
    lm = toy_model()
    ids = stream(lm, 12)
    for at in (0, 1, 5, 10, 11):
        forced = np.arange(12) == at
        got = decoding.position_posterior(ids, lm, draws=1, rate=0.0, forced=forced)
        logs = []
        for letter in range(25):
            trial = ids.copy()
            trial[at] = letter
            logs.append(plain_score(trial, lm))
        logs = np.array(logs) - np.logaddexp.reduce(logs)
        assert np.allclose(got[at], logs) and np.allclose(got[~forced], -np.log(25))


def test_pair_swaps_brute_force():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        scores, key = rng.normal(size=(8, 25)), rng.permutation(25)[:8]
        gain = lambda i, j: scores[i, key[j]] + scores[j, key[i]] - scores[i, key[i]] - scores[j, key[j]]  # noqa: E731, B023
        left, want = set(range(8)), []
        while len(want) < 3:
            best = max(itertools.combinations(sorted(left), 2), key=lambda x: gain(*x), default=None)
            if best is None or gain(*best) <= 0:
                break
            want.append(best)
            left -= set(best)
        got = decoding.pair_swaps(scores, key, 3)
        assert [(a, b) for a, b, _ in got] == want and all(np.isclose(g, gain(a, b)) and g > 0 for a, b, g in got)


def test_sensitivity_brute_force():
    lm = toy_model(1)
    ids, key = stream(lm, 60), np.random.default_rng(1).permutation(25)
    got = decoding.sensitivity(ids, key, lm)
    for s in range(25):
        if s not in ids:
            assert got[s] == 0
            continue
        others = []
        for letter in set(range(25)) - {int(key[s])}:
            trial = key.copy()
            trial[s] = letter
            others.append(plain_score(trial[ids], lm))
        assert np.isclose(got[s], plain_score(key[ids], lm) - max(others))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=40), st.integers(0, 10**6), st.booleans())
def test_incremental_score(ids, seed, prior):
    lm, rng, ids = toy_model(2), np.random.default_rng(seed), np.array(ids)
    state = search.Incremental(ids, rng.integers(0, 25, 7), lm, prior=prior)
    whole = lambda key: search._Trigrams(ids, 7).penalized(key, lm) if prior else plain_score(key[ids], lm)
    assert np.isclose(state.value, whole(state.key))
    for _ in range(8):
        which = rng.permutation(7)[: rng.integers(1, 3)].tolist()
        to = rng.integers(0, 25, len(which)).tolist()
        trial = state.key.copy()
        trial[which] = to
        gain = state.gain(which, to)
        assert np.isclose(gain, whole(trial) - whole(state.key))
        if rng.random() < 0.6:
            assert np.isclose(state.move(which, to), whole(trial)) and (state.key == trial).all()


def test_quota_key_follows_the_shares():
    lm = toy_model(3)
    occurrences = np.random.default_rng(3).integers(1, 90, 200)
    seats = np.bincount(search.quota_key(occurrences, lm), minlength=25)
    assert np.abs(seats - 200 * np.exp(lm[0]) / np.exp(lm[0]).sum()).max() < 1


def test_race_polish():
    lm = toy_model(4)
    ids, key = stream(lm, 400), np.arange(25)
    key[[0, 3]], key[[5, 9]] = key[[3, 0]], key[[9, 5]]
    out, about = decoding.race_polish(key, decoding.masked_judge(ids, lm))
    assert (out == np.arange(25)).all() and about["accepted"] and about["moves"] == 2
    noise_only = lambda keys, a, b: np.random.default_rng(a).normal(size=(len(keys), b - a))
    out, about = decoding.race_polish(key, noise_only, budgets=(8, 32))
    assert (out == key).all() and not about["accepted"]


def test_mechanisms(spark):
    lm = toy_model(7)
    text = search.decode(stream(lm, 500))
    got = {r["mechanism"]: r for r in mechanisms.compared(spark.createDataFrame([(3, "x", text)], "doc_id long, lang string, s string"), {"x": lm}).collect()}
    assert set(got) == set(mechanisms.PROPOSERS) and got["none"]["ser"] == got["none"]["ser_before"] > 0
    assert got["pair_swap"]["ser"] == got["race"]["ser"] == 0
    assert all(r["ser"] <= r["ser_before"] for n, r in got.items() if n in ("pair_swap", "race", "posterior"))
    with pytest.raises(ValueError):
        mechanisms.proposer("race")(lambda *x: x[0])


def test_error_spread():
    even, block = np.tile([1, 0, 0, 0, 0], 40), np.repeat([1, 0, 0, 0, 0], 40)
    a, b = decoding.error_spread(even), decoding.error_spread(block)
    assert a["rate"] == b["rate"] == 0.2 and a["mean_run"] == 1 and b["mean_run"] == 40
    assert a["window_sd"] == 0 and b["window_sd"] > 3 * b["shuffled_sd"] and a["lag1"] < 0 < 0.9 < b["lag1"]
    assert decoding.error_spread(np.zeros(0))["rate"] == 0


def test_order_nulls(spark):
    pages, a, b, n = list(range(10, 30)), [10, 11, 12], [11, 13, 29], [5, 1, 2]
    df = spark.createDataFrame([("m", pages, a, b, n)], "transcription string, pages array<long>, a array<long>, b array<long>, n array<long>")
    got = {r["rep"]: r["cost"] for r in decoding.order_nulls(df, 900).collect()}
    assert len(got) == 901 and np.isclose(got[0], (5 * 1 + 1 * 2 + 2 * 17) / 8)
    assert abs(np.mean([c for r, c in got.items() if r]) - 7) < 0.5  # two random places of twenty lie seven apart


# ---- searches
def test_annealing_200k_steps_on_many_types():
    import time

    lm, rng = toy_model(5), np.random.default_rng(5)
    plain = stream(lm, 10_846)
    ids = plain * 40 + rng.integers(0, 40, len(plain))
    _, ids = np.unique(ids, return_inverse=True)
    key = search.quota_key(np.bincount(ids), lm)
    began = time.process_time()
    best, value = search.anneal(ids, key, lm, 0, 20_000)
    assert value > search._Trigrams(ids, len(key)).penalized(key, lm)
    assert time.process_time() - began < 40


# ---- letters
def test_uniform_on_both_engines():
    place = np.arange(500)
    for doc in (0, 7, 2**31, 987_654_321_012):
        want = letters.uniform(3, doc, place)
        got = duckdb.sql(f"SELECT {letters.uniform_sql(3, f'CAST({doc} AS BIGINT)', 'p')} AS u FROM (SELECT unnest(range(500)) AS p) t ORDER BY p").fetchall()
        assert np.array_equal(want, [x[0] for x in got]) and 0.42 < want.mean() < 0.58 and (want < 1).all()


def test_letter_noise_rates():
    ids = stream(toy_model(6), 20_000)
    out, changed = letters.substituted(11, ids)
    assert changed == (out != ids).sum() and 0.18 < changed / len(ids) < 0.22
    assert all(len(set(out[ids == x]) - {x}) <= 1 for x in range(25))  # one wrong reading a letter
    out, events = letters.misread(11, ids)
    assert 0.045 < events / len(ids) < 0.055 and abs(len(out) - len(ids)) < 0.005 * len(ids)
    assert letters.substituted(1, ids[:0])[1] == letters.misread(1, ids[:0])[1] == 0


def test_token_lengths():
    for n in (0, 1, 2, 777):
        sizes = noise.token_lengths(n, np.random.default_rng(n))
        assert sizes.sum() == n and set(sizes.tolist()) <= {1, 2}


# ---- statements against Python
def rows(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, SMALL).collect()]


def cells():
    sql = """SELECT c.*, substr(c.instance, 1, instr(c.instance, '_') - 1) AS kind FROM (SELECT *, row_number() OVER (PARTITION BY instance, presentation, head, hypothesis, window_len ORDER BY loaded_at DESC, cell_id DESC) AS k
        FROM '{0}/score_cells.parquet' WHERE instance IS NOT NULL AND presentation IS NOT NULL AND head IS NOT NULL AND hypothesis IS NOT NULL AND total_per_all_symbols IS NOT NULL) c WHERE k = 1"""
    return duckdb.sql(sql.format(SMALL)).df()


def test_predictive_piles(spark):
    df = cells()

    def log_density(x, pile):
        n, df_ = pile.count_all, max(pile.count_all - 1, 1)
        scale = max(pile.sd, 0.05) * math.sqrt(1 + 1 / n)
        z = (x - pile.mean_) / scale
        return math.lgamma((df_ + 1) / 2) - math.lgamma(df_ / 2) - 0.5 * math.log(df_ * math.pi) - math.log(scale) - (df_ + 1) / 2 * math.log1p(z * z / df_)

    class Pile:
        def __init__(self, x):
            self.count_all, self.mean_, self.sd = len(x), x.mean(), x.std() if x.count() > 1 else 0.0

    piles = {k: Pile(df[df.kind == k].structure_margin) for k in ("positive", "shuffled")}
    got = {r["cell_id"]: r["log10_ratio"] for r in rows(spark, "op182_predictive_piles")}
    checked = 0
    for cell, x in zip(df.cell_id, df.structure_margin):
        if not math.isnan(x):
            want = (log_density(x, piles["positive"]) - log_density(x, piles["shuffled"])) / math.log(10)
            assert abs(got[cell] - want) < 1e-4
            checked += 1
    assert checked > 20


def test_key_bits(spark):
    for r in rows(spark, "op197_key_bits"):
        assert np.isclose(r["one_to_one_bits"], math.lgamma(26) / math.log(2), atol=1e-5)
        assert np.isclose(r["homophonic_bits"], r["types"] * math.log2(25), atol=1e-5)
        assert np.isclose(r["mixed_bits"], 18 * math.lgamma(24) / math.log(2), atol=1e-5)
        assert np.isclose(r["sum_bits"], math.lgamma(17) / math.log(2) + 25 * math.log2(26), atol=1e-5)


def test_recovery_report_counts_the_true_language(spark):
    out = {(r["lang"], r["window_len"]): r for r in rows(spark, "op130_recovery_report")}
    best = cells().sort_values(["total_per_all_symbols", "hypothesis"]).groupby(["instance", "presentation", "head", "window_len"]).first()
    labels = {"la": "latin", "it": "italian", "de": "german", "ge": "german", "fr": "french"}
    recs = duckdb.sql(f"SELECT doc_id, language FROM '{SMALL}/doc_records.parquet' WHERE doc_id IS NOT NULL AND language IS NOT NULL").fetchall()
    truth = {}
    for doc, label in recs:
        bare = "".join(c for c in label.lower() if "a" <= c <= "z")
        name = {"latein": "latin", "latino": "latin", "deutsch": "german"}.get(bare, labels.get(bare[:2]) if len(bare) > 1 and bare not in ("unknown", "und", "xx") else None)
        if name:
            truth[doc] = min(name, truth.get(doc, name))
    pairs = [(truth[d], h) for d, h in zip(best.doc_id, best.hypothesis) if d in truth]
    assert out[None, None]["n"] == len(pairs) and out[None, None]["hits"] == sum(a == b for a, b in pairs)


def test_shortlist_keeps_the_best_of_equal_decodes(spark):
    base = "in principio erat verbum et verbum erat apud deum et deus erat verbum " * 12
    schema = "doc_id long, text string, source string, lang string, n_tokens long"
    texts = [(i, base + f"{'abcdefghik'[i % 10]}" * 3, "s", x, None) for i in range(60) for x in ("la", "it") if i % 2 == (x == "it")]
    out = queries.operator(spark, "op159_shortlist", documents=spark.createDataFrame(texts, schema)).collect()
    by = {}
    for r in out:
        by.setdefault(r["lang"], []).append(r)
    text = {i: t for i, t, *_ in texts}
    for found in by.values():
        assert len({text[r["doc_id"]] for r in found}) == len(found) and [r["bits"] for r in sorted(found, key=lambda r: r["place"])] == sorted(r["bits"] for r in found)


def test_race_without_a_move_is_not_confirmed():
    judged = []

    def judge(keys, first, last):
        judged.append((first, last))
        return np.tile((keys != np.arange(25)).sum(axis=1, keepdims=True).astype(float), last - first)

    key, about = decoding.race_polish(np.arange(25), judge)
    assert (key == np.arange(25)).all() and about["moves"] == 0 and not about["accepted"] and about["draws"] == judged[-1][1] + 64
    assert all(last - first < 64 for first, last in judged)
