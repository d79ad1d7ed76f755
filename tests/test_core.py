"""The engine's own operators: statements on both engines, literal cases, brute force, round trips."""

import itertools
import math
import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from scriptorium import queries
from scriptorium.functions.normalize import fold_text, normalization_counts, normalized
from scriptorium.operators import heads, noise, search
from scriptorium.sources import files, ivtff
from scriptorium.streaming import examples

SMALL = "/root/testdata/sf0.001"
TOKENS = "transcription string, page_id long, hand string, lang string, illus string, par int, line int, idx int, word string, len int, pos string, uncertain boolean, at string, spot int"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def _shape(rows, columns):
    show = lambda v: repr(round(v, 5) + 0.0) if isinstance(v, float) else f"{type(v).__name__}{v}"
    return sorted(tuple(show(r[columns.index(c)]) for c in sorted(columns)) for r in rows)


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_statement_on_both_engines(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    other = duck.execute(queries.ORACLE[name])
    columns = [x[0] for x in other.description]
    assert sorted(df.columns) == sorted(columns)
    mine, theirs = _shape([tuple(r) for r in df.collect()], df.columns), _shape(other.fetchall(), columns)
    assert mine == theirs


def tokens(spark, rows):
    """rows: (transcription, page, hand, line, idx, word)"""
    return spark.createDataFrame([(t, p, h, "A", "T", 1, ln, i, w, len(w or ""), "mid", "?" in (w or ""), "x", 0) for t, p, h, ln, i, w in rows], TOKENS)


def some_tokens(seed=0, n=600):
    rng = np.random.default_rng(seed)
    words = ["ol", "chol", "daiin", "qokeey", "shedy", "otal", "aiin"]
    return [("t", 1 + k // 100, str(1 + k // 300), k % 100 // 10, k % 10, words[rng.integers(len(words))]) for k in range(n)]


def test_doubling_table_brute_force(spark):
    rows = some_tokens()
    got = {r["hand"]: r for r in queries.operator(spark, "op109_doubling_table", folio_tokens=tokens(spark, rows + rows[:5])).collect()}
    for hand in ("1", "2"):
        mine = [r for r in rows if r[2] == hand]
        pairs = [(a[5], b[5]) for a, b in itertools.pairwise(mine) if a[1] == b[1] and a[3] == b[3]]
        k, n, c = sum(a == b for a, b in pairs), len(pairs), Counter(r[5] for r in mine)
        chance = sum(v * (v - 1) for v in c.values()) / (len(mine) * (len(mine) - 1))
        p, z = k / n, 1.96
        low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        assert (got[hand]["pairs"], got[hand]["doubles"]) == (n, k)
        assert got[hand]["chance_per_1000"] == pytest.approx(1000 * chance, abs=1e-5) and got[hand]["low"] == pytest.approx(1000 * low, abs=1e-5)


def test_stream_metrics_brute_force(spark):
    rows = some_tokens(1, 300)
    got = queries.operator(spark, "op106_stream_metrics", folio_tokens=tokens(spark, rows)).first()
    words = [r[5] for r in rows]
    text, h = " ".join(words), lambda c: -sum(v / c.total() * math.log2(v / c.total()) for v in c.values())
    types = Counter(words)
    ranks = np.log(np.arange(1, len(types) + 1))
    slope = np.polyfit(ranks, np.log(sorted(types.values(), reverse=True)), 1)[0]
    assert got["h1_bits"] == pytest.approx(h(Counter(text)), abs=2e-3)
    assert got["h2_bits"] == pytest.approx(h(Counter(itertools.pairwise(text))) - h(Counter(text)), abs=5e-3)
    assert got["zipf_slope"] == pytest.approx(slope, abs=1e-5)
    assert got["doubling_per_1000"] == pytest.approx(1000 * sum(a == b for a, b in itertools.pairwise(words)) / (len(words) - 1), abs=1e-5)


def test_cipher_baseline_brute_force(spark):
    rows = some_tokens(2, 400)
    got = queries.operator(spark, "op104_cipher_baselines", folio_tokens=tokens(spark, rows)).first()
    sym = [r[5][0] for r in rows]
    train, test, v = sym[:200], sym[200:], len(set(sym))
    uni, two = Counter(train), defaultdict(Counter)
    for a, b in itertools.pairwise(train):
        two[a][b] += 1
    total = 0.0
    for a, b in itertools.pairwise(test):
        p0 = (uni[b] + 0.5) / (len(train) + 0.5 * v)
        n = two[a].total()
        total -= math.log2(n / (n + v) * two[a][b] / n + v / (n + v) * p0 if n else p0)
    assert got["heldout_bits"] == pytest.approx(total / (len(test) - 1), abs=1e-5)


def test_auroc_brute_force(spark):
    cells = spark.read.parquet(f"{SMALL}/score_cells.parquet")
    best = {}
    for r in cells.where("total_per_all_symbols is not null").collect():
        key = (r["instance"], r["presentation"], r["head"], r["hypothesis"], r["window_len"])
        if key not in best or (r["loaded_at"], r["cell_id"]) > (best[key]["loaded_at"], best[key]["cell_id"]):
            best[key] = r
    pos = [r["structure_margin"] for r in best.values() if r["instance"].startswith("positive") and r["structure_margin"] is not None]
    neg = [r["structure_margin"] for r in best.values() if not r["instance"].startswith("positive") and r["structure_margin"] is not None]
    want = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert queries.operator(spark, "op161_auroc", score_cells=cells).first()["auroc"] == pytest.approx(want, abs=1e-5)


def test_statements_on_empty_and_null_tables(spark):
    rows = [(None, None, None, None, None, None), ("t", 1, None, 1, 0, "?"), ("t", 1, None, 1, 1, None)]
    pages = spark.read.parquet(f"{SMALL}/folio_pages.parquet").limit(0)
    for name in ("op109_doubling_table", "op106_stream_metrics", "op117_length_summary", "op122_gap_statistics", "op163_variance_shares", "op055_page_attributes"):
        for table in (tokens(spark, rows), tokens(spark, [])):
            assert len(queries.operator(spark, name, folio_tokens=table, folio_pages=pages).collect()) <= 1


# ---- normaliser, literal cases
@pytest.mark.parametrize(
    "text, letters",
    [("Arma VIRUMQUE cano", "armavirumquecano"), ("u v\tx\ny z", "uvxyz"), ("Major Julius", "maioriulius"), ("Größe, Würde", "grossewurde"), ("præmium cœlum", "praemiumcoelum"), ("città più perché", "cittapiuperche"), ("fol. 37, l. IX: λόγος", "follix"), ("", "")],
)
def test_normalize_literals(text, letters):
    assert fold_text(text)[0] == letters and fold_text(letters)[0] == letters


def test_normalize_counts(spark):
    c = fold_text("fol. 37, l. IX: δεκα")[1]
    assert (c["foreign"], c["punct_digit"], c["dropped"]) == (4, 6, 0)
    c = fold_text("xyz δε ƕ")[1]
    assert (c["kept"], c["dropped"], c["foreign"]) == (3, 1, 2)
    assert fold_text("ß")[1]["kept"] == 2
    df = spark.createDataFrame([(1, "Straße"), (2, None)], "k int, text string")
    got = {r["k"]: (r["n"], r["c"]["kept"]) for r in df.select("k", normalized("text").alias("n"), normalization_counts("text").alias("c")).collect()}
    assert got == {1: ("strasse", 7), 2: (None, 0)}


# ---- scans
def test_ivtff_round_trip(spark):
    toks, pages = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("folio_tokens", "folio_pages"))
    got = ivtff.tokens(ivtff.parse(ivtff.rendered(toks, pages))).where("not uncertain")
    want = toks.where("word rlike '^[a-z]+$'").select("transcription", "page_id", "line", "idx", "word").distinct()
    assert got.groupBy("file").count().withColumnRenamed("file", "transcription").exceptAll(want.groupBy("transcription").count()).count() == 0
    pars = ivtff.paragraphs(ivtff.parse(ivtff.rendered(toks, pages))).select("file", "par").distinct().count()
    assert pars == toks.select("transcription", "page_id", "par").distinct().count()


def test_ivtff_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# note\n<f1r.0,@P0> lost\n<f1r> <! $L=A $H=1>\n\n<f1r.1,@P0> fa.[ch:sh]o.k@130;y?\n<f1v> <! $H=2>\n<f1v.1,@P0> d<!x>a.iin=\n")
    got = [(r["page"], r["lang"], r["hand"], r["text"]) for r in ivtff.parse(ivtff.read_lines(spark, str(tmp_path))).orderBy("line_no").collect()]
    assert got == [("f1r", "A", "1", "fa.cho.ky?"), ("f1v", None, "2", "da.iin=")]


def test_file_scans(spark, tmp_path):
    (tmp_path / "la" / "dom").mkdir(parents=True)
    (tmp_path / "la" / "dom" / "Some Work!.csv").write_text('id,textstring\n1,"first, line"\n2,second\n')
    found = files.discover(spark, str(tmp_path), spark.createDataFrame([("dom", "CC0")], "domain string, license string")).collect()
    assert [(r["language"], r["domain"], r["doc_id"], r["license"]) for r in found] == [("la", "dom", "dom_some_20work_csv" if "%20" in found[0]["path"] else "dom_some_work_csv", "CC0")]
    assert files.csv_corpus(spark, str(tmp_path)).first()["text"] == "first, line\nsecond"
    wide = spark.createDataFrame([("f1", 1, 1, "ab", "$", " ", "c?")], "folio string, par int, line int, t1 string, t2 string, t3 string, t4 string")
    assert [(r["word"], r["uncertain"]) for r in files.wide_tokens(wide).orderBy("idx").collect()] == [("ab", False), ("c?", True)]
    table = spark.createDataFrame([("b", c, ch, f"w{c}{i % 3}") for c in (1, 2) for i, ch in enumerate("abcdefghiklmnopqrstuvwxy")], "book string, column int, letter string, word string")
    assert files.word_tables(table).count() == 6
    with pytest.raises(Exception):
        files.word_tables(table.where("letter <> 'a'")).collect()


# ---- searches and dynamic programs
@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    table = rng.dirichlet(np.full(25, 0.06), size=25)
    stream, at = [], 0
    for _ in range(30_000):
        at = rng.choice(25, p=table[at])
        stream.append(at)
    stream = np.array(stream)
    t3 = np.full((25, 25, 25), 0.01)
    np.add.at(t3, (stream[:-2], stream[1:-1], stream[2:]), 1)
    p3 = np.log(t3 / t3.sum(-1, keepdims=True))
    t2 = t3.sum(0)
    return stream, (np.log((np.bincount(stream, minlength=25) + 1) / (len(stream) + 25)), np.log(t2 / t2.sum(-1, keepdims=True)), p3)


def test_substitution_recovery(model):
    stream, lm = model
    plain, perm = stream[1000:1900], np.random.default_rng(1).permutation(25)
    key, _ = search.solve_substitution(perm[plain], lm, 0, kicks=4)
    assert (key[perm[plain]] == plain).mean() > 0.9


def test_homophonic_recovery_on_real_letters(spark):
    folder = "/root/testdata/sf0.01"
    from scriptorium.plans import rows_only

    lm = search.dense_model(rows_only._counts(spark, folder))["italian"]
    texts = rows_only._rel(spark, folder, "SELECT s FROM parted WHERE part = 'heldout' AND lang = 'italian' AND length(s) > 1500").limit(2).collect()
    rates = []
    for text in texts:
        plain, rng = search.encode(text["s"]), np.random.default_rng(2)
        symbols = plain * 2 + rng.integers(0, 2, len(plain))
        key, _ = search.solve_homophonic(symbols, 50, lm, 0)
        rates.append((key[symbols] == plain).mean())
    assert min(rates) > 0.9
    plain = search.encode(texts[0]["s"])
    tokens, truth, pair = heads.mixed_tokens(plain, np.random.default_rng(1))
    key, read, _ = heads.solve_mixed(tokens, 75, lm, 0)
    used = np.bincount(tokens[tokens >= 0], minlength=75)
    assert (used @ (key == truth)) / used.sum() > 0.9 and (read == pair).mean() > 0.97
    stream, values, order = heads.sum_stream(plain[:700], np.random.default_rng(1))
    got = heads.solve_sums(stream, lm, 0, splits=(2,))
    assert (got["order"] == order).all() and (got["values"] == values).all()
    assert search.edit_distance(got["letters"], plain[:700]) / 700 < 0.35


def test_linear_order_brute_force():
    import itertools

    for seed in range(5):
        w = np.random.default_rng(seed).normal(size=(6, 6))
        value = lambda p: sum(w[a, b] for a, b in itertools.combinations(p, 2))  # noqa: E731, B023
        assert np.isclose(value(heads.linear_order(w)), max(map(value, itertools.permutations(range(6)))))


def test_edit_distance():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(0, 3, rng.integers(0, 12)), rng.integers(0, 3, rng.integers(0, 12))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(old[j - 1] + (x != y), old[j] + 1, row[-1] + 1))
        assert search.edit_distance(a, b) == row[-1]


def test_repeat_rule_and_alternation():
    ids = np.array([0, 1, 1, 2, 0])
    assert search.repeat_rule(ids)(np.array([3, 3, 4])) == -4.0
    trace = []
    key, best = search.alternate(np.array([0]), lambda k, r: k + r, lambda k: k, lambda k: float(k[0]), 4, lambda *x: trace.append(x))
    assert best == 6.0 and len(trace) == 4 and search.bonferroni_z(0.05, 1) == pytest.approx(1.6449, abs=1e-4)


def test_segment_viterbi_brute_force():
    rng = np.random.default_rng(3)
    small = tuple(rng.normal(size=(25,) * k) for k in (1, 2, 3))
    tokens_ = [(rng.normal(size=25) * 3, rng.normal(size=(25, 25)) * 3) for _ in range(2)]
    best = -1e9
    single, double = [t[0] for t in tokens_], [t[1] for t in tokens_]
    start = small[0][:, None] + small[1]
    for kinds in itertools.product((1, 2), repeat=2):
        score = start
        for s, d, kind in zip(single, double, kinds):
            step = (score[:, :, None] + small[2]).max(0)
            score = step + s[None, :] if kind == 1 else (step[:, :, None] + small[2]).max(0) + d
        best = max(best, score.max())
    value, letters = search.segment_viterbi(tokens_, small)
    assert value == pytest.approx(best) and 2 <= len(letters) <= 4


def test_lattice_and_soft_score_brute_force():
    rng = np.random.default_rng(5)
    lm = tuple(rng.normal(size=(25,) * k) for k in (1, 2, 3))
    emissions = {1: rng.normal(size=(4, 25)), 3: rng.normal(size=(4, 25))}

    def best(pos, score):
        if pos == 4:
            return score.max()
        step = (score[:, :, None] + lm[2]).max(0)
        return max(best(pos + n, step + e[pos][None, :]) for n, e in emissions.items() if pos + n <= 4)

    value, cut = search.lattice_viterbi(emissions, lm)
    assert value == pytest.approx(best(0, lm[0][:, None] + lm[1])) and sum(n for n, _ in cut) == 4
    assert search.lattice_viterbi({3: emissions[3]}, lm) == (float("-inf"), [])
    ids = rng.integers(0, 25, 200)
    assert search.soft_score(np.eye(25)[ids], lm) == pytest.approx(search._Trigrams(ids, 25).score(np.arange(25), lm))
    frame = search.null_frame(np.eye(25)[[1, 2]], np.eye(25)[[3, 4]], np.array([0.25, 1.0]))
    assert frame.shape == (4, 26) and np.allclose(frame.sum(1), 1) and frame[1, 25] == 0.25 and frame[3, 25] == 1.0


def test_lexical_coverage_and_fitting():
    assert search.lexical_coverage("abcdexfghij", {"abcde", "fghij", "bcdexf"}) == 10 / 11
    assert search.lexical_coverage("", {"abcd"}) == 0.0
    n = np.random.default_rng(4).integers(1, 50, (3, 4, 4)).astype(float)
    m = search.fit_no_three_way(n)
    assert all(np.allclose(m.sum(a), n.sum(a), atol=1e-6) for a in range(3))


# ---- noise and streams
@pytest.mark.parametrize("family, low, high", [("substitution", 0.1, 0.3), ("transcription", 0.1, 0.25), ("segmentation", 0.0, 1.0)])
def test_noise_rates(family, low, high):
    ids = np.random.default_rng(5).integers(0, 25, 20_000)
    got = noise.NOISES[family](ids, 0.2, np.random.default_rng(6))
    if family == "substitution":
        assert low < (got != ids).mean() < high
    assert abs(len(got) - len(ids)) < 0.1 * len(ids) and got.min() >= 0 and got.max() < 25
    assert np.array_equal(noise.NOISES[family](ids, 0.0, np.random.default_rng(6)), ids)
    assert noise.token_lengths(777, np.random.default_rng(7)).sum() == 777


def test_noise_frames(spark):
    df = spark.createDataFrame([(1, "abcabc" * 20, "x", "latin"), (2, "", "x", "french"), (3, None, "x", None)], "doc_id long, s string, kind string, lang string")
    assert {r["doc_id"] for r in noise.noise_mixture(df).collect()} == {1, 2, 3}
    assert sorted(noise.noised(df, "substitution", 0.3).collect()) == sorted(noise.noised(df.repartition(3), "substitution", 0.3).collect())
    controls = {(r["control"], r["doc_id"]): r for r in noise.control_battery(df).collect()}
    assert len(controls) == 12 and controls["contamination", 2]["truth"] == "" and ("positive", 1) in controls
    made = controls["codex_like", 1]["text"]
    assert 240 <= len(made) <= 360 and len(set(made)) <= 14


def test_example_stream(spark, tmp_path):
    plain = [(i, lang, "abcdefghiklmnop"[i : i + 10] * size) for i, size in enumerate((30, 3, 60, 0)) for lang in ("latin", "german")]
    texts, line = examples.placed_texts(spark.createDataFrame(plain, "doc_id long, lang string, s string"), 2)
    numbers = spark.range(3000).withColumnRenamed("id", "value")
    fixed = examples.examples(numbers, texts, line, 100).collect()
    by = {(i, lang): s for i, lang, s in plain}
    for r in fixed:
        whole = by[r["doc_id"], r["lang"]]
        whole = whole if len(whole) > 100 else whole * 20
        assert r["s"] == whole[r["start"] : r["start"] + 100] and all(m in ("_", c) for m, c in zip(r["masked"], r["s"]))
    drawn = [sum(r["doc_id"] == i for r in fixed) / 3000 for i in range(4)]
    assert len(fixed) == 3000 and all(abs(x - y / 93) < 0.03 for x, y in zip(drawn, (30, 3, 60, 0)))
    assert len({r["start"] for r in fixed if r["doc_id"] == 0}) > 150  # anywhere, not on tiles
    numbers.where("value < 50").write.parquet(f"{tmp_path}/numbers")
    stream = spark.readStream.schema("value long").parquet(f"{tmp_path}/numbers")
    got = examples.drained(examples.examples(stream, texts, line, 100), "stream").collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in fixed if r["value"] < 50)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE and n not in ("op213_substitution_search", "op214_homophonic_search", "op217_word_homophonic_search", "op215_mixed_search", "op216_sum_search")])
def test_rows_only_queries(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0
