"""Each operator against brute force on small inputs, and its defined results on awkward ones."""

import itertools
import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import cross_split, group_pairs, grouped_splits, languages, mixing, packing, queries, repeated_lines, shared_spans, texthash

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, lang string, n_tokens long, h string, class int, pos string, key string"


def docs(spark, rows):
    """rows: (doc_id, text, source, lang, n_tokens); the other columns clash with names used inside."""
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], DOCS)


AWKWARD = [(1, None, "a", None, None), (2, "", "a", "", None), (3, " \n\n", None, "la", 0), (4, "x" * 200_000, "b", "xx", None), (5, "x" * 200_000, "b", "de", None), (5, "x" * 200_000, "b", "de", None), (None, "lost row", "b", "fr", 2)]


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_every_query_runs(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    assert len(df.collect()) > 0 and len(set(df.columns)) == len(df.columns)


# ---- 1
@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=6), min_size=1, max_size=6), st.integers(2, 3))
def test_block_depths(seqs, least):
    lines = np.array([x for s in seqs for x in s], np.int64)
    doc = np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
    want = []
    for s in seqs:
        for p in range(len(s)):
            spans = [m for m in range(1, len(s) - p + 1) if sum(any(t[q : q + m] == s[p : p + m] for q in range(len(t))) for t in seqs) >= least]
            want.append(max(spans, default=0))
    assert repeated_lines.block_depths(lines, doc, least).tolist() == want


@pytest.mark.parametrize("listed", [1_000_000, 0])
def test_repeated_lines_brute_force(spark, monkeypatch, listed):
    monkeypatch.setattr(repeated_lines, "SHARD_LINES", 60)
    monkeypatch.setattr(repeated_lines, "BROADCAST_LINES", listed)
    rng, rows = random.Random(1), []
    for i in range(120):
        source = rng.choice("aab")
        lines = [f"unique text number {i} {k} of this very document {rng.random()}" for k in range(3)]
        lines.insert(rng.randrange(4), f"* Share this fine PAGE with Friends {i}!" if rng.random() < 0.2 else "")
        lines.insert(0, "too short 5")
        rows.append((i, "\n".join(lines), source, "la", None))
    of = {s: sum(r[2] == s for r in rows) for s in "ab"}
    key = lambda x: " ".join("0" if t[0].isdigit() else t for t in re.findall(r"[^\W\d_]+|\d+", x.lower()))
    where: dict = {}
    for i, text, source, *_ in rows:
        for n, line in enumerate(text.split("\n"), 1):
            if sum(not t[0].isdigit() for t in key(line).split()) >= 5:
                where.setdefault((source, key(line)), []).append((i, n))
    want = {x for (s, _), at in where.items() if len({i for i, _ in at}) >= max(4, 0.15 * of[s]) for x in at}
    assert want and {tuple(r) for r in repeated_lines.repeated_lines(docs(spark, rows)).collect()} == want
    clean = {r["doc_id"]: r for r in repeated_lines.without_repeated_lines(docs(spark, rows)).collect()}
    for i, text, *_ in rows:
        kept = [x for n, x in enumerate(text.split("\n"), 1) if (i, n) not in want]
        assert clean[i]["text"] == "\n".join(kept)


def test_repeated_lines_awkward(spark):
    assert repeated_lines.repeated_lines(docs(spark, AWKWARD)).count() == 0
    assert repeated_lines.repeated_lines(docs(spark, [])).count() == 0
    out = {r["doc_id"]: r["text"] for r in repeated_lines.without_repeated_lines(docs(spark, AWKWARD)).collect()}
    assert out[1] is None and out[2] == "" and out[3] == " \n\n"


# ---- 2
def test_components_brute_force(spark, monkeypatch):
    monkeypatch.setattr(grouped_splits, "SMALL_EDGES", 20)
    rng = random.Random(3)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 260)] + [(7, 7)] + [(500, 501 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups: dict = {}
    for x in parent:
        groups.setdefault(find(x), set()).add(x)
    got: dict = {}
    for r in grouped_splits.frontier_components(spark.createDataFrame(edges, "u long, v long")).collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


FORMS = [(7, "Carolus", "Carlo", "Karl", "Charles"), (9, "Matthaeus", "Matteo", "Matthäus", "Matthieu")]


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_splits_do_not_depend_on_the_bound(spark, monkeypatch, table):
    read = lambda t: spark.read.parquet(f"/root/testdata/{table}/{t}.parquet")
    out = []
    for bound in (0, 10**9):
        monkeypatch.setattr(grouped_splits, "SMALL_EDGES", bound)
        out.append(sorted(tuple(r) for r in grouped_splits.grouped_splits(read("doc_records"), read("forename_forms")).collect()))
    assert out[0] == out[1]


@pytest.mark.parametrize("block", [1, 3, 100])
def test_pairs_within(spark, block):
    members = [(g, x) for g in range(4) for x in random.Random(g).sample(range(50), 6 * g)]
    want = {(g, min(x, y), max(x, y)) for (g, x), (h, y) in itertools.product(members, members) if g == h and x != y}
    df = spark.createDataFrame(members, "g int, m int")
    got = group_pairs.pairs_within(df, "g", "m", block).collect()
    assert sorted(tuple(r) for r in got) == sorted((a, b) for _, a, b in want)


def test_path_keys():
    forms = {w: n for n, *names in FORMS for name in names for w in grouped_splits._words(name)}
    same = ["raw/latin/Rüvo-Karl--De-hortis-X--vol2.txt", "external/s/corpora/it/ruevo_carlo/De_hortis_X_tom_II_firstpass.csv", "https://s.example/fr/CHARLES+RÜVO/de%20hortis%20x?bd=1", "D:\\s\\latin\\De hortis X [Ruvo, Carolus]\\pars1_lat1.csv"]
    keys = {grouped_splits.path_keys(p, forms) for p in same}
    assert len(keys) == 1 and None not in keys.pop()
    assert grouped_splits.path_keys("legacy/latin/De_hortis_X/De_hortis_X_v0.csv", forms)[0] is None
    for unknown in ("N.N.", "incerti_auctoris", "_", "Ignoto"):
        assert grouped_splits.path_keys(f"raw/latin/{unknown}--Opera.txt", forms) == (None, None)
    assert grouped_splits.path_keys(None, forms) == (None, None)


def records(spark, rows):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id string, source_path string, language string, document_id long, grp string, author int")


def test_grouped_splits(spark):
    forms = spark.createDataFrame(FORMS, "name_id int, latin string, italian string, german string, french string")
    rows = [(f"r{i:03d}", f"raw/latin/S{'abcdefghij'[i % 10]}xo-Karl--Liber-{i}q.txt", random.Random(i).choice(["latin", "Latin ", None, "deutsch"]), i) for i in range(300)]
    rows += [("x1", None, None, 1000), ("x1", None, None, 1000), (None, "raw/latin/A-B--C.txt", "latin", 5), ("x2", "raw/latin/Saxo-Carlo--Prose.txt", "latin", 1001)]
    out = grouped_splits.grouped_splits(records(spark, rows), forms).collect()
    assert len(out) == 302
    by: dict = {}
    for r in out:
        by.setdefault(r["component"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by.values()) and len(by) == 11
    pairs = grouped_splits.tied_pairs(records(spark, rows), forms).collect()
    assert len(pairs) == 9 * (30 * 29 // 2) + 31 * 30 // 2 and all(r["doc_a"] < r["doc_b"] for r in pairs)
    assert grouped_splits.tied_pairs(records(spark, []), forms).count() == 0
    assert grouped_splits.grouped_splits(records(spark, []), forms).count() == 0


# ---- 3
def plain_words(text):
    return re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower())


def grams(text):
    w = plain_words(text)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 20 else set()


def split_tables(spark, texts, splits):
    d = docs(spark, [(i, t, "s", "la", None) for i, t in enumerate(texts)])
    r = spark.createDataFrame([(f"r{i}", i, "x") for i in range(len(texts))], "doc_id string, document_id long, class string")
    m = spark.createDataFrame([(v, s, f"r{i}", "y") for i, v, s in splits], "splits_version string, split string, doc_id string, side string")
    return m, r, d


def edited(words, rng, k):
    out = list(words)
    for _ in range(k):
        p = rng.randrange(len(out))
        out[p : p + 1] = rng.choice([[], [out[p], "inserted"], ["Chänged"]])
    return out


@pytest.mark.parametrize("hot, bits", [(50_000, 22), (2, 8), (10**9, 17)])
def test_cross_split_brute_force(spark, monkeypatch, hot, bits):
    monkeypatch.setattr(cross_split, "HOT", hot)
    monkeypatch.setattr(cross_split, "CELL_BITS", bits)
    monkeypatch.setattr(cross_split, "PAIRS", 50)
    rng, texts = random.Random(5), []
    vocabulary = [f"w{i}" for i in range(400)]
    notice = "this site kindly asks all readers to share and cite the whole page with care".split()
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 22, 60, 300]))]
        for k in (0, 1, max(1, len(base) // 14), max(1, len(base) // 9)):
            texts.append(" ".join((notice if rng.random() < 0.5 else []) + edited(base, rng, k)))
    texts += [None, "", "Ünïcode ǆ " * 30, "unicode dz " * 30]
    splits = [(i, "v1", rng.choice(["train", "Training", "HELDOUT", "validation", "nonsense"])) for i in range(len(texts))] + [(0, "v1", "train"), (0, "v1", "held-out"), (1, None, "train"), (0, "v1", "train")]
    side = lambda s: {"train": "t", "training": "t", "heldout": "e", "held-out": "e", "validation": "e"}.get(s.lower())
    g, want = [grams(t or "") for t in texts], set()
    for (i, v, s), (j, w, t) in itertools.product(splits, splits):
        if v and v == w and side(s) == "t" and side(t) == "e":
            a, b = sorted((f"r{i}", f"r{j}"))
            if i == j or (g[i] and g[j] and 2 * len(g[i] & g[j]) >= len(g[i] | g[j])):
                want.add((v, a, b))
    tables = split_tables(spark, texts, splits)
    assert {tuple(r) for r in cross_split.overlapping_pairs(*tables).collect()} == want and len(want) > 10
    assert sum(r["n_pairs"] for r in cross_split.overlap_report(*tables).collect()) >= len(want)


def test_cross_split_large_group_at_two_levels(spark):
    base = [f"g{i}" for i in range(97)]
    long = [[*base, *(f"long{i}x{k}" for k in range(3))] for i in range(60)]
    short = [[*base[:96], f"short{i}"] for i in range(60)]
    short += [[f"edit{i}x{k}" if k % 10 == i else w for k, w in enumerate(base)] for i in range(10)]
    assert {len(x) - 4 for x in long} == {96} and {len(x) - 4 for x in short} == {93}
    texts = [" ".join(x) for x in long + short]
    splits = [(i, "v1", "heldout" if i < 8 or i >= 120 else "train") for i in range(len(texts))]
    g = [grams(t) for t in texts]
    evals, trains = [[i for i, _, s in splits if s == side] for side in ("heldout", "train")]
    pairs = [(i, j) for i in evals for j in trains if 2 * len(g[i] & g[j]) >= len(g[i] | g[j])]
    assert len({i for i, _ in pairs if i >= 120}) == 10
    want = {("v1", *sorted((f"r{i}", f"r{j}"))) for i, j in pairs}
    assert {tuple(r) for r in cross_split.overlapping_pairs(*split_tables(spark, texts, splits)).collect()} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=9), st.lists(st.integers(0, 3), max_size=9)), min_size=1, max_size=8), st.integers(0, 4))
def test_banded_distances(pairs, edits):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(old[j - 1] + (x != y), old[j] + 1, row[-1] + 1))
        return min(row[-1], edits + 1)

    got = cross_split.banded_distances([np.array(a, np.int64) for a, _ in pairs], [np.array(b, np.int64) for _, b in pairs], edits)
    assert got.tolist() == [distance(a, b) for a, b in pairs]


@pytest.mark.parametrize("edits", [3, 6])
def test_edited_pairs_brute_force(spark, edits):
    rng, texts = random.Random(15), []
    for _ in range(25):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([19, 20, 23, 60, 200]))]
        texts += [" ".join(edited(base, rng, k)) for k in (0, 0, 1, 2, 3, 4, 5, 6, 8)]
    splits = [(i, "v1", "train" if rng.random() < 0.6 else "dev") for i in range(len(texts))]
    words = [plain_words(t) for t in texts]
    want = set()
    for (i, _, s), (j, _, t) in itertools.product(splits, splits):
        if s == "train" and t == "dev" and min(len(words[i]), len(words[j])) >= 20 and abs(len(words[i]) - len(words[j])) <= edits:
            d = cross_split.banded_distances([np.array([hash(w) for w in words[i]])], [np.array([hash(w) for w in words[j]])], edits)[0]
            if d <= edits:
                want.add((f"r{i}", f"r{j}", int(d)))
    got = cross_split.edited_pairs(*split_tables(spark, texts, splits), edits).select("train_doc", "eval_doc", "edits").collect()
    assert {tuple(r) for r in got} == want and len(want) > 50


def test_cross_split_repeated_ids(spark):
    words = [" ".join(f"{x}{i}" for i in range(60)) for x in "ab"]
    m, r, d = split_tables(spark, [words[0], words[0], words[1], words[1]], [(0, "v1", "train"), (1, "v1", "dev"), (2, "v1", "train"), (3, "v1", "dev")])
    d = d.unionByName(d).unionByName(docs(spark, [(3, words[0], "s", "la", None)]))  # rows repeated, and one id with two texts
    got = {tuple(x) for x in cross_split.overlapping_pairs(m, r, d).collect()}
    assert got == {("v1", "r0", "r1"), ("v1", "r2", "r3"), ("v1", "r0", "r3")}


def test_cross_split_empty(spark):
    assert cross_split.overlapping_pairs(*split_tables(spark, ["a"], [])).count() == 0
    m, r, d = split_tables(spark, ["a"], [(0, "v1", "train")])
    assert cross_split.overlapping_pairs(m, r, d.limit(0)).count() == 0


# ---- 4
WORDS = {"latin": "et in est non qui quae cum sed aquarum silvarum portabat laudavit", "italian": "che della gli sono questo anche perche mangiava cantavano bella", "german": "der die das und nicht ist mit wald schreibt guten schlafend", "french": "les des que dans est une pour avec chantait jardin maison"}


def speak(language, n, seed):
    return " ".join(random.Random(seed).choices(WORDS[language].split(), k=n))


def test_languages(spark):
    rows = [(i, "\n".join(speak(x, 14, 7 * i + k) for k in range(6)), "site_one", x, None) for i, x in enumerate(list(WORDS) * 30)]
    mixed = "\n".join([speak("latin", 14, 1000 + k) for k in range(5)] + ["Page 3 of 9 - back to the list of works of this site", "Kindly cite all of this from site_one always", speak("french", 14, 2000)])
    mixed = mixed.replace("Page 3 of 9", "§ Blaadje 3 van 9")  # any word, any short word between
    rows += [(900, mixed, "site_one", "la", None), (901, rows[0][1], "site_one", "DE", None), (902, rows[1][1], "site_one", None, None), (903, "et in", "site_one", None, None), *AWKWARD]
    got = {tuple(r) for r in languages.language_cases(docs(spark, rows)).collect()}
    assert {(900, 8, "french"), (901, 0, "latin"), (902, 0, "italian")} <= got
    assert not any(r[0] in (1, 2, 3, 903) for r in got) and not any(r[0] < 120 and r[0] > 5 for r in got)
    assert not any(r[:2] in ((900, 0), (900, 6), (900, 7)) for r in got)
    assert languages.language_cases(docs(spark, [])).count() == 0


def test_language_accuracy_on_held_out_rows(spark):
    out = languages.languages(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("line_no = 0 and label is not null").collect()
    assert sum(r["label"] == r["language"] for r in out) / len(out) > 0.93  # about one label in twenty is wrong


def test_names_of_sites_in_lines():
    text = ["kindly cite the İmages of Site One\nsite oneness is no name\nfrom SITE_ONE too\nand site\none", "a MÜHLE\nmühlen"]
    c, line, *_ = languages._lines_of(text)
    hashes = [languages._joined(r, len(r))[0] for r in (languages._runs(texthash.points(x))[1] for x in ("site_one", "Mühle"))]
    names = languages._Names(np.array(hashes, np.uint64).view(np.int64), [1, 2])
    assert sorted(names.hits(c, line)[0].tolist()) == [0, 2, 5]


def test_languages_do_not_depend_on_the_number_of_names(spark, monkeypatch):
    documents, out = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []
    for bound, bits in ((10**9, 28), (0, 28), (0, 4)):
        monkeypatch.setattr(languages, "MOST_NAMES", bound)
        monkeypatch.setattr(languages, "BITMAP_BITS", bits)
        out.append(sorted(tuple(r) for r in languages.languages(documents).collect()))
    assert out[0] == out[1] == out[2] and len(out[0]) > 90


# ---- 5
@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(0, 5)), max_size=40))
def test_best_fit(items):
    sizes, clusters = [s for s, _ in items], [c for _, c in items]
    boxes = packing.best_fit(sizes, ["s"] * len(items), clusters, 50)
    for b in set(boxes.tolist()):
        inside = [k for k in range(len(items)) if boxes[k] == b]
        assert sum(sizes[k] for k in inside) <= 50 and len({clusters[k] for k in inside}) == len(inside)


@pytest.mark.parametrize("shard", [20_000, 30])
def test_packing(spark, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD_ITEMS", shard)
    rng = random.Random(2)
    rows = [(i, " ".join(f"{rng.choice('abcdef')}{i}" for _ in range(rng.randrange(1, 40))), "s", "la", None) for i in range(150)] + [(700, rng.choice("ab") * 4, "s", "la", None), (701, "same text", "s", "la", None), (702, "Same  TEXT!", "s", "la", None)]
    kinds = spark.createDataFrame([("small", 16), ("none", None), ("zero", 0), ("large", 64)], "container_kind string, capacity int")
    out = packing.packed(docs(spark, rows + AWKWARD[:3]), kinds).collect()
    sizes = {i: len(re.findall(r"\w+|[^\w\s]+", t)) for i, t, *_ in rows}
    for kind, capacity in (("small", 16), ("large", 64)):
        mine = [r for r in out if r["container_kind"] == kind]
        total, held, box = {}, {}, {}
        for r in mine:
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
            held[r["container"]] = held.get(r["container"], 0) + r["n_tokens"]
            box.setdefault(r["doc_id"], set()).add(r["container"])
        assert total == sizes and max(held.values()) <= capacity and not box[701] & box[702]
        assert all(len(box[i]) == -(-n // capacity) for i, n in sizes.items())
        assert len(held) <= 1.2 * sum(sizes.values()) / capacity + 2
    by_source: dict = {}
    for r in packing.packed(docs(spark, [(i, t, f"s{i % 3}", a, b) for i, t, _, a, b in rows]), kinds, apart_sources=True).collect():
        by_source.setdefault(r["container"], []).append(r["doc_id"] % 3)
    assert all(len(set(x)) == len(x) for x in by_source.values())
    assert packing.packed(docs(spark, []), kinds).count() == 0
    assert packing.packed(docs(spark, AWKWARD), kinds.limit(0)).count() == 0


def test_a_kind_is_packed_alike_whatever_the_others_are(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 160)
    rng = random.Random(12)
    rows = docs(spark, [(i, " ".join(["w"] * rng.randrange(1, 90)), "s", "la", None) for i in range(150)])
    kinds = [("large", 100), ("small", 3)]
    both, alone = (packing.packed(rows, spark.createDataFrame(k, "container_kind string, capacity int")).where("container_kind = 'large'").collect() for k in (kinds, kinds[:1]))
    assert sorted(map(tuple, both)) == sorted(map(tuple, alone))


# ---- 6
@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 10), st.integers(0, 30)), min_size=1, max_size=6), st.integers(0, 60))
def test_sainte_lague(entries, seats):
    weights, caps = [w for w, _ in entries], [c for _, c in entries]
    want = [0] * len(weights)
    for _ in range(min(seats, sum(caps))):
        best = max((k for k in range(len(weights)) if want[k] < caps[k]), key=lambda k: (weights[k] / (2 * want[k] + 1), -k))
        want[best] += 1
    assert sum(mixing.sainte_lague(weights, seats, caps)) == sum(want)
    assert all(abs(a - b) <= 1 for a, b in zip(mixing.sainte_lague(weights, seats, caps), want))


@pytest.mark.parametrize("tokens, group", [(2_000_000, 4096), (60, 4)])
def test_mixing(spark, monkeypatch, tokens, group):
    monkeypatch.setattr(mixing, "SHARD_TOKENS", tokens)
    monkeypatch.setattr(mixing, "GROUP_SHARDS", group)
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(5, 60)), rng.choice(["a", "a", "a", "b"]), "la", None) for i in range(400)]
    schema = "mix_name string, source string, target_share double, max_repeats int, size_ratio double"
    targets = spark.createDataFrame([("m", " A ", 0.3, 3, 1.0), ("m", "b", 0.7, 2, 1.0), ("m", "gone", 0.2, 1, 1.0), ("n", "b", 1.0, None, 3.0), ("n", None, 1.0, 1, 1.0)], schema)
    out = {(r["mix_name"], r["source"]): r for r in mixing.mix_report(docs(spark, rows), targets).collect()}
    held = {s: sum(len(r[1].split()) for r in rows if r[2] == s) for s in "ab"}
    assert out["m", "gone"]["tokens"] == 0 and out["m", "b"]["tokens"] <= 2 * held["b"] and out["m", "b"]["most_repeats"] <= 2
    slack = 30 * (1 + sum(held.values()) // tokens)  # half a document a shard
    assert abs(out["n", "b"]["tokens"] - 3 * held["b"]) <= 2 * slack
    assert abs(out["m", "a"]["tokens"] + out["m", "b"]["tokens"] - held["a"] - held["b"]) <= 4 * slack
    first = mixing.mixed(docs(spark, rows), targets).collect()
    assert sorted(first) == sorted(mixing.mixed(docs(spark, rows), targets).collect())
    assert mixing.mixed(docs(spark, []), targets).count() == 0 and mixing.mixed(docs(spark, AWKWARD), targets.limit(0)).count() == 0


# ---- 7
@pytest.mark.parametrize("many", [64, 2])
def test_shared_spans_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(shared_spans, "MANY", many)
    rng = random.Random(6)
    make = lambda n: "".join(rng.choices("abcdefghi \nü𝔘", k=n))
    pool, rows = [make(n) for n in (30, 45, 60, 61, 90, 200)], []
    for i in range(60):
        parts = [make(rng.randrange(80))] + [x for _ in range(2) for x in (rng.choice(pool)[rng.randrange(25) :], make(rng.randrange(30)))]
        rows.append((i, "".join(parts), "s", "la", None))
    rows += [(100, "-" * 500, "s", "la", None), (101, "-" * 60, "s", "la", None), (102, "-" * 59, "s", "la", None), (103, None, "s", "la", None)]
    spans = {i: {t[k : k + 60] for k in range(len(t) - 59)} for i, t, *_ in rows if t and i is not None}
    want = {(a, b) for a, b in itertools.combinations(sorted(spans), 2) if spans[a] & spans[b]}
    assert {tuple(r) for r in shared_spans.sharing_pairs(docs(spark, rows), 60, 40).collect()} == want and len(want) > 20
    shared = {r["doc_id"]: r["shared_chars"] for r in shared_spans.shared_share(docs(spark, rows), 60, 40).collect()}
    for i, t, *_ in rows:
        if i is not None and i < 100:
            cover = set()
            for k in range(len(t or "") - 59):
                if any(t[k : k + 60] in s for j, s in spans.items() if j != i):
                    cover |= set(range(k, k + 60))
            assert shared[i] == len(cover), i
    assert shared_spans.sharing_pairs(docs(spark, [])).count() == 0
    assert {tuple(r) for r in shared_spans.sharing_pairs(docs(spark, AWKWARD)).collect()} == {(4, 5)}


def test_one_notice_in_many_texts(spark, monkeypatch):
    notice = "".join(random.Random(9).choices("abcdefgh ", k=1000))
    rows = [(i, f"{notice}{i}" if i % 4 else f"text {i} {notice[:700]} {i}", "s", "la", None) for i in range(300)]
    got = shared_spans.sharing_pairs(docs(spark, rows)).collect()
    assert len(got) == len(set(got)) == 300 * 299 // 2


@pytest.mark.parametrize("step", [1, -1])
def test_common_runs(step):
    rng = random.Random(10)
    for _ in range(300):
        s, t = ("".join(rng.choices("ab", weights=(30, 1), k=rng.randrange(200))) for _ in range(2))
        i, j = rng.randrange(len(s) + 1), rng.randrange(len(t) + 1)
        n = 0
        while (i + n < len(s) and j + n < len(t) and s[i + n] == t[j + n]) if step > 0 else (n < min(i, j) and s[i - n - 1] == t[j - n - 1]):
            n += 1
        assert shared_spans._common(s, i, t, j, step) == n


def test_a_saturated_sketch_loses_nothing(spark, monkeypatch):
    rows = [(i, "".join(random.Random(i % 150).choices("abcdefghi ", k=2000)) + str(i), "s", "la", None) for i in range(180)]
    want = {(i, i + 150) for i in range(30)}
    for bits in (28, 3):
        monkeypatch.setattr(shared_spans, "MOST_CELL_BITS", bits)
        monkeypatch.setattr(shared_spans, "CHUNK_BITS", min(16, bits))
        assert {tuple(r) for r in shared_spans.sharing_pairs(docs(spark, rows)).collect()} == want


def test_pieces_of_long_texts_lose_nothing(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choices("abcd", k=5000))
    whole = {(int(p), int(h)) for _, ps, hs in shared_spans.chosen_windows([text], 60, 40) for p, h in zip(ps, hs)}
    monkeypatch.setattr(texthash, "ROUND", 500)
    monkeypatch.setattr(texthash.rounds, "__defaults__", (500, 0))
    cut = {(int(p), int(h)) for _, ps, hs in shared_spans.chosen_windows([text], 60, 40) for p, h in zip(ps, hs)}
    assert whole <= cut
