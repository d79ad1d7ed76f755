"""Tests, resampling and permutation nulls with md5 draws, and generators with md5 draws."""

from __future__ import annotations

LETTERS = "abcdefghiklmnopqrstuvwxyz"
#: Draws of a bootstrap or a permutation test; the heavier nulls over pairs of pages take fewer.
REPS, PAIR_REPS = 2000, 500


def _reps(d, n=REPS):
    return f"(SELECT CAST(j AS INTEGER) AS rep FROM (SELECT 1 AS one) z{d.each('j', '1', str(n))})"


OPS = {
    "op165_chi_square": lambda d: """WITH t AS (SELECT hand, count(*) AS n, count(*) FILTER (WHERE word = before) AS k FROM pairs WHERE hand IS NOT NULL GROUP BY hand), e AS (SELECT n, k, sum(k) OVER () / CAST(sum(n) OVER () AS DOUBLE) AS p FROM t)
        SELECT round(sum(pow(k - n * p, 2) / (n * p) + pow((n - k) - n * (1 - p), 2) / (n * (1 - p))), 6) AS chi2, CAST(count(*) - 1 AS BIGINT) AS dof, round(sqrt(sum(pow(k - n * p, 2) / (n * p) + pow((n - k) - n * (1 - p), 2) / (n * (1 - p))) / sum(n)), 6) AS cramers_v FROM e""",
    "op166_page_bootstrap": lambda d: f"""WITH p AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS k, count(*) OVER () AS m, pairs_n, doubles FROM (SELECT page_id, count(*) AS pairs_n, count(*) FILTER (WHERE word = before) AS doubles FROM pairs GROUP BY page_id) q),
        draws AS (SELECT r.rep, CAST(floor({d.u("'b'", 'CAST(r.rep AS STRING)', 'CAST(p.k AS STRING)')} * p.m) AS BIGINT) AS pick FROM p CROSS JOIN {_reps(d)} r),
        rates AS (SELECT rep, 1000e0 * sum(doubles) / sum(pairs_n) AS rate FROM draws JOIN p ON p.k = pick GROUP BY rep) SELECT round({d.quantile('rate', '0.025e0')}, 6) AS low, round({d.quantile('rate', '0.975e0')}, 6) AS high, count(*) AS draws FROM rates""",
    "op167_label_permutation": lambda d: f"""WITH p AS (SELECT page_id, n, mean_len, hand, row_number() OVER (ORDER BY page_id) AS i FROM pagelen WHERE hand IN ('1', '2')), obs AS (SELECT sum(CASE WHEN hand = '1' THEN n * mean_len END) / sum(CASE WHEN hand = '1' THEN n END) - sum(CASE WHEN hand = '2' THEN n * mean_len END) / sum(CASE WHEN hand = '2' THEN n END) AS diff FROM p),
        s AS (SELECT r.rep, p.hand, row_number() OVER (PARTITION BY r.rep ORDER BY md5(concat_ws('|', 'perm', CAST(r.rep AS STRING), CAST(p.page_id AS STRING))), p.page_id) AS i FROM p CROSS JOIN {_reps(d)} r),
        nul AS (SELECT s.rep, sum(CASE WHEN s.hand = '1' THEN p.n * p.mean_len END) / sum(CASE WHEN s.hand = '1' THEN p.n END) - sum(CASE WHEN s.hand = '2' THEN p.n * p.mean_len END) / sum(CASE WHEN s.hand = '2' THEN p.n END) AS diff FROM s JOIN p ON p.i = s.i GROUP BY s.rep)
        SELECT round(max(obs.diff), 6) AS difference, round((count(*) FILTER (WHERE round(abs(nul.diff), 9) >= round(abs(obs.diff), 9)) + 1) / (count(*) + 1e0), 6) AS p FROM nul CROSS JOIN obs""",
    "op168_divergence_test": lambda d: f"""WITH base AS (SELECT page_id, min(hand) AS hand FROM tok WHERE hand IN ('1', '2') GROUP BY page_id), feat AS (SELECT t.page_id, substr(t.word, 1, 1) AS c, count(*) AS n FROM tok t JOIN base b ON b.page_id = t.page_id GROUP BY t.page_id, substr(t.word, 1, 1)),
        a AS (SELECT page_id, hand, row_number() OVER (ORDER BY page_id) AS i FROM base), s AS (SELECT 0 AS rep, page_id, hand FROM base UNION ALL SELECT q.rep, a.page_id, q.hand FROM (SELECT r.rep, b.hand, row_number() OVER (PARTITION BY r.rep ORDER BY md5(concat_ws('|', 'jsd', CAST(r.rep AS STRING), CAST(b.page_id AS STRING))), b.page_id) AS i FROM base b CROSS JOIN {_reps(d, PAIR_REPS)} r) q JOIN a ON a.i = q.i),
        c AS (SELECT s.rep, s.hand, f.c, CAST(sum(f.n) AS DOUBLE) AS n FROM s JOIN feat f ON f.page_id = s.page_id GROUP BY s.rep, s.hand, f.c), m AS (SELECT c.*, sum(n) OVER (PARTITION BY rep, hand) AS gt, sum(n) OVER (PARTITION BY rep, c) AS ct, sum(n) OVER (PARTITION BY rep) AS t FROM c),
        j AS (SELECT rep, sum(n / t * log2((n / gt) / (ct / t))) AS jsd FROM m GROUP BY rep) SELECT round(max(CASE WHEN rep = 0 THEN jsd END), 6) AS observed, round((count(*) FILTER (WHERE rep > 0 AND round(jsd, 9) >= (SELECT round(jsd, 9) FROM j WHERE rep = 0)) + 1) / (count(*) FILTER (WHERE rep > 0) + 1e0), 6) AS p FROM j""",
    "op172_page_order_test": lambda d: f"""WITH p AS (SELECT transcription, page_id, n FROM pagelen), dt AS (SELECT s.transcription, s.word, s.page_id, s.spot - min(s.spot) OVER (PARTITION BY s.transcription, s.page_id) AS inner_spot FROM seq s JOIN freq f ON f.transcription = s.transcription AND f.word = s.word WHERE f.n = 2),
        o AS (SELECT r.rep, p.transcription, p.page_id, coalesce(sum(p.n) OVER (PARTITION BY r.rep, p.transcription ORDER BY CASE WHEN r.rep = 1 THEN '' ELSE md5(concat_ws('|', 'order', CAST(r.rep AS STRING), CAST(p.page_id AS STRING))) END, p.page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p CROSS JOIN {_reps(d, PAIR_REPS)} r),
        g AS (SELECT o.rep, d.transcription, d.word, max(o.start + d.inner_spot) - min(o.start + d.inner_spot) AS gap FROM dt d JOIN o ON o.transcription = d.transcription AND o.page_id = d.page_id GROUP BY o.rep, d.transcription, d.word), m AS (SELECT transcription, rep, avg(ln(1e0 + gap)) AS stat FROM g GROUP BY transcription, rep)
        SELECT transcription, round(max(CASE WHEN rep = 1 THEN stat END), 6) AS observed, round(avg(CASE WHEN rep > 1 THEN stat END), 6) AS null_mean, round(stddev_pop(CASE WHEN rep > 1 THEN stat END), 6) AS null_sd FROM m GROUP BY transcription""".replace("s.spot - min(s.spot) OVER (PARTITION BY s.transcription, s.page_id) AS inner_spot FROM seq s JOIN", "s.inner_spot FROM (SELECT q.*, spot - min(spot) OVER (PARTITION BY transcription, page_id) AS inner_spot FROM seq q) s JOIN"),
    "op173_leaf_tails": lambda d: f"""WITH o AS (SELECT l.relation, count(*) AS n FROM pairsrare r JOIN leaves l ON l.page_a = least(r.page_a, r.page_b) AND l.page_b = greatest(r.page_a, r.page_b) GROUP BY l.relation),
        idx AS (SELECT pg.*, row_number() OVER (PARTITION BY transcription, quire ORDER BY page_id) AS i FROM pg WHERE quire IS NOT NULL AND bifolio IS NOT NULL),
        sh AS (SELECT r.rep, x.transcription, x.quire, x.page_id, row_number() OVER (PARTITION BY r.rep, x.transcription, x.quire ORDER BY md5(concat_ws('|', 'leaf', CAST(r.rep AS STRING), CAST(x.page_id AS STRING))), x.page_id) AS i FROM idx x CROSS JOIN {_reps(d, PAIR_REPS)} r),
        mv AS (SELECT sh.rep, sh.page_id, idx.page_id AS to_page FROM sh JOIN idx ON idx.transcription = sh.transcription AND idx.quire = sh.quire AND idx.i = sh.i),
        nul AS (SELECT a.rep, l.relation, count(*) AS n FROM pairsrare r JOIN mv a ON a.page_id = r.page_a JOIN mv b ON b.page_id = r.page_b AND b.rep = a.rep JOIN leaves l ON l.page_a = least(a.to_page, b.to_page) AND l.page_b = greatest(a.to_page, b.to_page) GROUP BY a.rep, l.relation)
        SELECT o.relation, max(o.n) AS observed, round(avg(CAST(nul.n AS DOUBLE)), 6) AS null_mean, round((count(*) FILTER (WHERE nul.n >= o.n) + 1) / ({PAIR_REPS} + 1e0), 6) AS p_ge FROM o JOIN nul ON nul.relation = o.relation GROUP BY o.relation""",
    "op174_stacked_order": lambda d: "SELECT transcription, page_id, CAST(row_number() OVER (PARTITION BY transcription ORDER BY quire, bifolio, page_idx, page_id) AS BIGINT) AS place FROM pg WHERE quire IS NOT NULL AND bifolio IS NOT NULL",
    "op176_order_costs": lambda d: """WITH o AS (SELECT 'read' AS ord, p.transcription, p.page_id, coalesce(sum(p.n) OVER (PARTITION BY p.transcription ORDER BY p.page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM pagelen p UNION ALL
        SELECT 'reversed' AS ord, p.transcription, p.page_id, coalesce(sum(p.n) OVER (PARTITION BY p.transcription ORDER BY p.page_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM pagelen p), s AS (SELECT q.*, spot - min(spot) OVER (PARTITION BY transcription, page_id) AS inner_spot FROM rare q),
        d AS (SELECT o.ord, s.transcription, s.word, o.start + s.inner_spot AS place FROM s JOIN o ON o.transcription = s.transcription AND o.page_id = s.page_id), g AS (SELECT ord, transcription, word, place - lag(place) OVER (PARTITION BY ord, transcription, word ORDER BY place) AS gap FROM d)
        SELECT ord, transcription, count(*) AS pairs, round(avg(CAST(gap AS DOUBLE)), 5) AS mean_gap, round(avg(exp(-gap / 300e0)), 6) AS kernel FROM g WHERE gap IS NOT NULL GROUP BY ord, transcription""",
    "op179_page_in_sheet_order": lambda d: "SELECT transcription, quire, bifolio, page_id, CAST(row_number() OVER (PARTITION BY transcription, quire, bifolio ORDER BY md5(concat_ws('|', 'sheet', CAST(page_id AS STRING))), page_id) AS INTEGER) AS place FROM pg WHERE quire IS NOT NULL AND bifolio IS NOT NULL",
    "op181_anova": lambda d: """WITH x AS (SELECT hypothesis AS g, plain_bits AS v FROM cells WHERE plain_bits IS NOT NULL), m AS (SELECT x.*, avg(v) OVER (PARTITION BY g) AS gm, avg(v) OVER () AS am FROM x)
        SELECT count(*) AS n, round((sum(pow(gm - am, 2)) / (count(DISTINCT g) - 1)) / (sum(pow(v - gm, 2)) / (count(*) - count(DISTINCT g))), 6) AS f FROM m""",
    "op181_spearman": lambda d: """WITH r AS (SELECT rank() OVER (ORDER BY plain_bits) + (count(*) OVER (PARTITION BY plain_bits) - 1) / 2e0 AS a, rank() OVER (ORDER BY structure_margin) + (count(*) OVER (PARTITION BY structure_margin) - 1) / 2e0 AS b FROM cells WHERE plain_bits IS NOT NULL AND structure_margin IS NOT NULL) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r""",
    "op182_predictive_piles": lambda d: f"""WITH p AS (SELECT kind, CAST(count(*) AS DOUBLE) AS n, avg(structure_margin) AS m, greatest(coalesce(stddev_samp(structure_margin), 0e0), 0.05e0) AS sd FROM cells c JOIN kinds k ON k.instance = c.instance GROUP BY kind),
        z AS (SELECT c.cell_id, p.kind, (c.structure_margin - p.m) / (p.sd * sqrt(1 + 1 / p.n)) AS z, p.sd * sqrt(1 + 1 / p.n) AS scale, greatest(p.n - 1, 1e0) AS df FROM cells c CROSS JOIN p WHERE p.kind IN ('positive', 'shuffled')),
        l AS (SELECT cell_id, kind, {d.lgamma('((df + 1) / 2)')} - {d.lgamma('(df / 2)')} - (df + 1) / 2 * ln(1 + z * z / df) - ln(scale) - 0.5e0 * ln(df * 3.141592653589793e0) AS lp FROM z) SELECT cell_id, round((max(CASE WHEN kind = 'positive' THEN lp END) - max(CASE WHEN kind = 'shuffled' THEN lp END)) / ln(10e0), 5) AS log10_ratio FROM l GROUP BY cell_id""",
    "op183_temperature_grid": lambda d: f"""WITH grid AS (SELECT pow(10e0, (CAST(j AS DOUBLE) - 20) / 20) AS temp FROM (SELECT 1 AS one) z{d.each('j', '0', '40')}), x AS (SELECT g.temp, s.doc_id, s.truth, s.lang, exp(-s.bits / g.temp) / sum(exp(-s.bits / g.temp)) OVER (PARTITION BY g.temp, s.doc_id) AS p FROM scored s CROSS JOIN grid g)
        SELECT round(temp, 6) AS temp, round(-avg(ln(greatest(p, 1e-300))), 6) AS nll FROM x WHERE lang = truth GROUP BY temp""",
    "op183_calibration_error": lambda d: """WITH x AS (SELECT doc_id, truth, lang, exp(-bits) / sum(exp(-bits)) OVER (PARTITION BY doc_id) AS p FROM scored), t AS (SELECT doc_id, max(p) AS conf, max_by(lang, p) = max(truth) AS hit FROM x GROUP BY doc_id), b AS (SELECT CAST(ceil(round(conf, 9) * 15) AS INTEGER) AS bin, count(*) AS n, avg(conf) AS c, avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END) AS a FROM t WHERE conf > 0 GROUP BY CAST(ceil(round(conf, 9) * 15) AS INTEGER))
        SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b""",
    # ---- generators
    "op206_substitution_cipher": lambda d: f"""SELECT doc_id, {d.sha256(f"translate(s, '{LETTERS}', k.to)")} AS cipher_sha FROM plain CROSS JOIN (SELECT {d.glue('ch', '', 'h')} AS to FROM (SELECT ch, md5(concat_ws('|', 'bij', ch)) AS h FROM (SELECT substr('{LETTERS}', CAST(j AS INTEGER), 1) AS ch FROM (SELECT 1 AS one) z{d.each('j', '1', '25')}) y) x) k WHERE length(s) > 0""".replace("k.to", "k.turned").replace("AS to ", "AS turned "),
    "op206_homophonic_cipher": lambda d: f"""SELECT lang, g AS letter, hom, count(*) AS n FROM (SELECT p.lang, p.g, CAST(floor({d.u("'h'", 'CAST(p.doc_id AS STRING)', 'CAST(p.pos AS STRING)')} * greatest(1e0, round(40 * w.p))) AS INTEGER) AS hom FROM (SELECT doc_id, lang, pos, g FROM (SELECT doc_id, lang, s FROM parted WHERE part = 'heldout') y{d.grams('s', 1, 'pos', 'g')}) p JOIN w1 w ON w.lang = p.lang AND w.g = p.g) q GROUP BY lang, g, hom""",
    "op207_homophone_allocation": lambda d: """WITH q AS (SELECT lang, g, 60e0 * (n / CAST(sum(n) OVER (PARTITION BY lang) AS DOUBLE)) AS x FROM c1), r AS (SELECT lang, g, floor(x) AS base, row_number() OVER (PARTITION BY lang ORDER BY round(x - floor(x), 9) DESC, g) AS place, 60 - sum(floor(x)) OVER (PARTITION BY lang) AS rest FROM q)
        SELECT lang, g AS letter, CAST(base + CASE WHEN place <= rest THEN 1 ELSE 0 END AS INTEGER) AS homophones FROM r""",
    "op211_key_derangement": lambda d: f"""WITH l AS (SELECT substr('{LETTERS}', CAST(j AS INTEGER), 1) AS ch FROM (SELECT 1 AS one) z{d.each('j', '1', '25')}), h AS (SELECT ch, row_number() OVER (ORDER BY md5(concat_ws('|', 'der', ch))) AS i, count(*) OVER () AS m FROM l) SELECT a.ch, b.ch AS to_ch FROM h a JOIN h b ON b.i = a.i % a.m + 1""",
    "op233_posterior_fill": lambda d: f"""WITH c AS (SELECT lang, g, p, sum(p) OVER (PARTITION BY lang ORDER BY g ROWS UNBOUNDED PRECEDING) / sum(p) OVER (PARTITION BY lang) AS hi FROM w1), u AS (SELECT lang, CAST(j AS INTEGER) AS draw, {d.u("'fill'", 'lang', 'CAST(j AS STRING)')} AS u FROM langs{d.each('j', '1', '20')})
        SELECT u.lang, u.draw, min(c.g) AS letter FROM u JOIN c ON c.lang = u.lang AND c.hi > u.u GROUP BY u.lang, u.draw""",
    "op234_section_ser": lambda d: f"""SELECT a.transcription, a.section, round(levenshtein(a.x, b.x) / CAST(length(b.x) AS DOUBLE), 6) AS ser FROM (SELECT transcription, CAST(floor(spot / 40) AS BIGINT) AS section, {d.glue('substr(word, 1, 1)', '', 'spot')} AS x FROM seq GROUP BY transcription, floor(spot / 40)) a JOIN (SELECT transcription, CAST(floor(spot / 40) AS BIGINT) AS section, {d.glue('substr(word, length(word), 1)', '', 'spot')} AS x FROM seq GROUP BY transcription, floor(spot / 40)) b ON b.transcription = a.transcription AND b.section = a.section""",
    "op238_weighted_ser": lambda d: f"SELECT transcription, round(sum(ser * n) / sum(n), 6) AS weighted, round({d.quantile('ser', '0.5e0')}, 6) AS median FROM (SELECT transcription, page_id, avg(levenshtein(before, word) / CAST(length(word) AS DOUBLE)) AS ser, count(*) AS n FROM pairs GROUP BY transcription, page_id HAVING count(*) >= 20) q GROUP BY transcription",
    "op205_example_labels": lambda d: f"""WITH u AS (SELECT CAST(j AS INTEGER) AS example, {d.u("'label'", 'CAST(j AS STRING)')} AS a, {d.u("'kind'", 'CAST(j AS STRING)')} AS b, {d.u("'len'", 'CAST(j AS STRING)')} AS c FROM (SELECT 1 AS one) z{d.each('j', '1', '1000')})
        SELECT example, a < 0.25e0 AS abstain, CASE WHEN a >= 0.25e0 THEN 'language' WHEN b < 0.45e0 THEN 'shuffled' WHEN b < 0.85e0 THEN 'pool' ELSE 'gibberish' END AS kind, CASE WHEN c < 0.2e0 THEN 128 WHEN c < 0.45e0 THEN 256 WHEN c < 0.7e0 THEN 512 ELSE 1024 END AS example_len FROM u""",
    "op231_readmission_batches": lambda d: "SELECT transcription, word, CAST(ceil(place * 5e0 / m) AS INTEGER) AS batch FROM (SELECT transcription, word, row_number() OVER (PARTITION BY transcription ORDER BY md5(concat_ws('|', 'wild', word)), word) AS place, count(*) OVER (PARTITION BY transcription) AS m FROM freq WHERE n = 1) q",
}
