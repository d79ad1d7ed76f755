"""Language models, scores, calibration, ranking and the reported cells."""

from __future__ import annotations

from scriptorium.plans.portable import entropy, wilson
from scriptorium.plans.relations import language

OPS = {
    "op101_ngram_counts": lambda d: "SELECT lang, k, g, n FROM grams" if d.name == "duck" else "SELECT lang, k, g, n FROM {grams_}",
    "op102_witten_bell": lambda d: "WITH q1 AS (SELECT lang, g, p FROM w1), " + ", ".join(f"q{k} AS (SELECT w.lang, w.g, (w.n + w.kinds * q.p) / (w.big + w.kinds) AS p FROM w{k} w JOIN q{k - 1} q ON q.lang = w.lang AND q.g = substr(w.g, 2, {k - 1}))" for k in range(2, 6)) + " " + " UNION ALL ".join(f"SELECT lang, {k} AS k, g, round(p, 6) AS p FROM q{k}" for k in range(1, 6)),
    "op103_lm_scores": lambda d: "SELECT doc_id, lang, round(bits, 6) AS bits FROM scored",
    "op147_best_language": lambda d: "SELECT doc_id, truth, lang AS best, round(bits, 6) AS bits, round(next_bits - bits, 6) AS margin FROM ranked WHERE place = 1",
    "op224_window_lm_bits": lambda d: "SELECT doc_id, lang, CAST(len AS BIGINT) AS positions, round(bits, 5) AS bits FROM scored WHERE lang = truth",
    "op099_per_document": lambda d: """SELECT instance, hypothesis, count(*) AS n, round(avg(total_per_all_symbols), 6) AS mean, round(coalesce(stddev_samp(total_per_all_symbols), 0e0), 6) AS sd, round(coalesce(stddev_samp(total_per_all_symbols), 0e0) / sqrt(CAST(count(*) AS DOUBLE)), 6) AS sem FROM cells GROUP BY instance, hypothesis""",
    "op100_spread_summary": lambda d: f"""SELECT head, count(*) AS n, round(avg(plain_bits), 6) AS mean, round(stddev_samp(plain_bits), 6) AS sd, round({d.quantile('plain_bits', '0.05e0')}, 6) AS q05, round({d.quantile('plain_bits', '0.5e0')}, 6) AS median, round({d.quantile('plain_bits', '0.95e0')}, 6) AS q95 FROM cells WHERE plain_bits IS NOT NULL GROUP BY head""",
    "op104_cipher_baselines": lambda d: f"""WITH s AS (SELECT transcription, substr(word, 1, 1) AS sym, spot, count(*) OVER (PARTITION BY transcription) AS m FROM seq), h AS (SELECT s.*, spot < floor(m / 2) AS train FROM s),
        v AS (SELECT transcription, count(DISTINCT sym) AS v FROM h GROUP BY transcription), u AS (SELECT transcription, sym, count(*) AS n, sum(count(*)) OVER (PARTITION BY transcription) AS total FROM h WHERE train GROUP BY transcription, sym),
        b AS (SELECT transcription, prev, sym, count(*) AS n, sum(count(*)) OVER (PARTITION BY transcription, prev) AS total FROM (SELECT h.*, lag(sym) OVER (PARTITION BY transcription ORDER BY spot) AS prev FROM h WHERE train) q WHERE prev IS NOT NULL GROUP BY transcription, prev, sym),
        c AS (SELECT DISTINCT transcription, prev, total FROM b), t AS (SELECT h.*, lag(sym) OVER (PARTITION BY transcription ORDER BY spot) AS prev FROM h WHERE NOT train)
        SELECT t.transcription, count(*) AS positions, round(-avg(log2(CASE WHEN c.total IS NULL THEN p0 ELSE c.total / CAST(c.total + v AS DOUBLE) * (coalesce(b.n, 0) / CAST(c.total AS DOUBLE)) + v / CAST(c.total + v AS DOUBLE) * p0 END)), 6) AS heldout_bits
        FROM (SELECT t.*, v.v, (coalesce(u.n, 0) + 0.5e0) / (tt.total + 0.5e0 * v.v) AS p0 FROM t JOIN v ON v.transcription = t.transcription JOIN (SELECT DISTINCT transcription, total FROM u) tt ON tt.transcription = t.transcription LEFT JOIN u ON u.transcription = t.transcription AND u.sym = t.sym WHERE t.prev IS NOT NULL) t
        LEFT JOIN c ON c.transcription = t.transcription AND c.prev = t.prev LEFT JOIN b ON b.transcription = t.transcription AND b.prev = t.prev AND b.sym = t.sym GROUP BY t.transcription""",
    "op129_harness_summary": lambda d: "SELECT kind, hypothesis, window_len, count(*) AS trials, round(avg(plain_bits), 6) AS mean_bits, round(max(plain_bits), 6) AS max_bits, round(avg(CASE WHEN language_like THEN 1e0 ELSE 0e0 END), 6) AS win_rate FROM cells c JOIN kinds k ON k.instance = c.instance GROUP BY kind, hypothesis, window_len",
    "op130_recovery_report": lambda d: f"""WITH top AS (SELECT c.instance, c.presentation, c.head, c.window_len, min(c.doc_id) AS doc_id, {d.first_by('hypothesis', 'total_per_all_symbols, hypothesis')} AS called FROM cells c GROUP BY c.instance, c.presentation, c.head, c.window_len),
        truth AS (SELECT doc_id, min({language(d, 'language')}) AS lang FROM {d.t('doc_records')} WHERE doc_id IS NOT NULL GROUP BY doc_id),
        j AS (SELECT top.window_len, t.lang, top.called = t.lang AS hit, a.family = b.family AS near FROM top JOIN truth t ON t.doc_id = top.doc_id JOIN langs a ON a.lang = t.lang LEFT JOIN langs b ON b.lang = top.called)
        SELECT lang, window_len, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE near) AS family_hits, round({wilson('(count(*) FILTER (WHERE hit))', 'count(*)', '-')}, 6) AS low, round({wilson('(count(*) FILTER (WHERE hit))', 'count(*)', '+')}, 6) AS high FROM j GROUP BY GROUPING SETS ((lang, window_len), (lang), (window_len), ())""",
    "op131_confusion": lambda d: f"SELECT truth, lang AS called, truth = lang AS correct, fa.family = fb.family AS same_family, count(*) AS n FROM ranked r JOIN (SELECT lang AS l1, family FROM langs) fa ON fa.l1 = r.truth JOIN (SELECT lang AS l2, family FROM langs) fb ON fb.l2 = r.lang WHERE place = 1 GROUP BY truth, lang, fa.family = fb.family",
    "op132_length_curves": lambda d: "SELECT window_len, head, round(avg(total_per_all_symbols), 4) AS mean_total, count(*) AS n FROM cells GROUP BY window_len, head",
    "op133_classifier_summary": lambda d: """WITH s AS (SELECT doc_id, truth, lang, exp(-bits) / sum(exp(-bits)) OVER (PARTITION BY doc_id) AS p FROM scored), m AS (SELECT doc_id, truth, max(p) AS top, max(CASE WHEN lang = truth THEN p END) AS own FROM s GROUP BY doc_id, truth)
        SELECT truth, count(*) AS n, round(avg(CASE WHEN own = top THEN 1e0 ELSE 0e0 END), 6) AS accuracy, round(avg(own), 6) AS mean_own, round(avg(CASE WHEN top < 0.4e0 THEN 1e0 ELSE 0e0 END), 6) AS abstain_rate FROM m GROUP BY truth""",
    "op142_calibrated_bits": lambda d: "SELECT c.cell_id, c.hypothesis, round(c.plain_bits + coalesce(o.offset_bits, 0e0), 6) AS bits FROM cells c LEFT JOIN calib o ON o.lang = c.hypothesis WHERE c.plain_bits IS NOT NULL",
    "op143_replicate_pairs": lambda d: "WITH t AS (SELECT instance, presentation, head, min_by(hypothesis, total_per_all_symbols) AS top FROM cells GROUP BY instance, presentation, head) SELECT a.instance, count(*) AS compared, count(*) FILTER (WHERE a.top <> b.top) AS disagree FROM t a JOIN t b ON a.instance = b.instance AND (a.presentation < b.presentation OR (a.presentation = b.presentation AND a.head < b.head)) GROUP BY a.instance",
    "op144_instance_lookup": lambda d: f"SELECT c.cell_id, c.instance, r.language, r.raw_chars FROM cells c JOIN (SELECT doc_id, min(language) AS language, max(raw_chars) AS raw_chars FROM {d.t('doc_records')} GROUP BY doc_id) r ON r.doc_id = c.doc_id",
    "op145_job_list": lambda d: f"""SELECT k.instance, h.head, l.lang AS hypothesis, CAST(w AS INTEGER) AS win FROM kinds k CROSS JOIN (SELECT * FROM (VALUES ('rung1', 25), ('homophonic', 60), ('naibbe', 400)) AS v(head, most)) h CROSS JOIN langs l{d.each('w', '0', '2')} WHERE (k.kind = 'positive' OR h.head <> 'naibbe') AND w <= CASE WHEN h.head = 'rung1' THEN 0 ELSE 2 END""",
    "op150_consensus_margin": lambda d: "SELECT instance, min_by(hypothesis, bits) AS winner, round(max(CASE WHEN place = 2 THEN bits END) - max(CASE WHEN place = 1 THEN bits END), 6) AS margin FROM (SELECT q.*, row_number() OVER (PARTITION BY instance ORDER BY bits, hypothesis) AS place FROM (SELECT instance, hypothesis, avg(total_per_all_symbols) AS bits FROM cells GROUP BY instance, hypothesis) q) r GROUP BY instance",
    "op151_flip_rate": lambda d: """WITH t AS (SELECT instance, presentation, head, min_by(hypothesis, total_per_all_symbols) AS top FROM cells GROUP BY instance, presentation, head), c AS (SELECT instance, top, count(*) AS n FROM t GROUP BY instance, top)
        SELECT instance, round(1 - sum(n * (n - 1)) / nullif(CAST(sum(n) AS DOUBLE) * (sum(n) - 1), 0), 6) AS flip FROM c GROUP BY instance""",
    "op152_reported_cell": lambda d: """SELECT instance, presentation, head, hypothesis, count(*) AS windows, round(avg(total_per_all_symbols), 6) AS total, round(avg(structure_margin), 6) AS margin, round(avg(plain_bits), 6) AS bits, coalesce(avg(plain_bits) <= 3.0e0 AND avg(structure_margin) >= 1.5e0, false) AS language_like FROM cells GROUP BY instance, presentation, head, hypothesis""",
    "op153_rank_table": lambda d: """WITH b AS (SELECT head, hypothesis, count(*) AS n_cells, min(total_per_all_symbols) AS best, round(max(total_per_all_symbols) - min(total_per_all_symbols), 6) AS spread, max(CASE WHEN language_like THEN 1 ELSE 0 END) = 1 AS any_like, min_by(plain_bits, total_per_all_symbols) AS bits,
        coalesce(min(total_per_all_symbols) < min_by(no_cipher_baseline_bits_per_symbol, total_per_all_symbols), true) AS beats FROM cells GROUP BY head, hypothesis)
        SELECT head, hypothesis, n_cells, round(best, 6) AS best, spread, any_like, beats, round(bits, 6) AS bits, CAST(row_number() OVER (PARTITION BY head ORDER BY best, hypothesis) AS INTEGER) AS place, round(lead(best) OVER (PARTITION BY head ORDER BY best, hypothesis) - best, 6) AS to_next FROM b""",
    "op153_agreement": lambda d: """WITH v AS (SELECT head, instance, presentation, window_len, min_by(hypothesis, total_per_all_symbols) AS vote FROM cells GROUP BY head, instance, presentation, window_len HAVING count(DISTINCT hypothesis) = 4), top AS (SELECT head, min_by(hypothesis, total_per_all_symbols) AS top FROM cells GROUP BY head)
        SELECT v.head, top.top, count(*) AS votes, round(avg(CASE WHEN vote = top.top THEN 1e0 ELSE 0e0 END), 6) AS agreement FROM v JOIN top ON top.head = v.head GROUP BY v.head, top.top""",
    "op154_tiers": lambda d: """WITH c AS (SELECT max(structure_margin) AS best FROM cells c JOIN kinds k ON k.instance = c.instance WHERE kind = 'shuffled') SELECT cell_id, CASE WHEN c.best IS NULL THEN 'PENDING' WHEN structure_margin >= 1.5e0 AND plain_bits <= 3.0e0 THEN 'LANGUAGE-LIKE'
        WHEN structure_margin >= 1.49e0 AND c.best < 1.26e0 THEN 'PROMISING' WHEN structure_margin >= 1.26e0 AND structure_margin >= c.best + 0.15e0 THEN 'NOTABLE' ELSE 'NOISE' END AS tier FROM cells CROSS JOIN c""",
    "op157_disagreements": lambda d: "SELECT instance, best, called, round(margin, 6) AS margin FROM (SELECT instance, min_by(hypothesis, total_per_all_symbols) AS best, min_by(hypothesis, plain_bits) AS called, max(plain_bits) - min(plain_bits) AS margin FROM cells WHERE plain_bits IS NOT NULL GROUP BY instance) q WHERE best <> called",
    "op159_shortlist": lambda d: """WITH c AS (SELECT s.lang, s.doc_id, s.bits, p.s, row_number() OVER (PARTITION BY s.lang, p.s ORDER BY round(s.bits, 9), s.doc_id) AS copy FROM scored s JOIN parted p ON p.doc_id = s.doc_id),
        r AS (SELECT lang, doc_id, bits, row_number() OVER (PARTITION BY lang ORDER BY round(bits, 9), doc_id) AS place FROM c WHERE copy = 1) SELECT lang, doc_id, CAST(place AS INTEGER) AS place, round(bits, 6) AS bits FROM r WHERE place <= 8""",
    "op161_auroc": lambda d: """WITH r AS (SELECT kind = 'positive' AS y, rank() OVER (ORDER BY structure_margin) + (count(*) OVER (PARTITION BY structure_margin) - 1) / 2e0 AS r FROM cells c JOIN kinds k ON k.instance = c.instance WHERE structure_margin IS NOT NULL)
        SELECT count(*) AS n, round((sum(CASE WHEN y THEN r ELSE 0e0 END) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2e0) / (CAST(count(*) FILTER (WHERE y) AS DOUBLE) * count(*) FILTER (WHERE NOT y)), 6) AS auroc FROM r""",
    "op164_curve_verdict": lambda d: """WITH m AS (SELECT instance, window_len, avg(total_per_all_symbols) AS bits FROM cells GROUP BY instance, window_len), i AS (SELECT window_len, bits - lag(bits) OVER (PARTITION BY instance ORDER BY window_len) AS inc FROM m)
        SELECT window_len, count(inc) AS n, round(avg(inc), 6) AS mean_inc, avg(inc) > -2 * stddev_samp(inc) / sqrt(CAST(count(inc) AS DOUBLE)) AS monotone FROM i WHERE inc IS NOT NULL GROUP BY window_len HAVING count(inc) > 1""",
    "op184_margin_uncertainty": lambda d: "SELECT a.lang AS lang_a, b.lang AS lang_b, round(abs(a.offset_bits - b.offset_bits), 6) AS report_only, round(sqrt(a.offset_sem * a.offset_sem + b.offset_sem * b.offset_sem), 6) AS applied FROM calib a JOIN calib b ON a.lang < b.lang",
    "op186_masked_bits": lambda d: f"""WITH k AS (SELECT doc_id, lang, len, pos, g, strat, greatest((strat + {d.u("'t'", 'CAST(doc_id AS STRING)', 'CAST(strat AS STRING)')}) / 4e0, 0.001e0) AS t FROM (SELECT doc_id, lang, s, CAST(length(s) AS DOUBLE) AS len FROM parted WHERE part = 'heldout') p{d.grams('s', 1, 'pos', 'g')}{d.each('strat', '0', '3')}),
        m AS (SELECT k.*, {d.u("'m'", 'CAST(doc_id AS STRING)', 'CAST(strat AS STRING)', 'CAST(pos AS STRING)')} < t AS masked FROM k)
        SELECT m.doc_id, round(sum(-log2(w1.p) / t) / (4 * max(len)), 5) AS bits, count(*) AS masked FROM m JOIN w1 ON w1.lang = m.lang AND w1.g = m.g WHERE masked GROUP BY m.doc_id""",
    "op187_masking": lambda d: f"SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE {d.u(chr(39) + 'k' + chr(39), 'CAST(doc_id AS STRING)', 'CAST(pos AS STRING)')} < 0.3e0) AS masked FROM plain p{d.grams('s', 1, 'pos', 'g')} GROUP BY doc_id",
    "op188_common_masks": lambda d: f"""WITH m AS (SELECT doc_id, pos, g FROM (SELECT doc_id, s FROM parted WHERE part = 'heldout') p{d.grams('s', 1, 'pos', 'g')} WHERE {d.u("'c'", 'CAST(doc_id AS STRING)', 'CAST(pos AS STRING)')} < 0.5e0)
        SELECT m.doc_id, l.lang, round(sum(-log2(coalesce(w1.p, 1e-6))) / count(*), 6) AS bits FROM m CROSS JOIN langs l LEFT JOIN w1 ON w1.lang = l.lang AND w1.g = m.g GROUP BY m.doc_id, l.lang""",
    "op180_variance_ratio": lambda d: """WITH p AS (SELECT instance, presentation, avg(CASE WHEN hypothesis = 'latin' THEN total_per_all_symbols END) AS a, avg(CASE WHEN hypothesis = 'german' THEN total_per_all_symbols END) AS b FROM cells GROUP BY instance, presentation)
        SELECT count(*) AS n, round(var_samp(a - b), 6) AS paired, round(var_samp(a) + var_samp(b), 6) AS independent, round((var_samp(a) + var_samp(b)) / nullif(var_samp(a - b), 0), 5) AS ratio FROM p WHERE a IS NOT NULL AND b IS NOT NULL""",
    "op196_calibrated_per_char": lambda d: "SELECT s.doc_id, s.lang, round(s.bits + c.offset_bits, 6) AS bits FROM scored s JOIN calib c ON c.lang = s.lang",
    "op197_key_bits": lambda d: f"""SELECT transcription, types, round(f.f25, 6) AS one_to_one_bits, round(types * log2(25e0), 6) AS homophonic_bits, round(18 * f.f23, 6) AS mixed_bits, round(f.f16 + 25 * log2(26e0), 6) AS sum_bits
        FROM (SELECT transcription, count(*) AS types FROM freq GROUP BY transcription) t CROSS JOIN (SELECT sum(log2(CAST(i AS DOUBLE))) AS f25, sum(CASE WHEN i <= 23 THEN log2(CAST(i AS DOUBLE)) END) AS f23, sum(CASE WHEN i <= 16 THEN log2(CAST(i AS DOUBLE)) END) AS f16 FROM (SELECT 1 AS one) z{d.each('i', '1', '25')}) f""",
    "op198_calibration_run": lambda d: "SELECT lang, n, round(offset_bits, 6) AS offset_bits, round(offset_sem, 6) AS offset_sem FROM calib",
    "op199_document_scoring": lambda d: "SELECT truth, lang AS top1, count(*) AS n, round(avg(bits), 6) AS mean_bits FROM ranked WHERE place = 1 GROUP BY truth, lang",
    "op222_arm_statistics": lambda d: f"""WITH t AS (SELECT c.instance, k.kind, min_by(hypothesis, total_per_all_symbols) AS top, max(CASE WHEN language_like THEN 1 ELSE 0 END) AS solved FROM cells c JOIN kinds k ON k.instance = c.instance GROUP BY c.instance, k.kind)
        SELECT kind, count(*) AS n, CAST(sum(solved) AS BIGINT) AS solved, round({wilson('sum(solved)', 'count(*)', '-')}, 6) AS low, round({wilson('sum(solved)', 'count(*)', '+')}, 6) AS high FROM t GROUP BY kind""",
    "op225_relative_profile": lambda d: "WITH m AS (SELECT kind, window_len, avg(plain_bits) AS b FROM cells c JOIN kinds k ON k.instance = c.instance GROUP BY kind, window_len) SELECT p.window_len, round(CASE WHEN s.b - p.b > 0.1e0 THEN (g.b - p.b) / (s.b - p.b) END, 6) AS profile FROM m p JOIN m s ON s.window_len = p.window_len AND s.kind = 'shuffled' JOIN m g ON g.window_len = p.window_len AND g.kind = 'gibberish' WHERE p.kind = 'positive'",
    "op226_judge_accuracy": lambda d: """WITH c AS (SELECT truth, lang, avg(bits) AS clean FROM scored GROUP BY truth, lang), e AS (SELECT s.*, s.bits - c.clean AS excess FROM scored s JOIN c ON c.truth = s.lang AND c.lang = s.lang)
        SELECT truth, count(*) AS n, round(avg(CASE WHEN raw_top = truth THEN 1e0 ELSE 0e0 END), 6) AS raw_accuracy, round(avg(CASE WHEN excess_top = truth THEN 1e0 ELSE 0e0 END), 6) AS excess_accuracy FROM (SELECT doc_id, truth, min_by(lang, bits) AS raw_top, min_by(lang, excess) AS excess_top FROM e GROUP BY doc_id, truth) q GROUP BY truth""",
    "op229_precision_at": lambda d: f"SELECT k, round(avg(CASE WHEN truth = lang THEN 1e0 ELSE 0e0 END), 6) AS precision_at FROM (SELECT r.*, row_number() OVER (ORDER BY round(next_bits - bits, 9) DESC, doc_id) AS pos FROM ranked r WHERE place = 1) q JOIN (SELECT CAST(j AS INTEGER) AS k FROM (SELECT 1 AS one) z{d.each('j', '1', '16')}) g ON pos <= k GROUP BY k",
    "op230_control_best": lambda d: "SELECT head, round(max(structure_margin), 6) AS best_margin, max(CASE WHEN language_like THEN 1 ELSE 0 END) = 1 AS any_like FROM cells c JOIN kinds k ON k.instance = c.instance WHERE kind IN ('shuffled', 'gibberish') GROUP BY head",
    "op236_weighted_accuracy": lambda d: "SELECT truth, round(sum(CASE WHEN lang = truth THEN len ELSE 0 END) / CAST(sum(len) AS DOUBLE), 6) AS weighted, round(avg(CASE WHEN lang = truth THEN 1e0 ELSE 0e0 END), 6) AS unweighted FROM ranked WHERE place = 1 GROUP BY truth",
    "op237_cross_head_mdl": lambda d: "SELECT instance, min_by(head, best) AS winner, round(min(best), 6) AS total, round(max(CASE WHEN place = 2 THEN best END) - min(best), 6) AS margin FROM (SELECT q.*, row_number() OVER (PARTITION BY instance ORDER BY best, head) AS place FROM (SELECT instance, head, min(total_per_all_symbols) AS best FROM cells GROUP BY instance, head) q) r GROUP BY instance",
    "op240_seed_agreement": lambda d: f"WITH w AS (SELECT instance, presentation AS seed, min_by(hypothesis, total_per_all_symbols) AS top FROM cells GROUP BY instance, presentation) SELECT a.seed AS seed_a, b.seed AS seed_b, count(*) AS n, round(avg(CASE WHEN a.top = b.top THEN 1e0 ELSE 0e0 END), 6) AS agreement FROM w a JOIN w b ON a.instance = b.instance AND a.seed < b.seed GROUP BY a.seed, b.seed",
    "op241_log_plateau": lambda d: f"""WITH log AS (SELECT loaded_at, 'step ' || CAST(floor(coalesce(window_len, 0) / 64) AS BIGINT) || ' | canary ' || hypothesis || ' | bits ' || CAST(CAST(round(plain_bits, 6) AS DECIMAL(12, 6)) AS STRING) AS line, cell_id FROM {d.t('score_cells')} WHERE hypothesis IS NOT NULL AND plain_bits IS NOT NULL),
        p AS (SELECT loaded_at, cell_id, CAST({d.extract('line', 'step ([0-9]+)')} AS BIGINT) AS step, {d.extract('line', 'canary ([a-z]+)')} AS lang, CAST({d.extract('line', 'bits (-?[0-9.]+)')} AS DOUBLE) AS v FROM log),
        last AS (SELECT lang, step, v FROM (SELECT p.*, row_number() OVER (PARTITION BY lang, step ORDER BY loaded_at DESC, cell_id DESC, v) AS k FROM p) q WHERE k = 1),
        back AS (SELECT a.lang, a.step, a.v, max(b.step) AS ref_step FROM last a JOIN last b ON b.lang = a.lang AND b.step <= a.step - 2 GROUP BY a.lang, a.step, a.v)
        SELECT b.lang, b.step, round((r.v - b.v) / nullif(r.v, 0), 6) AS improvement FROM back b JOIN last r ON r.lang = b.lang AND r.step = b.ref_step""",
    "op023_calibration_table": lambda d: "SELECT l.lang, l.family, CAST(l.pos AS INTEGER) AS pos, round(c.offset_bits, 6) AS offset_bits, round(c.offset_sem, 6) AS offset_sem FROM langs l JOIN calib c ON c.lang = l.lang",
    "op035_report_only_table": lambda d: "SELECT l.lang, l.family, round(c.offset_bits, 6) AS reported, 0e0 AS applied FROM langs l JOIN calib c ON c.lang = l.lang",
    "op034_lm_table": lambda d: "SELECT w2.lang, w2.g, round(ln(w2.n / CAST(w2.big AS DOUBLE)), 6) AS log_ml FROM w2",
    "op189_paired_bits": lambda d: f"""WITH m AS (SELECT doc_id, lang, role, pos, g FROM (SELECT doc_id, lang, 'decode' AS role, s FROM parted WHERE part = 'heldout' UNION ALL SELECT doc_id, lang, 'reversed' AS role, reverse(s) AS s FROM parted WHERE part = 'heldout') p{d.grams('s', 2, 'pos', 'g')}
        WHERE {d.u("'pair'", 'CAST(doc_id AS STRING)', 'CAST(pos AS STRING)')} < 0.5e0)
        SELECT m.doc_id, m.role, count(*) AS masked, round(avg(-log2(CASE WHEN x.big IS NULL THEN w1.p ELSE coalesce(w2.n, 0) / CAST(x.big + x.kinds AS DOUBLE) + x.kinds / CAST(x.big + x.kinds AS DOUBLE) * w1.p END)), 5) AS bits FROM m JOIN w1 ON w1.lang = m.lang AND w1.g = substr(m.g, 2, 1)
        LEFT JOIN ctx2 x ON x.lang = m.lang AND x.ctx = substr(m.g, 1, 1) LEFT JOIN w2 ON w2.lang = m.lang AND w2.g = m.g GROUP BY m.doc_id, m.role""",
    "op228_mask_arms": lambda d: """WITH m AS (SELECT kind, c.instance, avg(CASE WHEN presentation = 'plain' THEN total_per_all_symbols END) AS a, avg(CASE WHEN presentation = 'stripped' THEN total_per_all_symbols END) AS b, max(no_cipher_baseline_bits_per_symbol) AS rate FROM cells c JOIN kinds k ON k.instance = c.instance GROUP BY kind, c.instance)
        SELECT kind, count(*) AS n, round(avg(b - a), 6) AS margin, round(avg(0.8e0 * a + 0.2e0 * rate), 6) AS charged_total FROM m WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY kind""",
}
