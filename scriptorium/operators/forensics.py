"""Statistics of page-structured transcriptions and of letter streams, as portable statements."""

from __future__ import annotations

from scriptorium.plans.portable import entropy, wilson

B = "CAST({} AS BIGINT)".format
R = "round({}, 6)".format

OPS = {
    # ---- words and lengths
    "op049_dialect_words": lambda d: f"""SELECT transcription, lang AS dialect, page_id, line, CAST(row_number() OVER (PARTITION BY transcription, lang ORDER BY page_id, line, idx) AS BIGINT) AS n, word
        FROM (SELECT transcription, lang, page_id, line, idx, {d.sub('lower(word)', '[^a-z]', '')} AS word FROM alltok) q WHERE word <> '' AND lang IS NOT NULL""",
    "op050_dialect_streams": lambda d: f"""SELECT transcription, coalesce(lang, 'unassigned') AS dialect, {d.sha256(d.glue('word', '', 'page_id, line, idx'))} AS stream_sha, count(*) AS n_words,
        {B('sum(length(word))')} AS n_chars, count(DISTINCT page_id) AS n_pages FROM tok GROUP BY transcription, coalesce(lang, 'unassigned')""",
    "op051_page_dialects": lambda d: "SELECT page_id, page, lang AS dialect FROM pg",
    "op052_glyph_length": lambda d: f"SELECT word, {d.times('word', 'c[tkpf]h|ch|sh|[a-z]')} AS glyphs FROM tok GROUP BY word",
    "op053_collapsed_length": lambda d: f"SELECT word, {d.times(d.sub(d.sub('word', 'i+[nrlm]', 'N'), 'e+', 'e'), 'c[tkpf]h|ch|sh|[a-z]')} AS glyphs FROM tok GROUP BY word",
    "op054_token_table": lambda d: """SELECT transcription, page_id, line, idx, word, CAST(length(word) AS INTEGER) AS len, CASE WHEN k = 1 THEN 'first' WHEN k = m THEN 'last' ELSE 'mid' END AS place
        FROM (SELECT alltok.*, row_number() OVER (PARTITION BY transcription, page_id, line ORDER BY idx) AS k, count(*) OVER (PARTITION BY transcription, page_id, line) AS m FROM alltok) q
        WHERE unsure = 0 AND length(word) > 0""",
    "op055_page_attributes": lambda d: "SELECT t.transcription, t.page_id, t.line, t.idx, t.word, coalesce(t.hand, p.hand) AS hand, coalesce(t.lang, p.lang) AS lang, p.section FROM tok t LEFT JOIN pg p ON p.page_id = t.page_id",
    "op056_page_glyphs": lambda d: f"SELECT transcription, page_id, {d.sha256(d.glue('word', '', 'line, idx'))} AS glyphs_sha, {B('sum(length(word))')} AS n_glyphs, {B('count(*) - 1')} AS n_bounds FROM tok GROUP BY transcription, page_id",
    "op057_glyphs": lambda d: f"SELECT t.word, pos, glyph FROM (SELECT DISTINCT word FROM tok) t{d.found('t.word', 'c[tkpf]h|ch|sh|[a-z]', 'pos', 'glyph')}",
    "op059_word_shapes": lambda d: """SELECT word, length(word) >= 2 AND substr(word, length(word), 1) = substr(word, greatest(length(word) - 1, 1), 1) AS ends_double,
        length(word) >= 2 AND substr(word, 1, 1) = substr(word, 2, 1) AS starts_double,
        length(word) >= 4 AND substr(word, greatest(length(word) - 1, 1), 2) = substr(word, greatest(length(word) - 3, 1), 2) AS ends_doubled_pair,
        length(word) >= 3 AND substr(word, length(word), 1) = substr(word, greatest(length(word) - 1, 1), 1) AND substr(word, length(word), 1) = substr(word, greatest(length(word) - 2, 1), 1) AS ends_triple FROM tok GROUP BY word""",
    "op060_geminate_collapse": lambda d: "SELECT doc_id, replace(replace(replace(s, 'll', '1'), 'ss', '2'), 'tt', '3') AS collapsed FROM plain",
    "op061_geminate_counts": lambda d: """SELECT doc_id, letter, CAST((length(s) - length(replace(s, letter || letter, ''))) / 2 AS BIGINT) AS n
        FROM plain CROSS JOIN (SELECT substr('abcdefghiklmnopqrstuvwxyz', k, 1) AS letter FROM (SELECT 1 AS one) z""" + d.each("k", "1", "25") + """) l
        WHERE length(s) - length(replace(s, letter || letter, '')) > 0""",
    "op062_collapse_curve": lambda d: f"""WITH gem AS (SELECT lang, letter, sum((length(s) - length(replace(s, letter || letter, ''))) / 2) AS n FROM plain CROSS JOIN
        (SELECT substr('abcdefghiklmnopqrstuvwxyz', k, 1) AS letter FROM (SELECT 1 AS one) z{d.each('k', '1', '25')}) l WHERE lang IS NOT NULL GROUP BY lang, letter),
        chars AS (SELECT lang, sum(length(s)) AS total FROM plain WHERE lang IS NOT NULL GROUP BY lang),
        placed AS (SELECT gem.*, row_number() OVER (PARTITION BY lang ORDER BY n DESC, letter) AS place FROM gem)
        SELECT c.lang, CAST(k AS INTEGER) AS top_n, round(1000e0 * sum(CASE WHEN place > k THEN n ELSE 0 END) / max(total), 6) AS residual_per_1000
        FROM placed p JOIN chars c ON c.lang = p.lang CROSS JOIN (SELECT k FROM (SELECT 1 AS one) z{d.each('k', '0', '16')}) g GROUP BY c.lang, k""",
    "op063_alphabet_premaps": lambda d: "SELECT doc_id, replace(replace(s, 'w', 'uu'), 'k', 'c') AS one, replace(s, 'u', 'v') AS two FROM plain",
    "op064_letter_values": lambda d: "SELECT substr('abcdefghiklmnopqrstuvwxyz', CAST(k AS INTEGER), 1) AS letter, CAST(ascii(substr('abcdefghiklmnopqrstuvwxyz', CAST(k AS INTEGER), 1)) - 94 AS INTEGER) AS value FROM (SELECT 1 AS one) z" + d.each("k", "1", "25"),
    "op065_lexicon": lambda d: f"""SELECT lang, word, n, CAST(place AS BIGINT) AS place FROM (SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS place
        FROM (SELECT {'CASE WHEN 1 = 1 THEN l END'} AS lang, val AS word FROM (SELECT p.lang AS l, {d.sub("replace(lower(t.text), 'j', 'i')", '[^a-z]+', ' ')} AS x FROM plain p JOIN {d.t('documents')} t ON t.doc_id = p.doc_id WHERE p.lang IS NOT NULL) y{d.parts('x', ' ', 'pos', 'val')}) w
        WHERE length(word) >= 4 GROUP BY lang, word) q WHERE place <= 500""",
    # ---- doubling
    "op108_pair_doubling": lambda d: "SELECT transcription, page_id, line, count(*) AS pairs, count(*) FILTER (WHERE word = before) AS doubles FROM pairs GROUP BY transcription, page_id, line",
    "op108_page_doubling": lambda d: """SELECT transcription, page_id, count(*) AS pairs, count(*) FILTER (WHERE word = before) AS doubles
        FROM (SELECT transcription, page_id, word, lag(word) OVER (PARTITION BY transcription, page_id ORDER BY line, idx) AS before FROM tok) q WHERE before IS NOT NULL GROUP BY transcription, page_id""",
    "op109_doubling_table": lambda d: f"""WITH p AS (SELECT hand, count(DISTINCT page_id) AS pages, count(*) AS pairs_n, count(*) FILTER (WHERE word = before) AS doubles FROM pairs WHERE hand IS NOT NULL GROUP BY hand HAVING count(*) >= 200),
        u AS (SELECT hand, word, count(*) AS c FROM tok WHERE hand IS NOT NULL GROUP BY hand, word),
        s AS (SELECT hand, sum(c * (c - 1)) / (CAST(sum(c) AS DOUBLE) * (sum(c) - 1)) AS chance FROM u GROUP BY hand)
        SELECT p.hand, pages, pairs_n AS pairs, doubles, round(1000e0 * doubles / pairs_n, 6) AS per_1000, round(1000e0 * chance, 6) AS chance_per_1000, round(doubles / CAST(pairs_n AS DOUBLE) / nullif(chance, 0), 6) AS over_chance,
        round(1000e0 * {wilson('doubles', 'pairs_n', '-')}, 6) AS low, round(1000e0 * {wilson('doubles', 'pairs_n', '+')}, 6) AS high FROM p JOIN s ON s.hand = p.hand""",
    "op109_top_types": lambda d: """SELECT hand, word, n FROM (SELECT hand, word, count(*) AS n, row_number() OVER (PARTITION BY hand ORDER BY count(*) DESC, word) AS place FROM pairs WHERE word = before AND hand IS NOT NULL GROUP BY hand, word) q WHERE place <= 5""",
    "op110_letter_doubling": lambda d: f"SELECT doc_id, round(1000e0 * avg(CASE WHEN substr(g, 1, 1) = substr(g, 2, 1) THEN 1e0 ELSE 0e0 END), 6) AS per_1000 FROM plain{d.grams('s', 2, 'pos', 'g')} GROUP BY doc_id",
    "op111_inword_doubling": lambda d: f"""WITH letters AS (SELECT transcription, word, lag(word) OVER (PARTITION BY transcription ORDER BY page_id, line, idx) AS before FROM tok)
        SELECT transcription, {B('sum(length(word) - 1)')} AS inner_pairs, {B('sum(within)')} AS inner_doubles, count(before) AS cross_pairs,
        count(*) FILTER (WHERE substr(before, length(before), 1) = substr(word, 1, 1)) AS cross_doubles,
        round(1000e0 * sum(within) / nullif(sum(length(word) - 1), 0), 6) AS inner_per_1000
        FROM (SELECT l.*, length(word) - length({d.sub('word', '(aa|bb|cc|dd|ee|ff|gg|hh|ii|kk|ll|mm|nn|oo|pp|qq|rr|ss|tt|uu|vv|ww|xx|yy|zz)', '1')}) AS within FROM letters l) q GROUP BY transcription""",
    "op112_terminal_battery": lambda d: f"""WITH marked AS (SELECT transcription, page_id, par, word, length(word) >= 2 AND substr(word, length(word), 1) = substr(word, greatest(length(word) - 1, 1), 1) AS ends,
        length(word) >= 2 AND substr(word, 1, 1) = substr(word, 2, 1) AS starts, row_number() OVER (PARTITION BY transcription, page_id, par ORDER BY line DESC, idx DESC) = 1 AS final,
        lag(word) OVER (PARTITION BY transcription, page_id, par ORDER BY line, idx) AS before FROM tok)
        SELECT transcription, count(*) AS n, count(*) FILTER (WHERE ends) AS ends_double, count(*) FILTER (WHERE starts) AS starts_double, count(*) FILTER (WHERE final) AS finals, count(*) FILTER (WHERE final AND ends) AS final_ends,
        count(DISTINCT CASE WHEN ends THEN word END) AS types_ending, count(DISTINCT word) AS types,
        count(*) FILTER (WHERE substr(before, greatest(length(before) - 1, 1), 2) = substr(word, 1, 1) || substr(word, 1, 1)) AS two_one, count(*) FILTER (WHERE substr(word, 1, 2) = substr(before, length(before), 1) || substr(before, length(before), 1)) AS one_two,
        round(1000e0 * count(*) FILTER (WHERE ends) / count(*), 6) AS ends_per_1000, round(1000e0 * {wilson('(count(*) FILTER (WHERE ends))', 'count(*)', '-')}, 6) AS low FROM marked GROUP BY transcription""",
    "op113_paragraph_terminals": lambda d: """WITH w AS (SELECT transcription, page_id, par, line, idx, word, lag(word) OVER (PARTITION BY transcription, page_id, par ORDER BY line, idx) AS b1, lag(word, 2) OVER (PARTITION BY transcription, page_id, par ORDER BY line, idx) AS b2,
        row_number() OVER (PARTITION BY transcription, page_id, par ORDER BY line, idx) AS up, row_number() OVER (PARTITION BY transcription, page_id, par ORDER BY line DESC, idx DESC) AS down, row_number() OVER (PARTITION BY transcription, page_id, line ORDER BY idx DESC) AS in_line FROM tok)
        SELECT transcription, count(*) FILTER (WHERE down = 1 AND b1 IS NOT NULL) AS paragraphs, count(*) FILTER (WHERE down = 1 AND word = b1) AS terminal_doubles, count(*) FILTER (WHERE up = 2 AND word = b1) AS initial_doubles,
        count(*) FILTER (WHERE down = 1 AND word = b1 AND b1 = b2) AS terminal_triples, count(*) FILTER (WHERE in_line = 1 AND word = b1) AS line_doubles, round(1000e0 * count(*) FILTER (WHERE word = b1) / nullif(count(b1), 0), 6) AS running_per_1000 FROM w GROUP BY transcription""",
    "op114_modes_at_coverage": lambda d: """SELECT transcription, CAST(min(place) AS BIGINT) AS modes FROM (SELECT transcription, row_number() OVER (PARTITION BY transcription ORDER BY n DESC, word) AS place,
        sum(n) OVER (PARTITION BY transcription ORDER BY n DESC, word ROWS UNBOUNDED PRECEDING) AS acc, sum(n) OVER (PARTITION BY transcription) AS total FROM freq) q WHERE acc >= 0.9e0 * total GROUP BY transcription""",
    "op115_rate_with_interval": lambda d: f"SELECT hand, k, n, round(1000e0 * k / n, 6) AS per_1000, round(1000e0 * {wilson('k', 'n', '-')}, 6) AS low, round(1000e0 * {wilson('k', 'n', '+')}, 6) AS high FROM (SELECT hand, count(*) FILTER (WHERE word = before) AS k, count(*) AS n FROM pairs GROUP BY hand) q",
    "op116_doubling_decomposition": lambda d: """SELECT len, count(*) AS pairs, count(*) FILTER (WHERE first_same) AS same_unit, round(count(*) FILTER (WHERE word = before) / nullif(CAST(count(*) FILTER (WHERE first_same) AS DOUBLE), 0), 6) AS same_token_given_unit
        FROM (SELECT CAST(length(word) AS INTEGER) AS len, word, before, substr(word, 1, 2) = substr(before, 1, 2) AS first_same FROM pairs) q GROUP BY len""",
    "op107_stream_stats": lambda d: f"""WITH c AS (SELECT transcription, substr(word, CAST(i AS INTEGER), 1) AS ch FROM tok{d.each('i', '1', 'length(word)')}), n AS (SELECT transcription, ch, count(*) AS n FROM c GROUP BY transcription, ch),
        h AS (SELECT transcription, sum({entropy('n', 'total')}) AS h FROM (SELECT n.*, CAST(sum(n) OVER (PARTITION BY transcription) AS DOUBLE) AS total FROM n) q GROUP BY transcription)
        SELECT t.transcription, t.tokens, round(h, 6) AS char_entropy, t.short_share, t.doubling_per_1000 FROM h JOIN (SELECT transcription, count(*) AS tokens, round(avg(CASE WHEN length(word) <= 3 THEN 1e0 ELSE 0e0 END), 6) AS short_share,
        round(1000e0 * count(*) FILTER (WHERE word = before) / nullif(count(before), 0), 6) AS doubling_per_1000 FROM (SELECT transcription, word, lag(word) OVER (PARTITION BY transcription ORDER BY spot) AS before FROM seq) q GROUP BY transcription) t ON t.transcription = h.transcription""",
    # ---- entropy and stream metrics
    "op105_word_entropy": lambda d: f"SELECT transcription, round(sum({entropy('n', 'total')}), 6) AS bits FROM (SELECT transcription, n, CAST(sum(n) OVER (PARTITION BY transcription) AS DOUBLE) AS total FROM freq) q GROUP BY transcription",
    "op106_stream_metrics": lambda d: f"""WITH placed AS (SELECT transcription, n, row_number() OVER (PARTITION BY transcription ORDER BY n DESC, word) AS r FROM freq),
        zipf AS (SELECT transcription, regr_slope(ln(CAST(n AS DOUBLE)), ln(CAST(r AS DOUBLE))) AS slope FROM placed WHERE r <= 1000 GROUP BY transcription),
        types AS (SELECT transcription, count(*) AS types, count(*) FILTER (WHERE n = 1) AS hapax, CAST(sum(n) AS BIGINT) AS tokens FROM freq GROUP BY transcription),
        dbl AS (SELECT transcription, count(*) FILTER (WHERE word = before) AS doubles FROM (SELECT transcription, word, lag(word) OVER (PARTITION BY transcription ORDER BY spot) AS before FROM seq) q GROUP BY transcription),
        spaced AS (SELECT transcription, spot, word || ' ' || coalesce(substr(lead(word) OVER (PARTITION BY transcription ORDER BY spot), 1, 1), '') AS x, spot = max(spot) OVER (PARTITION BY transcription) AS final FROM seq),
        chars AS (SELECT transcription, substr(x, CAST(i AS INTEGER), 1) AS a, CASE WHEN final AND i >= length(x) - 1 THEN NULL ELSE substr(x, CAST(i AS INTEGER) + 1, 1) END AS b, final, i, length(x) AS m FROM spaced{d.each('i', '1', 'length(x)')}),
        kept AS (SELECT transcription, a, b FROM chars WHERE (final AND i <= m - 1) OR (NOT final AND i <= m - 1)),
        h1 AS (SELECT transcription, sum({entropy('n', 'total')}) AS h FROM (SELECT transcription, n, CAST(sum(n) OVER (PARTITION BY transcription) AS DOUBLE) AS total FROM (SELECT transcription, a, count(*) AS n FROM kept WHERE NOT (b IS NULL AND a = ' ') GROUP BY transcription, a) c) q GROUP BY transcription),
        h2 AS (SELECT transcription, sum({entropy('n', 'total')}) AS h FROM (SELECT transcription, n, CAST(sum(n) OVER (PARTITION BY transcription) AS DOUBLE) AS total FROM (SELECT transcription, a, b, count(*) AS n FROM kept WHERE b IS NOT NULL GROUP BY transcription, a, b) c) q GROUP BY transcription)
        SELECT t.transcription, t.tokens, t.types, round(t.types / CAST(t.tokens AS DOUBLE), 6) AS ttr, round(t.hapax / CAST(t.types AS DOUBLE), 6) AS hapax_share, round(slope, 6) AS zipf_slope, round(1000e0 * doubles / nullif(t.tokens - 1, 0), 6) AS doubling_per_1000,
        round(h1.h, 6) AS h1_bits, round(h2.h - h1.h, 6) AS h2_bits FROM types t JOIN zipf ON zipf.transcription = t.transcription JOIN dbl ON dbl.transcription = t.transcription JOIN h1 ON h1.transcription = t.transcription JOIN h2 ON h2.transcription = t.transcription""",
    # ---- lengths and transitions
    "op117_length_histogram": lambda d: "SELECT hand, CAST(least(len, 10) AS INTEGER) AS bin, count(*) AS n FROM lens WHERE hand IS NOT NULL GROUP BY hand, least(len, 10)",
    "op117_length_summary": lambda d: f"""SELECT hand, count(*) AS n, round(avg(CAST(len AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(len AS DOUBLE)), 6) AS sd, round({d.quantile('CAST(len AS DOUBLE)', '0.5e0')}, 6) AS median,
        round(avg(CASE WHEN len <= 3 THEN 1e0 ELSE 0e0 END), 6) AS short_share, round(avg(CASE WHEN len >= 7 THEN 1e0 ELSE 0e0 END), 6) AS long_share FROM lens WHERE hand IS NOT NULL GROUP BY hand""",
    "op118_transitions": lambda d: """SELECT hand, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, count(*) AS n FROM (SELECT hand, state AS a, lead(state) OVER (PARTITION BY transcription, page_id, line ORDER BY idx) AS b FROM lens) q
        WHERE b IS NOT NULL AND hand IS NOT NULL GROUP BY hand, a, b""",
    "op118_triples": lambda d: """SELECT hand, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(c AS INTEGER) AS c, count(*) AS n FROM (SELECT hand, state AS a, lead(state) OVER (PARTITION BY transcription, page_id, line ORDER BY idx) AS b,
        lead(state, 2) OVER (PARTITION BY transcription, page_id, line ORDER BY idx) AS c FROM lens) q WHERE c IS NOT NULL AND hand IS NOT NULL GROUP BY hand, a, b, c""",
    "op119_lift": lambda d: """WITH t AS (SELECT hand, a, b, count(*) AS n FROM (SELECT hand, state AS a, lead(state) OVER (PARTITION BY transcription, page_id, line ORDER BY idx) AS b FROM lens) q WHERE b IS NOT NULL AND hand IS NOT NULL GROUP BY hand, a, b)
        SELECT hand, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(n / CAST(sum(n) OVER (PARTITION BY hand, a) AS DOUBLE), 6) AS p_next,
        round((n / CAST(sum(n) OVER (PARTITION BY hand, a) AS DOUBLE)) / (sum(n) OVER (PARTITION BY hand, b) / CAST(sum(n) OVER (PARTITION BY hand) AS DOUBLE)), 6) AS lift FROM t""",
    "op120_mutual_information": lambda d: """WITH t AS (SELECT hand, a, b, CAST(count(*) AS DOUBLE) AS n FROM (SELECT hand, state AS a, lead(state) OVER (PARTITION BY transcription, page_id, line ORDER BY idx) AS b FROM lens) q WHERE b IS NOT NULL AND hand IS NOT NULL GROUP BY hand, a, b),
        m AS (SELECT hand, n, sum(n) OVER (PARTITION BY hand) AS total, sum(n) OVER (PARTITION BY hand, a) AS ra, sum(n) OVER (PARTITION BY hand, b) AS cb FROM t) SELECT hand, round(sum(n / total * log2(n * total / (ra * cb))), 6) AS bits FROM m GROUP BY hand""",
    "op162_lag1_autocorrelation": lambda d: """SELECT hand, round(corr(CAST(len AS DOUBLE), CAST(nxt AS DOUBLE)), 6) AS r, count(*) AS n FROM (SELECT hand, len, lead(len) OVER (PARTITION BY transcription, page_id, line ORDER BY idx) AS nxt,
        row_number() OVER (PARTITION BY transcription, page_id, line ORDER BY idx) AS k, row_number() OVER (PARTITION BY transcription, page_id, line ORDER BY idx DESC) AS back FROM lens) q WHERE k > 1 AND back > 2 AND hand IS NOT NULL GROUP BY hand""",
    "op163_variance_shares": lambda d: """WITH p AS (SELECT * FROM pagelen WHERE hand IS NOT NULL AND lang IS NOT NULL), g AS (SELECT p.*, sum(n * mean_len) OVER () / sum(n) OVER () AS grand, sum(n * mean_len) OVER (PARTITION BY lang) / sum(n) OVER (PARTITION BY lang) AS by_lang,
        sum(n * mean_len) OVER (PARTITION BY hand) / sum(n) OVER (PARTITION BY hand) AS by_hand, sum(n * mean_len) OVER (PARTITION BY hand, lang) / sum(n) OVER (PARTITION BY hand, lang) AS by_both FROM p)
        SELECT count(*) AS pages, round(sum(n * pow(by_lang - grand, 2)) / sum(n * pow(mean_len - grand, 2)), 6) AS language_share, round(sum(n * pow(by_hand - grand, 2)) / sum(n * pow(mean_len - grand, 2)), 6) AS hand_share, round(sum(n * pow(by_both - grand, 2)) / sum(n * pow(mean_len - grand, 2)), 6) AS both_share FROM g""",
    # ---- rare words
    "op121_doubletons": lambda d: "SELECT transcription, word, first_at, last_at FROM freq WHERE n = 2",
    "op122_gap_statistics": lambda d: f"""SELECT f.transcription, count(*) AS n, round({d.quantile('CAST(last_at - first_at AS DOUBLE)', '0.5e0')}, 6) AS median_gap, round(avg(log10(CAST(last_at - first_at AS DOUBLE))), 6) AS mean_log_gap,
        round(avg(CASE WHEN last_at - first_at <= 100 THEN 1e0 ELSE 0e0 END), 6) AS within_100, round(max((total * least(100e0, total - 1e0) - least(100e0, total - 1e0) * (least(100e0, total - 1e0) + 1) / 2) / (total * (total - 1e0) / 2)), 6) AS uniform_100
        FROM freq f JOIN size s ON s.transcription = f.transcription WHERE f.n = 2 GROUP BY f.transcription""",
    "op123_rare_by_class": lambda d: """SELECT transcription, CAST(n AS INTEGER) AS k, count(*) AS types, round(avg(CAST(span AS DOUBLE)), 6) AS mean_span, round(avg(CAST(pages AS DOUBLE)), 6) AS mean_pages
        FROM (SELECT transcription, word, n, max(spot) - min(spot) AS span, count(DISTINCT page_id) AS pages FROM rare GROUP BY transcription, word, n) q GROUP BY transcription, n""",
    "op124_rare_occurrences": lambda d: "SELECT transcription, word, page_id, spot FROM rare",
    "op125_burst_shape": lambda d: """WITH o AS (SELECT s.transcription, s.word, s.spot, f.n FROM seq s JOIN freq f ON f.transcription = s.transcription AND f.word = s.word WHERE f.n BETWEEN 3 AND 10),
        g AS (SELECT o.*, spot - lag(spot) OVER (PARTITION BY transcription, word ORDER BY spot) AS gap, row_number() OVER (PARTITION BY transcription, word ORDER BY spot) AS k FROM o)
        SELECT transcription, word, CAST(max(n) AS INTEGER) AS n, max(CASE WHEN k = 2 THEN gap END) AS first_gap, max(CASE WHEN k = n THEN gap END) AS last_gap, round((avg(CAST(spot AS DOUBLE)) - (min(spot) + max(spot)) / 2e0) / nullif(max(spot) - min(spot), 0), 6) AS skew FROM g GROUP BY transcription, word""",
    "op126_burst_summary": lambda d: """WITH o AS (SELECT s.transcription, s.word, s.spot, f.n FROM seq s JOIN freq f ON f.transcription = s.transcription AND f.word = s.word WHERE f.n BETWEEN 3 AND 10),
        g AS (SELECT o.*, spot - lag(spot) OVER (PARTITION BY transcription, word ORDER BY spot) AS gap, row_number() OVER (PARTITION BY transcription, word ORDER BY spot) AS k FROM o),
        b AS (SELECT transcription, word, max(n) AS n, max(CASE WHEN k = 2 THEN gap END) AS g1, max(CASE WHEN k = n THEN gap END) AS g2, (avg(CAST(spot AS DOUBLE)) - (min(spot) + max(spot)) / 2e0) / nullif(max(spot) - min(spot), 0) AS skew FROM g GROUP BY transcription, word)
        SELECT CAST(n AS INTEGER) AS k, count(*) AS types, round(avg(CASE WHEN g1 < g2 THEN 1e0 WHEN g1 = g2 THEN 0.5e0 ELSE 0e0 END), 6) AS front_share, round(avg(skew), 6) AS mean_skew, round(avg(skew) / nullif(stddev_samp(skew) / sqrt(CAST(count(*) AS DOUBLE)), 0), 5) AS t FROM b GROUP BY n HAVING count(*) > 2""",
    "op127_page_features": lambda d: """WITH top AS (SELECT word FROM (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS place FROM tok GROUP BY word) q WHERE place <= 60)
        SELECT page_id, 'word' AS feature, coalesce(top.word, 'OTHER') AS category, count(*) AS n FROM tok LEFT JOIN top ON top.word = tok.word GROUP BY page_id, coalesce(top.word, 'OTHER')
        UNION ALL SELECT page_id, 'first' AS feature, substr(word, 1, 1) AS category, count(*) AS n FROM tok GROUP BY page_id, substr(word, 1, 1)
        UNION ALL SELECT page_id, 'last' AS feature, substr(word, length(word), 1) AS category, count(*) AS n FROM tok GROUP BY page_id, substr(word, length(word), 1)""",
    "op128_top_differences": lambda d: """WITH s AS (SELECT hand, substr(word, 1, 1) AS category, count(*) AS n FROM tok WHERE hand IN ('1', '2') GROUP BY hand, substr(word, 1, 1)),
        p AS (SELECT category, sum(CASE WHEN hand = '1' THEN n ELSE 0 END) / CAST(max(t1) AS DOUBLE) AS a, sum(CASE WHEN hand = '2' THEN n ELSE 0 END) / CAST(max(t2) AS DOUBLE) AS b FROM s CROSS JOIN (SELECT sum(CASE WHEN hand = '1' THEN n ELSE 0 END) AS t1, sum(CASE WHEN hand = '2' THEN n ELSE 0 END) AS t2 FROM s) t GROUP BY category)
        SELECT category, round(a, 6) AS share_1, round(b, 6) AS share_2, round(a - b, 6) AS difference FROM p ORDER BY abs(round(a - b, 9)) DESC, category LIMIT 6""",
    "op135_sheet_affinity": lambda d: """SELECT transcription, quire, least(ba, bb) AS sheet_a, greatest(ba, bb) AS sheet_b, count(*) AS n FROM (SELECT r.transcription, a.quire, a.bifolio AS ba, b.bifolio AS bb FROM pairsrare r JOIN pg a ON a.page_id = r.page_a JOIN pg b ON b.page_id = r.page_b WHERE a.quire = b.quire AND a.bifolio IS NOT NULL AND b.bifolio IS NOT NULL) q
        GROUP BY transcription, quire, least(ba, bb), greatest(ba, bb)""",
    "op137_rare_pairs": lambda d: "SELECT transcription, word, page_a, page_b, at_a, at_b FROM pairsrare WHERE page_a <> page_b",
    "op138_leaf_categories": lambda d: "SELECT page_a, page_b, relation FROM leaves",
    "op139_leaf_counts": lambda d: """SELECT l.transcription, l.relation, count(*) AS n FROM pairsrare r JOIN leaves l ON l.page_a = least(r.page_a, r.page_b) AND l.page_b = greatest(r.page_a, r.page_b) GROUP BY l.transcription, l.relation""",
    "op140_page_affinity": lambda d: """SELECT transcription, page_a, page_b, count(*) AS shared_doubletons FROM (SELECT a.transcription, a.page_id AS page_a, b.page_id AS page_b FROM rare a JOIN rare b ON a.transcription = b.transcription AND a.word = b.word AND a.spot < b.spot WHERE a.n = 2) q
        WHERE page_a <> page_b GROUP BY transcription, page_a, page_b""",
    "op146_header_asof": lambda d: """WITH lines AS (SELECT transcription, page_id, line, 1 AS kind, min(word) AS first_word FROM tok GROUP BY transcription, page_id, line),
        mixed AS (SELECT transcription, page_id, CAST(0 AS INTEGER) AS line, 0 AS kind, page AS header, NULL AS first_word FROM pg UNION ALL SELECT transcription, page_id, line, kind, NULL AS header, first_word FROM lines),
        filled AS (SELECT m.*, count(header) OVER (PARTITION BY transcription ORDER BY page_id, kind, line ROWS UNBOUNDED PRECEDING) AS block FROM mixed m)
        SELECT transcription, page_id, line, max(header) OVER (PARTITION BY transcription, block) AS header, first_word, kind FROM filled""",
    "op094_pseudo_pages": lambda d: "SELECT transcription, CAST(floor(spot / 168) AS BIGINT) AS page, CAST(floor(floor(spot / 168) / 8) AS BIGINT) AS quire, count(*) AS tokens, min(word) AS least_word FROM seq GROUP BY transcription, floor(spot / 168), floor(floor(spot / 168) / 8)",
    "op093_ngram_stream": lambda d: f"SELECT transcription, page_id, gram, count(*) AS n FROM (SELECT transcription, page_id, {d.glue('word', '', 'line, idx')} AS x FROM tok GROUP BY transcription, page_id) p{d.grams('x', 3, 'pos', 'gram')} GROUP BY transcription, page_id, gram",
}
