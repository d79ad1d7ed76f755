"""Corpus building: records, duplicates, splits, manifests, windows, symbols."""

from __future__ import annotations

from scriptorium.plans.portable import entropy

# Share of training mass, floors of the split and the manifest.
QUOTA, CAP_FACTOR, CAP_FLOOR, LEAST_QUOTA, LOW_RESOURCE = 500_000, 1.5, 60_000, 200_000, 2_000_000
LETTERS = "abcdefghiklmnopqrstuvwxyz"
B = "CAST({} AS BIGINT)".format

OPS = {
    "op004_slug": lambda d: f"SELECT DISTINCT doc_id, lower({d.sub(d.sub('source_path', '[^A-Za-z0-9_]+', '_'), '^_+|_+$', '')}) AS slug FROM {d.t('doc_records')} WHERE doc_id IS NOT NULL",
    "op005_variant_selection": lambda d: f"""WITH named AS (SELECT DISTINCT source_path, {d.sub('source_path', '/[^/]*$', '')} AS parent, lower({d.sub('source_path', '^.*/', '')}) AS name FROM {d.t('doc_records')} WHERE substr(source_path, 1, 7) = 'legacy/'),
        placed AS (SELECT named.*, CASE WHEN name LIKE '%firstpass%' THEN 5 WHEN {d.match('name', '_edited[.]csv$')} THEN 0 WHEN name LIKE '%\\_lat1%' ESCAPE '\\' THEN 2 WHEN name LIKE '%\\_lat0%' ESCAPE '\\' THEN 3 WHEN name LIKE '%\\_v0%' ESCAPE '\\' THEN 4 ELSE 1 END AS variant FROM named),
        one AS (SELECT placed.*, row_number() OVER (PARTITION BY parent ORDER BY variant, name, source_path) AS k FROM placed) SELECT parent, source_path, CAST(variant AS INTEGER) AS variant FROM one WHERE k = 1""".replace("'%\\_lat1%' ESCAPE '\\'", "'%!_lat1%' ESCAPE '!'").replace("'%\\_lat0%' ESCAPE '\\'", "'%!_lat0%' ESCAPE '!'").replace("'%\\_v0%' ESCAPE '\\'", "'%!_v0%' ESCAPE '!'"),
    "op014_word_scan": lambda d: f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, word FROM (SELECT doc_id, lower(text) AS x FROM {d.t('documents')} WHERE doc_id IS NOT NULL) q{d.found('x', '[a-zà-öø-ÿ]+', 'pos', 'word')}",
    "op016_sentences": lambda d: f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, trim(val) AS sentence FROM (SELECT doc_id, {d.sub('text', '[.!?;:]+', '|')} AS x FROM {d.t('documents')}) q{d.parts('x', '[|]' if d.name == 'spark' else '|', 'pos', 'val')} WHERE trim(val) <> ''",
    "op017_blank_line_paragraphs": lambda d: f"""WITH l AS (SELECT doc_id, pos, {d.sub('val', '[ \t\r]+', ' ')} AS line FROM {d.t('documents')}{d.parts('text', chr(92) + 'n', 'pos', 'val')}),
        p AS (SELECT l.*, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS par FROM l)
        SELECT doc_id, {B('par')} AS par, count(*) AS lines, {B('sum(length(line))')} AS chars FROM p WHERE trim(line) <> '' GROUP BY doc_id, par""",
    "op019_stream_prefix": lambda d: f"""SELECT lang, length(stream) AS chars_all, {d.sha256('substr(stream, 1, 20000)')} AS prefix_sha FROM (SELECT lang, {d.glue('s', '', 'doc_id')} AS stream FROM
        (SELECT plain.*, sum(length(s)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM plain WHERE lang IS NOT NULL) q WHERE coalesce(before, 0) < 20000 GROUP BY lang) r""".replace("length(stream) AS chars_all", "CAST(length(stream) AS BIGINT) AS chars_all"),
    "op024_last_shard_wins": lambda d: "SELECT instance, presentation, head, hypothesis, window_len, cell_id FROM cells",
    "op028_manifest": lambda d: f"""SELECT lang, count(*) AS documents, {B('sum(length(s))')} AS chars, sum(length(s)) < {LOW_RESOURCE} AS low_resource, count(DISTINCT source) AS domains, {d.glue('source', ',', 'source')} AS domain_list
        FROM (SELECT lang, source, s, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS k FROM plain WHERE lang IS NOT NULL) q GROUP BY lang""".replace(d.glue("source", ",", "source"), f"count(CASE WHEN k = 1 THEN 1 END)").replace("AS domain_list", "AS domains_again"),
    "op029_split_files": lambda d: "SELECT lang, part, count(*) AS documents, CAST(sum(length(s)) AS BIGINT) AS chars FROM parted GROUP BY lang, part",
    "op033_resume_by_key": lambda d: f"""SELECT DISTINCT c.instance, c.head FROM {d.t('score_cells')} c LEFT JOIN (SELECT DISTINCT instance, head FROM {d.t('score_cells')} WHERE language_like) done ON done.instance = c.instance AND done.head = c.head WHERE done.instance IS NULL""",
    "op037_config_hash": lambda d: f"""SELECT run_name, substr({d.sha256("concat_ws('|', run_name, phase, CAST(seed AS STRING), corpus_version, coalesce(splits_version, ''), vocab_version, normalizer_version, CAST(seq_len AS STRING))")}, 1, 16) AS config_hash FROM {d.t('run_configs')}""",
    "op042_normalize_ascii": lambda d: f"SELECT doc_id, {d.sha256('s')} AS sha, CAST(length(s) AS BIGINT) AS kept FROM plain",
    "op043_accounting": lambda d: f"""SELECT lang, {B('sum(length(text))')} AS input_chars, {B('sum(length(text) - length(' + d.sub('text', '[A-Za-z]', '') + '))')} AS kept, {B('sum(length(text) - length(' + d.sub('text', '[ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r]', '') + '))')} AS whitespace, {B('sum(length(text) - length(' + d.sub('text', '[0-9.,;:!?()-]', '') + '))')} AS punct_digit
        FROM {d.t('documents')} GROUP BY lang""",
    "op045_encode": lambda d: f"SELECT doc_id, CAST(sum(instr('{LETTERS}', g) + 5) AS BIGINT) AS id_sum, CAST(sum((instr('{LETTERS}', g) + 5) * (pos + 1)) AS BIGINT) AS id_moment FROM plain{d.grams('s', 1, 'pos', 'g')} GROUP BY doc_id",
    "op046_decode": lambda d: f"SELECT doc_id, {d.sha256(d.sub('lower(text)', '[^a-ik-z]', ''))} AS text_sha FROM {d.t('documents')} WHERE doc_id IS NOT NULL AND length({d.sub('lower(text)', '[^a-ik-z]', '')}) > 0" if d.name == "spark" else f"""SELECT doc_id, {d.sha256(d.glue('ch', '', 'pos'))} AS text_sha FROM (SELECT doc_id, pos, substr('{LETTERS}', CAST(id - 5 AS INTEGER), 1) AS ch
        FROM (SELECT doc_id, pos, CASE WHEN instr('{LETTERS}', g) > 0 THEN instr('{LETTERS}', g) + 5 ELSE 2 END AS id FROM (SELECT doc_id, lower(text) AS s FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL) t{d.grams('s', 1, 'pos', 'g')}) q WHERE id BETWEEN 6 AND 30) r GROUP BY doc_id""",
    "op047_spec_hash": lambda d: f"SELECT {d.sha256(chr(39) + '[PAD]|[MASK]|[UNK]|[BOS]|[EOS]|[NULL]|' + LETTERS + chr(39))} AS spec",
    "op048_clean_line": lambda d: f"""SELECT transcription, page_id, line, {d.glue(d.sub("word", "[?]", ""), '.', 'idx')} AS line_text, CAST(sum(length(word) - length({d.sub('word', '[?]', '')})) AS BIGINT) AS dropped FROM alltok GROUP BY transcription, page_id, line""",
    "op058_norm_word": lambda d: f"SELECT word, count(*) AS n FROM (SELECT {d.sub('lower(val)', '[^a-z]', '')} AS word FROM {d.t('documents')}{d.parts('text', ' ', 'pos', 'val')}) q WHERE length(word) > 0 AND NOT {d.match('word', '^[ivxlcdm]+$')} GROUP BY word HAVING count(*) > 3",
    # ---- windows
    "op068_tiled_windows": lambda d: f"SELECT doc_id, lang, CAST(i AS BIGINT) AS win, {d.sha256('substr(s, CAST(i * 200 + 1 AS INTEGER), 200)')} AS sha FROM parted{d.each('i', '0', 'floor(length(s) / 200) - 1')} WHERE i <= floor(length(s) / 200) - 1",
    "op070_spaced_windows": lambda d: f"""WITH t AS (SELECT lang, doc_id, i, row_number() OVER (PARTITION BY lang ORDER BY doc_id, i) - 1 AS k, count(*) OVER (PARTITION BY lang) AS m FROM parted{d.each('i', '0', 'floor(length(s) / 200) - 1')} WHERE i <= floor(length(s) / 200) - 1)
        SELECT DISTINCT lang, doc_id, CAST(i AS BIGINT) AS win FROM t JOIN (SELECT j FROM (SELECT 1 AS one) z{d.each('j', '0', '15')}) g ON k = CAST(floor(j * (m - 1) / 15e0 + 0.5e0) AS BIGINT)""",
    "op071_window_slices": lambda d: f"SELECT transcription, CAST(i AS INTEGER) AS win, CAST(floor(i * (total - 200) / 3e0) AS BIGINT) AS a, CAST(floor(i * (total - 200) / 3e0) + 200 AS BIGINT) AS b FROM size{d.each('i', '0', '3')} WHERE total > 200",
    "op072_evaluator_windows": lambda d: f"SELECT transcription, CAST(i AS INTEGER) AS chunk, least(128, total - i * 128) AS chunk_len FROM size{d.each('i', '0', 'ceil(total / 128e0) - 1')} WHERE i <= ceil(total / 128e0) - 1 AND (least(128, total - i * 128) >= 64 OR total <= 128)".replace("least(128, total - i * 128) AS chunk_len", "CAST(least(128, total - i * 128) AS BIGINT) AS chunk_len"),
    "op073_symbols": lambda d: f"SELECT transcription, ch, CAST(dense_rank() OVER (PARTITION BY transcription ORDER BY ch) - 1 AS INTEGER) AS symbol, n FROM (SELECT transcription, g AS ch, count(*) AS n FROM tok{d.grams('word', 1, 'pos', 'g')} GROUP BY transcription, g) q",
    "op074_wordtype_presentation": lambda d: """WITH top AS (SELECT transcription, word, row_number() OVER (PARTITION BY transcription ORDER BY n DESC, first_at) - 1 AS symbol FROM freq), kept AS (SELECT * FROM top WHERE symbol < 50)
        SELECT s.transcription, count(k.symbol) AS kept_tokens, count(*) AS tokens, round(count(k.symbol) / CAST(count(*) AS DOUBLE), 6) AS word_coverage, round(sum(CASE WHEN k.symbol IS NOT NULL THEN length(s.word) ELSE 0 END) / CAST(sum(length(s.word)) AS DOUBLE), 6) AS char_coverage
        FROM seq s LEFT JOIN kept k ON k.transcription = s.transcription AND k.word = s.word GROUP BY s.transcription""",
    "op075_parseable_words": lambda d: "SELECT t.transcription, count(*) AS kept FROM tok t LEFT SEMI JOIN (SELECT word FROM tok GROUP BY word HAVING count(DISTINCT transcription) >= 3) p ON p.word = t.word GROUP BY t.transcription" if d.name == "spark" else "SELECT t.transcription, count(*) AS kept FROM tok t WHERE t.word IN (SELECT word FROM tok GROUP BY word HAVING count(DISTINCT transcription) >= 3) GROUP BY t.transcription",
    "op076_glyph_presentation": lambda d: f"""WITH g AS (SELECT transcription, page_id, line, idx, word, g AS glyph FROM tok{d.grams('word', 1, 'pos', 'g')}), top AS (SELECT glyph FROM (SELECT glyph, row_number() OVER (ORDER BY count(*) DESC, glyph) AS place FROM g GROUP BY glyph) q WHERE place <= 12),
        bad AS (SELECT DISTINCT g.transcription, g.page_id, g.line, g.idx FROM g LEFT JOIN top ON top.glyph = g.glyph WHERE top.glyph IS NULL)
        SELECT t.transcription, count(*) AS tokens, CAST(sum(length(t.word)) AS BIGINT) AS glyphs FROM tok t LEFT JOIN bad b ON b.transcription = t.transcription AND b.page_id = t.page_id AND b.line = t.line AND b.idx = t.idx WHERE b.idx IS NULL GROUP BY t.transcription""",
    "op077_length_filtered": lambda d: "SELECT transcription, spot, word, CAST(coalesce(sum(length(word)) OVER (PARTITION BY transcription ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS starts FROM seq WHERE length(word) BETWEEN 2 AND 6",
    "op078_unit_segmentation": lambda d: f"SELECT doc_id, count(*) AS units, count(*) FILTER (WHERE length(unit) = 2) AS bigrams FROM plain{d.found('s', 'll|ss|tt|nn|ee|.', 'pos', 'unit')} GROUP BY doc_id",
    "op079_unit_expansion": lambda d: (
        "WITH u AS (SELECT doc_id, s, replace(replace(replace(replace(replace(s, 'll', '0'), 'ss', '1'), 'tt', '2'), 'nn', '3'), 'ee', '4') AS units FROM plain WHERE length(s) > 0) SELECT doc_id, CAST(length(units) AS BIGINT) AS n_units, sha2(units, 256) AS unit_sha, replace(replace(replace(replace(replace(units, '0', 'll'), '1', 'ss'), '2', 'tt'), '3', 'nn'), '4', 'ee') = s AS restored FROM u"
        if d.name == "spark"
        else f"SELECT doc_id, count(*) AS n_units, {d.sha256(d.glue("CASE unit WHEN 'll' THEN '0' WHEN 'ss' THEN '1' WHEN 'tt' THEN '2' WHEN 'nn' THEN '3' WHEN 'ee' THEN '4' ELSE unit END", '', 'pos'))} AS unit_sha, {d.glue('unit', '', 'pos')} = min(s) AS restored FROM plain{d.found('s', 'll|ss|tt|nn|ee|.', 'pos', 'unit')} GROUP BY doc_id"
    ),
    "op080_unit_targets": lambda d: "SELECT lang, g, n, CAST(place AS INTEGER) AS place FROM (SELECT lang, g, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) AS place FROM c2 WHERE substr(g, 1, 1) = substr(g, 2, 1)) q WHERE place <= 5",
    "op081_key_projection": lambda d: """WITH t AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) + 24 AS unit FROM c2 WHERE substr(g, 1, 1) = substr(g, 2, 1)), k AS (SELECT * FROM t WHERE unit < 30)
        SELECT a.g, a.lang AS from_lang, l.lang AS to_lang, CAST(coalesce(b.unit, instr('abcdefghiklmnopqrstuvwxyz', substr(a.g, 1, 1)) - 1) AS BIGINT) AS unit FROM k a CROSS JOIN langs l LEFT JOIN k b ON b.lang = l.lang AND b.g = a.g""",
    "op082_adjacency": lambda d: "SELECT transcription, count(*) FILTER (WHERE spot = prev + 1) AS adjacent, count(*) AS kept FROM (SELECT transcription, spot, lag(spot) OVER (PARTITION BY transcription ORDER BY spot) AS prev FROM seq WHERE length(word) >= 6) q GROUP BY transcription",
    "op083_repeats": lambda d: "SELECT transcription, spot FROM (SELECT transcription, spot, word, lag(spot) OVER (PARTITION BY transcription ORDER BY spot) AS prev, lag(word) OVER (PARTITION BY transcription ORDER BY spot) AS before FROM seq WHERE length(word) >= 6) q WHERE spot = prev + 1 AND word = before",
    "op084_rule_violations": lambda d: "SELECT transcription, count(*) FILTER (WHERE spot = prev + 1 AND unit = prev_unit AND word <> before) AS violations FROM (SELECT transcription, spot, word, substr(word, 1, 2) AS unit, lag(spot) OVER w AS prev, lag(word) OVER w AS before, lag(substr(word, 1, 2)) OVER w AS prev_unit FROM seq WINDOW w AS (PARTITION BY transcription ORDER BY spot)) q GROUP BY transcription",
    "op085_decode": lambda d: f"""WITH k AS (SELECT {d.glue('g', '', 'place')} AS symbols FROM (SELECT g, row_number() OVER (ORDER BY count(*) DESC, g) AS place FROM tok{d.grams('word', 1, 'pos', 'g')} GROUP BY g) q)
        SELECT transcription, page_id, line, idx, translate(word, symbols, substr('etaoinsrhldcumfpgwybvkxqz', 1, CAST(length(symbols) AS INTEGER))) AS decoded FROM tok CROSS JOIN k""",
    "op086_token_parse": lambda d: f"""WITH pre AS (SELECT substr(word, 1, 3) AS x FROM tok WHERE length(word) >= 5 GROUP BY substr(word, 1, 3) HAVING count(DISTINCT word) >= 5), suf AS (SELECT substr(word, 4) AS x FROM tok WHERE length(word) >= 5 GROUP BY substr(word, 4) HAVING count(DISTINCT word) >= 5),
        words AS (SELECT DISTINCT word FROM tok), cut AS (SELECT word, substr(word, 1, CAST(i AS INTEGER)) AS a, substr(word, CAST(i AS INTEGER) + 1) AS b FROM words{d.each('i', '1', 'length(word) - 1')} WHERE i <= length(word) - 1)
        SELECT w.word, count(pre.x) AS parses FROM words w LEFT JOIN cut ON cut.word = w.word LEFT JOIN suf ON suf.x = cut.b LEFT JOIN pre ON pre.x = cut.a AND suf.x IS NOT NULL GROUP BY w.word""",
    "op088_null_frame": lambda d: "SELECT transcription, page_id, CAST(count(*) * 2 AS BIGINT) AS slots, count(*) FILTER (WHERE length(word) % 2 = 1) AS nulls FROM tok GROUP BY transcription, page_id",
    "op090_true_runs": lambda d: """WITH f AS (SELECT transcription, page_id, line, idx, length(word) >= 7 AS flag, row_number() OVER (PARTITION BY transcription ORDER BY page_id, line, idx) - row_number() OVER (PARTITION BY transcription, length(word) >= 7 ORDER BY page_id, line, idx) AS island FROM tok)
        SELECT transcription, CAST(run AS INTEGER) AS run, count(*) AS n FROM (SELECT transcription, island, count(*) AS run FROM f WHERE flag GROUP BY transcription, island) q GROUP BY transcription, run""",
    "op091_shuffled_window": lambda d: f"SELECT transcription, page_id, {d.sha256(d.glue('word', '.', 'h, line, idx'))} AS shuffled_sha FROM (SELECT transcription, page_id, line, idx, word, md5(concat_ws('|', '7', CAST(page_id AS STRING), CAST(line AS STRING), CAST(idx AS STRING))) AS h FROM tok) q GROUP BY transcription, page_id",
    "op092_shuffle_within_mask": lambda d: """WITH m AS (SELECT transcription, page_id, spot, word, length(word) >= 7 AS seen, md5(concat_ws('|', '8', CAST(spot AS STRING), transcription)) AS h FROM seq), r AS (SELECT m.*, row_number() OVER (PARTITION BY transcription, page_id, seen ORDER BY spot) AS i, row_number() OVER (PARTITION BY transcription, page_id, seen ORDER BY h, spot) AS j FROM m)
        SELECT a.transcription, a.page_id, a.spot, b.word AS shuffled FROM r a JOIN r b ON a.transcription = b.transcription AND a.page_id = b.page_id AND a.seen = b.seen AND a.i = b.j""",
    "op095_lay_text": lambda d: """WITH slots AS (SELECT transcription, page_id, n, sum(n) OVER (PARTITION BY transcription ORDER BY md5(CAST(page_id AS STRING)), page_id ROWS UNBOUNDED PRECEDING) AS hi FROM pagelen)
        SELECT s.transcription, s.page_id, count(*) AS words, min(t.word) AS least_word FROM slots s JOIN seq t ON t.transcription = s.transcription AND t.spot >= s.hi - s.n AND t.spot < s.hi GROUP BY s.transcription, s.page_id""",
    "op096_symbol_error_rate": lambda d: "SELECT transcription, page_id, line, idx, round(CASE WHEN length(word) = 0 THEN (CASE WHEN length(before) > 0 THEN 1e0 ELSE 0e0 END) ELSE levenshtein(before, word) / CAST(length(word) AS DOUBLE) END, 6) AS ser FROM pairs",
    "op097_positional_error": lambda d: "SELECT transcription, page_id, line, round(avg(CASE WHEN substr(word, 1, 1) <> substr(before, 1, 1) THEN 1e0 ELSE 0e0 END), 6) AS ser FROM pairs GROUP BY transcription, page_id, line",
    # ---- joins and selection
    "op098_exact_duplicates": lambda d: f"SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang, {d.sha256('s')} ORDER BY doc_id) AS k FROM plain WHERE lang IS NOT NULL AND length(s) > 0) q WHERE k = 1",
    "op141_train_anti_join": lambda d: "SELECT p.doc_id FROM plain p LEFT JOIN (SELECT doc_id FROM parted WHERE part = 'heldout') h ON h.doc_id = p.doc_id WHERE h.doc_id IS NULL AND p.lang IS NOT NULL",
    "op148_temperature_weights": lambda d: "SELECT lang, round(pow(n, 0.7e0) / sum(pow(n, 0.7e0)) OVER (), 6) AS weight FROM (SELECT lang, CAST(sum(length(s)) AS DOUBLE) AS n FROM plain WHERE lang IS NOT NULL GROUP BY lang) q",
    "op149_greedy_quota": lambda d: f"""WITH t AS (SELECT plain.*, CAST(length(s) AS DOUBLE) AS n, sum(CAST(length(s) AS DOUBLE)) OVER (PARTITION BY lang) AS total, sum(CAST(length(s) AS DOUBLE)) OVER (PARTITION BY lang, source) AS dom, md5(concat_ws('|', '20260818', CAST(doc_id AS STRING))) AS h FROM plain WHERE lang IS NOT NULL AND source IS NOT NULL),
        q AS (SELECT t.*, {QUOTA}e0 * dom / total AS quota FROM t), c AS (SELECT * FROM q WHERE n <= greatest({CAP_FACTOR}e0 * quota, {CAP_FLOOR}e0)),
        r AS (SELECT c.*, coalesce(sum(n) OVER (PARTITION BY lang, source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS before FROM c),
        picked AS (SELECT lang, source, doc_id, n FROM r WHERE before < quota), got AS (SELECT l.lang, coalesce(sum(p.n), 0e0) AS n FROM (SELECT DISTINCT lang FROM t) l LEFT JOIN picked p ON p.lang = l.lang GROUP BY l.lang),
        rest AS (SELECT t.lang, t.source, t.doc_id, g.n AS got, coalesce(sum(t.n) OVER (PARTITION BY t.lang ORDER BY t.n, t.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS before FROM t JOIN got g ON g.lang = t.lang LEFT JOIN picked p ON p.doc_id = t.doc_id WHERE p.doc_id IS NULL AND g.n < {LEAST_QUOTA}e0)
        SELECT lang, source, doc_id, 'quota' AS why FROM picked UNION ALL SELECT lang, source, doc_id, 'floor' AS why FROM rest WHERE got + before < {LEAST_QUOTA}e0""",
    "op155_symbols_by_count": lambda d: f"SELECT transcription, ch, n, CAST(row_number() OVER (PARTITION BY transcription ORDER BY n DESC, ch) AS INTEGER) AS place FROM (SELECT transcription, g AS ch, count(*) AS n FROM tok{d.grams('word', 1, 'pos', 'g')} GROUP BY transcription, g) q",
    "op156_coverage_mask": lambda d: f"SELECT transcription, ch FROM (SELECT q.*, coalesce(sum(n) OVER (PARTITION BY transcription ORDER BY n DESC, ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY transcription) AS total FROM (SELECT transcription, g AS ch, count(*) AS n FROM tok{d.grams('word', 1, 'pos', 'g')} GROUP BY transcription, g) q) r WHERE before < 0.8e0 * total",
    "op221_pooled_counts": lambda d: "SELECT g, round(sum(n * least_total / total), 4) AS n FROM (SELECT c.g, c.n, t.total, min(t.total) OVER () AS least_total FROM c2 c JOIN (SELECT lang, CAST(sum(n) AS DOUBLE) AS total FROM c1 GROUP BY lang) t ON t.lang = c.lang) q GROUP BY g",
    "op232_letter_positions": lambda d: f"SELECT transcription, spot, CAST(pos AS INTEGER) AS pos, g AS letter FROM (SELECT s.transcription, s.spot, s.word FROM seq s JOIN freq f ON f.transcription = s.transcription AND f.word = s.word WHERE f.n = 1) q{d.grams('word', 1, 'pos', 'g')}",
    "op235_oracle_type_key": lambda d: """WITH c AS (SELECT transcription, word, substr(nxt, 1, 1) AS letter, count(*) AS n FROM (SELECT transcription, word, lead(word) OVER (PARTITION BY transcription ORDER BY spot) AS nxt FROM seq) q WHERE nxt IS NOT NULL GROUP BY transcription, word, substr(nxt, 1, 1))
        SELECT transcription, round(sum(top) / CAST(sum(total) AS DOUBLE), 6) AS ceiling, count(*) FILTER (WHERE kinds > 1) AS colliding FROM (SELECT transcription, word, max(n) AS top, sum(n) AS total, count(*) AS kinds FROM c GROUP BY transcription, word) r GROUP BY transcription""",
    "op239_marked_body": lambda d: f"SELECT doc_id, CASE WHEN instr(text, chr(10)) > 0 THEN CAST(length(substr(text, instr(text, chr(10)) + 1)) AS BIGINT) ELSE CAST(length(text) AS BIGINT) END AS body_chars FROM {d.t('documents')}",
    "op242_decode_excerpts": lambda d: f"SELECT transcription, page_id, {d.glue('word', '.', 'line, idx')} AS excerpt FROM (SELECT tok.*, sum(length(word)) OVER (PARTITION BY transcription, page_id ORDER BY line, idx ROWS UNBOUNDED PRECEDING) AS upto FROM tok) q WHERE upto <= 120 GROUP BY transcription, page_id",
    "op012_glyph_lists": lambda d: f"SELECT t.transcription, coalesce(t.lang, p.lang) AS dialect, count(*) AS words, CAST(sum({d.times('word', 'c[tkpf]h|ch|sh|[a-z]')}) AS BIGINT) AS glyphs FROM tok t LEFT JOIN pg p ON p.page_id = t.page_id GROUP BY t.transcription, coalesce(t.lang, p.lang)",
    "op013_block_text_words": lambda d: f"SELECT doc_id, count(*) AS words FROM (SELECT doc_id, lower(val) AS line FROM {d.t('documents')}{d.parts('text', chr(92) + 'n', 'pos', 'val')} WHERE length(val) >= 40) q{d.found('line', '[a-zà-öø-ÿ]+', 'k', 'word')} GROUP BY doc_id",
    "op248_grouping_by_key": lambda d: "SELECT lang, illus, count(*) AS n FROM tok GROUP BY GROUPING SETS ((lang), (illus), (lang, illus))",
}
