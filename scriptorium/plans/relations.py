"""Relations shared by the statements: cleaned tokens, pages, texts and cells.

Repeated rows are merged by key; rows with nulls in a key are left out; "?" and null
attributes stay null.
"""

from __future__ import annotations

# Spellings of language labels.
LABELS = {
    "latin": ("la", "lat", "latin", "latino", "latein"),
    "italian": ("it", "ita", "itit", "italian", "italiano"),
    "german": ("de", "deu", "ger", "dede", "german", "deutsch"),
    "french": ("fr", "fra", "fre", "frfr", "french", "francais"),
}


def language(d, x: str) -> str:
    bare = d.sub(f"lower({x})", "[^a-z]", "")
    return "CASE " + " ".join(f"WHEN {bare} IN {v!r} THEN '{k}'" for k, v in LABELS.items()) + " END"


def _scored_sql(d) -> str:
    """Scores by joins: the grams of each held-out text against counts and contexts of each order."""
    heads = " UNION ALL ".join(f"SELECT doc_id, lang, substr(s, 1, {k}) AS g FROM parted WHERE part = 'heldout' AND length(s) >= {k}" for k in range(1, 5))
    asked = f"SELECT doc_id, lang AS truth, g, count(*) AS n FROM (SELECT doc_id, lang, g FROM parted{d.grams('s', 5, 'pos', 'g')} WHERE part = 'heldout' UNION ALL {heads}) q GROUP BY doc_id, lang, g"
    joins = "".join(
        f" LEFT JOIN ctx{k} x{k} ON x{k}.lang = l.lang AND x{k}.ctx = substr(a.g, length(a.g) - {k - 1}, {k - 1}) AND length(a.g) >= {k}"
        f" LEFT JOIN w{k} ON w{k}.lang = l.lang AND w{k}.g = substr(a.g, length(a.g) - {k - 1}, {k}) AND length(a.g) >= {k}"
        for k in range(2, 6)
    )
    p = "p1"
    for k in range(2, 6):
        p = f"CASE WHEN b{k} IS NULL THEN {p} ELSE (n{k} + t{k} * ({p})) / (b{k} + t{k}) END"
    columns = "".join(f", x{k}.big AS b{k}, x{k}.kinds AS t{k}, coalesce(w{k}.n, 0) AS n{k}" for k in range(2, 6))
    return f"""SELECT doc_id, truth, lang, sum(n) AS len, -sum(n * log2({p})) / sum(n) AS bits, -sum(n * log2(p1)) / sum(n) AS bits1 FROM (
        SELECT a.doc_id, a.truth, l.lang, a.g, a.n, coalesce(w1.p, 1 / (t.total + 25e0)) AS p1{columns}
        FROM ({asked}) a CROSS JOIN langs l JOIN (SELECT lang, max(total) AS total FROM w1 GROUP BY lang) t ON t.lang = l.lang
        LEFT JOIN w1 ON w1.lang = l.lang AND w1.g = substr(a.g, length(a.g), 1){joins}) q GROUP BY doc_id, truth, lang"""


RELATIONS = {
    # Every token of a transcription with a readable word.
    "tok": lambda d: f"""SELECT transcription, page_id, line, idx, min(par) AS par, min(word) AS word, min(nullif(hand, '?')) AS hand,
        min(nullif(lang, '?')) AS lang, min(nullif(illus, '?')) AS illus FROM {d.t('folio_tokens')}
        WHERE transcription IS NOT NULL AND page_id IS NOT NULL AND line IS NOT NULL AND idx IS NOT NULL AND {d.match('word', '^[a-z]+$')}
        GROUP BY transcription, page_id, line, idx""",
    # All tokens, unreadable ones too.
    "alltok": lambda d: f"""SELECT transcription, page_id, line, idx, min(par) AS par, min(word) AS word, min(nullif(hand, '?')) AS hand,
        min(nullif(lang, '?')) AS lang, max(CASE WHEN uncertain THEN 1 ELSE 0 END) AS unsure FROM {d.t('folio_tokens')}
        WHERE transcription IS NOT NULL AND page_id IS NOT NULL AND line IS NOT NULL AND idx IS NOT NULL AND word IS NOT NULL
        GROUP BY transcription, page_id, line, idx""",
    "seq": lambda d: "SELECT tok.*, CAST(row_number() OVER (PARTITION BY transcription ORDER BY page_id, line, idx) - 1 AS BIGINT) AS spot FROM tok",
    "pg": lambda d: f"""SELECT page_id, min(transcription) AS transcription, min(page) AS page, min(page_idx) AS page_idx, min(nullif(quire, '?')) AS quire,
        min(bifolio) AS bifolio, min(nullif(lang, '?')) AS lang, min(nullif(section, '?')) AS section, min(nullif(hand, '?')) AS hand
        FROM {d.t('folio_pages')} WHERE page_id IS NOT NULL GROUP BY page_id""",
    # Texts reduced to a-z without j, by ASCII folding.
    "plain": lambda d: f"""SELECT doc_id, source, {language(d, 'lang')} AS lang, {d.sub("replace(lower(text), 'j', 'i')", '[^a-z]', '')} AS s
        FROM {d.t('documents')} WHERE doc_id IS NOT NULL AND text IS NOT NULL""",
    # A tenth of the texts of each language, by hash, is held out.
    "parted": lambda d: f"""SELECT doc_id, lang, s, CASE WHEN {d.u("'split'", 'CAST(doc_id AS STRING)')} < 0.1e0 THEN 'heldout' ELSE 'train' END AS part
        FROM plain WHERE lang IS NOT NULL AND length(s) > 0""",
    "langs": lambda d: "SELECT * FROM (VALUES ('latin', 0, 'romance'), ('italian', 1, 'romance'), ('german', 2, 'germanic'), ('french', 3, 'romance')) AS v(lang, pos, family)",
    # Counts of runs of 1 to 5 letters in the training texts, and scores of the held-out
    # texts: one pass each on Spark (operators/ngrams), written out in SQL on DuckDB.
    "grams": lambda d: d.t("grams_") if d.name == "spark" else "SELECT * FROM (" + " UNION ALL ".join(f"SELECT lang, CAST({k} AS INTEGER) AS k, g, CAST(count(*) AS BIGINT) AS n FROM parted{d.grams('s', k, 'pos', 'g')} WHERE part = 'train' GROUP BY lang, g" for k in range(1, 6)) + ") q",
    **{f"c{k}": (lambda d, k=k: f"SELECT lang, g, n FROM {'{grams_}' if d.name == 'spark' else 'grams'} WHERE k = {k}") for k in range(1, 6)},
    "w1": lambda d: "SELECT lang, g, (n + 1) / (sum(n) OVER (PARTITION BY lang) + 25e0) AS p, sum(n) OVER (PARTITION BY lang) AS total FROM c1",
    **{f"w{k}": (lambda d, k=k: f"SELECT lang, g, n, sum(n) OVER (PARTITION BY lang, substr(g, 1, {k - 1})) AS big, count(*) OVER (PARTITION BY lang, substr(g, 1, {k - 1})) AS kinds FROM c{k}") for k in range(2, 6)},
    **{f"ctx{k}": (lambda d, k=k: f"SELECT DISTINCT lang, substr(g, 1, {k - 1}) AS ctx, big, kinds FROM w{k}") for k in range(2, 6)},
    "scored": lambda d: "SELECT * FROM {scored_}" if d.name == "spark" else _scored_sql(d),
    "ranked": lambda d: """SELECT scored.*, row_number() OVER (PARTITION BY doc_id ORDER BY round(bits, 9), lang) AS place,
        lead(bits) OVER (PARTITION BY doc_id ORDER BY round(bits, 9), lang) AS next_bits FROM scored""",
    # Cells by key, the latest load wins.
    "cells": lambda d: f"""SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY instance, presentation, head, hypothesis, window_len ORDER BY loaded_at DESC, cell_id DESC) AS latest
        FROM {d.t('score_cells')} c WHERE instance IS NOT NULL AND presentation IS NOT NULL AND head IS NOT NULL AND hypothesis IS NOT NULL AND total_per_all_symbols IS NOT NULL) q WHERE latest = 1""",
    "kinds": lambda d: f"SELECT DISTINCT instance, substr(instance, 1, instr(instance, '_') - 1) AS kind FROM {d.t('score_cells')} WHERE instance IS NOT NULL",
    # What the model of a language gains over single letters on held-out texts, with the error of the mean.
    "calib": lambda d: "SELECT truth AS lang, count(*) AS n, avg(bits1 - bits) AS offset_bits, stddev_samp(bits1 - bits) / sqrt(CAST(count(*) AS DOUBLE)) AS offset_sem FROM scored WHERE lang = truth GROUP BY truth",
    "freq": lambda d: "SELECT transcription, word, count(*) AS n, min(spot) AS first_at, max(spot) AS last_at FROM seq GROUP BY transcription, word",
    "size": lambda d: "SELECT transcription, count(*) AS total FROM tok GROUP BY transcription",
    "pairs": lambda d: "SELECT * FROM (SELECT transcription, page_id, line, idx, hand, lang, word, lag(word) OVER (PARTITION BY transcription, page_id, line ORDER BY idx) AS before FROM tok) q WHERE before IS NOT NULL",
    "lens": lambda d: "SELECT transcription, page_id, line, idx, hand, lang, word, length(word) AS len, least(length(word), 7) AS state FROM tok",
    "rare": lambda d: "SELECT seq.transcription, seq.word, seq.page_id, seq.spot, freq.n FROM seq JOIN freq ON freq.transcription = seq.transcription AND freq.word = seq.word WHERE freq.n BETWEEN 2 AND 5",
    "pairsrare": lambda d: "SELECT a.transcription, a.word, a.page_id AS page_a, b.page_id AS page_b, a.spot AS at_a, b.spot AS at_b FROM rare a JOIN rare b ON a.transcription = b.transcription AND a.word = b.word AND a.spot < b.spot",
    "leaves": lambda d: """SELECT a.page_id AS page_a, b.page_id AS page_b, a.transcription, a.quire, CASE WHEN a.bifolio = b.bifolio THEN 'conjugate'
        WHEN abs(a.bifolio - b.bifolio) = 1 THEN 'nested' ELSE 'other' END AS relation FROM pg a JOIN pg b ON a.transcription = b.transcription AND a.quire = b.quire
        AND a.page_idx < b.page_idx WHERE a.bifolio IS NOT NULL AND b.bifolio IS NOT NULL""",
    "pagelen": lambda d: "SELECT transcription, page_id, count(*) AS n, avg(CAST(length(word) AS DOUBLE)) AS mean_len, min(hand) AS hand, min(lang) AS lang FROM tok GROUP BY transcription, page_id",
}
