"""DuckDB SQL for queries of this subpackage that SQL can express in reasonable time."""

_LINES = """
lines AS (
  SELECT doc_id, source, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)),
keyed AS (
  SELECT doc_id, source, line_no, line, trim(regexp_replace(regexp_replace(lower(line), '\\p{Nd}+', ' 0 ', 'g'), '[^\\p{L}0]+', ' ', 'g')) AS k FROM lines),
sized AS (SELECT source, count(DISTINCT doc_id) AS of_docs FROM documents WHERE source IS NOT NULL GROUP BY 1),
often AS (
  SELECT keyed.source, k FROM keyed JOIN sized USING (source)
  WHERE len(regexp_extract_all(k, '\\p{L}+')) >= 5
  GROUP BY keyed.source, k, of_docs HAVING count(DISTINCT doc_id) >= 4 AND count(DISTINCT doc_id) >= 0.15 * of_docs)
"""

ORACLE = {
    "p1_found": f"WITH {_LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM keyed JOIN often USING (source, k)",
    "p1_clean": f"""WITH {_LINES},
marked AS (SELECT keyed.doc_id, keyed.line_no, keyed.line, often.k IS NOT NULL AS gone FROM keyed LEFT JOIN often USING (source, k)),
merged AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS clean, CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS n_removed FROM marked GROUP BY doc_id)
SELECT d.doc_id, d.source, CASE WHEN m.doc_id IS NULL THEN d.text ELSE m.clean END AS text, coalesce(m.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN merged m USING (doc_id)""",
}
