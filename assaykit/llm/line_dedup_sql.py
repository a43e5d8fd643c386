"""Line dedup in DuckDB SQL, for the oracle (documents with distinct ids)."""
from __future__ import annotations

from assaykit.llm.line_dedup import MIN_LINE_WORDS, MIN_RUN_WORDS

_WS = "[\\x20\\x09-\\x0D]"


def sql(least: int = MIN_RUN_WORDS, line: int = MIN_LINE_WORDS) -> str:
    return f"""
WITH s AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, i, list_filter(string_split_regex(x, '{_WS}+'), lambda v: v <> '') AS w FROM s),
l AS (SELECT doc_id, i, len(w) AS n, array_to_string(w, ' ') AS k, row_number() OVER o AS j, sum(len(w)) OVER o AS upto
  FROM t WHERE len(w) > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT a.doc_id, a.j AS a, b.j AS b FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.j >= a.j AND b.upto - a.upto + a.n >= {least}),
w AS (SELECT doc_id, a, min(b) AS b FROM r GROUP BY doc_id, a UNION SELECT doc_id, max(a), b FROM r GROUP BY doc_id, b
  UNION SELECT doc_id, j, j FROM l WHERE n >= {line}),
c AS (SELECT w.doc_id, a, b, string_agg(k, chr(10) ORDER BY j) AS content, min(i) AS first, max(i) AS last
  FROM w JOIN l ON l.doc_id = w.doc_id AND l.j BETWEEN w.a AND w.b GROUP BY w.doc_id, a, b),
later AS (SELECT doc_id, first, last FROM (SELECT *, min((doc_id, a)) OVER (PARTITION BY content) AS origin FROM c) WHERE origin <> (doc_id, a)),
gone AS (SELECT doc_id, list(DISTINCT i) AS lines FROM (SELECT doc_id, unnest(range(first, last + 1)) AS i FROM later) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_deleted,
  CASE WHEN lines IS NULL THEN text ELSE
    array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(lines, i - 1)), chr(10)) END AS text
FROM documents d LEFT JOIN gone USING (doc_id)"""
