"""The filter interaction audit in DuckDB SQL, for the oracle."""
from __future__ import annotations

from assaykit.llm import filter_audit as a


def sql() -> str:
    bits = "CASE letter " + " ".join(f"WHEN '{c}' THEN {1 << i}" for i, c in enumerate(a.LETTERS)) + " END"
    letters = ", ".join(f"('{c}')" for c in a.LETTERS)
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
  list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
first AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
told AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(w) < {a.LEAST_WORDS} THEN 1 ELSE 0 END
  + CASE WHEN 100 * len(list_distinct(w)) < {a.LEAST_DISTINCT} * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {a.MOST_CAPITALS} * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '{a.SYMBOLS}') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM d JOIN first USING (t) LEFT JOIN told USING (doc_id)),
l(letter) AS (VALUES {letters}),
o(filter_order) AS (SELECT letter FROM l UNION ALL SELECT filter_order || letter FROM o, l WHERE strpos(filter_order, letter) = 0),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before
  FROM o, (SELECT unnest(range(1, {len(a.LETTERS) + 1})) AS step) WHERE length(filter_order) = {len(a.LETTERS)}),
b AS (SELECT s.filter_order, s.step, s.letter, {bits} AS bit,
  (SELECT coalesce(sum({bits}), 0) FROM l WHERE strpos(s.before, l.letter) > 0) AS applied FROM s),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
r AS (SELECT part, filter_order, step, letter,
  sum(CASE WHEN mask & (applied | bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & applied = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & applied > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & applied = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & applied = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, b GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r"""
