"""The quality rules in DuckDB SQL, for the oracle."""
from __future__ import annotations

from assaykit.llm import quality as q

_WS = "[\\x20\\x09-\\x0D]"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _distances(good: str, out: str) -> str:
    """CTEs ending in ``out`` (rid, cd, wd): distances to the references of ``good``."""
    return f"""
{out}_n AS (SELECT lang, sum(n_words) AS n FROM {good} GROUP BY lang),
{out}_r AS (SELECT lang, kind, i, sum(v) AS v FROM {good} JOIN h USING (rid) GROUP BY ALL),
{out}_t AS (SELECT lang, kind, sum(v) AS t FROM {out}_r GROUP BY ALL),
{out}_p AS (SELECT m.rid, h.kind, CAST(h.v AS DOUBLE) / CASE h.kind WHEN 'c' THEN m.n_chars ELSE m.n_words END AS p,
            CAST(r.v AS DOUBLE) / t.t AS q
  FROM m JOIN h USING (rid) JOIN {out}_r r ON r.lang IS NOT DISTINCT FROM m.lang AND r.kind = h.kind AND r.i = h.i
  JOIN {out}_t t ON t.lang IS NOT DISTINCT FROM m.lang AND t.kind = h.kind
  JOIN {out}_n n ON n.lang IS NOT DISTINCT FROM m.lang WHERE m.n_words >= {q.MIN_WORDS} AND n.n >= {q.MIN_REFERENCE}),
{out}_d AS (SELECT rid, kind, sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
            + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))) AS d FROM {out}_p GROUP BY ALL),
{out} AS (SELECT rid, max(d) FILTER (kind = 'c') AS cd, max(d) FILTER (kind = 'w') AS wd FROM {out}_d GROUP BY rid)"""


def sql() -> str:
    named = "CASE lang " + " ".join(f"WHEN '{code}' THEN list_transform({_list(c)}, lambda c: len(list_filter(w, lambda x: x = c)))" for code, c in q.COMMON.items()) + " ELSE [] END"
    kinds = ["[a-z]", "[A-Z]", "[0-9]", _WS, "[#*$%&|<>]", None, "[^\\x00-\\x7F]"]
    counts = [f"length(regexp_replace(t, '[^{k[1:-1]}]', '', 'g'))" if k and k[1] != "^" else None for k in kinds]
    counts[6] = "length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g'))"
    known = " + ".join(c for c in counts if c)
    counts[5] = f"(length(t) - ({known}))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t,
  list_filter(string_split_regex(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{_WS[1:]}')) AS ls FROM documents),
p AS (SELECT rid, w, unnest(range(1, len(w) - {q.WINDOW - 2})) AS i FROM d),
k AS (SELECT rid, i, array_to_string(w[i:i + {q.WINDOW - 1}], ' ') AS k FROM p),
f AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM k) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM f, (SELECT unnest(range(0, {q.WINDOW})) AS o) GROUP BY rid),
m0 AS (SELECT d.rid, doc_id, lang, len(w) AS n_words, length(t) AS n_chars, length(t) - {counts[3]} AS word_chars,
  {counts[4]} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  [{', '.join(counts)}] AS chars, {named} AS named FROM d LEFT JOIN rep USING (rid)),
m AS (SELECT *, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED} * n_words AS base_failed FROM m0),
h AS (SELECT rid, 'c' AS kind, unnest(range(0, len(chars))) AS i, unnest(chars) AS v FROM m
  UNION ALL SELECT rid, 'w', unnest(range(0, len(named))), unnest(named) FROM m
  UNION ALL SELECT rid, 'w', -1, n_words - list_sum(named) FROM m WHERE len(named) > 0),
g1 AS (SELECT rid, lang, n_words FROM m WHERE NOT base_failed AND n_words >= {q.MIN_WORDS}),{_distances('g1', 'one')},
g2 AS (SELECT g1.* FROM g1 LEFT JOIN one USING (rid) WHERE coalesce(cd, 0) <= {q.FIRST_CHAR}),{_distances('g2', 'two')}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(cd, 0) > {q.MAX_CHAR} OR (coalesce(cd, 0) > {q.BOTH_CHAR} AND coalesce(wd, 0) > {q.BOTH_WORD})) AS kept,
  round(cd, 6) + 0.0 AS char_distance, round(wd, 6) + 0.0 AS word_distance
FROM m LEFT JOIN two USING (rid)"""
