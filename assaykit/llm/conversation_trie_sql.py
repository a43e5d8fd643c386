"""The trie of conversation prefixes in DuckDB SQL, for the oracle."""
from __future__ import annotations

from assaykit.llm import conversation_trie as t


def sql() -> str:
    text = "CAST(c AS VARCHAR)"
    # CRC-32 bit by bit: eight shifts a byte, with the reversed polynomial.
    crc = (f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))), "
           "lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))")
    return f"""
WITH told AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
d AS (SELECT c, turn, sha256(length(role) || ':' || role || text) AS digest,
  len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS words FROM told),
p AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS place FROM d),
v0 AS (SELECT c, count(*) AS n, c - (c % {t.FAMILY} + {t.FAMILY}) % {t.FAMILY} AS base, {crc} % {t.OPENINGS} AS h FROM d GROUP BY c),
v AS (SELECT v0.*, least(v0.h, coalesce(b.n, 0)) AS taken, least(v0.h, coalesce(b.n, 0)) + greatest(v0.n - v0.h, 0) AS length FROM v0 LEFT JOIN v0 AS b ON b.c = v0.base),
r AS (SELECT c, place - h + taken AS place, digest, words, length FROM p JOIN v USING (c) WHERE place > h
  UNION ALL SELECT v.c, place, digest, words, length FROM v JOIN p ON p.c = v.base WHERE place <= h),
s AS (SELECT c, place, words, length, md5(string_agg(digest, '') OVER (PARTITION BY c ORDER BY place ROWS UNBOUNDED PRECEDING)) AS id FROM r),
q AS (SELECT *, coalesce(lag(id) OVER (PARTITION BY c ORDER BY place), 'root') AS parent FROM s),
n AS (SELECT id, min(parent) AS parent, min(c) AS conv_id, min(place) AS depth, count(*) AS n_convs, min(words) AS words FROM q GROUP BY id
  UNION ALL SELECT 'root', NULL, min(c), 0, count(*), 0 FROM v HAVING count(*) > 0),
k AS (SELECT parent AS id, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * words AS saved FROM n LEFT JOIN k USING (id)),
a AS (SELECT q.id, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM w JOIN q ON q.c = w.conv_id AND q.place <= w.depth GROUP BY q.id
  UNION ALL SELECT 'root', sum(leaf), sum(saved) FROM w),
e AS (SELECT id, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM (SELECT id, c FROM q WHERE place = length UNION ALL SELECT 'root', c FROM v WHERE length = 0) GROUP BY id)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM w LEFT JOIN w AS up ON up.id = w.parent JOIN a ON a.id = w.id LEFT JOIN e ON e.id = w.id"""
