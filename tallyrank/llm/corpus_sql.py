"""SQL twins of corpus operators (DuckDB)."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a non-null SQL string: one step per bit, lowest first."""
    digits = f"hex(encode({text}))"
    nibble = "(strpos('0123456789ABCDEF', substr({0}, ((k // 8) * 2 + 2 - (k % 8) // 4)::bigint, 1)) - 1)".format(digits)
    bits = f"list_transform(range(0, 4 * length({digits})), lambda k: (({nibble} >> (k % 4)::int) & 1)::bigint)"
    # the register starts as all ones and is inverted at the end
    return (f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), "
            "lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295::bigint)")


OP13 = rf"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
         {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT conv_id, list(t ORDER BY pos) AS turns FROM turns GROUP BY conv_id),
ids AS (SELECT conv_id, turns, conv_id - conv_id % 20 AS base, {crc32_sql("conv_id::varchar")} % 4 AS h FROM own),
rebuilt AS (
  SELECT i.conv_id, list_concat(coalesce(b.turns[1:i.h], []), i.turns[i.h + 1:]) AS path
  FROM ids i LEFT JOIN own b ON b.conv_id = i.base
), prefixes AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT path[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (len(path) = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY 1, 2
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
         CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * len(regexp_extract_all(n.path[n.depth].text, '[^\x20\x09-\x0D]+')) END AS saves
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
), kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT l.*, coalesce(k.n_children, 0) AS n_children FROM linked l LEFT JOIN kids k ON k.path = l.path),
above AS (SELECT path[1:u.d] AS path, n_children, saves FROM counted, LATERAL (SELECT unnest(range(0, depth + 1)) AS d) u),
sums AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saves) AS saved_tokens FROM above GROUP BY 1)
SELECT c.conv_id, c.depth::bigint AS depth, c.parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens::bigint AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums s ON s.path = c.path
"""

OP12 = rf"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::varchar, '') AS doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
), counted AS (SELECT doc, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY 1, 2),
hashed AS (SELECT run, n, {crc32_sql("(doc || ':' || run)")} AS h FROM counted),
drawn AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS (SELECT word, sum(n)::bigint AS n FROM drawn WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
places AS (SELECT word, n, length(word) AS size, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS (SELECT word, n, size, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM places),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.size = b.size AND a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON b.word = a.head || a.tail
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON b.word = a.head || a.tail
), best AS (
  SELECT word, count(DISTINCT near) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY 1
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 10 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 10 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
), chain AS (
  SELECT word, word AS root, 0 AS steps FROM forms
  UNION ALL SELECT c.word, f.form, c.steps + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
), roots AS (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY 1)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON r.word = f.word
"""
