"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from kpimart.llm.lexical_search import LOWER, TERM, UPPER

#: SHA-1 of a text's UTF-8 bytes in base 32, 40 bits at a time.
_BASE32 = " || ".join(
    f"translate(lpad(to_base(('0x' || substr(sha1(coalesce(html, '')), {1 + 10 * i}, 10))::BIGINT, 32), 8, '0'), "
    "'0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"
    for i in range(4)
)

OP11 = f"""
WITH sized AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest FROM pages
), kept AS (SELECT payload_digest, max(page_id) AS page_id FROM sized GROUP BY payload_digest)
SELECT s.page_id, s.payload_bytes, s.payload_digest,
  CASE WHEN k.page_id = s.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k.page_id = s.page_id THEN NULL ELSE k.page_id END AS refers_to
FROM sized s JOIN kept k USING (payload_digest)
"""

#: crc32 of a decimal number's digits, bit by bit (3988292384 is the reversed polynomial).
_CRC32 = """xor(4294967295, list_reduce(
  list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda acc, byte: list_reduce(
    list_prepend(xor(acc, byte), CAST(range(8) AS BIGINT[])),
    lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)))"""

OP12 = f"""
WITH turns AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
  SELECT conv_id, t, CAST({_CRC32} % 6 AS BIGINT) AS h, conv_id - conv_id % 100 AS base FROM turns
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.t[1:a.h], []), a.t[a.h + 1:]) AS t FROM heads a LEFT JOIN turns b ON b.conv_id = a.base
), members AS (
  SELECT conv_id, len(t) AS turns, unnest(range(0, len(t) + 1)) AS depth, t FROM rebuilt
), nodes AS (
  SELECT t[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (turns = depth), '') AS ends
  FROM members GROUP BY ALL
), children AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children,
    (n_convs - 1) * (CASE WHEN n.depth = 0 THEN 0 ELSE length(n.path[n.depth].text) END) AS saved
  FROM nodes n LEFT JOIN children c USING (path)
), above AS (SELECT path[1:a] AS path, n_children, saved FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM full_nodes)),
sums AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(n.n_children AS BIGINT) AS n_children,
  s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN sums s USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""


def _terms(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{TERM}')"


OP13 = f"""
WITH texts AS (SELECT doc_id, {_terms('text')} AS terms FROM documents),
sized AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM texts WHERE len(terms) > 0),
total AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sized),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wanted AS (SELECT DISTINCT item_id, unnest({_terms('text')}) AS term FROM benchmark),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM wanted JOIN tf USING (term) JOIN weights USING (term), total GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

ORACLE_SQL = {"op11_warc": OP11, "op12_prefix_trie": OP12, "op13_lexical_search": OP13}
