"""DuckDB SQL for the queries that SQL can express. The others are tested against brute force."""

from __future__ import annotations

# Fixed values, apart from the operator's table: the licence lines that the given tables hold, normalised, with identifier and licence.
_LINES = {
    "released under the mit license": ("MITGrant", "MIT"),
    "licensed under the apache license version 2.0": ("Apache2Grant", "Apache-2.0"),
    "this work is licensed under the gnu general public license version 3": ("GPL3Grant", "GPL-3.0"),
    "licensed under cc by nc 4.0": ("CCBYNC4Grant", "CC-BY-NC-4.0"),
    "all rights reserved": ("AllRights", "LicenseRef-all-rights-reserved"),
}


def _licence_sql() -> str:
    known = ", ".join(f"('{s}', '{i}', '{licence}')" for s, (i, licence) in _LINES.items())
    # dots stay between digits only; the marking runs twice, as 1.2.3 shares a digit
    marked = r"regexp_replace(regexp_replace(LOWER(s), '([0-9])\.([0-9])', '\1§\2', 'g'), '([0-9])\.([0-9])', '\1§\2', 'g')"
    normal = rf"TRIM(regexp_replace(replace(regexp_replace({marked}, '[^\p{{L}}\p{{N}}§]+', ' ', 'g'), '§', '.'), ' +', ' ', 'g'))"
    return rf"""WITH sentences AS (
  SELECT doc_id, UNNEST(parts) AS s, GENERATE_SUBSCRIPTS(parts, 1) AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '[\n\r;:!?]+|\.\s|\.$') AS parts FROM documents)),
known(sentence, id, licence) AS (VALUES {known}),
found AS (SELECT doc_id, STRING_AGG(id, ',' ORDER BY pos) AS ids, LIST_SORT(LIST_DISTINCT(LIST(licence))) AS names FROM sentences JOIN known ON sentence = {normal} GROUP BY doc_id)
SELECT d.doc_id, COALESCE(ids, '') AS sentence_ids, COALESCE(ARRAY_TO_STRING(names, ','), '') AS licences
FROM documents d LEFT JOIN found USING (doc_id)"""


_WARC = """WITH p AS (SELECT page_id, COALESCE(html, '') AS h FROM pages),
g AS (SELECT h, MAX(page_id) AS holder FROM p GROUP BY h)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN strlen(h) >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 1000 AND page_id <> holder THEN holder END AS refers_to
FROM p JOIN g USING (h)"""

_JOIN = r"""WITH RECURSIVE words AS (
  SELECT doc_id, LIST_FILTER(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN LIST_DISTINCT(LIST_TRANSFORM(RANGE(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [ARRAY_TO_STRING(w, ' ')] ELSE [] END AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, UNNEST(s) AS x FROM sets),
rows AS (SELECT * FROM flat QUALIFY COUNT(*) OVER (PARTITION BY x) > 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, ANY_VALUE(a.n) AS na, ANY_VALUE(b.n) AS nb, COUNT(*) AS k FROM rows a JOIN rows b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * LEAST(a.n, b.n) >= 90 * GREATEST(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 90 * (na + nb - k)),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
least AS (SELECT a AS doc_id, MIN(b) AS c FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, LEAST(doc_id, COALESCE(c, doc_id)) AS component_id FROM sets LEFT JOIN least USING (doc_id)"""

# CRC-32 by its table: 256 entries made of eight steps each, then one look-up for each digit of the id
_TRIE = r"""WITH RECURSIVE step(n, k, v) AS (
  SELECT n, 0, n FROM RANGE(256) t(n) UNION ALL SELECT n, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END FROM step WHERE k < 8),
crc(n, v) AS (SELECT n, v FROM step WHERE k = 8),
turns AS (
  SELECT conv_id, sha256(strlen(r) || ':' || r || t)[1:32] AS d, strlen(t) AS n, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || t)[1:32]) AS k
  FROM (SELECT conv_id, turn, COALESCE(role, '') AS r, COALESCE(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)),
fold(c, s, v) AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR, 4294967295::BIGINT FROM turns
  UNION ALL SELECT c, s[2:], xor(fold.v // 256, crc.v) FROM fold JOIN crc ON crc.n = xor(fold.v % 256, ord(s[1])::BIGINT) WHERE s <> ''),
convs AS (SELECT c, xor(v, 4294967295::BIGINT) % 9 AS h FROM fold WHERE s = ''),
made AS (
  SELECT c, k AS place, d, n FROM convs JOIN turns ON conv_id = c - c % 5 AND k <= h
  UNION ALL SELECT c, k + 9, d, n FROM convs JOIN turns ON conv_id = c AND k > h),
placed AS (SELECT c, ROW_NUMBER() OVER w AS depth, n, sha256(STRING_AGG(d, '') OVER w) AS node, COUNT(*) OVER (PARTITION BY c) AS len FROM made WINDOW w AS (PARTITION BY c ORDER BY place)),
members AS (
  SELECT c, depth, n, node, len, COALESCE(LAG(node) OVER (PARTITION BY c ORDER BY depth), '') AS parent FROM placed
  UNION ALL SELECT c, 0, 0, '', COALESCE(len, 0), NULL FROM convs LEFT JOIN (SELECT DISTINCT c, len FROM placed) USING (c)),
nodes AS (
  SELECT node, MIN(c) AS conv_id, MIN(depth) AS depth, MIN(parent) AS parent, COUNT(*) AS n_convs, MIN(n) * (COUNT(*) - 1) AS saved,
    sha256(COALESCE(STRING_AGG(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len = depth), '')) AS ends
  FROM members GROUP BY node),
children AS (SELECT parent AS node, COUNT(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
-- a node's ancestors and itself are the nodes of its least member up to its depth
below AS (
  SELECT m.node, SUM(x.saved) AS saved_tokens, COUNT(*) FILTER (WHERE c.n_children IS NULL) AS n_leaves
  FROM nodes x JOIN members m ON m.c = x.conv_id AND m.depth <= x.depth LEFT JOIN children c ON c.node = x.node GROUP BY m.node)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, COALESCE(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM nodes x JOIN below USING (node) LEFT JOIN children USING (node) LEFT JOIN nodes p ON p.node = x.parent"""

_AUDIT = r"""WITH docs AS (SELECT ROW_NUMBER() OVER () AS row, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source, COALESCE(text, '') AS text FROM documents),
words AS (SELECT row, lang, source, UNNEST(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, COUNT(*) AS n FROM words GROUP BY lang, term HAVING COUNT(DISTINCT row) >= 3),
langs AS (SELECT lang, SUM(n) AS total, COUNT(*) AS v FROM kept GROUP BY lang),
found AS (SELECT lang, source, term, COUNT(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, COALESCE(SUM(n), 0) AS total FROM groups LEFT JOIN found USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT lang, source, k.term, COALESCE(f.n, 0) AS n, 1 + (1000000000::HUGEINT * (COALESCE(f.n, 0) + 1)) // (t.total + l.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v)::HUGEINT AS q
  FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN found f USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, SUM(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, COALESCE(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
both_parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM every
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""

SQL: dict[str, str] = {"op4_license_scan": _licence_sql(), "op8_warc_archive": _WARC, "op9_ngram_join": _JOIN, "op11_prefix_trie": _TRIE, "op12_divergence_audit": _AUDIT}
