"""DuckDB equivalents of the queries that SQL can express."""

from __future__ import annotations

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP5 = f"""
WITH line AS (
  SELECT doc_id, t.pos, t.line, lower_ascii AS key FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents) t,
    LATERAL (SELECT translate(trim(t.line, {WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii)),
rep AS (SELECT key, max(doc_id) AS keeper FROM line WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT l.*, coalesce(l.doc_id <> r.keeper, false) AS gone FROM line l LEFT JOIN rep r USING (key)) GROUP BY doc_id
"""

OP7 = r"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
word AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM doc),
fig AS (
  SELECT rid, doc_id, text, words, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         len(string_split(text, chr(10))) AS n_lines
  FROM word),
win AS (
  SELECT rid, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] || ' ' || words[i+3] || ' ' || words[i+4] AS w
  FROM (SELECT rid, words, unnest(range(1, n_words - 3)) AS i FROM fig WHERE n_words >= 5)),
many AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM many, range(0, 5) AS r(k) GROUP BY rid),
all_ AS (SELECT fig.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM fig LEFT JOIN rep USING (rid)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM all_)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
         OR 10 * n_dup_lines > 3 * n_lines OR 2 * length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) > word_chars
         OR 10 * length(regexp_replace(text, '[^0-9]', '', 'g')) > 3 * word_chars OR 2 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) < word_chars
         OR 2 * len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) < n_words
         OR 10 * len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[-*•]'))) > 9 * n_lines
         OR 10 * len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(\.\.\.|…)$'))) > 3 * n_lines) AS kept
FROM judged
"""

OP10 = r"""
WITH tok AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win, least(13, len(w)) AS k
      FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM q),
hit AS (
  SELECT doc_id, i, q.k, item_id
  FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM tok, sizes WHERE len(w) >= k)) d JOIN q USING (win, k)),
n AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, range(0, 13) AS r(j) WHERE j < k GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM tok LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP11 = """
WITH turn AS (
  SELECT conv_id, len, key, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos FROM (
    SELECT conv_id, turn, length(text) AS len, sha256(length(role) || ':' || role || text) AS key FROM (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))),
conv AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda a, b: xor(xor(a, b) >> 1, 3988292384::UBIGINT * (xor(a, b) & 1))), 4294967295::UBIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turn)),
made AS (
  SELECT c.conv_id, t.pos, t.key, t.len FROM conv c JOIN turn t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.pos, t.key, t.len FROM conv c JOIN turn t ON t.conv_id = c.conv_id AND t.pos > c.h),
seq AS (
  SELECT conv_id, coalesce(keys, []) AS keys, coalesce(lens, []) AS lens
  FROM conv LEFT JOIN (SELECT conv_id, list(key ORDER BY pos) AS keys, list(len ORDER BY pos) AS lens FROM made GROUP BY conv_id) USING (conv_id)),
member AS (SELECT conv_id, d, array_to_string(keys[1:d], '') AS k, array_to_string(keys[1:d - 1], '') AS up, lens[d] AS len, d = len(keys) AS ends FROM (SELECT *, unnest(range(0, len(keys) + 1)) AS d FROM seq)),
node AS (
  SELECT k, d, any_value(CASE WHEN d > 0 THEN up END) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(len), 0) AS len,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM member GROUP BY k, d),
kids AS (SELECT up AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY up),
sub AS (
  SELECT substr(k, 1, 64 * a) AS k, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * len)::BIGINT AS saved_tokens
  FROM (SELECT node.k, n_convs, len, n_children IS NULL AS leaf, unnest(range(0, d + 1)) AS a FROM node LEFT JOIN kids USING (k)) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM node n JOIN sub ON sub.k = n.k LEFT JOIN kids ON kids.k = n.k LEFT JOIN node p ON p.k = n.up AND n.d > 0
"""

OP12 = r"""
WITH doc AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
word AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM doc),
cnt AS (SELECT lang, source, term, count(*) AS n FROM word GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS n FROM word GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
grp AS (SELECT DISTINCT lang, source FROM doc),
own AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER g + 2 * count(*) OVER g) AS p
  FROM (SELECT grp.lang, grp.source, kept.term, coalesce(cnt.n, 0) AS n FROM grp JOIN kept ON kept.lang = grp.lang LEFT JOIN cnt ON cnt.lang = grp.lang AND cnt.source = grp.source AND cnt.term = kept.term)
  WINDOW g AS (PARTITION BY lang, source)),
whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER g + 2 * count(*) OVER g) AS q FROM kept WINDOW g AS (PARTITION BY lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT own.lang, own.source, 'term' AS part, own.term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM own JOIN whole ON whole.lang = own.lang AND whole.term = own.term WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

ORACLES: dict[str, str] = {"op10_decontamination": OP10, "op11_prefix_trie": OP11, "op12_source_divergence": OP12, "op5_line_dedup": OP5, "op7_quality": OP7}
