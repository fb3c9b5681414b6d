"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

_OP1 = r"""
WITH d AS (SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d WHERE text IS NOT NULL),
worded AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
  translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY 1),
counted AS (SELECT source, norm, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS keeper FROM worded GROUP BY 1, 2),
hosts AS (SELECT source, count(DISTINCT doc_id) AS host_docs FROM documents GROUP BY 1),
busy AS (SELECT c.source, norm, keeper FROM counted c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source WHERE n_docs > 20 AND n_docs > host_docs * 0.005),
lost AS (SELECT doc_id, sum(n) AS removed FROM worded w JOIN busy b ON w.norm = b.norm AND w.source IS NOT DISTINCT FROM b.source WHERE w.doc_id <> b.keeper GROUP BY 1),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY 1),
s AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(hit.n, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN hit USING (doc_id) LEFT JOIN lost USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < 20 OR n_words - removed_words < 0.3 * n_words)) AS kept, removed_words FROM f
"""

_WORDS2 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP2 = rf"""
WITH d AS (SELECT doc_id, {_WORDS2} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS2} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, z, array_to_string(w[i : i + z - 1], ' ') AS g FROM (SELECT item, w, least(10, len(w)) AS z, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT z FROM bw),
dw AS (SELECT doc_id, z, i, array_to_string(w[i : i + z - 1], ' ') AS g FROM (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM d, sizes WHERE len(w) >= z)),
hits AS (SELECT doc_id, dw.z, i, item FROM dw JOIN bw ON dw.z = bw.z AND dw.g = bw.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + z)) AS p FROM hits) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""


_OP6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM twice)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY p)) AS kept_sha256 FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_OP4 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE role END AS name,
  replace(replace(text, '\', '\\'), '</turn>', '<\/turn>') AS half FROM c),
f AS (SELECT *, length(half) + coalesce(list_sum(list_transform(regexp_extract_all(half, '#{3,}'), lambda x: length(x))), 0) AS escaped,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
  lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM e),
g AS (SELECT *, CASE WHEN role = 'user' THEN before IN ('', 'system', 'assistant') WHEN role = 'assistant' THEN before = 'user' ELSE role = 'system' AND k = 1 END AS ok FROM f)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(name) + 2 + escaped + 8)::BIGINT AS formatted_chars,
  bool_and(ok) AND arg_max(role, k) = 'assistant' AS valid, (min(k - 1) FILTER (NOT ok))::BIGINT AS first_bad_turn
FROM g GROUP BY conv_id
"""


_OP13 = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, r.id, r.label = a.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score FROM e a, e r WHERE a.id % 100 = 0 AND a.id <> r.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_lines": _OP1, "op2_decontaminate": _OP2, "op4_chat_format": _OP4, "op6_phrase_dedup": _OP6, "op13_hard_negatives": _OP13}
