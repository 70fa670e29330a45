"""The queries of this subpackage over the standard tables, and SQL for those that SQL expresses."""

from __future__ import annotations

from lodestone.llm.bpe import op5_byte_level_bpe
from lodestone.llm.conversation_trie import op11_conversation_trie
from lodestone.llm.decontaminate import op3_benchmark_decontamination
from lodestone.llm.hard_negatives import op13_hard_negatives
from lodestone.llm.html_text import op1_html_extraction
from lodestone.llm.language_id import op7_language_id
from lodestone.llm.license_scan import op2_license_scan
from lodestone.llm.media import op8_media_columns
from lodestone.llm.mixing import op12_mixing
from lodestone.llm.near_dedup import op6_minhash_near_dedup
from lodestone.llm.quality import op9_quality_classifier
from lodestone.llm.shard import op4_kd_tree_sharding
from lodestone.llm.url_filter import op10_url_filter

QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_license_scan, op3_benchmark_decontamination, op4_kd_tree_sharding, op5_byte_level_bpe, op6_minhash_near_dedup, op7_language_id, op8_media_columns, op9_quality_classifier, op10_url_filter, op11_conversation_trie, op12_mixing, op13_hard_negatives)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: CRC-32 of a string of ASCII characters, bit by bit: -1 stands for a shift, other numbers for a byte.
_CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"
_TURN = "md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))"

SQL = {
    "op3_benchmark_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark),
places AS (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, list_slice(w, i, i + 9) AS g FROM places),
lengths AS (SELECT DISTINCT len(g) AS n FROM windows),
starts AS (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lengths),
hits AS (SELECT s.r, s.i, s.n, x.item FROM (SELECT r, i, n, list_slice(w, i, i + n - 1) AS g FROM starts) s JOIN windows x ON s.g = x.g),
hit_words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS j FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)""",
    "op11_conversation_trie": f"""
WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_TURN}) AS i, {_TURN} AS t, strlen(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % 5 AS base, {_CRC32.format("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT c FROM o)),
rebuilt AS (SELECT ids.c, i, t, n FROM ids JOIN o ON o.c = base AND i <= h UNION ALL SELECT ids.c, i, t, n FROM ids JOIN o ON o.c = ids.c AND i > h),
s AS (SELECT ids.c, coalesce(list(t ORDER BY i) FILTER (t IS NOT NULL), []) AS ts, list(n ORDER BY i) FILTER (t IS NOT NULL) AS ns FROM ids LEFT JOIN rebuilt USING (c) GROUP BY ids.c),
p AS (SELECT c, ts, ns, unnest(range(len(ts) + 1)) AS d FROM s),
nodes AS (SELECT d, array_to_string(ts[1:d], '') AS g, min(c) AS conv_id, count(*) AS n, CASE WHEN d > 0 THEN max(ns[d]) ELSE 0 END AS b,
  string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(ts) = d) AS ends FROM p GROUP BY d, g),
children AS (SELECT left(g, 32 * (d - 1)) AS g, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (g)),
below AS (SELECT left(g, 32 * u) AS g, sum((n_children = 0)::INT) AS n_leaves, sum((n - 1) * b) AS saved FROM (SELECT *, unnest(range(d + 1)) AS u FROM counted) GROUP BY ALL)
SELECT a.conv_id, a.d AS depth, up.conv_id AS parent_conv_id, a.n AS n_convs, CAST(a.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM counted a JOIN below USING (g) LEFT JOIN nodes up ON a.d > 0 AND up.g = left(a.g, 32 * (a.d - 1))""",
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0),
p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM scores WHERE label = own AND vec_id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN scores USING (anchor_id) WHERE label <> p.own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10""",
    # Targets by the set of stopped sources, which the ratio of limit to weight orders; then thresholds by a running sum.
    "op12_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  CAST('0x' || substr(md5('mix' || chr(31) || coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
ordered AS (SELECT *, 2 * source_size / weight AS ratio, row_number() OVER (ORDER BY 2 * source_size / weight, source NULLS LAST) AS k FROM sizes),
states AS (SELECT k, ratio, 1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left, sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM ordered),
last AS (SELECT k, words_left, weight_left FROM states WHERE ratio >= words_left / weight_left ORDER BY k LIMIT 1),
wanted AS (SELECT source, source_size, CASE WHEN o.k < l.k THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(words_left AS DOUBLE) * weight / weight_left END AS target FROM ordered o, last l),
budget AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats FROM wanted),
sums AS (SELECT d.*, source_size, target, repeats, target - repeats * source_size AS rest,
  sum(size) OVER (PARTITION BY d.source ORDER BY h) AS until, sum(size) OVER (PARTITION BY d.source, h) AS own, count(*) OVER (PARTITION BY d.source, h) AS n
  FROM d JOIN budget b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, source,
  CAST(repeats * size + CASE WHEN rest <= 0 OR until - own > rest THEN 0 WHEN until <= rest THEN size
    WHEN n > 1 THEN floor(size * (rest - until + own) / own) WHEN 2 * (rest - until + own) > own THEN size ELSE 0 END AS BIGINT) AS taken
FROM sums""",
}
