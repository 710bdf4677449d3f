"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keep FROM d WHERE payload_bytes >= 1000 GROUP BY ALL HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM d LEFT JOIN k USING (payload_digest)
"""

CHAT = """
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) AS body,
    length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\' || chr(10))) AS head FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + head + body) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

TOPK = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5
"""

MIXING = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 2.0e0 * source_size AS most, CAST([3, 1, 2][CAST(place % 3 + 1 AS BIGINT)] AS DOUBLE) AS weight FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS nth, 1.5e0 * sum(source_size) OVER () AS total FROM w
), c AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o
), l AS (SELECT arg_min(level, nth) AS level FROM c WHERE level < most / weight),
t AS (SELECT source, source_size, least(most, coalesce((SELECT level FROM l) * weight, most)) AS target FROM w),
r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5(concat_ws('|', 'mix-1', coalesce(d.source, ''), CAST(doc_id AS VARCHAR))), 1, 13) AS BIGINT) / 4503599627370496e0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
"""


def statements() -> dict[str, str]:
    return {"op2_warc": WARC, "op7_chat": CHAT, "op8_topk": TOPK, "op10_mixing": MIXING}
