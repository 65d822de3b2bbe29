"""DuckDB SQL of the queries that SQL can express, over the views of the tables."""

from __future__ import annotations

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p),
-- five hex digits are twenty bits are four base32 digits
b AS (SELECT *, list_transform(range(8), lambda g: ('0x' || substr(x, 5 * g::INTEGER + 1, 5))::BIGINT) AS parts FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[i // 4 + 1] >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""

NEARDUP = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w
), sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c, any_value(x.n) + any_value(y.n) AS n
  FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (SELECT a, b FROM pairs WHERE 100 * c >= 75 * (n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least ON doc_id = a
"""

MIXING = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, rank % 3 AS schedule, [3.0, 1.0, 2.0][(rank % 3 + 1)::INTEGER]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap,
    1.5::DOUBLE * sum(source_size) OVER () AS whole
  FROM (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM s)
), l AS (
  SELECT *, cap / w AS stop,
    (whole - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), x AS (SELECT arg_min(level, (stop, rank)) AS x FROM l WHERE level <= stop),
t AS (
  SELECT source, source_size, schedule, CASE WHEN x.x IS NULL THEN cap ELSE least(cap, x.x * w) END AS target
  FROM l LEFT JOIN x ON true
), g AS (SELECT *, round(target)::BIGINT AS goal FROM t),
f AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS whole_takes FROM g
), c AS (
  SELECT d.doc_id, d.size, f.source_size, f.target, f.schedule, f.goal, f.whole_takes, goal - whole_takes * source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
), e AS (
  SELECT *, greatest(0, least(size, rest - start)) AS extra,
    whole_takes > 0 OR least(size, rest - start) > 0 OR (size = 0 AND start < rest) AS used FROM c
), seg(schedule, t0, w0, area, t1, w1, total) AS (
  VALUES (0, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE),
    (1, 0.0, 2.0, 0.0, 0.5, 1.0, 1.125), (1, 0.5, 1.0, 0.75, 1.0, 0.5, 1.125),
    (2, 0.0, 0.25, 0.0, 0.6, 1.0, 0.975), (2, 0.6, 1.0, 0.375, 1.0, 2.0, 0.975)
), h AS (
  SELECT e.*, seg.*, least(start::DOUBLE / goal, 1.0) * total AS need,
    row_number() OVER (PARTITION BY doc_id, start ORDER BY t0 DESC) AS place
  FROM e LEFT JOIN seg ON used AND seg.schedule = e.schedule AND area <= least(start::DOUBLE / goal, 1.0) * total
), k AS (
  SELECT *, need - area AS over, sqrt(greatest(w0 * w0 + 2 * ((w1 - w0) / (t1 - t0)) * (need - area), 0.0)) AS root
  FROM h WHERE place = 1
)
SELECT doc_id, size, source_size, target, (whole_takes * size + extra)::BIGINT AS taken,
  CASE WHEN used THEN round(least(t0 + CASE WHEN over <= 0 THEN 0.0 ELSE 2 * over / (w0 + root) END, 1.0), 9) END AS position
FROM k
"""

SHARDING = """
WITH d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(text, '') AS t,
    hex(encode(coalesce(text, ''))) AS h FROM documents
), codes AS (  -- the table of the polynomial 0xEDB88320, from its rule
  SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, _:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS code
  FROM range(256) r(i)
), crc AS (
  SELECT doc_id, k, strlen(t)::BIGINT + 1 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(t) + 1),
      lambda i: ('0x' || substr(h, (2 * i - 1)::INTEGER, 2))::BIGINT)),
      lambda c, b: xor(c // 256, code[(xor(c % 256, b) + 1)::INTEGER])), 4294967295) AS text_crc32
  FROM d, codes
), draws AS (
  SELECT *, list_transform(range(17), lambda i: ('0x' || substr(md5(k || ':' || i::VARCHAR), 1, 13))::BIGINT) AS draw FROM crc
), placed AS (
  SELECT *, (list_position(draw[1:16], list_max(draw[1:16])) - 1)::INTEGER AS shard,
    (list_position(draw, list_max(draw)) - 1)::INTEGER AS grown_shard
  FROM draws
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM placed
"""

PHRASES = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, w[i:i + k - 1] AS words, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))
  GROUP BY lang, words HAVING count(*) >= 30
), c AS (SELECT * FROM grams WHERE len(words) > 1),
cuts AS (
  SELECT c.lang, c.words, c.f AS a, k, h.f AS l, t.f AS r, (2000000::HUGEINT * c.f) // (h.f::HUGEINT + t.f) AS score
  FROM (SELECT *, unnest(range(1, len(words))) AS k FROM c) c
  JOIN grams h ON h.lang = c.lang AND h.words = c.words[1:k]
  JOIN grams t ON t.lang = c.lang AND t.words = c.words[k + 1:]
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
), inside AS (
  SELECT DISTINCT lang, words[i:i + k - 1] AS words, f
  FROM (SELECT *, unnest(range(1, len(words) - k + 2)) AS i
    FROM (SELECT *, unnest(range(2, len(words))) AS k FROM c WHERE len(words) > 2))
), covered AS (SELECT lang, words, max(f) AS most FROM inside GROUP BY lang, words),
kept AS (
  SELECT lowest.*, array_to_string(lowest.words, ' ') AS phrase FROM lowest LEFT JOIN covered USING (lang, words)
  WHERE most IS NULL OR 100 * most < 80 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
  score::BIGINT AS score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000
"""

SQL = {
    "op3_topk": TOPK,
    "op4_warc": WARC,
    "op5_neardup": NEARDUP,
    "op9_mixing": MIXING,
    "op10_sharding": SHARDING,
    "op11_phrases": PHRASES,
}
