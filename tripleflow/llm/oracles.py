"""SQL for the registered queries that SQL can express over whole tables."""

from __future__ import annotations

from . import lm

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32 by its polynomial: a table of 256 remainders, then a step for each byte.
SHARDS = """
WITH remainders AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM documents, remainders),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS everything FROM sized),
cut AS (SELECT *, least(floor((upto - size / 2) * 8 / everything), 7)::INT AS shard FROM summed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM cut
"""

MIX = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 10))::BIGINT / 1099511627776.0::DOUBLE AS u
  FROM documents),
sources AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS rank, source_size * 2.0::DOUBLE AS most
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
filling AS (SELECT *, most / weight AS fills_at FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER filled, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER filled, 0)) AS level
  FROM filling WINDOW filled AS (ORDER BY fills_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT arg_min(level, (fills_at, rank)) AS final FROM levels WHERE level <= fills_at),
targets AS (SELECT source, weight, source_size, coalesce(least(most, final * weight), most) AS target FROM levels, final),
placed AS (
  SELECT s.*, weight, source_size, target, round(target)::BIGINT AS want, 0.8::DOUBLE - (weight - 1) * 0.4::DOUBLE AS a,
    (sum(size) OVER (PARTITION BY s.source ORDER BY u, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS begun
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
streamed AS (SELECT *, CASE WHEN source_size > 0 THEN want // source_size ELSE 0 END AS passed FROM placed),
ending AS (SELECT *, least(greatest(want - passed * source_size - begun, 0), size) AS rest, CASE WHEN want > 0 THEN begun::DOUBLE / want END AS done FROM streamed)
SELECT doc_id, source, size, source_size, target, (passed * size + rest)::BIGINT AS taken, (passed + CASE WHEN rest * 2 >= size THEN 1 ELSE 0 END)::INT AS passes,
  CASE WHEN passed * size + rest > 0 THEN
    CASE WHEN abs(a) < 1e-9 THEN done ELSE (sqrt((1 - a) * (1 - a) + 4 * a * done) - (1 - a)) / (2 * a) END + 0.0 END AS position
FROM ending
"""

WARC = """
WITH digests AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(encode(coalesce(html, ''))) AS payload_digest FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS leader FROM digests)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> leader THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> leader THEN leader END AS refers_to
FROM firsts
"""

_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
LEAKS = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT item_id, least(len(w), 8) AS n, array_to_string(list_slice(w, i, i + least(len(w), 8) - 1), ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
places AS (
  SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS key
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT r, i, p.n, item_id FROM places p JOIN windows v ON p.n = v.n AND p.key = v.key),
hits AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS spot FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""

SQL: dict[str, str] = {"op2_cross_entropy": lm.SQL, "op6_shard_bytes": SHARDS, "op7_mix_curriculum": MIX, "op9_arc_to_warc": WARC, "op10_fm_index": LEAKS}
