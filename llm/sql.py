"""DuckDB statements for the queries of this subpackage that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP7 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""

OP3 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages
), m AS (SELECT hex, max(page_id) AS original FROM p GROUP BY hex)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 5 * i + 1, 5))::BIGINT >> (15 - 5 * j)) & 31)::INT, 1) for j in range(4)], '') for i in range(8)], '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM p JOIN m USING (hex)
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS nxt FROM documents
), e AS (
  SELECT doc_id, text, nxt, length(text) AS n, substr(text, 1, length(text) - length(text) // 3) || substr(nxt, 1, length(text) // 3) AS edited FROM d
), t AS (
  SELECT *, list_transform(string_split_regex(text, '\n\n+'), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '[^\n]{1,48}'), lambda x: substr(md5(x), 1, 8)))) AS a,
    list_transform(string_split_regex(edited, '\n\n+'), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '[^\n]{1,48}'), lambda x: substr(md5(x), 1, 8)))) AS b,
    list_transform(string_split_regex(nxt, '\n\n+'), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '[^\n]{1,48}'), lambda x: substr(md5(x), 1, 8)))) AS c FROM e
), f AS (
  SELECT *, list_distinct(flatten(flatten(a))) AS la, list_distinct(flatten(flatten(b))) AS lb, list_distinct(flatten(flatten(c))) AS lc FROM t
)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
  sha256(array_to_string(list_transform(list_zip(list_transform(string_split_regex(text, '\n\n+'), lambda s: md5(array_to_string(list_transform(string_split(s, chr(10)), lambda p: md5(array_to_string(list_transform(regexp_extract_all(p, '[^\n]{1,48}'), lambda x: md5(x)), ''))), ''))), list_transform(regexp_extract_all(text, '\n\n+'), lambda g: length(g)::VARCHAR)), lambda z: z[1] || coalesce(z[2], '')), '.')) || ':' ||
    array_to_string(list_transform(a, lambda s: array_to_string(list_transform(s, lambda p: array_to_string(p, '')), ',')), ';') AS fingerprint,
  sha256(array_to_string(list_transform(list_zip(list_transform(string_split_regex(edited, '\n\n+'), lambda s: md5(array_to_string(list_transform(string_split(s, chr(10)), lambda p: md5(array_to_string(list_transform(regexp_extract_all(p, '[^\n]{1,48}'), lambda x: md5(x)), ''))), ''))), list_transform(regexp_extract_all(edited, '\n\n+'), lambda g: length(g)::VARCHAR)), lambda z: z[1] || coalesce(z[2], '')), '.')) || ':' ||
    array_to_string(list_transform(b, lambda s: array_to_string(list_transform(s, lambda p: array_to_string(p, '')), ',')), ';') AS edited_fingerprint,
  CASE WHEN len(la) + len(lb) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(la, lb))::DOUBLE / (len(la) + len(lb) - len(list_intersect(la, lb))) END AS near_edited,
  CASE WHEN len(la) + len(lc) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(la, lc))::DOUBLE / (len(la) + len(lc) - len(list_intersect(la, lc))) END AS near_next,
  sha256(array_to_string(list_transform(list_zip(list_transform(string_split_regex(text, '\n\n+'), lambda s: md5(array_to_string(list_transform(string_split(s, chr(10)), lambda p: md5(array_to_string(list_transform(regexp_extract_all(p, '[^\n]{1,48}'), lambda x: md5(x)), ''))), ''))), list_transform(regexp_extract_all(text, '\n\n+'), lambda g: length(g)::VARCHAR)), lambda z: z[1] || coalesce(z[2], '')), '.')) AS root,
  sha256(array_to_string(list_transform(list_zip(list_transform(string_split_regex(edited, '\n\n+'), lambda s: md5(array_to_string(list_transform(string_split(s, chr(10)), lambda p: md5(array_to_string(list_transform(regexp_extract_all(p, '[^\n]{1,48}'), lambda x: md5(x)), ''))), ''))), list_transform(regexp_extract_all(edited, '\n\n+'), lambda g: length(g)::VARCHAR)), lambda z: z[1] || coalesce(z[2], '')), '.')) AS edited_root
FROM f
"""

OP8 = r"""
WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id
), b AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / (CASE q WHEN 1 THEN 4.0::DOUBLE WHEN 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END) AS key
  FROM documents LEFT JOIN l USING (doc_id)
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM b GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS share, 3 * source_size::DOUBLE AS cap FROM s
), v AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / share, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
    sum(share) OVER (ORDER BY cap / share, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, CASE WHEN cap / share <= level THEN cap ELSE
    share * ((sum(source_size) OVER () - coalesce(sum(cap) FILTER (cap / share <= level) OVER (), 0)) / sum(share) FILTER (cap / share > level) OVER ()) END AS target FROM v
), r AS (
  SELECT doc_id, b.source, size, source_size, target, sum(size) OVER (PARTITION BY b.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before,
    CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(floor(target)::BIGINT - epochs * source_size - before, size)))::BIGINT AS taken, source
FROM r
"""

# the checksum's table by its rule, and a fold over the bytes
_CRC_STEP = "list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, {})"
OP11 = f"""
WITH t AS (SELECT list(c ORDER BY b) AS crc FROM (SELECT b, {_CRC_STEP.format("b")} AS c FROM range(256) r(b))
), d AS (SELECT doc_id, source, encode(coalesce(text, '')) AS bytes FROM documents
), s AS (
  SELECT doc_id, source, octet_length(bytes) + 1 AS size,
    xor(4294967295, list_reduce(list_transform(range(octet_length(bytes)), lambda i: ('0x' || substr(hex(bytes), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)]), 4294967295)) AS crc32
  FROM d, t
), k AS (SELECT *, md5(concat_ws('|', 'interleave', coalesce(doc_id::VARCHAR, ''), crc32::VARCHAR, size::VARCHAR)) AS key FROM s
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id, crc32, size) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n,
    ('0x' || substr(md5('interleave|' || coalesce(source, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS phase FROM k
), p AS (
  SELECT *, row_number() OVER (ORDER BY (rank::DOUBLE + phase) / n, source NULLS LAST, key, doc_id, rank) - 1 AS position, count(*) OVER () AS total FROM r
), c AS (SELECT *, position * 16 // total AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard,
  (position - (shard * total + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard
FROM c
"""

OP12 = r"""
WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), f AS (
  SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
     coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM w LEFT JOIN l USING (doc_id)
), m AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL
), x AS (SELECT unnest(range(1, 6)) AS i
), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS seq FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (SELECT array_to_string(list_transform(seq, lambda i: chr(64 + i::INT)), '') AS filter_order, seq, x.i AS step FROM o, x
), j AS (
  SELECT part, filter_order, step, n, good, toxic, fails[seq[step]] AS own, len(list_filter(seq[1:step - 1], lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda v: v)) AS k
  FROM m, s
)
SELECT part, filter_order, step::INT AS step,
  coalesce(sum(n) FILTER (NOT own AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (own AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (own AND k = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (own AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (own AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost,
  coalesce(sum(120 * n // greatest(k, 1)) FILTER (own), 0)::BIGINT AS shapley
FROM j GROUP BY part, filter_order, step
"""
