"""DuckDB SQL of the operators that SQL can express; the others are held against brute force in tests/llm."""

_MIX = """
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || COALESCE(doc_id::VARCHAR, 'null')) AS h FROM documents),
src AS (
  SELECT source, SUM(size)::BIGINT AS s,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source),
capped AS (  -- in order of cap by weight, the first k sources that their caps stop
  SELECT *, SUM(s) OVER (ORDER BY s / w, source) - s AS s_before, SUM(w) OVER (ORDER BY s / w, source) - w AS w_before,
         SUM(s) OVER () AS s_all, SUM(w) OVER () AS w_all FROM src),
ranked AS (SELECT *, 1.5 * s_all - 2 * s_before AS left_, w_all - w_before AS w_left, row_number() OVER (ORDER BY s / w, source) AS k FROM capped),
level AS (SELECT arg_min(left_, k) AS left_, arg_min(w_left, k) AS w_left, MIN(k) AS k FROM ranked WHERE 2 * s * w_left >= left_ * w),
aim AS (
  SELECT r.source, s, CASE WHEN l.k IS NULL OR r.k < l.k THEN (2 * s)::DOUBLE ELSE (l.left_ * w)::DOUBLE / l.w_left::DOUBLE END AS target FROM ranked r, level l),
plan AS (
  SELECT source, s, target, CASE WHEN s = 0 THEN 0 ELSE FLOOR(target / s) END::BIGINT AS whole FROM aim),
room AS (SELECT *, FLOOR(target - whole * s + 0.5)::BIGINT AS rest FROM plan),
placed AS (
  SELECT d.doc_id, d.size, r.s AS source_size, r.target, r.whole,
         LEAST(d.size, GREATEST(0, r.rest - (SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size))) AS more
  FROM sized d JOIN room r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (size * whole + more)::BIGINT AS taken FROM placed
"""

_WINDOWS = """
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS p, LEAST(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, GREATEST(1, len(w) - 12))) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT row_number() OVER () AS r, doc_id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w
  FROM documents),
places AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT r, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT r, item_id, i, places.n FROM places JOIN windows ON places.p = windows.p AND places.n = windows.n),
hits AS (SELECT r, COUNT(DISTINCT place) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS place FROM found) GROUP BY r),
items AS (SELECT r, COUNT(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS k FROM found) GROUP BY r)
SELECT d.doc_id, len(w)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items,
       sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(w) AS contaminated
FROM doc_words d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""

_WARC = """
WITH own AS (SELECT page_id, COALESCE(html, '') AS p FROM pages),
hashed AS (SELECT page_id, octet_length(encode(p))::BIGINT AS payload_bytes, sha1(p) AS h FROM own),
heads AS (SELECT h, MAX(page_id) AS answer FROM hashed GROUP BY h),
letters AS (
  SELECT h, answer, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) % 32 + 1, 1) FOR k IN range(32)], '') AS d
  FROM heads)
SELECT page_id, payload_bytes, d AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM answer THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM answer THEN NULL ELSE answer END AS refers_to
FROM hashed JOIN letters USING (h)
"""

_SEARCH = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), []) AS w
  FROM documents),
total AS (SELECT COUNT(*) FILTER (len(w) > 0)::BIGINT AS n_all, SUM(len(w))::BIGINT AS l_all FROM d),
tf AS (SELECT r, term, COUNT(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, COUNT(*)::BIGINT AS df FROM tf GROUP BY term),
weight AS (SELECT term, FLOOR(1000 * LN((2 * n_all + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM df, total),
sized AS (SELECT r, doc_id, (10 + (90 * len(w)::BIGINT * n_all) // l_all)::BIGINT AS m FROM d, total WHERE len(w) > 0),
q AS (
  SELECT DISTINCT q, item_id, unnest(w) AS term FROM (
    SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL)),
scored AS (
  SELECT q, item_id, sized.r, doc_id, SUM(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN weight USING (term) JOIN tf USING (term) JOIN sized USING (r) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

#: CRC-32 of a string's UTF-8 bytes, bit by bit, by its reflected polynomial.
_CRC32 = """xor(list_reduce(
    list_transform(range(1, octet_length(encode(term)) + 1), lambda i: ('0x' || substr(hex(encode(term)), (2 * i - 1)::INTEGER, 2))::BIGINT),
    lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, (x % 2) * 3988292384), xor(c, b)), 4294967295), 4294967295)"""

_RESAMPLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w
  FROM documents),
own AS (SELECT r, term, COUNT(*)::BIGINT AS n FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
aim AS (
  SELECT term, COUNT(*)::BIGINT AS n FROM (
    SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY term),
dictionary AS (
  SELECT term, SUM(s)::BIGINT AS s, SUM(t)::BIGINT AS t FROM (SELECT term, n AS s, 0 AS t FROM own UNION ALL SELECT term, 0, n FROM aim) GROUP BY term),
hashed AS (SELECT term, s, t, {_CRC32} % 10000 AS bucket FROM dictionary),
gains AS (
  SELECT bucket, FLOOR(1000 * LN((SUM(t) + 1)::DOUBLE * ((SELECT SUM(s) FROM hashed) + 10000)::DOUBLE / ((SUM(s) + 1)::DOUBLE * ((SELECT SUM(t) FROM hashed) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM hashed GROUP BY bucket),
weights AS (SELECT r, SUM(n * gain)::BIGINT AS weight FROM own JOIN hashed USING (term) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT d.r, doc_id, len(w)::BIGINT AS n_features, COALESCE(weight, 0)::BIGINT AS weight,
         (COALESCE(weight, 0) + FLOOR(-1000 * LN(-LN((('0x' || substr(sha256('2024:' || COALESCE(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM d LEFT JOIN weights USING (r)),
fit AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS rank, COUNT(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END::BIGINT AS rank FROM scored LEFT JOIN fit USING (r)
"""

SQL = {"op11_ranked_search": _SEARCH, "op13_importance_resampling": _RESAMPLE, "op2_mixing": _MIX, "op5_decontamination": _WINDOWS, "op8_warc": _WARC}
