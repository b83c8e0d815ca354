"""DuckDB statements of the operators that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT item, w, least(len(w), 13) AS n, unnest(range(1, (len(w) - least(len(w), 13) + 2)::BIGINT)) AS p
  FROM b WHERE len(w) > 0
),
bk AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM bw),
dp AS (
  SELECT doc_id, w, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS p
  FROM d, (SELECT DISTINCT n FROM bk) WHERE len(w) >= n
),
h AS (
  SELECT doc_id, p, x.n, item
  FROM (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k FROM dp) x JOIN bk ON x.n = bk.n AND x.k = bk.k
),
hits AS (
  SELECT doc_id, count(DISTINCT q)::BIGINT AS n_hit
  FROM (SELECT doc_id, unnest(range(p, (p + n)::BIGINT)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM h)) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

# Windows of 50 words: the first id that has each, then the covered words.
REPEATED_PASSAGES = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, (len(w) - 48)::BIGINT)) AS pos FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 49], ' ') AS k FROM p),
f AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY k) AS first FROM k),
c AS (
  SELECT doc_id, list(DISTINCT q) AS covered
  FROM (SELECT doc_id, unnest(range(pos, pos + 50)) AS q FROM f WHERE first < doc_id) GROUP BY doc_id
),
e AS (
  SELECT d.doc_id, w, CASE WHEN covered IS NULL THEN w ELSE list_select(w, list_sort(
           list_filter(range(1, (len(w) + 1)::BIGINT), lambda i: NOT list_contains(covered, i)))) END AS kept,
         coalesce(list_sort(covered), []) AS covered
  FROM d LEFT JOIN c ON d.doc_id = c.doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(covered)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256,
       len(list_filter(range(1, (len(covered) + 1)::BIGINT), lambda i: i = 1 OR covered[i] <> covered[i - 1] + 1))::BIGINT AS n_spans
FROM e
"""

# The same on bytes, written as pairs of hexadecimal digits.
REPEATED_STRINGS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, (length(h) // 2 - 49)::BIGINT)) AS pos FROM d WHERE length(h) >= 100),
k AS (SELECT doc_id, pos, substr(h, 2 * pos + 1, 100) AS k FROM p),
f AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY k) AS first FROM k),
m AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM f WHERE first < doc_id),
g AS (SELECT doc_id, pos, sum((before IS NULL OR pos > before + 50)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM m),
r AS (SELECT doc_id, run, min(pos) AS a, max(pos) + 50 AS b FROM g GROUP BY doc_id, run),
s AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS left_at FROM r),
t AS (
  SELECT s.doc_id, count(*)::BIGINT AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last,
         string_agg(substr(h, 2 * left_at + 1, 2 * (a - left_at)), '' ORDER BY a) AS heads
  FROM s JOIN d ON s.doc_id = d.doc_id GROUP BY s.doc_id
)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN t.doc_id IS NULL THEN h ELSE heads || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""

# One period of earliest deadline first, slot by slot, then every block's slot.
# A waiting source's key: not released, deadline, number.
MIXTURE = """
WITH RECURSIVE r AS (
  SELECT doc_id, coalesce(source, '') AS source, md5(coalesce(doc_id::VARCHAR, '')) AS deal FROM documents
),
c AS (SELECT source, count(*) AS n FROM r GROUP BY source),
q AS (SELECT source, n, greatest(1000, 2 * count(*) OVER ()) AS slots, count(*) OVER () AS m, pow(n::DOUBLE, 0.9) AS weight FROM c),
u AS (SELECT *, (slots - m) * weight / sum(weight) OVER () AS quota FROM q),
v AS (
  SELECT *, floor(quota) AS whole, slots - m - sum(floor(quota)) OVER () AS spare,
         row_number() OVER (ORDER BY floor(quota) - quota, source) AS place
  FROM u
),
p AS (SELECT source, n::BIGINT AS n, slots::BIGINT AS slots, (whole + 1 + (place <= spare)::INT)::BIGINT AS share FROM v),
one AS (SELECT list(source ORDER BY source) AS s, list(share ORDER BY source) AS a, max(slots) AS slots FROM p),
edf AS (
  SELECT 0::BIGINT AS t, list_transform(a, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick, a, slots FROM one
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: d + (i = k)::BIGINT), k, a, slots
  FROM (
    SELECT *, list_min(list_transform(a, lambda x, i:
      (CASE WHEN done[i] * slots // x <= t THEN 0 ELSE 1000000000000000 END)
      + ((done[i] + 1) * slots + x - 1) // x * 100000 + i)) % 100000 AS k
    FROM edf WHERE t < slots
  )
),
turns AS (
  SELECT one.s[pick] AS source, t - 1 AS slot_in_period, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn
  FROM edf, one WHERE t > 0
),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY deal, doc_id) - 1 AS rank FROM r),
ends AS (
  SELECT max((n - 1) // 16 // p.share * p.slots + slot_in_period) AS horizon
  FROM p JOIN turns ON turns.source = p.source AND turn = (n - 1) // 16 % p.share
  WHERE p.share * (SELECT count(*) FROM r) >= n * p.slots
)
SELECT doc_id, k.source, (rank // 16)::BIGINT AS block, (rank % 16)::BIGINT AS place,
       (rank // 16 // share * slots + slot_in_period)::BIGINT AS slot,
       (rank // 16 * slots // share)::BIGINT AS release,
       (((rank // 16 + 1) * slots + share - 1) // share)::BIGINT AS deadline,
       rank // 16 // share * slots + slot_in_period <= horizon AS in_mix
FROM ranked k JOIN p ON p.source = k.source JOIN turns ON turns.source = k.source AND turn = rank // 16 % share, ends
"""

# CRC-32 byte by byte over the hexadecimal digits of each distinct feature, through the table of 256 bytes.
IMPORTANCE = f"""
WITH RECURSIVE bits AS (
  SELECT b, b AS c, 0 AS k FROM (SELECT unnest(range(256)) AS b)
  UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8
),
crcs AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
texts AS (
  SELECT 'd' AS side, row_number() OVER () AS no, doc_id, {_WORDS} AS w FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), NULL, {_WORDS} FROM benchmark
),
runs AS (
  SELECT side, no, unnest(w) AS f FROM texts
  UNION ALL
  SELECT side, no, w[p] || ' ' || w[p + 1] FROM (SELECT side, no, w, unnest(range(1, len(w)::BIGINT)) AS p FROM texts)
),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM runs)),
hashed AS (
  SELECT f, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(1, len(h)::BIGINT, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
    lambda c, x: xor(t[(xor(c, x) & 255) + 1], c // 256)), 4294967295) % 10000 AS bucket
  FROM hexed, crcs
),
r AS (SELECT side, no, bucket FROM runs JOIN hashed USING (f)),
n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM r GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
                                 / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS gain FROM n
),
m AS (SELECT no, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM r JOIN g USING (bucket) WHERE side = 'd' GROUP BY no),
z AS (
  SELECT doc_id, len(w) AS n, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                    / 4294967296::DOUBLE)))::BIGINT AS score
  FROM texts LEFT JOIN m ON texts.no = m.no WHERE side = 'd'
),
o AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n >= 20) OVER () AS many FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n >= 20 AND place <= 25 * many // 100 THEN place END AS rank FROM o
"""

TOP_SCORES = """
WITH r AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
d AS (SELECT len(v) AS dim FROM r GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
p AS (
  SELECT q.vec_id AS query_id, q.v, c.vec_id, list_sum(list_transform(q.v, lambda x, i: x * c.v[i]))::BIGINT AS score
  FROM r q, r c, d WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = dim AND len(c.v) = dim
),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 20
"""
