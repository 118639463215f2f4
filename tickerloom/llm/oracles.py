"""DuckDB SQL for the queries of this package that SQL can express, over the same tables."""

from __future__ import annotations

_SPACE = r"[^\x20\x09-\x0D]+"

EXACT_TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

# Sources in the order of cap / weight: those before ``stop`` are capped, the others share what is left.
SOURCE_MIX = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACE}')) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17'), 1, 8) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * total / w, k) AS place FROM w),
c AS (SELECT *, (SELECT sum(total) FROM s) - 3 * (sum(total) OVER (ORDER BY place) - total) AS remaining,
  (SELECT sum(w) FROM w) - (sum(w) OVER (ORDER BY place) - w) AS weight FROM o),
f AS (SELECT arg_min(remaining, place) AS remaining, arg_min(weight, place) AS weight, min(place) AS stop FROM c WHERE remaining * w <= 3 * total * weight),
t AS (SELECT c.source, c.total, CASE WHEN c.place < f.stop THEN CAST(3 * c.total AS DOUBLE)
  ELSE c.w * CAST(f.remaining AS DOUBLE) / CAST(f.weight AS DOUBLE) END AS target FROM c, f),
p AS (SELECT *, CAST(round_even(target, 0) AS BIGINT) AS want FROM t),
q AS (SELECT source, total, target, CASE WHEN total > 0 THEN want // total ELSE 0 END AS whole,
  CASE WHEN total > 0 THEN want % total ELSE 0 END AS rest FROM p),
g AS (SELECT source, h, doc_id, size, count(*) AS m FROM d GROUP BY ALL),
b AS (SELECT *, sum(size * m) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size) AS upto FROM g)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, q.total AS source_size, q.target, CAST(q.whole * d.size + CASE WHEN b.upto < q.rest THEN d.size
  WHEN b.upto - d.size * b.m < q.rest THEN (q.rest - (b.upto - d.size * b.m)) // b.m ELSE 0 END AS BIGINT) AS taken
FROM d JOIN b ON b.source IS NOT DISTINCT FROM d.source AND b.h = d.h AND b.doc_id IS NOT DISTINCT FROM d.doc_id AND b.size = d.size
JOIN q ON q.source IS NOT DISTINCT FROM d.source"""

CHAT_FORMAT = r"""WITH x AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER w AS k,
  coalesce(lag(role) OVER w, '') AS before, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS last
  FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '|', '\p')) + 1
    + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 11) AS BIGINT) AS formatted_chars,
  bool_and((before, role) IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')))
    AND bool_or(last AND role = 'assistant') AS well_formed
FROM t GROUP BY conv_id"""

NGRAM_JOIN = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.b AS component_id FROM w LEFT JOIN n USING (doc_id)
JOIN (SELECT a, min(b) AS b FROM reach GROUP BY 1) r ON r.a = w.doc_id"""

# The checksum byte by byte over the table of its remainders; hex digits give the bytes of a text.
IMPORTANCE_RESAMPLING = r"""WITH RECURSIVE step(b, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8),
tab AS (SELECT list(v ORDER BY b) AS t FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
f AS (SELECT row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
g AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM f UNION SELECT f FROM g)),
y AS (SELECT f, [4294967295::BIGINT] || list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS y FROM h),
c AS (SELECT f, xor(list_reduce(y, lambda s, v: xor(s >> 8, t[(xor(s, v) & 255) + 1])), 4294967295) % 10000 AS bucket FROM y, tab),
s AS (SELECT bucket, count(*) AS n FROM f JOIN c USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM g JOIN c USING (f) GROUP BY bucket),
e AS (SELECT c.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM s), 0) + 10000)::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM c) c LEFT JOIN s ON s.bucket = c.bucket LEFT JOIN t ON t.bucket = c.bucket),
m AS (SELECT row, count(*) AS n, sum(gain) AS gain FROM f JOIN c USING (f) JOIN e USING (bucket) GROUP BY row),
r AS (SELECT row, doc_id, len(w) AS words, coalesce(m.n, 0) AS n_features, CASE WHEN m.n IS NULL THEN 0
    ELSE CAST(m.gain // m.n - CASE WHEN m.gain < 0 AND m.gain % m.n <> 0 THEN 1 ELSE 0 END AS BIGINT) END AS weight,
  ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (row)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM r),
q AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY words >= 20) AS able FROM z)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN words >= 20 AND place <= 25 * able // 100 THEN CAST(place AS BIGINT) END AS rank FROM q"""

# Two hex digits a byte; a byte goes if one of the 400 strings that cover it starts twice.
SUFFIX_DEDUP = """WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT row, i, md5(substr(x, 2 * i + 1, 800)) AS m FROM (SELECT row, x, unnest(range(0, len(x) // 2 - 399)) AS i FROM d WHERE len(x) >= 800)),
g AS (SELECT m FROM s GROUP BY m HAVING count(*) > 1),
p AS (SELECT row, i, lag(i) OVER (PARTITION BY row ORDER BY i) AS before FROM s JOIN g USING (m)),
n AS (SELECT row, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY i) AS span FROM p),
r AS (SELECT row, span, min(i) AS a, max(i) + 400 AS z FROM n GROUP BY row, span),
k AS (SELECT row, a, z, lag(z) OVER (PARTITION BY row ORDER BY a) AS upto, row_number() OVER (PARTITION BY row ORDER BY a DESC) AS back FROM r),
t AS (SELECT d.row, string_agg(substr(x, 2 * coalesce(upto, 0) + 1, 2 * (a - coalesce(upto, 0))), '' ORDER BY a)
    || substr(any_value(x), 2 * max(z) + 1) AS kept, sum(z - a) AS removed, count(*) AS spans FROM k JOIN d USING (row) GROUP BY d.row)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN t USING (row)"""

ORACLES = {
    "op2_exact_top_k": EXACT_TOP_K,
    "op3_source_mix": SOURCE_MIX,
    "op4_chat_format": CHAT_FORMAT,
    "op10_ngram_jaccard_join": NGRAM_JOIN,
    "op12_importance_resampling": IMPORTANCE_RESAMPLING,
    "op13_suffix_dedup": SUFFIX_DEDUP,
}
