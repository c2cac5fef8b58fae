"""DuckDB SQL for the queries that SQL can state."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_REPEATS = f"""
  WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
  win AS MATERIALIZED (
    SELECT r, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS d
    FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
  rep AS (SELECT d FROM win GROUP BY d HAVING count(*) > 1),
  lost AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win WHERE d IN (SELECT d FROM rep)),
  flags AS (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
  kept AS (SELECT f.r, count(*) AS n, string_agg(f.x, ' ' ORDER BY f.p) AS t
           FROM flags f LEFT JOIN lost ON f.r = lost.r AND f.p = lost.p WHERE lost.p IS NULL GROUP BY f.r)
  SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
  FROM w LEFT JOIN kept USING (r)"""

# Five bits of a hexadecimal digest at a time: digit 5 i / 4 and the next hold them.
_BASE32 = """
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
    (16 * (instr('0123456789abcdef', substr(h, 1 + (5 * i) // 4, 1)) - 1)
     + instr('0123456789abcdef', substr(h || '0', 2 + (5 * i) // 4, 1)) - 1) >> (3 - (5 * i) % 4)) & 31)::INT, 1)), '')"""

_WARC = f"""
  WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
  k AS (SELECT *, max(page_id) OVER (PARTITION BY n, h) AS keeper FROM p)
  SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest,
         CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
         CASE WHEN keeper <> page_id THEN keeper END AS refers_to, true AS intact
  FROM k"""

_JACCARD = rf"""
  WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) BETWEEN 1 AND 2 THEN [array_to_string(ws, ' ')]
           ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END)) AS g FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g)
        WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
  l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
  t AS (SELECT x, y FROM l UNION SELECT t.x, l.y FROM t JOIN l ON l.x = t.y)
  SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, m.m) AS component_id
  FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM t GROUP BY x) m USING (doc_id)"""


_ROUND = """
  a{k} AS MATERIALIZED (
    SELECT d.part, d.xs, d.n, arg_min(e, s * 64 + e) AS e
    FROM (SELECT d.part, d.xs, d.n, b.e, list_sum(list_transform(range(1, len(d.xs) + 1),
                 lambda i: (d.xs[i] - b.c[i]) * (d.xs[i] - b.c[i])))::BIGINT AS s
          FROM d JOIN b{k} b USING (part)) d GROUP BY ALL),
  m{k} AS (
    SELECT part, e, list(floor_mean ORDER BY i) AS c
    FROM (SELECT part, e, i, CAST(floor(sum(xs[i] * n) / sum(n)) AS BIGINT) AS floor_mean
          FROM a{k}, (SELECT unnest(range(1, 1 + (SELECT any_value(len(xs)) FROM d))) AS i) GROUP BY part, e, i) GROUP BY part, e),
  b{next} AS MATERIALIZED (SELECT part, e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (part, e)),"""

_CODES = f"""
  WITH v AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
           list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS xs
    FROM embeddings WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  p AS MATERIALIZED (
    SELECT r, part, xs[part * (len(xs) // 16) + 1:(part + 1) * (len(xs) // 16)] AS xs
    FROM v, (SELECT unnest(range(0, 16)) AS part)),
  d AS MATERIALIZED (SELECT part, xs, count(*) AS n FROM p GROUP BY part, xs),
  b0 AS MATERIALIZED (SELECT part, r - 1 AS e, xs AS c FROM p WHERE r <= 64),
  {_ROUND.format(k=0, next=1)}
  {_ROUND.format(k=1, next=2)}
  f AS MATERIALIZED (
    SELECT part, xs, min(s * 64 + e) % 64 AS e, min(s) AS s
    FROM (SELECT d.part, d.xs, b.e, list_sum(list_transform(range(1, len(d.xs) + 1),
                 lambda i: (d.xs[i] - b.c[i]) * (d.xs[i] - b.c[i])))::BIGINT AS s
          FROM d JOIN b2 b USING (part)) GROUP BY ALL),
  t AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS h FROM b2),
  c AS (SELECT r, string_agg(printf('%02x', f.e), '' ORDER BY part) AS code, sum(s)::BIGINT AS error
        FROM p JOIN f USING (part, xs) GROUP BY r)
  SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
  FROM v JOIN c USING (r), t"""

_PHRASES = r"""
  WITH pieces AS MATERIALIZED (
    SELECT coalesce(lang, 'und') AS lang, unnest(list_transform(string_split_regex(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]'),
             lambda x: regexp_extract_all(x, '[^ 	]+'))) AS ws FROM documents),
  grams AS MATERIALIZED (
    SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces), (SELECT unnest([1, 2, 3, 4]) AS k)
    WHERE i + k - 1 <= len(ws)),
  f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
  n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang),
  c AS MATERIALIZED (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
  s AS (SELECT lang, c.phrase, a, j, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score
        FROM (SELECT *, unnest(range(1, len(ws))) AS j FROM c) c
        JOIN f l USING (lang) JOIN f r USING (lang)
        WHERE l.phrase = array_to_string(ws[1:j], ' ') AND r.phrase = array_to_string(ws[j + 1:], ' ')),
  best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
  inner_ AS (
    SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS by_
    FROM (SELECT lang, ws, a, m, unnest(range(1, len(ws) - m + 2)) AS i
          FROM (SELECT lang, ws, a, unnest(range(2, len(ws))) AS m FROM c)) GROUP BY ALL),
  kept AS (SELECT best.* FROM best LEFT JOIN inner_ USING (lang, phrase)
           WHERE by_ IS NULL OR 100 * by_ < 80 * a)
  SELECT lang, rank, phrase, a, l, r, n, score
  FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
  JOIN n USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {
        "op7_substring_dedup": _REPEATS,
        "op8_warc": _WARC,
        "op9_jaccard_join": _JACCARD,
        "op11_code_compression": _CODES,
        "op13_collocations": _PHRASES,
    }
