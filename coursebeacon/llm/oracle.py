"""DuckDB SQL for the queries that SQL can express, over whole tables. Constants are written out."""

STATEMENTS: dict[str, str] = {}

STATEMENTS["op1_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""

STATEMENTS["op3_url_filters"] = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
q AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p),
lab AS (
  SELECT doc_id, max(CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id),
hc AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k,
         regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') AS name
  FROM q LEFT JOIN lab ON lab.doc_id = q.page_id GROUP BY host),
hl AS (
  SELECT *, string_split(name, '.') AS parts FROM hc),
hp AS (
  SELECT host, n, k, parts, len(parts) AS m,
         array_to_string(parts[-2:], '.') AS last2 FROM hl),
h AS (
  SELECT host, n, k,
         CASE WHEN m > 1 AND last2 IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'com.br', 'co.jp', 'co.nz', 'co.za')
              THEN array_to_string(parts[-3:], '.') ELSE last2 END AS domain,
         CASE WHEN m > 1 AND last2 IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'com.br', 'co.jp', 'co.nz', 'co.za')
              THEN last2 ELSE parts[-1] END AS suffix
  FROM hp),
o AS (SELECT (sum(k) + 0.5) / (sum(n) + 1.0) AS overall FROM h),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY suffix),
sr AS (
  SELECT least(greatest(coalesce(CASE WHEN sum(n) - count(*) > 0
    THEN (sum(pow(k - n * overall, 2) / (n * overall * (1 - overall))) - count(*)) / (sum(n) - count(*))
    ELSE 0.5 END, 0.5), 0.0001), 0.5) AS rho FROM s, o WHERE n > 0),
sm AS (
  SELECT suffix, ((1 - rho) / rho * overall + k) / ((1 - rho) / rho + n) AS suffix_mean FROM s, o, sr),
d AS (
  SELECT domain, h.suffix, any_value(suffix_mean) AS p, sum(n) AS n, sum(k) AS k
  FROM h JOIN sm ON h.suffix = sm.suffix GROUP BY domain, h.suffix),
dr AS (
  SELECT least(greatest(coalesce(CASE WHEN sum(n) - count(*) > 0
    THEN (sum(pow(k - n * p, 2) / (n * p * (1 - p))) - count(*)) / (sum(n) - count(*))
    ELSE 0.5 END, 0.5), 0.0001), 0.5) AS rho FROM d WHERE n > 0),
dm AS (SELECT domain, ((1 - rho) / rho * p + k) / ((1 - rho) / rho + n) AS domain_mean FROM d, dr),
hd AS (SELECT host, n, k, domain_mean AS p FROM h JOIN dm ON h.domain = dm.domain),
hr AS (
  SELECT least(greatest(coalesce(CASE WHEN sum(n) - count(*) > 0
    THEN (sum(pow(k - n * p, 2) / (n * p * (1 - p))) - count(*)) / (sum(n) - count(*))
    ELSE 0.5 END, 0.5), 0.0001), 0.5) AS rho FROM hd WHERE n > 0),
hb AS (
  SELECT host, (1 - rho) / rho * p + k AS a, (1 - rho) / rho * (1 - p) + n - k AS b FROM hd, hr),
hv AS (
  SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) >= 0.5 AS blocked FROM hb),
v AS (
  SELECT page_id, q.host, path, blocked,
    CASE WHEN (q.host = 'example.net' OR q.host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (q.host = 'example.com' OR q.host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (q.host = 'org' OR q.host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (q.host = 'net' OR q.host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM q JOIN hv ON q.host = hv.host)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM v
"""

STATEMENTS["op2_benchmark_decontamination"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS size,
         array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS run
  FROM iw, unnest(range(1, greatest(len(w) - 10 + 2, 2))) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM win),
place AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS run
  FROM dw, sizes, unnest(range(1, len(w) - size + 2)) AS u(i)),
hit AS (SELECT doc_id, i, place.size, item FROM place JOIN win ON win.run = place.run AND win.size = place.size),
word AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, size)) AS u(k) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
  FROM hit GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)
"""

STATEMENTS["op10_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS run
  FROM d, unnest(range(1, len(w) - 20 + 2)) AS u(i)),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nth FROM win)
  WHERE nth > 1),
gone AS (
  SELECT doc_id, list(DISTINCT i + k) AS g FROM rep, unnest(range(0, 20)) AS u(k) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string([w[j] FOR j IN range(1, len(w) + 1) IF NOT list_contains(coalesce(g, []), j)], ' '), ''))
    AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

STATEMENTS["op13_phrase_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, size, w[i:i + size - 1] AS gram
  FROM w, (VALUES (1), (2), (3)) AS s(size), unnest(range(1, len(w) - size + 2)) AS u(i)),
f AS (
  SELECT lang, size, gram, array_to_string(gram, ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f
  FROM g GROUP BY lang, size, gram),
total AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, gram, phrase, f AS a FROM f WHERE size > 1 AND f >= 10),
cut AS (
  SELECT c.lang, c.size, c.phrase, a, k, x.f AS l, y.f AS r, (1000000 * a * a) // (x.f * y.f) AS score
  FROM cand c, unnest(range(1, c.size)) AS u(k)
  JOIN f x ON x.lang = c.lang AND x.gram = c.gram[1:k]
  JOIN f y ON y.lang = c.lang AND y.gram = c.gram[k + 1:c.size]),
low AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, part, max(a) AS around FROM (
    SELECT lang, array_to_string(gram[1:2], ' ') AS part, a FROM cand WHERE size = 3
    UNION ALL SELECT lang, array_to_string(gram[2:3], ' '), a FROM cand WHERE size = 3)
  GROUP BY lang, part),
kept AS (
  SELECT low.* FROM low LEFT JOIN around ON around.lang = low.lang AND part = phrase
  WHERE coalesce(100 * around < 50 * a, TRUE)),
best AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT best.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best JOIN total ON total.lang = best.lang WHERE rank <= 2000
"""
