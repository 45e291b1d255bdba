"""DuckDB SQL for the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

import string

WORDS = r"[^\x20\x09-\x0D]+"

#: One round: vectors to their nearest centroid, then centroids to the floor of the mean of theirs.
_ASSIGN = """a{r} AS (SELECT vec_id, x, arg_min(c, d) AS c, min(d[1]) AS distance
  FROM (SELECT v.no, vec_id, v.x, c, [list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c] AS d FROM v, m{r} m)
  GROUP BY no, vec_id, x)"""
_MOVE = """m{n} AS (SELECT m{r}.c, coalesce(new.x, m{r}.x) AS x FROM m{r} LEFT JOIN
  (SELECT c, list(CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT) ORDER BY i) AS x FROM
    (SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY c, i) GROUP BY c) new ON new.c = m{r}.c)"""


def clustering_sql(rounds: int = 3) -> str:
    steps = ",\n".join(f"{_ASSIGN.format(r=r)},\n{_MOVE.format(r=r, n=r + 1)}" for r in range(rounds))
    return f"""
WITH v AS (SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
m0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS INTEGER) AS c, x FROM v
       ORDER BY c LIMIT 16),
{steps},
{_ASSIGN.format(r=rounds)}
SELECT vec_id, a{rounds}.c AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m{rounds}.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN m{rounds} ON m{rounds}.c = a{rounds}.c"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS at FROM (SELECT g.doc_id, g.i FROM g JOIN f ON f.k = g.k WHERE f.first < g.doc_id)),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS at FROM d),
kept AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.at) AS text, count(*) AS n
         FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.at = w.at WHERE gone.at IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
        "op5_bm25_search": rf"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORDS}')) AS word
           FROM documents),
tf AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY doc_id, word),
len AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id),
total AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT sum(n) FROM len) / (SELECT count(*) FROM documents) AS mean),
df AS (SELECT word, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, total GROUP BY word, docs),
s AS (SELECT q.doc_id AS query_id, tf.doc_id, round(sum(idf * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * len.n / mean))), 6) AS score
      FROM tf q JOIN df ON df.word = q.word JOIN tf ON tf.word = q.word JOIN len ON len.doc_id = tf.doc_id, total
      WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, tf.doc_id)
SELECT query_id, rank, doc_id, score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10""",
        "op11_spelling_variants": rf"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
                 CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
runs AS (SELECT doc_id, run, count(*) AS k FROM
  (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[a-zÀ-ÿ]{{7,}}')) AS run FROM documents)
  GROUP BY doc_id, run),
hashed AS (SELECT run, k, length(run) AS len, xor(4294967295, list_reduce(list_prepend(4294967295,
             list_transform(string_split(rtrim(regexp_replace(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '(..)', '\1 ', 'g')), ' '), lambda b: CAST('0x' || b AS BIGINT))),
             lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h FROM runs, crc),
found AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % len AS BIGINT)) || substr(run, CAST(h % len + 2 AS BIGINT)) ELSE run END AS word, k FROM hashed),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM found WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, n, left(word, i - 1) || substr(word, i + 1) AS rest, i FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, w.word, w.n FROM cut JOIN w ON w.word = cut.rest
  UNION SELECT w.word, cut.word, cut.n FROM cut JOIN w ON w.word = cut.rest),
best AS (SELECT word, count(*) AS n_near, min_by(near, (-n, near)) AS near, max(n) AS near_n FROM pairs GROUP BY word),
known AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form,
  CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM w LEFT JOIN best ON best.word = w.word),
chain AS (SELECT word, word AS at, form AS next FROM known UNION ALL
  SELECT chain.word, known.word, known.form FROM chain JOIN known ON known.word = chain.next)
SELECT known.word, n, n_near, form, form_n, chain.at AS root FROM known JOIN chain ON chain.word = known.word AND chain.next IS NULL""",
        "op12_centroid_clustering": clustering_sql(),
        "op13_source_mixing": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS size,
  coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
p AS (SELECT *, sum(size) OVER () - coalesce(sum(3 * size) OVER before, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest_w
  FROM s WINDOW before AS (ORDER BY 3 * size / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * size * rest_w < w * rest AS capped FROM p),
l AS (SELECT (SELECT sum(size) FROM s) - coalesce(sum(3 * size) FILTER (capped), 0) AS rest, sum(w) FILTER (NOT capped) AS w FROM c),
t AS (SELECT source, size, CASE WHEN capped THEN CAST(3 * size AS DOUBLE) ELSE CAST(c.w AS DOUBLE) * CAST(l.rest AS DOUBLE) / CAST(l.w AS DOUBLE) END AS target FROM c, l),
r AS (SELECT source, CAST(size AS BIGINT) AS source_size, target, CASE WHEN size > 0 THEN target / CAST(size AS DOUBLE) ELSE 0 END AS rate FROM t),
e AS (SELECT d.*, source_size, target, rate, seed, CAST('0x' || left(md5('mix:' || seed || ':' || key), 12) AS BIGINT) / 281474976710656.0::DOUBLE < rate - floor(rate) AS extra
  FROM d JOIN r ON r.source IS NOT DISTINCT FROM d.source, range(16) s(seed)),
best AS (SELECT source, arg_min(seed, [missed, seed]) AS seed FROM
  (SELECT source, seed, abs(CAST(any_value(floor(rate) * source_size) + sum(CASE WHEN extra THEN size ELSE 0 END) AS DOUBLE) - any_value(target)) AS missed
   FROM e GROUP BY source, seed) GROUP BY source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (floor(rate) + CASE WHEN extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e JOIN best ON best.source IS NOT DISTINCT FROM e.source AND best.seed = e.seed""",
    }
