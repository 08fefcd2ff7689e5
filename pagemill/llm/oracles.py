"""DuckDB SQL of the training-data queries that SQL can express."""

from .centroids import CLUSTERS, COMPONENTS, ROUNDS, SCALE
from .centroids import SEED as HASH_SEED
from .collocations import HELD_PERCENT, LOWER, MAX_WORDS, MIN_COUNT, SCORE_UNIT, TOP, UPPER
from .embeddings import MIN_COSINE
from .mixing import SEED
from .quality import MAX_DOCS_PER_HOST, MAX_REPEAT_PERCENT, MIN_KEPT_PERCENT, MIN_WORDS

_WORD = r"'[^\x20\x09-\x0D]+'"

MIX_SOURCES = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS BIGINT) AS size,
    md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST) AS pos FROM w),
r AS (
  SELECT *, sum(source_size) OVER ()
      - 3 * coalesce(sum(source_size) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
    sum(weight) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM o),
f AS (SELECT min_by(words_left, pos) AS words_left, min_by(weight_left, pos) AS weight_left, min(pos) AS pos
  FROM r WHERE 3 * source_size * weight_left >= weight * words_left),
t AS (
  SELECT r.source, source_size,
    CASE WHEN f.pos IS NULL OR r.pos < f.pos THEN CAST(3 * source_size AS DOUBLE)
      ELSE CAST(weight * f.words_left AS DOUBLE) / f.weight_left END AS target
  FROM r LEFT JOIN f ON true),
p AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) // source_size END AS passes,
    CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) % source_size END AS rest
  FROM t),
g AS (SELECT source, k, sum(size) AS words FROM d GROUP BY source, k),
u AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY k) AS upto FROM g),
e AS (
  SELECT p.source, max(k) AS last FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source
  WHERE 2 * upto - words <= 2 * rest GROUP BY p.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (passes + CASE WHEN rest > 0 AND k <= coalesce(last, '') THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""

QUALITY_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, {_WORD}) AS ws FROM d),
x AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (
  SELECT rid, count(DISTINCT p) AS n
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM x) WHERE c > 1)
  GROUP BY rid),
l AS (SELECT *, len(regexp_extract_all(ln, {_WORD})) AS n
  FROM (SELECT rid, source, unnest(string_split(t, chr(10))) AS ln, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d)),
h AS (
  SELECT *, trim(regexp_replace(regexp_replace(lower(ln), '[0-9]+', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS h
  FROM l WHERE n > 0),
b AS (SELECT rid, md5(string_agg(h, chr(10) ORDER BY pos)) AS whole, count(*) - count(DISTINCT ln) AS dup FROM h GROUP BY rid),
common AS (
  SELECT source, h FROM (SELECT DISTINCT source, h, whole FROM h JOIN b USING (rid)) GROUP BY source, h HAVING count(*) > {MAX_DOCS_PER_HOST}),
lost AS (SELECT rid, sum(n) AS n FROM h JOIN common c ON h.source IS NOT DISTINCT FROM c.source AND h.h = c.h GROUP BY rid),
c AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(b.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(lost.n, 0) AS BIGINT) AS n_common_words
  FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN b USING (rid) LEFT JOIN lost USING (rid)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND 100 * (n_words - n_common_words) >= {MIN_KEPT_PERCENT} * n_words AS kept FROM f
"""


def _rounds() -> str:
    """Assignments a0, a1, ... to centroids c0, c1, ...: the smallest distance, then the smallest number."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""d{r} AS MATERIALIZED (
  SELECT rid, c, sum((v.x - k.x) * (v.x - k.x)) AS d FROM v JOIN c{r} k USING (i) GROUP BY rid, c),
a{r} AS MATERIALIZED (
  SELECT rid, c, d FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, c) AS n FROM d{r}) WHERE n = 1)""")
        if r < ROUNDS:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT k.c, k.i, coalesce(m.x, k.x) AS x
  FROM c{r} k LEFT JOIN (
    SELECT c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM v JOIN a{r} USING (rid) GROUP BY c, i
  ) m ON k.c = m.c AND k.i = m.i)""")
    return ",\n".join(steps)


CENTROID_CLUSTERING = f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {COMPONENTS}),
v AS MATERIALIZED (
  SELECT rid, unnest(range({COMPONENTS})) AS i, CAST(floor({SCALE} * CAST(unnest(embedding) AS DOUBLE)) AS HUGEINT) AS x FROM e),
s AS (SELECT rid, row_number() OVER (ORDER BY sha256('{HASH_SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), embedding) - 1 AS c FROM e),
c0 AS MATERIALIZED (SELECT c, i, x FROM s JOIN v USING (rid) WHERE c < {CLUSTERS}),
{_rounds()},
t AS (SELECT c, sum(d) AS inertia FROM a{ROUNDS} GROUP BY c),
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS hash FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(t.inertia AS BIGINT) AS cluster_inertia,
  CAST((SELECT sum(inertia) FROM t) AS BIGINT) AS inertia, hash AS centroid_sha256
FROM a{ROUNDS} JOIN e USING (rid) JOIN t USING (c) JOIN h USING (c)
"""

COLLOCATIONS = f"""
WITH w AS (
  SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER.decode()}', '{LOWER.decode()}') AS t FROM documents)),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, {MAX_WORDS + 1})) AS k)),
f AS MATERIALIZED (
  SELECT lang, phrase, k, count(*) AS f
  FROM (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM s) GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
q AS (
  SELECT c.lang, c.phrase, a, cut, l.f AS l, r.f AS r, CAST({SCORE_UNIT} * CAST(a AS HUGEINT) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1 : cut], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[cut + 1 : c.k], ' ')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS turn FROM q) WHERE turn = 1),
h AS (
  SELECT lang, array_to_string(ws[pos : pos + size - 1], ' ') AS phrase, max(f) AS holder
  FROM (SELECT lang, f, ws, size, unnest(range(1, k - size + 2)) AS pos
    FROM (SELECT lang, f, k, string_split(phrase, ' ') AS ws, unnest(range(2, k)) AS size FROM f WHERE k > 2))
  GROUP BY ALL)
SELECT * FROM (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
  FROM b JOIN n USING (lang) LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase
  WHERE holder IS NULL OR 100 * holder < {HELD_PERCENT} * a)
WHERE rank <= {TOP}
"""

EMBEDDING_LINKS = f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label,
    CASE WHEN label IS NOT NULL AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
      AND len([x FOR x IN embedding IF x <> 0]) > 0 THEN CAST(embedding AS DOUBLE[]) END AS e
  FROM embeddings),
link AS MATERIALIZED (
  SELECT a.rid, b.rid AS other FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.rid <> b.rid
  WHERE list_cosine_similarity(a.e, b.e) >= {MIN_COSINE}),
reach AS (SELECT rid, rid AS other FROM v UNION SELECT r.rid, l.other FROM reach r JOIN link l ON l.rid = r.other),
c AS (SELECT r.rid, min(o.vec_id) AS component_id FROM reach r JOIN v o ON o.rid = r.other GROUP BY r.rid),
n AS (SELECT rid, count(*) AS n FROM link GROUP BY rid)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN c USING (rid) LEFT JOIN n USING (rid)
"""
