"""Registered queries of this subpackage as SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Sequence

from wordweave.llm import urls


def exact_duplicates() -> str:
    return r"""
WITH plain AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
),
classes AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM plain GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM plain JOIN classes USING (t)"""


def _level(order: int) -> str:
    """CTEs: grams of a context of ``order`` characters with both smoothed
    probabilities."""
    below = f"JOIN q{order - 1} b ON b.g = right(l.g, {order})" if order else ""
    q = {k: f"b.q{k}" if order else f"1.0::DOUBLE / {urls.CHARACTERS}" for k in "ar"}

    def smoothed(k: str) -> str:
        return (
            f"CASE WHEN c.n{k} > 0 THEN (l.{k} + c.t{k} * ({q[k]})) / (c.n{k} + c.t{k})::DOUBLE "
            f"ELSE {q[k]} END AS q{k}"
        )

    return f"""
l{order} AS MATERIALIZED (
  SELECT right(gram, {order + 1}) AS g, sum(a)::BIGINT AS a, sum(r)::BIGINT AS r FROM grams GROUP BY 1
),
c{order} AS MATERIALIZED (
  SELECT left(g, {order}) AS c, sum(a)::BIGINT AS na, sum(r)::BIGINT AS nr,
    count(*) FILTER (a > 0) AS ta, count(*) FILTER (r > 0) AS tr
  FROM l{order} GROUP BY 1
),
q{order} AS MATERIALIZED (
  SELECT l.g, {smoothed('a')}, {smoothed('r')}
  FROM l{order} l JOIN c{order} c ON c.c = left(l.g, {order}) {below}
)"""


def url_filter(rules: Sequence[urls.Rule]) -> str:
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))

    def chosen(value) -> str:
        cases = " ".join(
            f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(v, h, p)}'"
            for v, h, p in ordered
        )
        return f"CASE {cases} END"

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    marks = ", ".join(f"'{c}'" for c in urls.CALIBRATING)
    levels = ",".join(_level(k) for k in range(urls.ORDER + 1))
    return rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{upper}', '{upper.lower()}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
),
ruled AS MATERIALIZED (
  SELECT *, host || path AS address, {chosen(lambda v, h, p: h + p)} AS rule, {chosen(lambda v, h, p: v)} AS decided
  FROM split
),
addresses AS MATERIALIZED (
  SELECT address, max(decided) AS decided, count(*) AS n,
    max(decided) IS NOT NULL AND substr(md5(address), 1, 1) NOT IN ({marks}) AS learned
  FROM ruled GROUP BY address
),
windows AS MATERIALIZED (
  SELECT address, decided, n, learned,
    substr(repeat(chr(2), {urls.ORDER}) || address || chr(3), i, {urls.ORDER + 1}) AS gram
  FROM (SELECT *, unnest(range(1, len(address) + 2)) AS i FROM addresses)
),
grams AS MATERIALIZED (
  SELECT gram, sum(CASE WHEN learned AND decided = 'allow' THEN n ELSE 0 END) AS a,
    sum(CASE WHEN learned AND decided = 'block' THEN n ELSE 0 END) AS r
  FROM windows GROUP BY gram
),{levels},
scores AS MATERIALIZED (
  SELECT address, round(avg(ln(qa) - ln(qr)), 6) AS score
  FROM windows JOIN q{urls.ORDER} ON g = gram GROUP BY address
),
steps AS MATERIALIZED (
  SELECT greatest(-{urls.REACH}, least({urls.REACH}, floor(score / {urls.STEP}::DOUBLE)))::INTEGER AS step,
    sum(CASE WHEN decided = 'allow' THEN n ELSE 0 END) AS a, sum(CASE WHEN decided = 'block' THEN n ELSE 0 END) AS r
  FROM addresses JOIN scores USING (address) WHERE decided IS NOT NULL AND NOT learned GROUP BY 1
),
tried AS (
  SELECT s, (SELECT coalesce(sum(CASE WHEN step < s THEN a ELSE r END), 0) FROM steps) AS wrong
  FROM (SELECT unnest(range((SELECT min(step) FROM steps), (SELECT max(step) FROM steps) + 2)) AS s)
),
least_score AS (
  SELECT CASE WHEN (SELECT min(least(x.a, x.r)) FROM (SELECT sum(a) AS a, sum(r) AS r FROM steps) x) > 0
    THEN round({urls.STEP}::DOUBLE * (SELECT s FROM tried ORDER BY wrong, abs(s), s LIMIT 1), 6) ELSE 0 END AS t
)
SELECT page_id, host, path, rule,
  coalesce(decided, CASE WHEN score >= (SELECT t FROM least_score) THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled JOIN scores USING (address)"""


def phrases(least: int = 10, share: int = 50, top: int = 2000) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
split AS MATERIALIZED (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
),
f1 AS MATERIALIZED (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(w) AS p FROM split) GROUP BY ALL),
f2 AS MATERIALIZED (
  SELECT lang, p1, p2, count(*) AS f
  FROM (SELECT lang, w[i] AS p1, w[i + 1] AS p2 FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM split))
  GROUP BY ALL HAVING count(*) >= {least}
),
f3 AS MATERIALIZED (
  SELECT lang, p1, p2, p3, count(*) AS f
  FROM (
    SELECT lang, w[i] AS p1, w[i + 1] AS p2, w[i + 2] AS p3
    FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM split)
  )
  GROUP BY ALL HAVING count(*) >= {least}
),
taken AS (
  SELECT lang, p1, p2, max(f) AS most
  FROM (SELECT lang, p1, p2, f FROM f3 UNION ALL SELECT lang, p2, p3, f FROM f3) GROUP BY ALL
),
cuts AS (
  SELECT x.lang, x.p1 || ' ' || x.p2 AS phrase, 1 AS k, x.f AS a, l.f AS l, r.f AS r
  FROM f2 x JOIN f1 l ON l.lang = x.lang AND l.p = x.p1 JOIN f1 r ON r.lang = x.lang AND r.p = x.p2
    LEFT JOIN taken t ON t.lang = x.lang AND t.p1 = x.p1 AND t.p2 = x.p2
  WHERE t.most IS NULL OR 100 * t.most < {share} * x.f
  UNION ALL
  SELECT x.lang, x.p1 || ' ' || x.p2 || ' ' || x.p3, 1, x.f, l.f, r.f
  FROM f3 x JOIN f1 l ON l.lang = x.lang AND l.p = x.p1
    JOIN f2 r ON r.lang = x.lang AND r.p1 = x.p2 AND r.p2 = x.p3
  UNION ALL
  SELECT x.lang, x.p1 || ' ' || x.p2 || ' ' || x.p3, 2, x.f, l.f, r.f
  FROM f3 x JOIN f2 l ON l.lang = x.lang AND l.p1 = x.p1 AND l.p2 = x.p2
    JOIN f1 r ON r.lang = x.lang AND r.p = x.p3
),
scored AS (
  SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts
),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM ranked JOIN (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang) USING (lang) WHERE rank <= {top}"""


def near_vectors(linked: float = 0.98) -> str:
    return f"""
WITH RECURSIVE vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, label, embedding::DOUBLE[] AS v,
    label IS NOT NULL AND coalesce(len(embedding), 0) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS able
  FROM embeddings
),
links AS MATERIALIZED (
  SELECT a.i AS a, b.i AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.i <> b.i
  WHERE a.able AND b.able AND CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= {linked} ELSE FALSE END
),
reached(a, b) AS (
  SELECT i, i FROM vectors UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
),
lowest AS (SELECT r.a, min(x.vec_id) AS component_id FROM reached r JOIN vectors x ON x.i = r.b GROUP BY r.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vectors.i) AS n_links, component_id,
  vec_id IS NOT DISTINCT FROM component_id AS kept
FROM vectors JOIN lowest ON lowest.a = vectors.i"""
