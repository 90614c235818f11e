"""The registered queries as SQL, for checking only.

Written from the definition of each query, on purpose without the two-level
sums, buckets and in-row tricks of the Spark plans.
"""

from __future__ import annotations

from wordweave.functions import scoring
from wordweave.functions.lexicon import DEFAULT_LEXICON
from wordweave.functions.text import WHITESPACE
from wordweave.plans.catalog import CHOSEN, COUNT_MIN, HALF, NEGATIVE, SEED

ORACLE: dict[str, str] = {}


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[{WHITESPACE}]+'), lambda w: w <> '')"


def terms(text: str) -> str:
    strip = r"regexp_replace(lower(w), '[^\p{L}]', '', 'g')"
    return f"list_filter(list_transform({words(text)}, lambda w: {strip}), lambda t: t <> '')"


def chars(text: str) -> str:
    return (
        f"list_filter(string_split(regexp_replace({text}, '\\r\\n|\\r|\\n', chr(10), 'g'), ''), "
        "lambda c: c <> '')"
    )


def draw(*parts) -> str:
    return f"cast('0x' || substr(md5(concat_ws('|', {', '.join(map(str, parts))})), 1, 15) AS BIGINT)"


def text(value: str) -> str:
    return f"'{value}'"


LINES = r"""
lines AS MATERIALIZED (
  SELECT doc_id, CAST(unnest(range(len(arr))) AS INTEGER) AS line_no, unnest(arr) AS text
  FROM (
    SELECT doc_id, CASE WHEN text = '' THEN []
      ELSE string_split_regex(regexp_replace(text, '(\r\n|\r|\n)\z', ''), '\r\n|\r|\n') END AS arr
    FROM documents
  )
)"""

DOC_TERMS = f"doc_terms AS (SELECT doc_id, source, unnest({terms('text')}) AS term FROM documents)"

LEXICON = "lexicon(term, valence, polarity) AS (VALUES " + ", ".join(
    f"('{t}', {v}::DOUBLE, {p}::DOUBLE)" for t, v, p in DEFAULT_LEXICON.entries
) + ")"


def valence(source: str, keys: str, name: str = "scored", columns: str = "text") -> str:
    """CTEs scoring the text column of ``source``."""
    return f"""
{name}_n AS (SELECT {keys}, {columns}, {terms('text')} AS ts FROM {source}),
{name}_hits AS (
  SELECT {keys}, sum(valence) AS s,
    sum(CASE WHEN valence > 0 THEN valence + 1 ELSE 0 END) AS p,
    sum(CASE WHEN valence < 0 THEN 1 - valence ELSE 0 END) AS n,
    count(*) FILTER (valence <> 0) AS c
  FROM (SELECT {keys}, unnest(ts) AS term FROM {name}_n) JOIN lexicon USING (term) GROUP BY {keys}
),
{name}_sums AS (
  SELECT {keys}, {columns}, coalesce(s, 0) AS s, coalesce(p, 0) AS p, coalesce(n, 0) AS n,
    len(ts) - coalesce(c, 0) AS u
  FROM {name}_n LEFT JOIN {name}_hits USING ({keys})
),
{name} AS (
  SELECT {keys}, {columns},
    CASE WHEN p + n + u > 0 THEN round(n / (p + n + u), 3) ELSE 0 END AS neg,
    CASE WHEN p + n + u > 0 THEN round(u / (p + n + u), 3) ELSE 0 END AS neu,
    CASE WHEN p + n + u > 0 THEN round(p / (p + n + u), 3) ELSE 0 END AS pos,
    round(s / sqrt(s * s + 15), 4) AS compound
  FROM {name}_sums
)"""


POLARITY = f"""
polar AS (
  SELECT l.doc_id, l.line_no, l.text, coalesce(h.polarity, 0) AS polarity
  FROM lines l LEFT JOIN (
    SELECT doc_id, line_no, avg(polarity) AS polarity
    FROM (SELECT doc_id, line_no, unnest({terms('text')}) AS term FROM lines)
    JOIN lexicon USING (term) GROUP BY doc_id, line_no
  ) h USING (doc_id, line_no)
)"""


def cosine(left: str, right: str, value: str) -> str:
    return f"""
SELECT round(
  coalesce((SELECT sum(CAST(l.{value} AS DOUBLE) * r.{value}) FROM {left} l JOIN {right} r USING (term)), 0)
  / nullif((SELECT sqrt(sum(CAST({value} AS DOUBLE) * {value})) FROM {left})
         * (SELECT sqrt(sum(CAST({value} AS DOUBLE) * {value})) FROM {right}), 0), 6) AS similarity"""


def pair_occurrences(source: str = "lines", keys: str = "doc_id, line_no") -> str:
    """Sentence pairs of ``source`` with their address."""
    return f"""
sent AS (
  SELECT {keys}, [upper(w[1][1]) || lower(w[1][2:])] || w[2:] || [''] AS s
  FROM (SELECT {keys}, {words('text')} AS w FROM {source}) WHERE len(w) > 0
),
occ AS MATERIALIZED (
  SELECT {keys}, pos, s[pos + 1] AS w1, s[pos + 2] AS w2
  FROM (SELECT {keys}, s, unnest(range(len(s) - 1)) AS pos FROM sent)
),
pairs AS MATERIALIZED (SELECT w1, w2, count(*) AS cnt FROM occ GROUP BY w1, w2)"""


def intervals(name: str, source: str, weight: str = "cnt") -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT w1, w2, cnt, CAST(hi - {weight} AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi,
    CAST(tot AS BIGINT) AS tot
  FROM (
    SELECT *, sum({weight}) OVER (PARTITION BY w1 ORDER BY w2 = '', md5(w2), w2
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi,
      sum({weight}) OVER (PARTITION BY w1) AS tot
    FROM {source})
)"""


def flat_units(
    name: str, source: str, keys: str, items: str, where: str = "true", in_order: bool = False
) -> str:
    """CTE: (pos, word) of the flat sequence of a source."""
    first = "" if in_order else "digest, "
    return f"""
{name}_units AS (
  SELECT {keys}, {items} AS items, md5(concat_ws('|', {keys})) AS digest
  FROM {source} WHERE {where}
),
{name}_starts AS (
  SELECT {keys}, items, coalesce(sum(len(items)) OVER (ORDER BY {first}{keys}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM {name}_units
),
{name}_units_words AS (
  SELECT {keys}, start, unnest(range(len(items))) AS i, unnest(items) AS word FROM {name}_starts
),
{name} AS MATERIALIZED (
  SELECT {keys}, i, CAST(start + i AS BIGINT) AS pos, word FROM {name}_units_words
)"""


def flat_occurrences(
    name: str, source: str, keys: str, items: str, where: str = "true", in_order: bool = False
) -> str:
    """CTEs: the flat sequence and its neighbours (pos, w1, w2)."""
    return flat_units(f"{name}_seq", source, keys, items, where, in_order) + f""",
{name}_next AS MATERIALIZED (
  SELECT pos, word AS w1, lead(word) OVER (ORDER BY pos) AS w2 FROM {name}_seq
),
{name} AS MATERIALIZED (SELECT pos, w1, w2 FROM {name}_next WHERE w2 IS NOT NULL)"""


def picks(name: str, source: str, items: str, n: int, weight: str = "cnt") -> str:
    return f"""
{name}_iv AS MATERIALIZED (
  SELECT {items}, hi - {weight} AS lo, hi, tot FROM (
    SELECT *, sum({weight}) OVER (ORDER BY md5(concat_ws('|', {items})), {items}
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi, sum({weight}) OVER () AS tot
    FROM {source})
),
{name} AS MATERIALIZED (
  SELECT path_id, {items} FROM (
    SELECT path_id, {draw(SEED, 'path_id', text('start'))}
      % (SELECT CAST(max(tot) AS BIGINT) FROM {name}_iv) AS d
    FROM (SELECT unnest(range({n})) AS path_id)
  ) JOIN {name}_iv ON d >= lo AND d < hi
)"""


def sentence_of(path: str, done: str) -> str:
    return f"array_to_string({path}, ' ') || CASE WHEN {done} THEN '.' ELSE '' END"


# Scans and normal forms

ORACLE["lines"] = f"WITH {LINES} SELECT doc_id, line_no, text FROM lines"
for _name, _split, _column in (("document_words", words, "word"), ("document_terms", terms, "term")):
    ORACLE[_name] = f"""
SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) AS pos, unnest(a) AS {_column}
FROM (SELECT doc_id, {_split('text')} AS a FROM documents)"""
ORACLE["character_counts"] = f"""
SELECT char, count(*) AS cnt FROM (SELECT unnest({chars('text')}) AS char FROM documents) GROUP BY char"""

# Term statistics

_TF = f"WITH {DOC_TERMS}, tf AS (SELECT term, count(*) AS tf FROM doc_terms GROUP BY term)"
_DF = """
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM doc_terms GROUP BY term),
idf AS (SELECT term, ln((SELECT count(*) FROM documents) / (df + 1.0)) AS idf FROM df)"""
_TFIDF = f"{_TF}, {_DF}, tfidf AS (SELECT term, tf * idf AS tfidf FROM tf JOIN idf USING (term))"

ORACLE["term_frequency"] = f"{_TF} SELECT term, tf FROM tf"
ORACLE["term_frequency_by_source"] = f"""
WITH {DOC_TERMS} SELECT source, term, count(*) AS tf FROM doc_terms GROUP BY source, term"""
ORACLE["document_frequency"] = f"{_TF}, {_DF} SELECT term, df FROM df"
ORACLE["corpus_size"] = "SELECT count(*) AS n FROM documents"
ORACLE["idf"] = f"{_TF}, {_DF} SELECT term, round(idf, 6) AS idf FROM idf"
ORACLE["tfidf"] = f"{_TFIDF} SELECT term, round(tfidf, 6) AS tfidf FROM tfidf"
ORACLE["tfidf_by_source"] = f"""
{_TF}, {_DF}, stf AS (SELECT source, term, count(*) AS tf FROM doc_terms GROUP BY source, term)
SELECT source, term, round(tf * idf, 6) AS tfidf FROM stf JOIN idf USING (term)"""
ORACLE["tf_top20"] = f"{_TF} SELECT term, tf FROM tf ORDER BY tf DESC, term LIMIT 20"
ORACLE["tfidf_top20"] = f"""
{_TFIDF} SELECT term, round(tfidf, 6) AS tfidf FROM (
  SELECT * FROM tfidf ORDER BY tfidf DESC, term LIMIT 20)"""
ORACLE["vector_norms"] = f"""
WITH {DOC_TERMS}, tf AS (SELECT source, term, count(*) AS tf FROM doc_terms GROUP BY source, term)
SELECT source, round(sqrt(sum(CAST(tf AS DOUBLE) * tf)), 6) AS norm FROM tf GROUP BY source"""
ORACLE["cosine_conversations"] = f"""
{_TFIDF},
c AS (SELECT conv_id, turn, unnest({terms('text')}) AS term FROM conversations),
cdf AS (SELECT term, count(*) AS tf, count(DISTINCT (conv_id, turn)) AS df FROM c GROUP BY term),
cv AS (SELECT term, tf * ln((SELECT count(*) FROM conversations) / (df + 1.0)) AS tfidf FROM cdf)
{cosine('tfidf', 'cv', 'tfidf')}"""
ORACLE["cosine_benchmark"] = f"""
{_TF}, b AS (
  SELECT term, count(*) AS tf FROM (SELECT unnest({terms('text')}) AS term FROM benchmark) GROUP BY term)
{cosine('tf', 'b', 'tf')}"""
ORACLE["cosine_disjoint"] = f"""
{_TF}, e AS (SELECT * FROM tf WHERE length(term) % 2 = 0), o AS (SELECT * FROM tf WHERE length(term) % 2 <> 0)
{cosine('e', 'o', 'tf')}"""
ORACLE["similar_conversations"] = f"""
WITH tf AS MATERIALIZED (
  SELECT conv_id, term, count(*)::DOUBLE AS v FROM (SELECT conv_id, unnest({terms('text')}) AS term FROM conversations)
  GROUP BY ALL
),
norm AS (SELECT conv_id, sqrt(sum(v * v)) AS norm, list((term, v) ORDER BY term) AS whole FROM tf GROUP BY conv_id),
cls AS MATERIALIZED (
  SELECT conv_id, norm, min(conv_id) OVER (PARTITION BY whole) AS class_id, count(*) OVER (PARTITION BY whole) AS size FROM norm
),
heads AS MATERIALIZED (SELECT conv_id, norm, size FROM cls WHERE conv_id = class_id),
units AS MATERIALIZED (SELECT conv_id, size, term, v / norm AS u FROM tf JOIN heads USING (conv_id)),
sims AS MATERIALIZED (
  SELECT a.conv_id AS a, b.conv_id AS b, any_value(b.size) AS size, sum(a.u * b.u) AS s
  FROM units a JOIN units b ON a.term = b.term AND a.conv_id <> b.conv_id GROUP BY ALL HAVING sum(a.u * b.u) >= 0.8
),
found AS (
  SELECT a AS class_id, sum(size)::BIGINT AS n_similar, arg_min(b, (-round(s, 9), b)) AS best, max(s) AS best_similarity
  FROM sims GROUP BY a
)
SELECT conv_id, class_id, size - 1 AS n_copies, coalesce(n_similar, 0) AS n_similar,
  coalesce(best, class_id) AS best, round(coalesce(best_similarity, 0), 6) AS best_similarity
FROM cls LEFT JOIN found USING (class_id)"""
_KEPT = "doc_id % 7 <> 3 OR doc_id % 3 = 0"
ORACLE["idf_after_changes"] = f"""
WITH kept AS (SELECT doc_id, text FROM documents WHERE {_KEPT}),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({terms('text')}) AS term FROM kept) GROUP BY term)
SELECT term, round(ln((SELECT count(*) FROM kept) / (df + 1.0)), 6) AS idf FROM df"""
ORACLE["document_frequency_estimates"] = f"""
WITH occ AS MATERIALIZED (SELECT doc_id, unnest(list_distinct({terms('text')})) AS term FROM documents),
cells AS MATERIALIZED (
  SELECT term, r, ((cast('0x' || substr(md5(term), 4 * r + 1, 4) AS BIGINT) * {COUNT_MIN.width}) >> 16) AS cell
  FROM (SELECT DISTINCT term FROM occ), (SELECT unnest(range({COUNT_MIN.rows})) AS r)
),
sketch AS (SELECT r, cell, count(*) AS n FROM occ JOIN cells USING (term) GROUP BY ALL)
SELECT term, min(n) AS estimate, CAST(ceil((SELECT count(*) FROM occ) * {COUNT_MIN.error}::DOUBLE) AS BIGINT) AS error
FROM cells JOIN sketch USING (r, cell) GROUP BY term"""
ORACLE["stored_vector"] = f"{_TF} SELECT term, CAST(tf AS DOUBLE) AS value FROM tf"

# Sentiment

_SCORED = f"WITH {LINES}, {LEXICON}, {valence('lines', 'doc_id, line_no')}"
_POLAR = f"WITH {LINES}, {LEXICON}, {POLARITY}"
ORACLE["line_sentiment"] = f"{_SCORED} SELECT doc_id, line_no, neg, neu, pos, compound FROM scored"
ORACLE["line_sentiment_by_table"] = ORACLE["line_sentiment"]
ORACLE["line_polarity"] = f"{_POLAR} SELECT doc_id, line_no, round(polarity, 6) AS polarity FROM polar"
ORACLE["conversation_sentiment"] = f"""
WITH {LEXICON}, {valence('conversations', 'conv_id, turn')}
SELECT conv_id, turn, neg, neu, pos, compound FROM scored"""
ORACLE["sentiment_interval"] = f"""
{_SCORED} SELECT doc_id, line_no, text FROM scored WHERE compound BETWEEN -1.0 AND -0.2"""
ORACLE["polarity_interval"] = f"""
{_POLAR} SELECT doc_id, line_no, text FROM polar WHERE polarity BETWEEN 0.1 AND 1.0"""
ORACLE["negative_lines"] = f"{_SCORED} SELECT doc_id, line_no, neg FROM scored WHERE neg > {NEGATIVE}"
ORACLE["negative_lines_half"] = f"{_SCORED} SELECT doc_id, line_no, neg FROM scored WHERE neg > {HALF}"

ORACLE["conversation_sentiment_by_table"] = f"""
WITH {LEXICON}, turns AS (SELECT row_number() OVER () AS i, text FROM conversations), {valence('turns', 'i')}
SELECT text, neg, neu, pos, compound FROM scored"""


def listed(group) -> str:
    return ", ".join(f"'{w}'" for w in sorted(group))


def any_before(group) -> str:
    return " OR ".join(f"coalesce(b{k} IN ({listed(group)}), FALSE)" for k in (1, 2, 3))


def boosts() -> str:
    steps = [
        f"CASE WHEN b{k} IN ({listed(scoring.BOOSTERS)}) THEN 1 WHEN b{k} IN ({listed(scoring.DAMPENERS)}) THEN -1 "
        f"ELSE 0 END * {scoring.BOOSTED * fading}::DOUBLE"
        for k, fading in enumerate(scoring.FADING, 1)
    ]
    return " + ".join(steps)


# Lines with their terms one by one, each with the three terms before it.
_PLACED = f"""
placed AS MATERIALIZED (
  SELECT doc_id, line_no, i, term, lag(term, 1) OVER w AS b1, lag(term, 2) OVER w AS b2, lag(term, 3) OVER w AS b3
  FROM (
    SELECT doc_id, line_no, unnest(range(len(ts))) AS i, unnest(ts) AS term
    FROM (SELECT doc_id, line_no, {terms('text')} AS ts FROM lines))
  WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY i)
)"""
_MARKS = f"least(length(text) - length(replace(text, '!', '')), {scoring.MOST_EXCLAIMED})"
ORACLE["line_sentiment_rules"] = f"""
WITH {LINES}, {LEXICON}, {_PLACED},
buts AS (SELECT doc_id, line_no, max(i) AS last_but FROM placed WHERE term = 'but' GROUP BY ALL),
rated AS (
  SELECT doc_id, line_no, (valence + sign(valence) * ({boosts()}))
    * CASE WHEN {any_before(scoring.NEGATIONS)} THEN {scoring.NEGATED}::DOUBLE ELSE 1 END
    * CASE WHEN i < last_but THEN {scoring.BEFORE_BUT}::DOUBLE WHEN i > last_but THEN {scoring.AFTER_BUT}::DOUBLE
      ELSE 1 END AS v
  FROM placed JOIN lexicon USING (term) LEFT JOIN buts USING (doc_id, line_no)
),
hits AS (
  SELECT doc_id, line_no, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS p,
    sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END) AS n, count(*) FILTER (v <> 0) AS c
  FROM rated GROUP BY ALL
),
sums AS (
  SELECT doc_id, line_no, coalesce(p, 0) AS p, coalesce(n, 0) AS n, len({terms('text')}) - coalesce(c, 0) AS u,
    coalesce(s, 0) + sign(coalesce(s, 0)) * {_MARKS} * {scoring.EXCLAIMED}::DOUBLE AS s
  FROM lines LEFT JOIN hits USING (doc_id, line_no)
)
SELECT doc_id, line_no, CASE WHEN p + n + u > 0 THEN round(n / (p + n + u), 3) ELSE 0 END AS neg,
  CASE WHEN p + n + u > 0 THEN round(u / (p + n + u), 3) ELSE 0 END AS neu,
  CASE WHEN p + n + u > 0 THEN round(p / (p + n + u), 3) ELSE 0 END AS pos, round(s / sqrt(s * s + 15), 4) AS compound
FROM sums"""
ORACLE["line_sentiment_rules_by_table"] = ORACLE["line_sentiment_rules"]
# A chunk ends with a rated term or with a word that breaks it.
ORACLE["line_polarity_chunks"] = f"""
WITH {LINES}, {LEXICON}, {_PLACED},
kinds AS (
  SELECT doc_id, line_no, i, polarity,
    polarity IS NULL AND term IN ({listed(scoring.NEGATIONS)}) AS negation,
    CASE WHEN polarity IS NOT NULL THEN NULL WHEN term IN ({listed(scoring.BOOSTERS)}) THEN {scoring.STRONGER}::DOUBLE
      WHEN term IN ({listed(scoring.DAMPENERS)}) THEN {scoring.WEAKER}::DOUBLE END AS factor, length(term) = 1 AS single
  FROM placed LEFT JOIN lexicon USING (term)
),
chunks AS (
  SELECT *, coalesce(sum(CASE WHEN polarity IS NOT NULL OR NOT (negation OR factor IS NOT NULL OR single) THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk
  FROM kinds
),
turns AS (
  SELECT *, max(CASE WHEN negation THEN i END) OVER (PARTITION BY doc_id, line_no, chunk) AS turned FROM chunks
),
values_ AS (
  SELECT doc_id, line_no, chunk, max(polarity) AS p, max(turned) IS NOT NULL AS turned,
    coalesce(product(factor) FILTER (turned IS NULL OR i > turned), 1) AS factor
  FROM turns GROUP BY ALL HAVING max(polarity) IS NOT NULL
),
means AS (
  SELECT doc_id, line_no, avg(greatest(-1, least(1, p * CASE WHEN turned THEN {scoring.TURNED}::DOUBLE / factor ELSE factor END))) AS polarity
  FROM values_ GROUP BY ALL
)
SELECT doc_id, line_no, round(coalesce(polarity, 0), 6) AS polarity FROM lines LEFT JOIN means USING (doc_id, line_no)"""
ORACLE["line_polarity_chunks_by_table"] = ORACLE["line_polarity_chunks"]
ORACLE["line_polarity_by_table"] = ORACLE["line_polarity"]
ORACLE["sentiment_interval_by_table"] = ORACLE["sentiment_interval"]

# Pairs and transitions

_PAIRS = f"WITH {LINES}, {pair_occurrences()}"
ORACLE["sentence_bigrams"] = f"{_PAIRS} SELECT w1, w2, cnt FROM pairs"
ORACLE["reversed_bigrams"] = f"{_PAIRS} SELECT w2 AS first, w1 AS second, cnt FROM pairs"
ORACLE["transitions"] = f"""
{_PAIRS}, {intervals('trans', 'pairs')} SELECT w1, w2, cnt, lo, hi, tot FROM trans"""
_UPPER = r"regexp_matches(w1, '^\p{Lu}')"
ORACLE["start_pairs_sequential"] = f"{_PAIRS} SELECT w1, w2, cnt FROM pairs WHERE {_UPPER} AND w2 <> ''"
ORACLE["start_pairs_population"] = f"{_PAIRS} SELECT w1, w2, cnt FROM pairs WHERE {_UPPER}"
_FLAT = flat_occurrences("flat", "documents", "doc_id", words("text"))
_FLAT_PAIRS = "flat_pairs AS MATERIALIZED (SELECT w1, w2, count(*) AS cnt FROM flat GROUP BY w1, w2)"
_FLAT_CHARS = flat_occurrences("flat", "documents", "doc_id", chars("text"))
ORACLE["flat_bigrams"] = f"WITH {_FLAT}, {_FLAT_PAIRS} SELECT w1, w2, cnt FROM flat_pairs"
ORACLE["flat_char_bigrams"] = f"WITH {_FLAT_CHARS}, {_FLAT_PAIRS} SELECT w1, w2, cnt FROM flat_pairs"
_SEQ = flat_units("seq", "documents", "doc_id", words("text"))
ORACLE["word_index"] = f"WITH {_SEQ} SELECT pos, word FROM seq"
_IN_ORDER = flat_units("seq", "documents", "doc_id", words("text"), in_order=True)
ORACLE["word_index_in_order"] = f"WITH {_IN_ORDER} SELECT pos, word FROM seq"
ORACLE["first_words_in_order"] = f"WITH {_IN_ORDER} SELECT pos, word FROM seq WHERE pos < 10000"
_FLAT_IN_ORDER = flat_occurrences("flat", "documents", "doc_id", words("text"), in_order=True)
ORACLE["flat_bigrams_in_order"] = f"WITH {_FLAT_IN_ORDER}, {_FLAT_PAIRS} SELECT w1, w2, cnt FROM flat_pairs"
ORACLE["first_words"] = f"WITH {_SEQ} SELECT pos, word FROM seq WHERE pos < 10000"


def shuffled(keys: str) -> str:
    return f"""
shuf AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS pos, word FROM (
    SELECT md5(concat_ws('|', {SEED}, {keys}, i)) AS h, word FROM seq)
)"""


ORACLE["shuffled_words"] = f"WITH {_SEQ}, {shuffled('doc_id')} SELECT pos, word FROM shuf"
# The ends first, then the pairs that lead to their first words: no join order
# can list all two-step paths.
ORACLE["path_enumeration"] = f"""
{_PAIRS},
ends AS MATERIALIZED (SELECT w1, cnt FROM pairs WHERE w2 = ''),
leads AS MATERIALIZED (SELECT w1, w2, cnt FROM pairs WHERE w2 IN (SELECT w1 FROM ends))
SELECT a.w1 || ' ' || a.w2 || ' ' AS words, a.cnt * b.cnt AS multiplicity
FROM leads a JOIN ends b ON a.w2 = b.w1"""
_CHOSEN = ", ".join(f"'{w}'" for w in CHOSEN)


def heaviest(ends: str, steps: int, k: int) -> str:
    """The best paths level by level, listed whole."""
    ctes = [f"""
h0 AS MATERIALIZED (
  SELECT * FROM (
    SELECT w1, [w1, w2] AS words, CAST(cnt AS HUGEINT) AS m,
      row_number() OVER (PARTITION BY w1 ORDER BY cnt DESC, w2) AS rank FROM pairs WHERE {ends}) WHERE rank <= {k}
)"""]
    for i in range(steps):
        ctes.append(f"""
h{i + 1} AS MATERIALIZED (
  SELECT * FROM (
    SELECT p.w1, [p.w1] || h.words AS words, p.cnt * h.m AS m,
      row_number() OVER (PARTITION BY p.w1 ORDER BY p.cnt * h.m DESC, h.words) AS rank
    FROM pairs p JOIN h{i} h ON p.w2 = h.w1) WHERE rank <= {k}
)""")
    return f"""
{_PAIRS}, {', '.join(ctes)}
SELECT array_to_string(words, ' ') AS words, CAST(rank AS INTEGER) AS rank, CAST(m AS VARCHAR) AS multiplicity FROM h{steps}"""


ORACLE["path_enumeration_words"] = f"""
{_PAIRS},
k1 AS MATERIALIZED (SELECT w1, w1 || ' ' || w2 AS words, cnt FROM pairs WHERE w2 IN ({_CHOSEN})),
k2 AS MATERIALIZED (
  SELECT p.w1, p.w1 || ' ' || k1.words AS words, p.cnt * k1.cnt AS cnt FROM k1 JOIN pairs p ON p.w2 = k1.w1)
SELECT p.w1 || ' ' || k2.words AS words, p.cnt * k2.cnt AS multiplicity FROM k2 JOIN pairs p ON p.w2 = k2.w1"""
ORACLE["heaviest_endings"] = heaviest("w2 = ''", 3, 3)
_COUNTS = "p1 AS MATERIALIZED (SELECT w1, CAST(sum(cnt) AS DECIMAL(38, 0)) AS paths FROM pairs GROUP BY w1)"
for _k in range(2, 6):
    _COUNTS += f""",
p{_k} AS MATERIALIZED (
  SELECT a.w1, CAST(sum(CAST(a.cnt AS HUGEINT) * CAST(b.paths AS HUGEINT)) AS DECIMAL(38, 0)) AS paths
  FROM pairs a JOIN p{_k - 1} b ON a.w2 = b.w1 GROUP BY a.w1)"""
ORACLE["path_counts"] = f"{_PAIRS}, {_COUNTS} SELECT w1, CAST(paths AS VARCHAR) AS paths FROM p5"

# Sampling

ORACLE["bernoulli_sample"] = f"""
SELECT doc_id FROM documents WHERE {draw(SEED, 'doc_id')} % (SELECT count(*) FROM documents) < 100"""
ORACLE["exact_sample"] = f"SELECT doc_id FROM documents ORDER BY {draw(SEED, 'doc_id')}, doc_id LIMIT 100"
ORACLE["exact_line_sample"] = f"WITH {LINES} SELECT text FROM lines ORDER BY {draw(SEED, 'text')}, text LIMIT 1000"
_PART = f"""CASE WHEN {draw(SEED, 'doc_id')} % 100 < 80 THEN 'train'
  WHEN {draw(SEED, 'doc_id')} % 100 < 90 THEN 'valid' ELSE 'test' END"""
ORACLE["corpus_split"] = f"SELECT doc_id, {_PART} AS split FROM documents"

# Generators

_STARTS = f"starts AS (SELECT * FROM pairs WHERE {_UPPER} AND w2 <> '')"
_D = draw(SEED, "p.path_id", "p.step")
ORACLE["markov_sequential"] = f"""
WITH RECURSIVE {LINES}, {pair_occurrences()}, {intervals('trans', 'pairs')}, {_STARTS},
{picks('picked', 'starts', 'w1, w2', 200)},
walk AS (
  SELECT path_id, 0 AS step, [w1] AS words, w2 AS cur FROM picked
  UNION ALL
  SELECT p.path_id, p.step + 1, list_append(p.words, p.cur), t.w2
  FROM walk p JOIN trans t ON p.cur = t.w1 AND {_D} % t.tot >= t.lo AND {_D} % t.tot < t.hi
  WHERE p.step < 8
)
SELECT path_id, {sentence_of('words', "cur = ''")} AS sentence FROM walk WHERE cur = '' OR step = 8"""
ORACLE["markov_min_length"] = f"""
WITH RECURSIVE {LINES}, {pair_occurrences()}, {intervals('trans', 'pairs')}, {_STARTS},
going AS (SELECT * FROM pairs WHERE w2 <> ''), {intervals('open', 'going')},
{picks('picked', 'starts', 'w1, w2', 200)},
early AS (
  SELECT path_id, 0 AS step, [w1] AS words, w2 AS cur, w1, w2 FROM picked
  UNION ALL
  SELECT p.path_id, p.step + 1,
    CASE WHEN t.w2 IS NULL THEN [p.w1] ELSE list_append(p.words, p.cur) END,
    coalesce(t.w2, p.w2), p.w1, p.w2
  FROM early p LEFT JOIN open t ON p.cur = t.w1 AND {_D} % t.tot >= t.lo AND {_D} % t.tot < t.hi
  WHERE p.step < 4
),
walk AS (
  SELECT path_id, step, words, cur FROM early WHERE step = 4
  UNION ALL
  SELECT p.path_id, p.step + 1, list_append(p.words, p.cur), t.w2
  FROM walk p JOIN trans t ON p.cur = t.w1 AND {_D} % t.tot >= t.lo AND {_D} % t.tot < t.hi
  WHERE p.step < 8
)
SELECT path_id, {sentence_of('words', "cur = ''")} AS sentence FROM walk WHERE cur = '' OR step = 8"""


def population_start(target: int) -> str:
    return f"""
begin AS MATERIALIZED (
  SELECT path_id, [w1, w2] AS words, w2 AS cur FROM (
    SELECT concat_ws('-', doc_id, line_no, pos) AS path_id, w1, w2 FROM occ WHERE {_UPPER})
  WHERE {draw(SEED, 'path_id')} % (SELECT count(*) FROM occ WHERE {_UPPER}) < {target}
)"""


def stepped(name: str, source: str, step: int) -> str:
    d = draw(SEED, "p.path_id", step)
    return f"""
{name} AS MATERIALIZED (
  SELECT p.path_id, list_append(p.words, t.w2) AS words, t.w2 AS cur
  FROM {source} p JOIN trans t ON p.cur = t.w1 AND {d} % t.tot >= t.lo AND {d} % t.tot < t.hi
)"""


def population_ctes(source: str, entries: int, min_length: int, max_length: int, start: int) -> str:
    """The population walk with its cap, early emission and stop rule, one
    group of CTEs per step; ends in ``made`` (path_id, words, done)."""
    ctes = [pair_occurrences(source), intervals("trans", "pairs"), population_start(start)]
    ctes.append(f"c0 AS MATERIALIZED (SELECT true AS go, CAST({entries} AS BIGINT) AS wanted)")
    ctes.append("l0 AS (SELECT * FROM begin)")
    outs = []
    for i in range(max_length):
        j = i + 1
        cap = draw(SEED, "path_id", i, text("cap"))
        ctes.append(stepped(f"s{j}", f"l{i}", i))
        ctes.append(f"n{j} AS MATERIALIZED (SELECT count(*) AS n FROM s{j})")
        ctes.append(f"""
k{j} AS MATERIALIZED (
  SELECT * FROM s{j} WHERE (SELECT n FROM n{j}) <= {start} OR {cap} % (SELECT n FROM n{j}) < {start})""")
        emitted = f"(SELECT count(*) FROM k{j} WHERE cur = '')" if i >= min_length else "0"
        ctes.append(f"""
c{j} AS MATERIALIZED (
  SELECT go AND (SELECT n FROM n{j}) >= wanted - {emitted} AS go, wanted - {emitted} AS wanted FROM c{i})""")
        ctes.append(f"""
l{j} AS MATERIALIZED (SELECT * FROM k{j} WHERE cur <> '' AND (SELECT go FROM c{j}))""")
        ran = f"(SELECT go FROM c{i})"
        last = "true" if j == max_length else f"NOT (SELECT go FROM c{j})"
        early = "cur = ''" if i >= min_length else "false"
        outs.append(f"SELECT path_id, words, cur FROM k{j} WHERE {ran} AND (({early}) OR ({last}))")
    ctes.append("made_raw AS (" + " UNION ALL ".join(outs) + ")")
    ctes.append("""
made AS MATERIALIZED (
  SELECT path_id, list_filter(words, lambda w: w <> '') AS words, cur = '' AS done FROM made_raw)""")
    return ",\n".join(ctes)


ORACLE["markov_population"] = f"""
WITH {LINES}, {population_ctes('lines', 400, 2, 6, 1000)}
SELECT path_id, len(words) AS n_words, {sentence_of('words', 'done')} AS sentence, done FROM made"""

_COLLAPSE = [pair_occurrences(), intervals("trans", "pairs"), population_start(1000), "l0 AS (SELECT * FROM begin)"]
for _i in range(5):
    _keep = f"md5(concat_ws('|', {SEED}, path_id, {_i}, 'keep'))"
    _COLLAPSE.append(f"""
v{_i} AS MATERIALIZED (
  SELECT path_id, words, cur FROM (
    SELECT *, row_number() OVER (PARTITION BY cur ORDER BY {_keep}, path_id) AS rn
    FROM l{_i} WHERE cur <> '') WHERE rn = 1)""")
    _COLLAPSE.append(stepped(f"l{_i + 1}", f"v{_i}", _i))
ORACLE["markov_collapse"] = f"""
WITH {LINES}, {', '.join(_COLLAPSE)}
SELECT path_id, {sentence_of("list_filter(words, lambda w: w <> '')", "cur = ''")} AS sentence FROM l5"""


def chains(units: str, entries: int, length: int) -> str:
    """CTEs from flat occurrences to ``walk`` rows at rest; recursive."""
    return f"""
{units}, {_FLAT_PAIRS}, {intervals('trans', 'flat_pairs')},
freq AS (SELECT word, count(*) AS cnt FROM flat_seq GROUP BY word),
{picks('picked', 'freq', 'word', entries)},
{walk_on(length)}"""


def walk_on(length: int) -> str:
    return f"""
walk AS (
  SELECT path_id, 0 AS step, [word] AS words, word AS cur FROM picked
  UNION ALL
  SELECT p.path_id, p.step + 1, list_append(p.words, t.w2), t.w2
  FROM walk p JOIN trans t ON p.cur = t.w1 AND {_D} % t.tot >= t.lo AND {_D} % t.tot < t.hi
  WHERE p.step < {length}
),
made AS MATERIALIZED (
  SELECT path_id, arg_max(words, step) AS words FROM walk GROUP BY path_id
)"""


_CHAIN_TEXT = "SELECT path_id, array_to_string(words, ' ') AS text FROM made"
ORACLE["markov_flat_word"] = f"WITH RECURSIVE {chains(_FLAT, 100, 8)} {_CHAIN_TEXT}"
ORACLE["markov_flat_char"] = f"WITH RECURSIVE {chains(_FLAT_CHARS, 100, 12)} {_CHAIN_TEXT}"
_NEGATIVE_CTES = f"""
{LINES}, {LEXICON}, {valence('lines', 'doc_id, line_no')},
bad AS MATERIALIZED (SELECT doc_id, line_no, text FROM scored WHERE neg > {NEGATIVE})"""
_NEGATIVE_FLAT = flat_occurrences("flat", "bad", "doc_id, line_no", words("text"))
_NEGATIVE_CHAINS = f"WITH RECURSIVE {_NEGATIVE_CTES}, {chains(_NEGATIVE_FLAT, 100, 10)}"
ORACLE["first_negative_words"] = f"""
WITH {_NEGATIVE_CTES}, {flat_units("seq", "bad", "doc_id, line_no", words("text"), in_order=True)}
SELECT pos, word FROM seq WHERE pos < 1000"""
ORACLE["negative_generator"] = f"{_NEGATIVE_CHAINS} {_CHAIN_TEXT}"
_RESCORE = f"""
SELECT count(*) AS n, round(avg(neg), 6) AS mean_neg,
  round(1 - avg(CASE WHEN neg > {NEGATIVE} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS error_rate
FROM again"""
ORACLE["negative_generator_scores"] = f"""
{_NEGATIVE_CHAINS}, texts AS ({_CHAIN_TEXT}), {valence('texts', 'path_id', 'again')} {_RESCORE}"""
ORACLE["negative_generator_scores_by_table"] = ORACLE["negative_generator_scores"]
ORACLE["generated_sentiment"] = f"""
WITH {LINES}, {LEXICON}, {valence('lines', 'doc_id, line_no')},
kept AS MATERIALIZED (SELECT doc_id, line_no, text FROM scored WHERE compound BETWEEN -1.0 AND -0.2),
{population_ctes('kept', 100, 2, 8, 500)},
texts AS (SELECT path_id, {sentence_of('words', 'done')} AS text FROM made),
{valence('texts', 'path_id', 'again')} {_RESCORE}"""

# Evaluation

_COVERAGE = """
seen AS (SELECT DISTINCT w1, w2 FROM train),
sums AS (
  SELECT (SELECT count(*) FROM test JOIN seen USING (w1, w2)) AS matched,
    (SELECT count(*) FROM test) AS test_bigrams, (SELECT count(DISTINCT w1) FROM test) AS test_words
)
SELECT matched, test_bigrams, test_words, round(matched / nullif(test_words, 0), 6) AS score_reference,
  round(matched / nullif(test_bigrams, 0), 6) AS score_bigram FROM sums"""


def shuffled_parts(keys: str) -> str:
    return f"""
{shuffled(keys)},
cut AS (SELECT CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT) AS border FROM shuf),
nexts AS MATERIALIZED (SELECT pos, word AS w1, lead(word) OVER (ORDER BY pos) AS w2 FROM shuf),
train AS (SELECT w1, w2 FROM nexts WHERE pos < (SELECT border FROM cut) - 1),
test AS (SELECT w1, w2 FROM nexts WHERE pos >= (SELECT border FROM cut) AND w2 IS NOT NULL)"""


ORACLE["holdout_shuffled"] = f"WITH {_SEQ}, {shuffled_parts('doc_id')}, {_COVERAGE}"
ORACLE["holdout_shuffled_negative"] = f"""
WITH {_NEGATIVE_CTES}, {flat_units('seq', 'bad', 'doc_id, line_no', words('text'))},
{shuffled_parts('doc_id, line_no')}, {_COVERAGE}"""
_PARTS = ", ".join(
    flat_occurrences(name, "documents", "doc_id", words("text"), f"({_PART}) = '{name}'")
    for name in ("train", "test")
)
ORACLE["holdout_documents"] = f"WITH {_PARTS}, {_COVERAGE}"
ORACLE["holdout_seen_pairs"] = f"""
WITH {_PARTS} SELECT w1, w2, count(*) AS cnt FROM test
WHERE EXISTS (SELECT 1 FROM train t WHERE t.w1 = test.w1 AND t.w2 = test.w2) GROUP BY w1, w2"""
ORACLE["bigram_perplexity"] = f"""
WITH {_PARTS},
v AS (SELECT count(DISTINCT w) AS v FROM (SELECT w1 AS w FROM train UNION ALL SELECT w2 FROM train)),
c12 AS (SELECT w1, w2, count(*) AS c FROM train GROUP BY w1, w2),
c1 AS (SELECT w1, count(*) AS c FROM train GROUP BY w1),
t AS (SELECT w1, w2, count(*) AS b FROM test GROUP BY w1, w2),
s AS (
  SELECT sum(b) AS n, -sum(b * ln((coalesce(c12.c, 0) + 1.0::DOUBLE)
      / (coalesce(c1.c, 0) + 1.0::DOUBLE * (SELECT v FROM v)))) / sum(b) AS loss
  FROM t LEFT JOIN c12 USING (w1, w2) LEFT JOIN c1 USING (w1)
)
SELECT CAST(n AS BIGINT) AS n, round(loss, 6) AS loss, round(exp(loss), 6) AS perplexity FROM s"""



def grams_of(name: str, part: str, order: int) -> str:
    """CTE: every word of the documents of a part with its longest context."""
    return f"""
{name} AS MATERIALIZED (
  SELECT least(i, {order - 1}) + 1 AS n, array_to_string(p[greatest(1, i - {order - 2}):i], ' ') AS ctx, p[i + 1] AS w
  FROM (
    SELECT p, unnest(range(1, len(p))) AS i
    FROM (SELECT [chr(9)] || {words('text')} AS p FROM documents WHERE ({_PART}) = '{part}'))
)"""


def discounted(n: int, count: str = "c") -> str:
    return f"(SELECT CASE {count} WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END FROM d{n})"


def shorter(context: str) -> str:
    return f"CASE WHEN strpos({context}, ' ') > 0 THEN substr({context}, strpos({context}, ' ') + 1) ELSE '' END"


def kneser_ney(order: int) -> str:
    """CTEs l (counts), d (discounts), k (contexts) and p (probabilities) of
    each order."""
    ctes = [
        grams_of("tokens", "train", order),
        "full_grams AS MATERIALIZED (SELECT n, ctx, w, count(*) AS c FROM tokens GROUP BY ALL)",
        f"l{order} AS MATERIALIZED (SELECT ctx, w, c FROM full_grams WHERE n = {order})",
    ]
    for n in range(order - 1, 0, -1):
        ctes.append(f"""
l{n} AS MATERIALIZED (
  SELECT {shorter('ctx')} AS ctx, w, count(*) AS c FROM l{n + 1} GROUP BY 1, 2
  UNION ALL SELECT ctx, w, c FROM full_grams WHERE n = {n}
)""")
    for n in range(1, order + 1):
        ctes.append(f"""
n{n} AS (
  SELECT count(*) FILTER (c = 1)::DOUBLE AS a, count(*) FILTER (c = 2)::DOUBLE AS b,
    count(*) FILTER (c = 3)::DOUBLE AS x, count(*) FILTER (c = 4)::DOUBLE AS y FROM l{n}
),
y{n} AS (
  SELECT CASE WHEN a > 0 AND b > 0 THEN a / (a + 2 * b) ELSE 0.5::DOUBLE END AS s,
    CASE WHEN a > 0 AND b > 0 AND x > 0 THEN 1 - 2 * (a / (a + 2 * b)) * b / a END AS t1,
    CASE WHEN a > 0 AND b > 0 AND x > 0 THEN 2 - 3 * (a / (a + 2 * b)) * x / b END AS t2,
    CASE WHEN a > 0 AND b > 0 AND x > 0 THEN 3 - 4 * (a / (a + 2 * b)) * y / x END AS t3 FROM n{n}
),
d{n} AS MATERIALIZED (
  SELECT CASE WHEN good THEN t1 ELSE s END AS d1, CASE WHEN good THEN t2 ELSE s END AS d2,
    CASE WHEN good THEN t3 ELSE s END AS d3
  FROM (SELECT *, coalesce(t1 > 0 AND t1 < 1 AND t2 > 0 AND t2 < 2 AND t3 > 0 AND t3 < 3, FALSE) AS good FROM y{n})
),
k{n} AS MATERIALIZED (
  SELECT ctx, sum(c)::BIGINT AS tot, sum({discounted(n)}) / sum(c) AS gamma FROM l{n} GROUP BY ctx
)""")
        below = f"1.0::DOUBLE / ((SELECT count(*) FROM l1) + 1)" if n == 1 else "b.p"
        join = "" if n == 1 else f"JOIN p{n - 1} b ON b.ctx = {shorter('l.ctx')} AND b.w = l.w"
        ctes.append(f"""
p{n} AS MATERIALIZED (
  SELECT l.ctx, l.w, l.c, (l.c - {discounted(n, 'l.c')}) / k.tot + k.gamma * ({below}) AS p
  FROM l{n} l JOIN k{n} k ON k.ctx = l.ctx {join}
)""")
    return ",".join(ctes)


def backed_off(order: int) -> str:
    """CTEs: the probability of each test gram, from the shortest context up."""
    ctes = [grams_of("tests", "test", order), "t AS MATERIALIZED (SELECT ctx, w, count(*) AS b FROM tests GROUP BY ALL)"]
    ctes.append("""
q0 AS (
  SELECT ctx, w, b, CASE WHEN ctx = '' THEN [] ELSE string_split(ctx, ' ') END AS s,
    1.0::DOUBLE / ((SELECT count(*) FROM l1) + 1) AS q FROM t
)""")
    for n in range(1, order + 1):
        ctes.append(f"""
q{n} AS MATERIALIZED (
  SELECT x.ctx, x.w, x.b, x.s, CASE WHEN len(x.s) < {n - 1} THEN x.q ELSE coalesce(p.p, x.q * coalesce(k.gamma, 1)) END AS q
  FROM (SELECT *, array_to_string(s[len(s) - {n - 2}:], ' ') AS part FROM q{n - 1}) x
    LEFT JOIN p{n} p ON p.ctx = x.part AND p.w = x.w AND len(x.s) >= {n - 1}
    LEFT JOIN k{n} k ON k.ctx = x.part AND len(x.s) >= {n - 1}
)""")
    return ",".join(ctes)


ORACLE["kneser_ney_perplexity"] = f"""
WITH {kneser_ney(5)}, {backed_off(5)},
e AS (SELECT sum(b)::BIGINT AS n, -sum(b * ln(q)) / sum(b) AS loss FROM q5)
SELECT n, round(loss, 6) AS loss, round(exp(loss), 6) AS perplexity FROM e"""
ORACLE["backoff_weights"] = f"""
WITH {kneser_ney(3)}
{' UNION ALL '.join(f'SELECT {n} AS n, ctx, tot, round(gamma, 6) AS gamma FROM k{n}' for n in (1, 2, 3))}"""


def backoff_walk(order: int, entries: int, length: int) -> str:
    """CTEs of a walk, one group per step; ends in ``w`` and its last number."""
    weights = " UNION ALL ".join(
        f"SELECT {n} AS n, ctx, w, CAST(round((c - {discounted(n)}) * 1048576) AS BIGINT) AS cnt FROM l{n}"
        for n in range(1, order + 1)
    )
    gammas = " UNION ALL ".join(f"SELECT {n} AS n, ctx, gamma FROM k{n}" for n in range(1, order + 1))
    ctes = [f"""
choices AS MATERIALIZED (
  SELECT n, ctx, w, hi - cnt AS lo, hi, tot FROM (
    SELECT *, sum(cnt) OVER (PARTITION BY n, ctx ORDER BY md5(w), w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi,
      sum(cnt) OVER (PARTITION BY n, ctx) AS tot
    FROM ({weights} UNION ALL SELECT 0, chr(10), w, 1 FROM l1) WHERE cnt > 0)
),
gammas AS MATERIALIZED ({gammas}),
w0 AS (SELECT unnest(range({entries})) AS path_id, [chr(9)] AS h)"""]
    for i in range(length):
        order_draw = draw(SEED, "path_id", i, "t.n")
        ctes.append(f"""
t{i} AS MATERIALIZED (
  SELECT path_id, h, n, CASE WHEN n = 1 THEN '' ELSE array_to_string(h[len(h) - n + 2:], ' ') END AS ctx
  FROM (SELECT path_id, h, unnest(range(1, least(len(h), {order - 1}) + 2)) AS n FROM w{i})
),
o{i} AS MATERIALIZED (
  SELECT path_id, max(t.n) AS n FROM t{i} t JOIN gammas g ON g.n = t.n AND g.ctx = t.ctx
  WHERE {order_draw} / 1152921504606846976.0::DOUBLE >= g.gamma GROUP BY path_id
),
w{i + 1} AS MATERIALIZED (
  SELECT x.path_id, list_append(x.h, c.w) AS h
  FROM (
    SELECT w.path_id, w.h, coalesce(o.n, 0) AS n, coalesce(t.ctx, chr(10)) AS ctx, {draw(SEED, 'w.path_id', i)} AS d
    FROM w{i} w LEFT JOIN o{i} o ON o.path_id = w.path_id LEFT JOIN t{i} t ON t.path_id = w.path_id AND t.n = o.n) x
    JOIN choices c ON c.n = x.n AND c.ctx = x.ctx AND x.d % c.tot >= c.lo AND x.d % c.tot < c.hi
)""")
    return ",".join(ctes)


ORACLE["kneser_ney_walk"] = f"""
WITH {kneser_ney(3)}, {backoff_walk(3, 50, 6)}
SELECT path_id, array_to_string(h[2:], ' ') AS text FROM w6"""

# Language-model data

_VOCAB = """
vocab AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY cnt DESC, word) - 1 AS token_id, word, cnt
  FROM (SELECT word, count(*) AS cnt FROM seq GROUP BY word)
)"""
_BATCH = """
nb AS (SELECT count(*) // 20 AS nb FROM seq),
batch AS MATERIALIZED (
  SELECT pos // (SELECT nb FROM nb) AS batch_col, pos % (SELECT nb FROM nb) AS row, token_id
  FROM seq JOIN vocab USING (word) WHERE pos < (SELECT nb FROM nb) * 20
)"""
ORACLE["vocabulary"] = f"WITH {_SEQ}, {_VOCAB} SELECT token_id, word, cnt FROM vocab"
ORACLE["batchify"] = f"WITH {_SEQ}, {_VOCAB}, {_BATCH} SELECT batch_col, row, token_id FROM batch"
ORACLE["bptt_windows"] = f"""
WITH {_SEQ}, {_VOCAB}, {_BATCH},
ahead AS (
  SELECT *, lead(token_id) OVER (PARTITION BY batch_col ORDER BY row) AS target_id FROM batch
)
SELECT batch_col, row // 35 AS window, row % 35 AS pos, token_id, target_id
FROM ahead WHERE target_id IS NOT NULL"""
for _name, _power in (("temperature_walk", 2.0), ("temperature_walk_cold", 20.0)):
    ORACLE[_name] = f"""
WITH RECURSIVE {_FLAT}, {_FLAT_PAIRS},
warm AS (
  SELECT * FROM (
    SELECT w1, w2, cnt, CAST(round(pow(cnt::DOUBLE / max(cnt) OVER (PARTITION BY w1), {_power}::DOUBLE)
      * 1e9) AS BIGINT) AS weight FROM flat_pairs)
  WHERE weight > 0
),
{intervals('trans', 'warm', 'weight')},
freq AS (SELECT word, 1 AS cnt FROM flat_seq GROUP BY word),
{picks('picked', 'freq', 'word', 20)},
{walk_on(23)}
SELECT path_id, CAST(line_no AS INTEGER) AS line_no,
  array_to_string(words[line_no * 20 + 1 : line_no * 20 + 20], ' ') AS text
FROM (SELECT path_id, words, unnest(range((len(words) - 1) // 20 + 1)) AS line_no FROM made)"""
