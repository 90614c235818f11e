"""Lexicon sentiment of lines, and filters on the scores.

Every scorer takes a ``Lexicon``, which makes a map-only plan, or a lexicon
table (term, valence, polarity) of any size. Up to ``IN_ROW`` terms of a table are
laid out as one value, in which a line looks up its own terms; a larger table is
joined, which is decided when the plan runs. A score depends on nothing but the text,
so in the join rated terms are gathered by the digest of the text, with their places;
lines need no key, and repeated ones cost little. A term that the table rates more
than once counts with its mean. ``keys`` are not needed any more and change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordweave.functions import scoring
from wordweave.functions import text as tx
from wordweave.functions.lexicon import DEFAULT_LEXICON, Lexicon
from wordweave.functions.scoring import Modifiers

# A term is spread over so many groups when lines meet a lexicon table.
SALTS = 16

# Lines look up a table of up to so many terms without a join.
IN_ROW = 4_096

NO_MODIFIERS = Modifiers()
VALENCE = "valence"
POLARITY = "polarity"


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per line of a text column; ``line_no`` counts from 0."""
    others = [c for c in docs.columns if c != text]
    return docs.select(*others, F.posexplode(tx.lines(F.col(text))).alias("line_no", "text"))


def _places(lines: DataFrame, lexicon: DataFrame, terms: Column, which: str, longest: int) -> DataFrame:
    """Adds ``_ratings``, the rated runs of ``terms`` (at, size, rating) in
    order of place.

    One of two branches has rows, by the size of the table. The other is left before a
    text is split.
    """
    rated = (
        lexicon.where(F.col("term").isNotNull())
        .groupBy("term")
        .agg(F.avg(which).alias("rating"))
        .where(F.col("rating").isNotNull())
    )
    slots = _slots(rated).scalar()
    inside = lines.where(slots.isNotNull()).withColumn("_slots", slots)
    return inside.select(*lines.columns, _looked_up(terms, F.col("_slots"), longest).alias("_ratings")).unionByName(
        _joined(lines.where(slots.isNull()), rated, terms, longest)
    )


def _slot(term: Column, slots: Column) -> Column:
    return F.pmod(F.xxhash64(term), slots).cast("int")


def _slots(rated: DataFrame) -> DataFrame:
    """One row with the table as an array of as many maps as there are terms, told by
    the hash of the term; none if there are too many."""
    entries = rated.limit(IN_ROW + 1).agg(F.collect_list(F.struct("term", "rating")).alias("_entries"))
    n = F.greatest(F.size("_entries"), F.lit(1))

    def those(slot: Column) -> Column:
        return F.map_from_entries(F.filter("_entries", lambda e: _slot(e["term"], n) == slot))

    return entries.where(F.size("_entries") <= IN_ROW).select(F.transform(F.sequence(F.lit(0), n - 1), those))


def _looked_up(terms: Column, slots: Column, longest: int) -> Column:
    """The ratings of runs of terms, from the slots of the table."""

    def rated(g: Column) -> Column:
        found = F.get(slots, _slot(g["term"], F.size(slots)))[g["term"]]
        return F.struct(g["at"].alias("at"), g["size"].alias("size"), found.alias("rating"))

    found = F.filter(F.transform(scoring.grams(terms, longest), rated), lambda r: r["rating"].isNotNull())
    return scoring.apart(found, longest)


def _joined(lines: DataFrame, rated: DataFrame, terms: Column, longest: int) -> DataFrame:
    """``_places`` by a join with ``rated`` (term, rating).

    A frequent term may own a large part of all rows, so terms meet the lexicon
    in ``SALTS`` groups, chosen by the text. Spark broadcasts the table if it
    is small by its own size check. A text that very many lines share is
    gathered once: its ratings are a set.
    """
    named = lines.withColumn("_text", F.unhex(F.md5("text")))
    salt = F.pmod(F.xxhash64("_text"), F.lit(SALTS)).cast("int")
    tokens = named.select("_text", salt.alias("_salt"), F.inline(scoring.grams(terms, longest)))
    salted = rated.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    gathered = (
        tokens.join(salted, ["term", "_salt"])
        .groupBy("_text")
        .agg(F.collect_set(F.struct("at", "size", "rating")).alias("_found"))
    )
    none = F.array().cast("array<struct<at: int, size: int, rating: double>>")
    found = F.coalesce("_found", none)
    # Without a text there is nothing to find, and NULL joins with nothing.
    return named.join(gathered, "_text", "left").select(
        *lines.columns, scoring.apart(found, longest).alias("_ratings")
    )


def _longest(lexicon: Lexicon | DataFrame) -> int:
    if isinstance(lexicon, Lexicon):
        return lexicon.longest
    return lexicon.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1


def _computed(frame: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that leave through a generator: what uses them later uses
    the value, where a plain projection would be computed again each time."""
    return frame.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def valence(
    lines: DataFrame,
    lexicon: Lexicon | DataFrame = DEFAULT_LEXICON,
    keys: list[str] | None = None,
    modifiers: Modifiers = NO_MODIFIERS,
) -> DataFrame:
    """Adds neg, neu, pos and compound. A NULL text scores like an empty one."""
    text = F.coalesce("text", F.lit(""))
    if modifiers:
        summed = _by_rules(lines, text, lexicon, modifiers)
    else:
        terms = F.col("_forms")
        split = lines.withColumn("_forms", tx.terms(text))
        if isinstance(lexicon, DataFrame):
            split = _places(split, lexicon, terms, "valence", 1)
            values = F.transform("_ratings", lambda r: r["rating"])
        else:
            values = lexicon.hits(terms, "valence")
        summed = split.withColumn("_s", scoring.valence_sums(scoring.unmodified(values)))
    s, n = F.col("_s"), F.size("_forms").cast("double")
    total = scoring.exclaimed(text, s["total"]) if modifiers.exclamation else s["total"]
    scores = F.struct(*scoring.shares(total, s["positive"], s["negative"], n - s["hits"]))
    # A later filter on the scores stays above the generator.
    return summed.select(*lines.columns, F.inline(F.array(scores)))


def _by_rules(lines: DataFrame, text: Column, lexicon: Lexicon | DataFrame, modifiers: Modifiers) -> DataFrame:
    """Adds ``_forms`` and the sums ``_s`` after the chosen rules."""
    longest = _longest(lexicon) if modifiers.idioms else 1
    split = _computed(lines, _forms=scoring.forms(text, modifiers.emoticons))
    split = _computed(
        split,
        _terms=F.transform("_forms", lambda f: f["term"]),
        _around=scoring.surroundings(F.col("_forms")),
    )
    terms = F.col("_terms")
    if isinstance(lexicon, DataFrame):
        split = _places(split, lexicon, terms, "valence", longest)
    else:
        found = scoring.inline_ratings(terms, lexicon, "valence", longest)
        split = _computed(split, _ratings=scoring.apart(found, longest))
    hits = scoring.modified(F.col("_forms"), F.col("_around"), F.col("_ratings"), modifiers)
    return _computed(split, _s=scoring.valence_sums(hits))


def polarity(
    lines: DataFrame,
    lexicon: Lexicon | DataFrame = DEFAULT_LEXICON,
    keys: list[str] | None = None,
    chunks: bool = False,
) -> DataFrame:
    """Adds the mean polarity of the rated terms of the line; with ``chunks``
    after the negations and intensifiers directly before them."""
    split = lines.withColumn("_terms", tx.terms(F.coalesce("text", F.lit(""))))
    terms = F.col("_terms")
    if isinstance(lexicon, DataFrame):
        split = _places(split, lexicon, terms, "polarity", 1)
        values = F.transform("_ratings", lambda r: r["rating"])
    elif chunks:
        split = _computed(lines, _terms=tx.terms(F.coalesce("text", F.lit(""))))
        split = _computed(split, _ratings=scoring.inline_ratings(terms, lexicon, "polarity", 1))
    else:
        values = lexicon.hits(terms, "polarity")
    if chunks:
        values = scoring.chunk_polarities(terms, F.col("_ratings"))
    return _computed(split, polarity=scoring.mean_polarity(values)).select(*lines.columns, "polarity")


def sentiment(
    lines: DataFrame,
    method: str = VALENCE,
    lexicon: Lexicon | DataFrame = DEFAULT_LEXICON,
    keys: list[str] | None = None,
) -> DataFrame:
    """Adds ``score`` in [-1, 1] by the chosen method."""
    if method == VALENCE:
        scored, score = valence(lines, lexicon, keys), "compound"
    elif method == POLARITY:
        scored, score = polarity(lines, lexicon, keys), "polarity"
    else:
        raise NotImplementedError(f"unknown sentiment method {method!r}")
    return scored.select(*lines.columns, F.col(score).alias("score"))


def score_between(
    lines: DataFrame,
    lower: float = -1.0,
    upper: float = 1.0,
    method: str = VALENCE,
    lexicon: Lexicon | DataFrame = DEFAULT_LEXICON,
    keys: list[str] | None = None,
) -> DataFrame:
    """Lines whose score lies in the closed interval; the score is dropped."""
    if lower > upper:
        raise ValueError("the lower bound is greater than the upper bound")
    scored = sentiment(lines, method, lexicon, keys)
    return scored.where(F.col("score").between(lower, upper)).select(*lines.columns)


def negative_lines(
    lines: DataFrame,
    threshold: float = 0.5,
    lexicon: Lexicon | DataFrame = DEFAULT_LEXICON,
    keys: list[str] | None = None,
) -> DataFrame:
    """Lines whose negative share is strictly above the threshold."""
    return valence(lines, lexicon, keys).where(F.col("neg") > threshold).select(*lines.columns, "neg")
