"""Sentence scores as column expressions over an array of terms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordweave.functions import text as tx
from wordweave.functions.lexicon import Lexicon

# Fixed value: the published normalisation constant of the valence score.
ALPHA = 15.0


# The published constants of the score modifiers.
NEGATED, BOOSTED, CAPITALS, EXCLAIMED, MOST_EXCLAIMED = -0.74, 0.293, 0.733, 0.292, 4
FADING = (1.0, 0.95, 0.9)
BEFORE_BUT, AFTER_BUT = 0.5, 1.5

# Words that modify, in the normal form of terms.
NEGATIONS = frozenset(
    "aint arent cannot cant couldnt didnt doesnt dont hadnt hasnt havent isnt neither never no nobody "
    "none nor not nothing nowhere rarely seldom shouldnt wasnt werent without wont wouldnt".split()
)
BOOSTERS = frozenset(
    "absolutely completely deeply especially exceptionally extremely greatly highly incredibly "
    "intensely particularly purely quite really remarkably so thoroughly totally truly very".split()
)
DAMPENERS = frozenset("almost barely hardly kinda less little marginally partly scarcely slightly somewhat sortof".split())


# What an intensifier and a negation do to a polarity, rated by us.
STRONGER, WEAKER, TURNED = 1.3, 0.7, -0.5


@dataclass(frozen=True)
class Modifiers:
    """Which rules change the rating of a term; all off by default.

    negation: one of the three terms before is a negation. boosters: one of
    them strengthens or weakens, less with distance. capitals: the word is in
    capitals and the text is not. exclamation: up to four exclamation marks
    add to the total. but: ratings before the last "but" count half, those
    after it one and a half times. idioms: an entry of several words counts
    once, at its first word, in place of the words inside; of overlapping ones
    the first, then the longest counts. emoticons: every token is a term, one
    that is mostly signs as it is written.
    """

    negation: bool = False
    boosters: bool = False
    capitals: bool = False
    exclamation: bool = False
    but: bool = False
    idioms: bool = False
    emoticons: bool = False

    def __bool__(self) -> bool:
        return any(vars(self).values())


ALL_MODIFIERS = Modifiers(*[True] * 7)


def _in(term: Column, group: frozenset[str]) -> Column:
    return F.coalesce(term.isin(sorted(group)), F.lit(False))


def forms(text: Column, emoticons: bool = False) -> Column:
    """(term, loud) of every word of a text: its normal form and whether it is
    in capitals. Words without letters are left out, unless ``emoticons``
    keeps them as they are written."""

    def letters(word: Column) -> Column:
        return F.regexp_replace(word, r"[^\p{L}]", "")

    def term(word: Column) -> Column:
        plain = F.lower(letters(word))
        if not emoticons:
            return plain
        signs = F.length(word) - F.length(letters(word)) >= F.length(letters(word))
        return F.when((plain == "") | (signs & word.rlike(r"^[^\p{L}\p{N}]")), word).otherwise(plain)

    raw = tx.words(text)
    if not emoticons:
        raw = F.filter(raw, lambda w: letters(w) != "")
    loud = lambda w: (F.upper(w) == w) & (F.lower(w) != w)
    return F.transform(raw, lambda w: F.struct(term(w).alias("term"), loud(w).alias("loud")))


def grams(terms: Column, longest: int) -> Column:
    """(at, size, term): the runs of up to ``longest`` terms and where they
    begin. ``size`` is negative, so that the natural order has the longer
    first."""
    places = F.when(F.size(terms) > 0, F.sequence(F.lit(0), F.size(terms) - 1)).otherwise(
        F.array().cast("array<int>")
    )

    def of(size: int) -> Column:
        if size == 1:
            return F.transform(
                terms, lambda term, at: F.struct(at.alias("at"), F.lit(-1).alias("size"), term.alias("term"))
            )
        inside = F.filter(places, lambda at: at + size <= F.size(terms))
        return F.transform(
            inside,
            lambda at: F.struct(
                at.alias("at"),
                F.lit(-size).alias("size"),
                F.array_join(F.slice(terms, at + 1, F.lit(size)), " ").alias("term"),
            ),
        )

    return F.concat(*[of(size) for size in range(1, longest + 1)])


def inline_ratings(terms: Column, lexicon: Lexicon, which: str, longest: int) -> Column:
    """(at, size, rating) of the rated runs of terms."""
    rated = list(lexicon.ratings(which))
    hit = F.filter(grams(terms, longest), lambda g: g["term"].isin(rated) if rated else F.lit(False))
    return F.transform(
        hit, lambda g: F.struct(g["at"], g["size"], lexicon.rating(g["term"], which).alias("rating"))
    )


def apart(ratings: Column, longest: int) -> Column:
    """Ratings in order of place; of overlapping ones the first and longest."""
    ordered = F.array_sort(ratings)
    if longest == 1:
        return ordered
    kind = "struct<upto: int, kept: array<struct<at: int, size: int, rating: double>>>"
    start = F.struct(F.lit(0).alias("upto"), F.array().alias("kept")).cast(kind)

    def add(state: Column, r: Column) -> Column:
        taken = F.struct((r["at"] - r["size"]).alias("upto"), F.array_append(state["kept"], r).alias("kept"))
        return F.when(r["at"] >= state["upto"], taken.cast(kind)).otherwise(state)

    return F.aggregate(ordered, start, add, lambda state: state["kept"])


def surroundings(words: Column) -> Column:
    """What the rules ask of a whole text: whether some of its words are in
    capitals and some are not, and the place of its last "but"."""
    n = F.size(words)
    back = F.array_position(F.reverse(F.transform(words, lambda w: w["term"])), "but")
    return F.struct(
        (F.exists(words, lambda w: w["loud"]) & ~F.forall(words, lambda w: w["loud"])).alias("mixed"),
        F.when(back > 0, n - back).alias("but"),
    )


def modified(words: Column, around: Column, ratings: Column, modifiers: Modifiers) -> Column:
    """(value, size) of ``ratings`` after the chosen rules; ``words`` are the
    ``forms`` that the places of ratings refer to, ``around`` their
    ``surroundings``. All three should be columns, as they are used many times.
    Values of 0 are left out."""

    def rated(rating: Column) -> Column:
        at, value = rating["at"], rating["rating"]
        sign = F.signum(value)
        if modifiers.capitals:
            value = F.when(around["mixed"] & F.get(words, at)["loud"], value + sign * CAPITALS).otherwise(value)
        near = F.lit(False)
        for back, fading in enumerate(FADING, 1):
            before = F.when(at >= back, F.get(words, at - back)["term"])
            if modifiers.boosters:
                step = F.when(_in(before, BOOSTERS), BOOSTED * fading).when(_in(before, DAMPENERS), -BOOSTED * fading)
                value = value + sign * F.coalesce(step, F.lit(0.0))
            near = near | _in(before, NEGATIONS)
        if modifiers.negation:
            value = value * F.when(near, NEGATED).otherwise(1.0)
        if modifiers.but:
            value = value * F.when(at < around["but"], BEFORE_BUT).when(at > around["but"], AFTER_BUT).otherwise(1.0)
        value = F.when(sign != 0, value).otherwise(0.0)
        return F.struct(value.alias("value"), (-rating["size"]).cast("double").alias("size"))

    return F.filter(F.transform(ratings, rated), lambda v: v["value"] != 0)


def unmodified(values: Column) -> Column:
    """The same form of the ratings of single terms."""
    return F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(1.0).alias("size")))


def exclaimed(text: Column, total: Column) -> Column:
    """The total after exclamation marks, which strengthen it."""
    marks = F.least(F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))), F.lit(MOST_EXCLAIMED))
    return total + F.signum(total) * marks * EXCLAIMED


def compound(total: Column) -> Column:
    return F.round(total / F.sqrt(total * total + F.lit(ALPHA)), 4)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 3)).otherwise(F.lit(0.0))


def shares(total: Column, positive: Column, negative: Column, neutral: Column) -> list[Column]:
    """neg, neu, pos and compound from the four sums of a sentence."""
    whole = positive + negative + neutral
    return [
        share(negative, whole).alias("neg"),
        share(neutral, whole).alias("neu"),
        share(positive, whole).alias("pos"),
        compound(total).alias("compound"),
    ]


def valence_sums(hits: Column) -> Column:
    """Struct of the sums behind the valence score, one pass over the hits
    (value, size); ``hits`` of it is the number of words they cover."""
    zero = F.lit(0.0)
    start = F.struct(
        zero.alias("total"), zero.alias("positive"), zero.alias("negative"), zero.alias("hits")
    )

    def add(acc: Column, hit: Column) -> Column:
        v = hit["value"]
        return F.struct(
            (acc["total"] + v).alias("total"),
            (acc["positive"] + F.when(v > 0, v + 1).otherwise(0.0)).alias("positive"),
            (acc["negative"] + F.when(v < 0, 1 - v).otherwise(0.0)).alias("negative"),
            (acc["hits"] + F.when(v != 0, hit["size"]).otherwise(0.0)).alias("hits"),
        )

    return F.aggregate(hits, start, add)


def mean_polarity(values: Column) -> Column:
    """Mean of an array of polarities, 0 without any."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("hits"))
    return F.aggregate(
        values,
        start,
        lambda acc, v: F.struct(
            (acc["total"] + v).alias("total"), (acc["hits"] + 1.0).alias("hits")
        ),
        lambda acc: F.when(acc["hits"] > 0, acc["total"] / acc["hits"]).otherwise(F.lit(0.0)),
    )


def chunk_polarities(terms: Column, ratings: Column) -> Column:
    """Polarities of the rated terms (at, rating) with what stands before them.

    A chunk is a rated term and the intensifiers, negations and words of one
    letter directly before it. Intensifiers multiply the polarity by 1.3 or
    0.7; after a negation they divide it, and it is turned to minus a half. An
    intensifier before the negation does not count. The result stays in [-1, 1].
    """
    by_place = F.map_from_entries(F.transform(ratings, lambda r: F.struct(r["at"], r["rating"])))
    kind = "struct<turned: boolean, factor: double, found: array<double>>"
    fresh = (F.lit(False).alias("turned"), F.lit(1.0).alias("factor"))
    start = F.struct(*fresh, F.array().alias("found")).cast(kind)

    def rating(at: Column) -> Column:
        return F.get(F.filter(ratings, lambda r: r["at"] == at), F.lit(0))["rating"]

    placed = F.transform(terms, lambda t, at: F.struct(t.alias("term"), rating(at).alias("rating")))

    def add(state: Column, word: Column) -> Column:
        factor = state["factor"]
        value = word["rating"] * F.when(state["turned"], F.lit(TURNED) / factor).otherwise(factor)
        inside = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))

        def to(turned: Column, factor: Column) -> Column:
            return F.struct(turned.alias("turned"), factor.alias("factor"), state["found"].alias("found")).cast(kind)

        step = F.when(_in(word["term"], BOOSTERS), STRONGER).when(_in(word["term"], DAMPENERS), WEAKER)
        return (
            F.when(
                word["rating"].isNotNull(),
                F.struct(*fresh, F.array_append(state["found"], inside).alias("found")).cast(kind),
            )
            .when(_in(word["term"], NEGATIONS), to(F.lit(True), F.lit(1.0)))
            .when(step.isNotNull(), to(state["turned"], factor * step))
            .when(F.length(word["term"]) == 1, state)
            .otherwise(to(F.lit(False), F.lit(1.0)))
        )

    return F.aggregate(placed, start, add, lambda state: state["found"])
