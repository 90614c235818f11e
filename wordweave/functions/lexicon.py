"""Sentiment lexicons.

A lexicon rates terms twice: ``valence`` in [-4, 4] and ``polarity`` in
[-1, 1]. A ``Lexicon`` travels inside the plan as literals and suits lists that
people write; one of any size stays a table (see ``operators.sentiment``, where
every scorer takes either).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lexicon:
    entries: tuple[tuple[str, float, float], ...]

    def __post_init__(self):
        if len({term for term, _, _ in self.entries}) != len(self.entries):
            raise ValueError("a term is rated twice")

    @classmethod
    def from_rows(cls, rows: Iterable[tuple[str, float, float]]) -> Lexicon:
        return cls(tuple((t, float(v), float(p)) for t, v, p in rows))

    @classmethod
    def from_table(cls, table: DataFrame) -> Lexicon:
        """Inline a lexicon table; every term of it becomes part of the plan."""
        return cls.from_rows(tuple(r) for r in table.select("term", "valence", "polarity").collect())

    def ratings(self, which: str) -> dict[str, float]:
        at = {"valence": 1, "polarity": 2}[which]
        return {e[0]: e[at] for e in self.entries}

    @property
    def longest(self) -> int:
        """Words of the longest entry."""
        return max((len(t.split(" ")) for t, _, _ in self.entries), default=1)

    def hits(self, terms: Column, which: str) -> Column:
        """Ratings of the rated terms of an array, in array order.

        Set membership is a hash probe per term; the rating itself is looked
        up for hits only, one set per distinct rating.
        """
        rated = self.ratings(which)
        if not rated:
            return F.array().cast("array<double>")
        return F.transform(F.filter(terms, lambda t: t.isin(list(rated))), lambda t: self.rating(t, which))

    def rating(self, term: Column, which: str) -> Column:
        """The rating of a term, NULL without one."""
        groups = defaultdict(list)
        for entry, value in self.ratings(which).items():
            groups[value].append(entry)
        ordered = sorted(groups.items(), key=lambda g: (-len(g[1]), g[0]))
        found = F.lit(None).cast("double")
        for value, group in reversed(ordered):
            found = F.when(term.isin(group), F.lit(value)).otherwise(found)
        return found


# A small general-purpose lexicon rated by us.
_NEGATIVE = {
    -3.0: "hate evil murder torture terror hideous horrific abuse",
    -2.5: "scum moron disgusting vile awful terrible horrible cruel killed disaster",
    -2.0: (
        "idiot trash worthless pathetic stupid loser attack crash fail failure "
        "fear fraud guilty violent victim war wounded dead death crime angry"
    ),
    -1.5: "clown bad ugly lie poor sad worse wrong lost weak problem risk threat",
    -1.0: "boring cold doubt late miss noise slow tired blame dull",
}
_POSITIVE = {
    1.0: "calm clean easy fair fine fresh safe smart",
    1.5: "agree bright comfort gain help hope improve progress trust",
    2.0: "good nice happy kind strong success support thank win friendly",
    2.5: "beautiful brilliant charming delight joy wonderful",
    3.0: "best great excellent love perfect superb",
}

DEFAULT_LEXICON = Lexicon.from_rows(
    (term, valence, valence / 4)
    for valence, group in {**_NEGATIVE, **_POSITIVE}.items()
    for term in group.split()
)
