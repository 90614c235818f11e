"""Approximate counts with a stated error, from sketches that can be merged.

Distinct values are counted by HyperLogLog sketches, frequencies of terms by a
count-min table. Both are small whatever the input, and the sketch of a whole is the
merged sketch of its parts, so stored sketches of days or shards add up.
"""

from __future__ import annotations

from math import ceil, exp, log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordweave.functions import seeded
from wordweave.functions import text as tx

# A sketch has 2^PRECISION registers.
PRECISION = 12


def distinct_sketch(frame: DataFrame, value: Column, *by: str) -> DataFrame:
    """(by..., sketch): one sketch of the distinct values per group."""
    return frame.groupBy(*by).agg(F.hll_sketch_agg(value, F.lit(PRECISION)).alias("sketch"))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """(by..., sketch): sketches of parts as those of the whole."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimates(sketches: DataFrame) -> DataFrame:
    """Replaces ``sketch`` by ``estimate`` and ``error``: in 95 of 100 cases
    the true number lies within that distance, two standard errors."""
    kept = [c for c in sketches.columns if c != "sketch"]
    number = F.hll_sketch_estimate("sketch")
    error = F.ceil(number * (2 * 1.04 / sqrt(1 << PRECISION))).cast("long")
    return sketches.select(*kept, number.alias("estimate"), error.alias("error"))


def vocabulary_size(units: DataFrame) -> DataFrame:
    """(estimate, error) of the number of distinct words in ``items``."""
    return estimates(distinct_sketch(units.select(F.explode("items").alias("word")), F.col("word")))


def population_size(paths: DataFrame, path_id: str = "path_id") -> DataFrame:
    """(estimate, error) of the number of paths."""
    return estimates(distinct_sketch(paths, F.col(path_id).cast("string")))


class CountMin:
    """Frequencies too high by at most ``error`` of the total, with
    probability ``1 - failure`` each; never too low."""

    # Rows come from parts of one 128-bit digest.
    MOST_ROWS = 8

    def __init__(self, error: float, failure: float):
        self.error, self.failure = error, failure
        self.width = ceil(exp(1) / error)
        self.rows = max(1, ceil(log(1 / failure)))
        if self.rows > self.MOST_ROWS or self.width > 1 << 16:
            raise ValueError("eight rows of 65,536 cells are the most")

    def cells(self, term: Column) -> Column:
        """The cell of the term in each row."""
        digest = seeded.digest(term)
        return F.array(
            *[
                F.struct(
                    F.lit(row).alias("row"),
                    F.shiftright(F.conv(F.substring(digest, 4 * row + 1, 4), 16, 10).cast("long") * self.width, 16)
                    .cast("int")
                    .alias("cell"),
                )
                for row in range(self.rows)
            ]
        )

    def sketch(self, terms: DataFrame, term: str = "term") -> DataFrame:
        """(row, cell, n) of the occurrences of ``term``."""
        return (
            terms.select(F.inline(self.cells(F.col(term))))
            .groupBy("row", "cell")
            .agg(F.count("*").alias("n"))
        )

    def document_sketch(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The sketch of document frequencies: a term counts once per row."""
        terms = docs.select(F.explode(F.array_distinct(tx.terms(F.col(text)))).alias("term"))
        return self.sketch(terms)

    @staticmethod
    def merged(sketches: DataFrame) -> DataFrame:
        return sketches.groupBy("row", "cell").agg(F.sum("n").alias("n"))

    def frequencies(self, sketch: DataFrame, terms: DataFrame, term: str = "term") -> DataFrame:
        """(term, estimate, error) of distinct terms; the sketch has a fixed
        size and is broadcast."""
        total = sketch.where(F.col("row") == 0).agg(F.sum("n")).scalar()
        cells = terms.select(term, F.inline(self.cells(F.col(term))))
        found = cells.join(F.broadcast(sketch), ["row", "cell"], "left")
        return found.groupBy(term).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate")).select(
            term, "estimate", F.ceil(F.coalesce(total, F.lit(0)) * self.error).cast("long").alias("error")
        )
