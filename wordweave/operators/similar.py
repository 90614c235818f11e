"""Pairs of similar vectors among many.

Vectors are rows (key..., term, value). Equal vectors are one class, so that a text
copied many times is compared once. Classes are dealt into blocks, and a task compares
two blocks: a matrix of cosines, in double precision, of which only what reaches the
threshold leaves the task. Where few different words make nearly all vectors share some,
as many pairs are compared as there are, but none is written down to be compared: disk
grows with the vectors, memory is bounded by the block, time grows with the square of
the number of classes over the number of cores.

``prefixes`` and ``candidates`` tell the pairs that may be similar beforehand, for
vectors that have few terms in common. Terms have one order, the rare first. A vector
lists the terms of its prefix: as many as it takes until the rest of it has a norm below
the threshold. By the inequality of Cauchy and Schwarz what the rest adds to a cosine is
below the threshold too, so two vectors that reach it share their first common term in
both prefixes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordweave.session import Scratch, cut

# The norm of the rest is rounded up by so much.
MARGIN = 1e-9

# Classes and entries of a block, about; few classes make smaller blocks, of so many classes
# at least, for all cores to have some.
BLOCK_ROWS, BLOCK_ENTRIES, LEAST_ROWS = 4_000, 1_200_000, 1_000

# Classes of a block that are compared with another block at a time.
STRIP = 1_000

# A term is compared by a matrix product if it is in one of so many pairs of a block,
# so many terms at a time; other terms pair by pair, so many pairs at a time.
DENSE, COLUMNS, PAIRS = 500, 512, 1 << 20


def classes(vectors: DataFrame, key: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Membership (key, class_id), and the unit vectors (class_id, term, u) of
    the classes; ``class_id`` is the smallest key with an equal direction of equal
    length. Zero vectors, which have no cosine, are left out."""
    v = F.col(value).cast("double")
    summed = cut(vectors.groupBy(key, "term").agg(F.sum(v).alias("_v")).where(F.col("_v") != 0))
    entry = F.struct("term", "_v")
    whole = summed.groupBy(key).agg(
        F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_norm"),
        # Equal vectors have equal sums of entry digests and equal sizes.
        F.count("*").alias("_n"),
        F.sum(F.xxhash64(entry).cast("decimal(38,0)")).alias("_first"),
        F.sum(F.xxhash64(F.lit(1), entry).cast("decimal(38,0)")).alias("_second"),
    )
    least = whole.groupBy("_n", "_first", "_second").agg(F.min(key).alias("class_id"))
    members = cut(whole.join(least, ["_n", "_first", "_second"]).select(key, "class_id", "_norm"))
    units = (
        summed.join(members.where(F.col(key) == F.col("class_id")), key)
        .select("class_id", "term", (F.col("_v") / F.col("_norm")).alias("u"))
    )
    return members.select(key, "class_id"), cut(units)


def prefixes(units: DataFrame, threshold: float) -> DataFrame:
    """(class_id, term): the listed terms of each unit vector."""
    df = units.groupBy("term").agg(F.count("*").alias("_df"))
    ordered = Window.partitionBy("class_id").orderBy(F.col("_df").desc(), F.col("term").desc())
    rest = F.sum(F.col("u") * F.col("u")).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # The sum runs from the most frequent term up to this one.
    return (
        units.join(df, "term")
        .withColumn("_rest", F.sqrt(rest))
        .where(F.col("_rest") + MARGIN >= threshold)
        .select("class_id", "term")
    )


def candidates(units: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: classes that share a listed term."""
    listed = cut(prefixes(units, threshold))
    other = listed.withColumnRenamed("class_id", "b")
    met = listed.withColumnRenamed("class_id", "a").join(other, "term").where(F.col("a") < F.col("b"))
    return met.select("a", "b").distinct()


def blocks(units: DataFrame, sizes: DataFrame) -> tuple[DataFrame, int]:
    """(block, vectors) and the number of blocks: the classes of a block in order, as
    (class_id, size, terms, values). Terms are numbers; those of a single class, which
    no pair shares, have none. ``units`` should be stored."""
    n, entries = units.agg(F.count_distinct("class_id"), F.count("*")).first()
    # Each two blocks are a task, so 2 c ** 0.5 blocks are about 2 c tasks.
    busy = ceil(2 * units.sparkSession.sparkContext.defaultParallelism ** 0.5)
    number = max(1, ceil(n / BLOCK_ROWS), ceil(entries / BLOCK_ENTRIES), min(ceil(n / LEAST_ROWS), busy))
    shared = units.groupBy("term").agg(F.count("*").alias("_df")).where(F.col("_df") > 1)
    numbered = cut(shared.select("term", F.monotonically_increasing_id().alias("_id")))
    vectors = (
        units.join(numbered, "term")
        .groupBy("class_id")
        .agg(F.collect_list(F.struct("_id", "u")).alias("_entries"))
        .join(sizes, "class_id")
        .select("class_id", "size", F.col("_entries._id").alias("terms"), F.col("_entries.u").alias("values"))
    )
    block = F.pmod(F.xxhash64("class_id"), F.lit(number)).cast("int").alias("block")
    return vectors.groupBy(block).agg(F.sort_array(F.collect_list(F.struct(*vectors.columns))).alias("vectors")), number


class _Block:
    """Classes with their entries (row, term, value) in order of the term."""

    def __init__(self, ids: pa.Array, sizes: np.ndarray, row: np.ndarray, term: np.ndarray, value: np.ndarray):
        self.ids, self.sizes, self.rows = ids, sizes, len(ids)
        self.row, self.term, self.value = row, term, value

    @classmethod
    def read(cls, vectors: pa.Array) -> _Block:
        ids, sizes, terms, values = vectors.flatten()
        lengths = np.diff(terms.offsets.to_numpy())
        term = terms.flatten().to_numpy()
        order = np.argsort(term, kind="stable")
        row = np.repeat(np.arange(len(ids)), lengths)[order]
        return cls(ids, sizes.to_numpy(zero_copy_only=False), row, term[order], values.flatten().to_numpy()[order])

    def strips(self) -> Iterator[tuple[int, _Block]]:
        """Blocks of the next ``STRIP`` classes, with the place of the first."""
        for low in range(0, self.rows, STRIP):
            here = (self.row >= low) & (self.row < low + STRIP)
            ids, sizes = self.ids.slice(low, STRIP), self.sizes[low : low + STRIP]
            yield low, _Block(ids, sizes, self.row[here] - low, self.term[here], self.value[here])

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place in ``terms`` and value of the entries with one of ``terms``."""
        at = np.minimum(np.searchsorted(terms, self.term), len(terms) - 1)
        found = terms[at] == self.term
        return self.row[found], at[found], self.value[found]


def _different(ordered: np.ndarray) -> np.ndarray:
    return ordered[np.flatnonzero(np.diff(ordered, prepend=ordered[0] - 1))] if len(ordered) else ordered


def _cosines(a: _Block, b: _Block) -> np.ndarray:
    """The cosines of all classes of two blocks."""
    found = np.zeros((a.rows, b.rows))
    common = np.intersect1d(_different(a.term), _different(b.term), assume_unique=True)
    if not len(common):
        return found
    (row_a, at_a, value_a), (row_b, at_b, value_b) = a.of(common), b.of(common)
    often_a, often_b = (np.bincount(at, minlength=len(common)) for at in (at_a, at_b))
    dense = often_a * often_b * DENSE > a.rows * b.rows
    place = np.cumsum(dense) - 1
    for low in range(0, int(dense.sum()), COLUMNS):
        sides = []
        for block, row, at, value in ((a, row_a, at_a, value_a), (b, row_b, at_b, value_b)):
            here = dense[at] & (place[at] >= low) & (place[at] < low + COLUMNS)
            side = np.zeros((block.rows, COLUMNS))
            side[row[here], place[at[here]] - low] = value[here]
            sides.append(side)
        found += sides[0] @ sides[1].T
    # An entry of a rare term meets the entries of the other side, which lie together.
    starts = np.cumsum(often_b) - often_b
    rare = np.flatnonzero(~dense[at_a])
    often, first, base, weight = often_b[at_a[rare]], starts[at_a[rare]], row_a[rare] * b.rows, value_a[rare]
    upto = np.cumsum(often)
    flat, low = found.reshape(-1), 0
    while low < len(rare):
        done = upto[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
        times = often[low:high]
        right = np.arange(times.sum()) + np.repeat(first[low:high] - (np.cumsum(times) - times), times)
        cell = np.repeat(base[low:high], times) + row_b[right]
        np.add.at(flat, cell, np.repeat(weight[low:high], times) * value_b[right])
        low = high
    return found


def _compared(
    units: DataFrame, sizes: DataFrame, threshold: float, schema: T.StructType, found: Callable
) -> DataFrame:
    """What ``found`` makes of the cosines of each two blocks, and of each with itself,
    stored; pairs below the threshold are -1, and of a block with itself pairs are
    there once, the smaller class first. The first block comes in strips of classes."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and is at most 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at_a, at_b = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                whole, b = _Block.read(batch.column(1)[i].values), _Block.read(batch.column(3)[i].values)
                for low, a in whole.strips():
                    cosines = _cosines(a, b)
                    cosines[cosines < threshold] = -1.0
                    if at_a == at_b:
                        cosines[np.tri(a.rows, b.rows, low, dtype=bool)] = -1.0
                    yield from found(a, b, cosines)

    with Scratch(units.sparkSession) as scratch:
        made, number = blocks(units, sizes)
        # A block is a row; rows are dealt out, so that a task has few pairs of blocks.
        dealt = scratch.keep(made).repartition(number)
        other = dealt.select(F.col("block").alias("other"), F.col("vectors").alias("others"))
        met = dealt.join(other.hint("shuffle_replicate_nl"), F.col("block") <= F.col("other"))
        return cut(met.select("block", "vectors", "other", "others").mapInArrow(run, schema))


def _one_each(units: DataFrame) -> DataFrame:
    return units.select("class_id", F.lit(1).cast("long").alias("size")).distinct()


def similar_classes(units: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of classes with at least the
    threshold."""
    kind = units.schema["class_id"].dataType
    schema = T.StructType().add("a", kind).add("b", kind).add("similarity", "double")

    def found(a: _Block, b: _Block, cosines: np.ndarray) -> Iterator[pa.RecordBatch]:
        left, right = np.nonzero(cosines >= 0)
        columns = [a.ids.take(pa.array(left)), b.ids.take(pa.array(right)), pa.array(cosines[left, right])]
        yield pa.RecordBatch.from_arrays(columns, schema.names)

    pairs = _compared(units, _one_each(units), threshold, schema, found)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def neighbours(units: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """(class_id, n_similar, best, best_similarity) of the classes that others are
    similar to: the vectors of those (``sizes`` has class_id and size), the class most
    similar, the smallest of those equal to nine digits, and the highest similarity.

    Pairs are counted where they meet: each comparison of two blocks returns at most
    one row for each class of the first, and one for each of the second and strip."""
    kind = units.schema["class_id"].dataType
    schema = T.StructType().add("class_id", kind).add("_n", "long").add("_best", kind)
    schema = schema.add("_top", "double").add("_most", "double")

    def side(a: _Block, b: _Block, cosines: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero((cosines >= 0).any(axis=1))
        cosines = cosines[some]
        rounded = np.round(cosines, 9)
        # Classes are in order, so the first of equals is the smallest.
        best = rounded.argmax(axis=1) if len(some) else np.zeros(0, int)
        columns = [
            a.ids.take(pa.array(some)),
            pa.array((cosines >= 0) @ b.sizes),
            b.ids.take(pa.array(best)),
            pa.array(rounded[np.arange(len(some)), best]),
            pa.array(cosines.max(axis=1, initial=-1.0)),
        ]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def found(a: _Block, b: _Block, cosines: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield side(a, b, cosines)
        yield side(b, a, cosines.T)

    return (
        _compared(units, sizes, threshold, schema, found)
        .groupBy("class_id")
        .agg(
            F.sum("_n").alias("n_similar"),
            F.min_by("_best", F.struct(-F.col("_top"), F.col("_best"))).alias("best"),
            F.max("_most").alias("best_similarity"),
        )
    )


def similar(vectors: DataFrame, key: str, threshold: float, value: str = "value") -> DataFrame:
    """(key, class_id, n_copies, n_similar, best, best_similarity), one row per
    vector that is not zero: its class, the other vectors equal to it, the vectors
    outside the class at or above the threshold, and the class most similar
    (the smallest of equals; its own and 0 without one)."""
    members, units = classes(vectors, key, value)
    sizes = members.groupBy("class_id").agg(F.count("*").alias("size"))
    return (
        members.join(sizes, "class_id")
        .join(neighbours(units, sizes, threshold), "class_id", "left")
        .select(
            key,
            "class_id",
            (F.col("size") - 1).alias("n_copies"),
            F.coalesce("n_similar", F.lit(0)).alias("n_similar"),
            F.coalesce("best", "class_id").alias("best"),
            F.coalesce("best_similarity", F.lit(0.0)).alias("best_similarity"),
        )
    )
