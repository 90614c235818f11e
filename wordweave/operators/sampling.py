"""Seeded sampling by hashing row identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordweave.functions import seeded
from wordweave.operators.transitions import bucketed, part_width, running_weights
from wordweave.session import cut


def keep_about(size: Column, target: int, *parts) -> Column:
    """Predicate keeping each of ``size`` rows with probability target/size."""
    return seeded.draw(*parts) % size < F.lit(target)


def sample_to_size(frame: DataFrame, target: int, seed, *ids: str) -> DataFrame:
    """Bernoulli sample with expected size ``target``; all rows if fewer."""
    size = frame.agg(F.count("*")).scalar()
    return frame.where(keep_about(size, target, seed, *[F.col(i) for i in ids]))


# Bits of a draw that one histogram tells apart.
HISTOGRAM_BITS = 15


def _threshold(draws: DataFrame, target: int) -> tuple[int, int]:
    """(bound, rows below it) of the ``target`` smallest of the stored
    ``_draw``: the smallest draw that does not belong to them whole.

    Each round counts rows by the next bits of the draw and goes on in the bin
    that the target falls into, so nothing is sorted or collected but a histogram
    of bounded size.
    """
    low, below, bits = 0, 0, (seeded.DRAW_RANGE - 1).bit_length()
    while bits:
        bits -= HISTOGRAM_BITS
        inside = draws.where((F.col("_draw") >= low) & (F.col("_draw") <= low + (1 << (bits + HISTOGRAM_BITS)) - 1))
        bins = inside.groupBy(F.shiftright("_draw", bits).alias("bin")).count().orderBy("bin").collect()
        for bin_, rows in bins:
            if below + rows > target:
                low = bin_ << bits
                break
            below += rows
        else:
            return seeded.DRAW_RANGE, below
    return low, below


def exact_sample(frame: DataFrame, size: int, seed, *ids: str) -> DataFrame:
    """Exactly ``size`` rows, or all if there are fewer, the same for any
    layout: those with the smallest draws by ``ids``.

    Rows with equal ids have equal draws. Where they straddle the border, a draw
    by all their columns decides, and between rows equal in everything it does not
    matter which are taken. The threshold comes from histograms; the frame is
    filtered by it and neither sorted nor sent anywhere.
    """
    if size <= 0:
        return frame.limit(0)
    drawn = frame.withColumn("_draw", seeded.draw(seed, *[F.col(i) for i in ids]))
    stored = cut(drawn.select("_draw"))
    bound, below = _threshold(stored, size)
    sure = drawn.where(F.col("_draw") < bound)
    if bound == seeded.DRAW_RANGE or below == size:
        return sure.drop("_draw")
    whole = F.to_json(F.struct(*frame.columns))
    tied = cut(drawn.where(F.col("_draw") == bound).withColumn("_draw", seeded.draw(seed, "tie", whole)))
    second, more = _threshold(tied.select("_draw"), size - below)
    kept = sure.unionByName(tied.where(F.col("_draw") < second))
    if below + more < size and second < seeded.DRAW_RANGE:
        kept = kept.unionByName(tied.where(F.col("_draw") == second).limit(size - below - more))
    return kept.drop("_draw")


def hash_split(key: Column, seed, shares: Sequence[tuple[str, int]]) -> Column:
    """Name of the part a key belongs to; shares are in percent and add up
    to 100."""
    if sum(s for _, s in shares) != 100:
        raise ValueError("the shares have to add up to 100")
    at = seeded.draw(seed, key) % 100
    upto, name = 0, F
    for part, percent in shares:
        upto += percent
        name = name.when(at < upto, F.lit(part))
    return name


def weighted_picks(
    candidates: DataFrame, items: Sequence[str], picks: int, seed, weight: str = "cnt"
) -> DataFrame:
    """(path_id, items...): ``picks`` independent draws with replacement,
    each candidate with probability weight / total. ``candidates`` is read
    several times and should be stored."""
    items = list(items)
    size, total = candidates.agg(F.count("*"), F.sum(weight)).first()
    one_key = candidates.select(*items, F.col(weight).alias("_w"), F.lit(0).alias("_all"))
    tiled = running_weights(one_key, ["_all"], items, "_w", seeded.digits_for(size))
    everything = F.lit(total or 1)
    width = part_width(everything, F.lit(size), everything)
    drawn = (
        candidates.sparkSession.range(picks if size else 0)
        .withColumnRenamed("id", "path_id")
        .withColumn("_d", seeded.draw(seed, F.col("path_id"), "start") % everything)
        .withColumn("_width", width)
        .withColumn("bucket", F.expr("_d div _width"))
    )
    inside = (F.col("_d") >= F.col("lo")) & (F.col("_d") < F.col("hi"))
    return drawn.join(bucketed(tiled, everything), "bucket").where(inside).select("path_id", *items)
