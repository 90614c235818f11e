"""Word transitions: the weighted graph the generators walk on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordweave.functions import seeded
from wordweave.functions import text as tx
from wordweave.session import Scratch, cut

# Average number of candidates a walking path compares per step.
BUCKET_ROWS = 64

# Successors of a word up to which one task lays them out, and how many words
# with more a broadcast may name (256 rows each). Neither changes a result.
TOGETHER, FEW = 20_000, 1_000

# No (word, part) gets more than about one in so many of all draws.
SPREAD = 1024


def sentences(lines: DataFrame) -> DataFrame:
    """Adds ``sentence``: words with the first capitalised and the end mark.

    The words are a column of their own first, so each line is split once.
    """
    split = lines.withColumn("_words", tx.words(F.col("text")))
    return split.withColumn("sentence", tx.sentence(F.col("_words"))).drop("_words")


def sentence_pairs(lines: DataFrame) -> DataFrame:
    """(w1, w2), one row per occurrence; pairs stay within their line."""
    return sentences(lines).select(F.inline(tx.adjacent(F.col("sentence"))))


def sentence_pairs_with_place(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., pos, w1, w2), one row per occurrence with its address."""
    return sentences(lines).select(
        *keys, F.posexplode(tx.adjacent(F.col("sentence"))).alias("pos", "_pair")
    ).select(*keys, "pos", "_pair.w1", "_pair.w2")


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("w1", "w2").agg(F.count("*").alias("cnt"))


def swapped(pairs: DataFrame) -> DataFrame:
    """(next, word) order of the pair columns."""
    return pairs.select("w2", "w1", *[c for c in pairs.columns if c not in ("w1", "w2")])


def sequential_starts(pairs: DataFrame) -> DataFrame:
    """Pairs a single sentence may start with: an upper-case first word, and
    the second word is not the end."""
    return pairs.where(tx.starts_upper(F.col("w1")) & (F.col("w2") != tx.END))


def population_starts(pairs: DataFrame) -> DataFrame:
    """Pairs a population may start with: an upper-case first word."""
    return pairs.where(tx.starts_upper(F.col("w1")))


def running_weights(
    frame: DataFrame, keys: list[str], items: list[str], weight: str, digits: int
) -> DataFrame:
    """Adds ``lo``, ``hi``, ``tot`` and ``n``: the rows of a key tile [0, tot)
    in the order of a digest of their items, ``n`` is their number.

    A key may own any part of all rows. Its rows are summed up inside shards,
    which are told by the first ``digits`` digits of the digest, and then over
    its shards, so no task holds all rows of a key. The order does not depend
    on the number of digits.
    """
    order = seeded.digest(*[F.col(i) for i in items])
    # The explicit repartition keeps the shuffle of the rows apart from that of
    # the sums, which follows the keys alone.
    sharded = (
        frame.withColumn("_order", order)
        .withColumn("_shard", F.substring("_order", 1, digits))
        .repartition(*keys, "_shard")
    )
    upto = (Window.unboundedPreceding, Window.currentRow)
    inside = Window.partitionBy(*keys, "_shard").orderBy("_order", *items).rowsBetween(*upto)
    shards = sharded.groupBy(*keys, "_shard").agg(
        F.sum(weight).alias("_sum"), F.count("*").alias("_rows")
    )
    over_key = Window.partitionBy(*keys)
    before = shards.select(
        *keys,
        "_shard",
        (F.sum("_sum").over(over_key.orderBy("_shard").rowsBetween(*upto)) - F.col("_sum")).alias("_before"),
        F.sum("_sum").over(over_key).alias("tot"),
        F.sum("_rows").over(over_key).alias("n"),
    )
    end = F.col("_before") + F.col("_upto")
    return (
        sharded.withColumn("_upto", F.sum(weight).over(inside))
        .join(before, [*keys, "_shard"])
        .withColumns({"lo": end - F.col(weight), "hi": end})
        .select(*frame.columns, "lo", "hi", "tot", "n")
    )


def with_intervals(counts: DataFrame, weight: str = "cnt", sizes: DataFrame | None = None) -> DataFrame:
    """Adds ``lo``, ``hi``, ``tot`` and ``n``: the successors of a word tile
    [0, tot), the end of the sentence last, the others by digest.

    With the end last, the first part of the same intervals serves draws that
    must not meet the end. ``counts`` is read more than once and should be
    stored; stored ``sizes`` (w1, n) are given if they are known.

    The order is the same for every word. Only the work is laid out by size: a
    word with very many successors is summed up in digest shards in several
    tasks and then over its shards.
    """
    if sizes is None:
        sizes = cut(counts.groupBy("w1").agg(F.count("*").alias("n")))
    large = sizes.where(F.col("n") > TOGETHER).select("w1", F.lit(True).alias("_large"))
    few = large.count() <= FEW

    def small(side: DataFrame) -> DataFrame:
        """A side with at most 256 rows per large word."""
        return F.broadcast(side) if few else side

    order = F.when(F.col("w2") == tx.END, "~").otherwise(seeded.digest(F.col("w2")))
    marked = counts.join(small(large), "w1", "left").withColumn("_order", order)
    shard = F.substring("_order", 1, 2)
    sharded = marked.withColumn("_shard", F.when(F.col("_large"), shard).otherwise("")).repartition("w1", "_shard")
    upto = (Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("w1", "_shard")
    local = sharded.withColumns(
        {
            "_upto": F.sum(weight).over(group.orderBy("_order", "w2").rowsBetween(*upto)),
            "_sum": F.sum(weight).over(group),
            "_rows": F.count("*").over(group),
        }
    )
    shards = (
        marked.where(F.col("_large"))
        .groupBy("w1", shard.alias("_shard"))
        .agg(F.sum(weight).alias("_part"), F.count("*").alias("_count"))
    )
    word = Window.partitionBy("w1")
    before = shards.select(
        "w1",
        "_shard",
        (F.sum("_part").over(word.orderBy("_shard").rowsBetween(*upto)) - F.col("_part")).alias("_before"),
        F.sum("_part").over(word).alias("_tot"),
        F.sum("_count").over(word).alias("_n"),
    )
    end = F.coalesce("_before", F.lit(0)) + F.col("_upto")
    return local.join(small(before), ["w1", "_shard"], "left").select(
        *counts.columns,
        (end - F.col(weight)).alias("lo"),
        end.alias("hi"),
        F.coalesce("_tot", "_sum").alias("tot"),
        F.coalesce("_n", "_rows").alias("n"),
    )


def transitions(lines: DataFrame) -> DataFrame:
    """(w1, w2, cnt, lo, hi, tot) of the sentences of ``lines``."""
    return with_intervals(cut(pair_counts(sentence_pairs(lines)))).drop("n")


def part_width(total: Column, rows: Column, everything: Column) -> Column:
    """Width of the equal parts [0, total) is cut into: one part per
    ``BUCKET_ROWS`` rows, and at least one per 1/``SPREAD`` of the weight of
    all keys.

    Draws meet a part as often as its share of the weight says, so no part
    gets more than about 1/``SPREAD`` of them, even if its key has two rows.
    """
    parts = F.greatest(F.ceil(rows / F.lit(float(BUCKET_ROWS))), F.ceil(total * float(SPREAD) / everything))
    return F.greatest(F.ceil(total / parts), F.lit(1)).cast("long")


def bucketed(intervals: DataFrame, everything: Column) -> DataFrame:
    """Adds ``bucket`` and ``width``: the interval [0, tot) of a key is cut
    into equal parts, see ``part_width``, and each row is listed in every part
    it reaches into.

    A draw then meets its row by an equi-join on (key, bucket). All parts of a
    key are equally likely and its rows lie in digest order, so a draw compares
    about ``BUCKET_ROWS`` rows however large its key is. Listing adds at most
    one row per part, and there are at most ``SPREAD`` parts more than keys and
    full parts.
    """
    return (
        intervals.withColumn("width", part_width(F.col("tot"), F.col("n"), everything))
        .withColumn(
            "bucket",
            F.explode(
                F.sequence(F.expr("lo div width"), F.expr("(hi - 1) div width"))
            ),
        )
    )


def word_totals(counts: DataFrame, everything: Column, weight: str = "cnt") -> DataFrame:
    """(cur, n, tot, open, width): the number of successors and what a path needs to draw at a word; ``open``
    is the total without the end."""
    total = F.sum(weight)
    ends = F.sum(F.when(F.col("w2") == tx.END, F.col(weight)).otherwise(0))
    return counts.groupBy(F.col("w1").alias("cur")).agg(
        F.count("*").alias("n"),
        total.alias("tot"),
        (total - ends).alias("open"),
        part_width(total, F.count("*"), everything).alias("width"),
    )


def step_table(intervals: DataFrame, totals: DataFrame, everything: Column) -> DataFrame:
    """The table paths step on: (w1, bucket, lo, hi, nxt, nxt_tot, nxt_open,
    nxt_width).

    Each row already carries the totals of the word it leads to, so a step
    needs one join only. The end leads nowhere: its rows, one for most words,
    are spread by their first word instead of meeting in one task.
    """
    salt = F.when(F.col("w2") == tx.END, F.xxhash64("w1")).otherwise(F.lit(0).cast("long"))
    ahead = totals.select(
        F.col("cur").alias("w2"),
        F.lit(0).cast("long").alias("_salt"),
        F.col("tot").alias("nxt_tot"),
        F.col("open").alias("nxt_open"),
        F.col("width").alias("nxt_width"),
    )
    return (
        bucketed(intervals, everything)
        .select("w1", "bucket", "lo", "hi", "w2", salt.alias("_salt"))
        .join(ahead, ["w2", "_salt"], "left")
        .select("w1", "bucket", "lo", "hi", F.col("w2").alias("nxt"), "nxt_tot", "nxt_open", "nxt_width")
    )


AHEAD = ("nxt", "nxt_tot", "nxt_open", "nxt_width")


def packed(rows: DataFrame) -> DataFrame:
    """(w1, bucket, upto, ahead): the rows of a ``step_table`` that share a
    word and part as one row.

    ``upto`` holds the upper ends of their intervals in order, which are the
    running sums of the weights, ``ahead`` where they lead. A part has about
    ``BUCKET_ROWS`` rows, and never more than it is wide.
    """
    entry = F.struct("hi", *AHEAD)
    gathered = rows.groupBy("w1", "bucket").agg(F.sort_array(F.collect_list(entry)).alias("_rows"))
    return gathered.select(
        "w1",
        "bucket",
        F.transform("_rows", lambda r: r["hi"]).alias("upto"),
        F.transform("_rows", lambda r: F.struct(*[r[c].alias(c) for c in AHEAD])).alias("ahead"),
    )


# The most rows of a part that a draw can tell apart, as a number of bits.
SEARCHED_BITS = 26


def drawn_place(upto: Column, draw: Column) -> Column:
    """The place of the first of the ascending ``upto`` that is above the
    draw, by binary search inside the row."""
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(SEARCHED_BITS))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get(upto, at + step - 1) <= draw, at + step).otherwise(at),
    )


def with_temperature(counts: DataFrame, temperature: float) -> DataFrame:
    """Adds ``weight``: the count relative to the word's most frequent
    successor, to the power 1/T, on an integer scale. T below 1 sharpens,
    above 1 flattens.

    The best successor always has the full weight of one billion, so a cold
    walk follows it; one whose weight is below half a billionth is never drawn
    and leaves. ``counts`` is read twice and should be stored. The best counts, one
    row per word, are looked up in a table of each task, so no pairs are sorted.
    """
    if temperature < 1e-3:
        raise ValueError("the temperature has to be at least 1e-3")
    best = cut(counts.groupBy("w1").agg(F.max("cnt").alias("_best")))
    relative = F.col("cnt") / F.col("_best")
    scaled = F.round(F.pow(relative, F.lit(1.0 / temperature)) * F.lit(1e9)).cast("long")
    weighted = counts.join(best.hint("shuffle_hash"), "w1").select(*counts.columns, scaled.alias("weight"))
    return weighted.where(F.col("weight") > 0)


def enumerate_paths(counts: DataFrame, ends: DataFrame, steps: int) -> DataFrame:
    """All paths that reach the given pairs, extended backwards.

    ``ends`` is a frame like ``counts``; each step joins the path's first word
    with the pairs leading to it. Equal paths are one row with their
    ``multiplicity``. The result is as large as the number of paths.
    """
    paths = ends.select(
        F.array("w1", "w2").alias("words"),
        F.col("w1").alias("head"),
        F.col("cnt").alias("multiplicity"),
    )
    back = counts.select(F.col("w1").alias("before"), F.col("w2").alias("head"), "cnt")
    for _ in range(steps):
        paths = paths.join(back, "head").select(
            F.array_prepend("words", F.col("before")).alias("words"),
            F.col("before").alias("head"),
            (F.col("multiplicity") * F.col("cnt")).alias("multiplicity"),
        )
    return paths.select("words", "multiplicity")


def heaviest_paths(counts: DataFrame, ends: DataFrame, steps: int, k: int) -> DataFrame:
    """(words, rank, multiplicity): of each first word the ``k`` paths with the
    largest multiplicity that reach the given pairs in ``steps`` more steps back;
    equal ones in the order of their words.

    The best paths from a word go on with best paths of the next, so a word keeps
    ``k`` back-pointers per step (next word and its rank) and no path is listed
    before the last step; the words are then read off the pointers. ``ends`` is a
    frame like ``counts``. Multiplicities are DECIMAL(38,0); larger ones raise an error.

    A path that is not the best of its next word comes after the best one. So the ``k``
    best next words are found first, by their best paths, and only they are tried with
    the others. ``counts`` is read more than once and should be stored.
    """
    exact = "decimal(38,0)"
    spark = counts.sparkSession

    def best(candidates: DataFrame, *order: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("head").orderBy(F.col("multiplicity").desc(), *order))
        return candidates.withColumn("rank", place).where(F.col("rank") <= k)

    with Scratch(spark) as scratch:
        going = scratch.colocated(
            counts.select(F.col("w1").alias("head"), F.col("w2").alias("nxt"), "cnt"), counts.count(), "nxt"
        )
        last = ends.select(
            F.col("w1").alias("head"), F.col("w2").alias("nxt"), F.lit(0).alias("nxt_rank"), F.col("cnt").cast(exact).alias("multiplicity")
        )
        levels = [scratch.keep(best(last, F.col("nxt"), F.col("nxt_rank")))]
        reached = (F.col("cnt") * F.col("_ahead")).cast(exact)
        for _ in range(steps):
            ahead = levels[-1].select(
                F.col("head").alias("nxt"), F.col("rank").alias("nxt_rank"), F.col("multiplicity").alias("_ahead")
            )
            first = ahead.where(F.col("nxt_rank") == 1).drop("nxt_rank")
            tried = going.join(first, "nxt").select("head", "nxt", "cnt", reached.alias("multiplicity"))
            chosen = scratch.keep(best(tried, F.col("nxt")).select("head", "nxt", "cnt"))
            longer = chosen.join(ahead, "nxt").select("head", "nxt", "nxt_rank", reached.alias("multiplicity"))
            levels.append(scratch.keep(best(longer, F.col("nxt"), F.col("nxt_rank")), instead_of=chosen))
        paths = levels[-1].select(
            F.array("head", "nxt").alias("words"), "rank", "multiplicity", F.col("nxt").alias("_at"), F.col("nxt_rank").alias("_rank")
        )
        for level in reversed(levels[:-1]):
            back = level.select(F.col("head").alias("_at"), F.col("rank").alias("_rank"), F.col("nxt").alias("_to"), F.col("nxt_rank").alias("_to_rank"))
            longer = paths.join(back, ["_at", "_rank"]).select(
                F.array_append("words", F.col("_to")).alias("words"),
                "rank",
                "multiplicity",
                F.col("_to").alias("_at"),
                F.col("_to_rank").alias("_rank"),
            )
            paths = scratch.keep(longer, instead_of=paths)
        return cut(paths.select("words", "rank", "multiplicity"))


def path_counts(counts: DataFrame, steps: int) -> DataFrame:
    """(w1, paths): how many paths of ``steps`` transitions start at a word,
    with multiplicity.

    Counts flow back along the transitions, so no path is ever listed. Exact
    as DECIMAL(38,0); more paths than it can hold raise an error.
    """
    exact = "decimal(38,0)"
    # A path that has ended does not go on, so the end has no totals to join.
    going = counts.where(F.col("w2") != tx.END)
    totals = counts.groupBy("w1").agg(F.sum("cnt").cast(exact).alias("paths"))
    for _ in range(steps - 1):
        ahead = totals.select(F.col("w1").alias("w2"), F.col("paths").alias("_ahead"))
        totals = (
            going.join(ahead, "w2")
            .groupBy("w1")
            .agg(F.sum((F.col("cnt") * F.col("_ahead")).cast(exact)).cast(exact).alias("paths"))
        )
    return totals
