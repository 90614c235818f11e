"""A next-word model of variable order: interpolated Kneser-Ney smoothing.

A gram is a context of up to ``order - 1`` words and the word that follows; a
unit begins with the mark START, which is a context and never follows. Grams of the
highest order, and those that begin with START, count occurrences; the others count
in how many different words they go back, which is the number of longer grams that
end with them. Three discounts per order come from the counts of counts. What a
context loses by them is its back-off weight, given to the same word after the
shorter context.

Everything is a join or a sum by gram or by context. A level is made from the
distinct grams of the level above, so the texts are read once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordweave.functions import seeded
from wordweave.operators.walk import FEW, chain_for
from wordweave.session import Scratch, cut

# A tab is no part of a word.
START = "\t"

# The key of a draw from all words; no context is a line break.
ANY = "\n"

# Weights of a draw are discounted counts in units of 2^-20.
SCALE = 1 << 20

Keep = Callable[[DataFrame], DataFrame]


def shorter(context: Column) -> Column:
    """A context without its first word."""
    at = F.instr(context, " ")
    return F.when(at > 0, F.substring(context, at + 1, F.length(context))).otherwise("")


def full_grams(units: DataFrame, order: int, *others: str) -> DataFrame:
    """(others..., n, ctx, w): each word of the units (column ``items``) with
    the longest context the order allows; ``n`` is the length of the gram."""
    # Nothing stands before START, so every word ends one window of ``order`` places
    # and the windows are slices side by side. Joining leaves empty places out.
    before = F.array(*[F.lit(None).cast("string")] * (order - 2), F.lit(START))
    padded = units.select(*others, F.inline(F.array(F.struct(F.concat(before, "items").alias("_p")))))
    count = F.greatest(F.size("_p") - (order - 1), F.lit(0))
    places = [f"_w{k}" for k in range(1, order)]
    window = F.arrays_zip(
        *[F.slice("_p", F.lit(k + 1), count).alias(name) for k, name in enumerate([*places, "w"])]
    )
    length = sum((F.col(name).isNotNull().cast("int") for name in places), F.lit(1))
    return padded.select(*others, F.inline(window)).select(
        *others, length.alias("n"), F.concat_ws(" ", *places).alias("ctx"), "w"
    )


def _every(by_order: dict[int, DataFrame]) -> DataFrame:
    """The frames of all orders as one, with their order ``n``."""
    frames = [f.select(F.lit(n).alias("n"), *[c for c in f.columns if c != "n"]) for n, f in sorted(by_order.items())]
    joined = frames[0]
    for frame in frames[1:]:
        joined = joined.unionByName(frame)
    return joined


@dataclass
class Model:
    """``levels`` (ctx, w, c) and ``weights`` (ctx, tot, gamma) by order n, the
    number of words and the discounts by order.

    Probabilities follow from the counts. They are made where they are asked for:
    ``probabilities`` of chosen grams, ``grams`` of all."""

    order: int
    levels: dict[int, DataFrame]
    weights: dict[int, DataFrame]
    words: int
    discounts: dict[int, tuple[float, float, float]]

    @property
    def unseen(self) -> float:
        """The probability below order one: words not seen count as one."""
        return 1.0 / (self.words + 1)

    @property
    def counts(self) -> DataFrame:
        """(n, ctx, w, c) of each gram."""
        return _every(self.levels)

    @property
    def contexts(self) -> DataFrame:
        """(n, ctx, tot, gamma) of each context."""
        return _every(self.weights)

    @property
    def grams(self) -> DataFrame:
        """(n, ctx, w, c, p) of each gram."""
        below, grams = None, {}
        for n in range(1, self.order + 1):
            kept = (F.col("c") - _discount(F.col("c"), self.discounts[n])) / F.col("tot")
            if below is None:
                # One context: its two numbers are literals.
                tot, gamma = self.weights[1].select("tot", "gamma").first() or (1, 0.0)
                made = self.levels[1].withColumn("tot", F.lit(tot)).select(
                    "ctx", "w", "c", (kept + F.lit(gamma * self.unseen)).alias("p")
                )
            else:
                back = below.select(F.col("ctx").alias("_short"), "w", F.col("p").alias("_below"))
                made = (
                    self.levels[n]
                    .join(self.weights[n], "ctx")
                    .withColumn("_short", shorter(F.col("ctx")))
                    .join(back, ["_short", "w"])
                    .select("ctx", "w", "c", (kept + F.col("gamma") * F.col("_below")).alias("p"))
                )
            grams[n] = below = made
        return _every(grams)


def _discounts(counts: Sequence[int]) -> tuple[float, float, float]:
    """From the numbers of grams counted once to four times. One discount
    serves for all where they do not allow three, a half where they are none."""
    n1, n2, n3, n4 = counts
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    share = n1 / (n1 + 2 * n2)
    if n3:
        three = 1 - 2 * share * n2 / n1, 2 - 3 * share * n3 / n2, 3 - 4 * share * n4 / n3
        if all(0 < d < k for k, d in enumerate(three, 1)):
            return three
    return share, share, share


def _discount(count: Column, discounts: tuple[float, float, float]) -> Column:
    return F.when(count == 1, discounts[0]).when(count == 2, discounts[1]).otherwise(discounts[2])


def train(units: DataFrame, order: int, keep: Keep = cut, keep_contexts: Keep | None = None) -> Model:
    """The model of units (column ``items``); units without words count for
    nothing. ``keep`` stores what is used more than once. The contexts are stored
    likewise, or by ``keep_contexts``; ``probabilities`` does not read them whole."""
    if order < 2:
        raise ValueError("the order has to be at least 2")
    full = keep(full_grams(units, order).groupBy("n", "ctx", "w").agg(F.count("*").alias("c")))
    levels = {order: full.where(F.col("n") == order).drop("n")}
    for n in range(order - 1, 0, -1):
        ends = levels[n + 1].groupBy(shorter(F.col("ctx")).alias("ctx"), "w").agg(F.count("*").alias("c"))
        levels[n] = keep(ends.unionByName(full.where(F.col("n") == n).drop("n")))
    discounts = {}
    for n, level in levels.items():
        row = level.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first()
        discounts[n] = _discounts([x or 0 for x in row])
    store = keep_contexts or keep
    contexts = {n: store(_weights(level, discounts[n])) for n, level in levels.items()}
    return Model(order, levels, contexts, levels[1].count(), discounts)


def _weights(level: DataFrame, discounts: tuple[float, float, float]) -> DataFrame:
    """(ctx, tot, gamma) of the contexts of grams (ctx, w, c) of one order."""
    lost = F.sum(_discount(F.col("c"), discounts))
    summed = level.groupBy("ctx").agg(F.sum("c").alias("tot"), lost.alias("_lost"))
    return summed.select("ctx", "tot", (F.col("_lost") / F.col("tot")).alias("gamma"))


# Bits of a bitmap for each key, and the most bits of all (a broadcast table of 2^20 rows).
KEY_BITS, MOST_BITS = 8, 1 << 26


def possible(frame: DataFrame, asked: DataFrame, *keys: str) -> DataFrame:
    """The rows of ``frame`` with keys that ``asked`` holds, and some others: a bitmap
    of bounded size leaves most others out before they are shuffled. A full one leaves
    out nothing. ``asked`` should be stored."""
    rows, bits = asked.count(), 1 << 12
    while bits < min(rows * KEY_BITS, MOST_BITS):
        bits *= 2
    place = F.xxhash64(*keys).bitwiseAND(F.lit(bits - 1).cast("long"))
    mark = F.expr("shiftleft(1L, int(_bit & 63))")
    marks = (
        asked.select(place.alias("_bit"))
        .groupBy(F.shiftright("_bit", 6).alias("_word"))
        .agg(F.bit_or(mark).alias("_marks"))
    )
    tested = frame.withColumn("_bit", place).join(F.broadcast(marks), F.shiftright("_bit", 6) == F.col("_word"))
    return tested.where(F.col("_marks").bitwiseAND(mark) != 0).select(*frame.columns)


def _suffixes(frame: DataFrame, order: int) -> DataFrame:
    """Adds (n, _ctx): every shorter context of ``ctx`` and itself."""
    tokens = F.split("ctx", " ")
    size = F.when(F.col("ctx") == "", 0).otherwise(F.size(tokens))
    parts = F.transform(
        F.sequence(F.lit(0), size),
        lambda k: F.struct(
            (k + 1).alias("n"), F.array_join(F.slice(tokens, size - k + 1, k), " ").alias("_ctx")
        ),
    )
    return frame.select("*", F.inline(parts))


def probabilities(model: Model, grams: DataFrame) -> DataFrame:
    """(ctx, w, p) of each distinct row of ``grams`` (ctx, w).

    From order one up, a known context adds what it keeps for the word, if the gram
    is known, to its weight times the probability after the shorter context; an
    unknown one passes that on whole. All known grams end with known ones.

    Orders are made one after the other from what is asked of them, so grams and
    contexts that nobody asks for are hardly shuffled, and no order waits on disk for
    the next but for its asked grams.
    """
    spark = grams.sparkSession
    with Scratch(spark) as scratch:
        size = F.when(F.col("ctx") == "", 0).otherwise(F.size(F.split("ctx", " ")))
        given = scratch.keep(grams.select("ctx", "w").distinct().withColumn("_n", size + 1))
        deepest = given.agg(F.max("_n")).first()[0] or 1
        asked: dict[int, DataFrame] = {}
        for n in range(deepest, 0, -1):
            here = given.where(F.col("_n") == n).select("ctx", "w", F.lit(True).alias("_given"))
            if n < deepest:
                longer = asked[n + 1].select(shorter(F.col("ctx")).alias("ctx"), "w", F.lit(False).alias("_given"))
                here = here.unionByName(longer).groupBy("ctx", "w").agg(F.max("_given").alias("_given"))
            asked[n] = scratch.keep(here)
        made = {}
        for n in range(1, deepest + 1):
            found, level = asked[n], model.levels.get(n)
            if n == 1:
                # One context: its two numbers are literals.
                tot, gamma = model.weights[1].select("tot", "gamma").first() or (1, 1.0)
                counts = possible(level, found, "ctx", "w")
                found = found.join(counts, ["ctx", "w"], "left").withColumns(
                    {"tot": F.lit(tot), "gamma": F.lit(gamma), "_below": F.lit(model.unseen)}
                )
            else:
                if level is not None:
                    counts = possible(level, found, "ctx", "w")
                    weights = _weights(possible(level, found, "ctx"), model.discounts[n])
                    found = found.join(counts, ["ctx", "w"], "left").join(weights, "ctx", "left")
                below = made[n - 1].select(F.col("ctx").alias("_short"), "w", F.col("p").alias("_below"))
                found = found.withColumn("_short", shorter(F.col("ctx"))).join(below, ["_short", "w"])
            p = F.col("_below")
            if level is not None:
                kept = (F.col("c") - _discount(F.col("c"), model.discounts[n])) / F.col("tot")
                p = F.coalesce(kept, F.lit(0.0)) + p * F.coalesce("gamma", F.lit(1.0))
            made[n] = scratch.keep(found.select("ctx", "w", "_given", p.alias("p")), instead_of=asked[n])
        return cut(_every(made).where("_given").select("ctx", "w", "p"))


def perplexity(model: Model, units: DataFrame) -> DataFrame:
    """(n, loss, perplexity) of the model on the words of other units."""
    with Scratch(units.sparkSession) as scratch:
        test = scratch.keep(full_grams(units, model.order).groupBy("ctx", "w").agg(F.count("*").alias("b")))
        scored = test.join(probabilities(model, test), ["ctx", "w"])
        return cut(
            scored.agg(
                F.sum("b").alias("n"), (-F.sum(F.col("b") * F.log("p")) / F.sum("b")).alias("loss")
            ).select("n", "loss", F.exp("loss").alias("perplexity"))
        )


def _last(history: Column, words: Column) -> Column:
    """The last words of a history as a context."""
    return F.array_join(F.slice(history, F.size(history) - words + 1, words), " ")


def walk(model: Model, entries: int, length: int, seed: int = 0) -> DataFrame:
    """(path_id, words): chains of ``length`` words drawn from the model, each
    after a START of its own.

    The order of a draw is chosen first: from the longest context down, a known
    one is left with the probability of its back-off weight. The word is then
    drawn from the discounted counts of that context, below order one from all
    words evenly. Only what the contexts of a step lead to is laid out for it.
    Draws are hashes, so a repeated step gives the same words.
    """
    spark = model.grams.sparkSession
    history = F.col("history")
    with Scratch(spark) as scratch:
        start = F.array(F.lit(START)).alias("history")
        paths = scratch.keep(spark.range(entries if model.words else 0).select(F.col("id").alias("path_id"), start))
        every = model.levels[1].select("w")
        for step in range(length):
            longest = F.least(F.size(history), F.lit(model.order - 1))
            tried = _suffixes(paths.select("path_id", _last(history, longest).alias("ctx")), model.order)
            known = tried.select("path_id", "n", F.col("_ctx").alias("ctx")).join(model.contexts, ["n", "ctx"])
            chance = seeded.draw(seed, F.col("path_id"), F.lit(step), F.col("n")) / float(seeded.DRAW_RANGE)
            chosen = known.where(chance >= F.col("gamma")).groupBy("path_id").agg(F.max("n").alias("n"))
            here = _last(history, F.col("n") - 1)
            ready = scratch.keep(
                paths.join(chosen, "path_id", "left").select(
                    "path_id", "history", "n", F.when(F.col("n").isNull(), ANY).otherwise(here).alias("cur")
                )
            )
            met = ready.where(F.col("n").isNotNull()).select("n", F.col("cur").alias("ctx")).distinct()
            weight = F.lit(0.0)
            for n, discounts in model.discounts.items():
                weight = F.when(F.col("n") == n, F.col("c") - _discount(F.col("c"), discounts)).otherwise(weight)
            counts = model.counts.join(F.broadcast(met) if entries <= FEW else met, ["n", "ctx"], "left_semi").select(
                F.col("ctx").alias("w1"), F.col("w").alias("w2"), F.round(weight * SCALE).cast("long").alias("cnt")
            )
            if not ready.where(F.col("n").isNull()).isEmpty():
                counts = counts.unionByName(every.select(F.lit(ANY).alias("w1"), F.col("w").alias("w2"), F.lit(1).cast("long").alias("cnt")))
            chain = chain_for(entries, scratch.keep(counts.where(F.col("cnt") > 0)), scratch)
            at = scratch.keep(chain.enter(ready))
            moved = chain.step(at, entries, seed, step)
            paths = scratch.keep(
                moved.select("path_id", F.array_append("history", F.col("nxt")).alias("history")), instead_of=paths
            )
        return cut(paths.select("path_id", F.slice("history", 2, F.size("history")).alias("words")))
