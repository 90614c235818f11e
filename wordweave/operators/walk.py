"""Generators: all paths advance together, one join per step.

A path is a row (path_id, words, cur, tot, width, ...). ``cur`` is the word
the next transition leaves from, ``tot``, ``open`` and ``width`` belong to it.
A path that cannot go on has a NULL ``tot`` and takes no part in the joins.

What a walk writes lies in a scratch folder that is deleted at its end; only
its result stays, as a checkpoint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordweave.functions import seeded
from wordweave.functions import text as tx
from wordweave.operators import transitions as tr
from wordweave.operators.sampling import keep_about, weighted_picks
from wordweave.session import Scratch, cut


# Up to so many paths are sent to the stored table; more are shuffled to it.
SENT = 50_000

# Up to so many paths meet few rows, and no table is laid out for them.
FEW = 5_000

# Leading digits of the digest that tell the shards of a word's successors.
SHARD_DIGITS = 3


class Chain:
    """Weighted transitions (w1, w2, weight), stored so that steps join them
    in place, for as long as ``scratch`` lives. ``counts`` should be stored.

    The table has one row per word and part, with an array of running sums. A
    draw meets one row and finds its successor in it by binary search, so a step
    joins as many rows as there are paths."""

    def __init__(self, counts: DataFrame, scratch: Scratch, weight: str = "cnt"):
        rows, total = counts.agg(F.count("*"), F.sum(weight)).first()
        everything = F.lit(total or 1)
        totals = scratch.keep(tr.word_totals(counts, everything, weight))
        self.totals = totals.drop("n")
        intervals = tr.with_intervals(counts, weight, totals.select(F.col("cur").alias("w1"), "n"))
        self.table = scratch.colocated(
            tr.step_table(intervals, self.totals, everything), rows, "w1", "bucket", gathered=tr.packed
        )

    def enter(self, paths: DataFrame) -> DataFrame:
        """Adds tot, open and width of the current word."""
        return paths.join(self.totals, "cur", "left")

    def step(self, paths: DataFrame, size: int, seed, step: Column | int, early: bool = False) -> DataFrame:
        """Adds nxt, nxt_tot, nxt_open and nxt_width: one successor per path,
        drawn in proportion to its count; NULL where the path cannot go on.
        ``early`` draws do not meet the end. ``size`` is a bound on the number
        of paths, which should be stored."""
        moved = self.moves(paths, size, seed, step, early)
        types = dict(moved.dtypes)
        nothing = [F.lit(None).cast(types[c]).alias(c) for c in tr.AHEAD]
        stays = F.coalesce(F.col("open" if early else "tot"), F.lit(0)) <= 0
        return moved.unionByName(paths.where(stays).select("*", *nothing))

    def moves(self, paths: DataFrame, size: int, seed, step: Column | int, early: bool = False) -> DataFrame:
        """The paths that can go on, with their successors."""
        total = F.col("open" if early else "tot")
        drawn = (
            paths.where(F.coalesce(total, F.lit(0)) > 0)
            .withColumn("_d", seeded.draw(seed, F.col("path_id"), step) % total)
            .withColumn("_at", F.expr("_d div width"))
        )
        meets = (F.col("cur") == F.col("w1")) & (F.col("_at") == F.col("bucket"))
        drawn = F.broadcast(drawn) if size <= SENT else drawn
        met = self.table.join(drawn, meets)
        found = met.withColumn("_to", F.get("ahead", tr.drawn_place(F.col("upto"), F.col("_d"))))
        return found.select(*paths.columns, *[F.col("_to")[c].alias(c) for c in tr.AHEAD])


class FewDraws(Chain):
    """The same draws for few paths, without a table of all transitions.

    Successors of a word lie in the order of ``with_intervals``, told apart in
    shards by the first digits. The sums of the shards are made for words that
    paths reach; a draw finds its shard among them, and only the rows of that shard
    are laid out. Each step reads ``counts`` twice, and nothing but the sums and
    those rows is sent anywhere."""

    def __init__(self, counts: DataFrame, scratch: Scratch, weight: str = "cnt"):
        self.scratch, self.weight = scratch, weight
        self.counts = counts.select("w1", "w2", F.col(weight).alias("_weight"))
        self.shards: DataFrame | None = None

    def _of(self, words: DataFrame) -> DataFrame:
        """The transitions of ``words`` (w1), with their order and shard."""
        order = F.when(F.col("w2") == tx.END, "~").otherwise(seeded.digest(F.col("w2")))
        rows = self.counts.join(F.broadcast(words), "w1", "left_semi").withColumn("_order", order)
        return rows.withColumn("_shard", F.substring("_order", 1, SHARD_DIGITS))

    def _reach(self, words: DataFrame) -> DataFrame:
        """(cur, tot, open, width) of ``words`` (w1), whose shards are known from
        now on."""
        words = words.distinct()
        new = words if self.shards is None else words.join(self.shards.select("w1").distinct(), "w1", "left_anti")
        made = self.scratch.keep(self._of(new).groupBy("w1", "_shard").agg(F.sum("_weight").alias("_sum")))
        # One table, so that the plan of a step does not grow with the steps before.
        self.shards = made if self.shards is None else self.scratch.keep(self.shards.unionByName(made))
        ends = F.when(F.col("_shard") == "~", F.col("_sum")).otherwise(0)
        return (
            self.shards.join(words, "w1", "left_semi")
            .groupBy(F.col("w1").alias("cur"))
            .agg(F.sum("_sum").alias("tot"), F.sum(F.col("_sum") - ends).alias("open"))
            .withColumn("width", F.lit(1).cast("long"))
        )

    def enter(self, paths: DataFrame) -> DataFrame:
        paths = self.scratch.keep(paths)
        return paths.join(self._reach(paths.select(F.col("cur").alias("w1"))), "cur", "left")

    def moves(self, paths: DataFrame, size: int, seed, step: Column | int, early: bool = False) -> DataFrame:
        total = F.col("open" if early else "tot")
        upto = (Window.unboundedPreceding, Window.currentRow)
        drawn = paths.where(F.coalesce(total, F.lit(0)) > 0).withColumn(
            "_d", seeded.draw(seed, F.col("path_id"), step) % total
        )
        before = F.sum("_sum").over(Window.partitionBy("w1").orderBy("_shard").rowsBetween(*upto)) - F.col("_sum")
        shards = self.shards.join(drawn.select(F.col("cur").alias("w1")).distinct(), "w1", "left_semi")
        inside = (F.col("_d") >= F.col("_before")) & (F.col("_d") < F.col("_before") + F.col("_sum"))
        met = self.scratch.keep(
            drawn.join(shards.withColumn("_before", before), (F.col("cur") == F.col("w1")) & inside).select(
                *paths.columns, "_shard", (F.col("_d") - F.col("_before")).alias("_d")
            )
        )
        wanted = met.select(F.col("cur").alias("w1"), "_shard").distinct()
        group = Window.partitionBy("w1", "_shard").orderBy("_order", "w2").rowsBetween(*upto)
        rows = self._of(wanted.select("w1").distinct()).join(F.broadcast(wanted), ["w1", "_shard"], "left_semi")
        laid = rows.withColumn("_hi", F.sum("_weight").over(group)).select(
            F.col("w1").alias("cur"), "_shard", F.col("w2").alias("nxt"), "_hi", (F.col("_hi") - F.col("_weight")).alias("_lo")
        )
        found = self.scratch.keep(
            met.join(laid, ["cur", "_shard"])
            .where((F.col("_d") >= F.col("_lo")) & (F.col("_d") < F.col("_hi")))
            .select(*paths.columns, "nxt")
        )
        ahead = self._reach(found.select(F.col("nxt").alias("w1"))).toDF(*tr.AHEAD)
        return found.join(ahead, "nxt", "left").select(*paths.columns, *tr.AHEAD)


def chain_for(size: int, counts: DataFrame, scratch: Scratch, weight: str = "cnt") -> Chain:
    """The transitions for ``size`` paths at most; the draws are the same."""
    return (FewDraws if size <= min(FEW, SENT) else Chain)(counts, scratch, weight)


def _advance(
    paths: DataFrame, size: int, chain: Chain, scratch: Scratch, steps: range, seed, move, early: bool = False
) -> DataFrame:
    """Walk, writing the paths out after each step: the plan of a step stays
    small and a lost executor repeats one step at most."""
    paths = scratch.keep(paths)
    for step in steps:
        paths = scratch.keep(move(chain.step(paths, size, seed, step, early)), instead_of=paths)
    return paths


def _moved(paths: DataFrame, words: Column, rest: dict[str, Column] | None = None) -> DataFrame:
    """Follow the drawn successor. A path without one takes its columns from
    ``rest``, by default its own."""
    goes = F.col("nxt").isNotNull()
    rest = rest or {c: F.col(c) for c in ("words", "cur", "tot", "open", "width")}
    ahead = {
        "words": words,
        "cur": F.col("nxt"),
        "tot": F.col("nxt_tot"),
        "open": F.col("nxt_open"),
        "width": F.col("nxt_width"),
    }
    kept = [c for c in paths.columns if c not in ahead and not c.startswith("nxt")]
    return paths.select(
        *kept, *(F.when(goes, to).otherwise(rest[c]).alias(c) for c, to in ahead.items())
    )


def _emit_current(paths: DataFrame) -> DataFrame:
    """Append the current word and go on."""
    return _moved(paths, F.array_append("words", F.col("cur")))


def _append_next(paths: DataFrame) -> DataFrame:
    """Append the drawn word."""
    return _moved(paths, F.array_append("words", F.col("nxt")))


def _restart(paths: DataFrame) -> DataFrame:
    """Like ``_emit_current``, but a path without successor goes back to its
    start; the step is spent."""
    start = {
        "words": F.array("start_word"),
        "cur": F.col("start_cur"),
        "tot": F.col("start_tot"),
        "open": F.col("start_open"),
        "width": F.col("start_width"),
    }
    return _moved(paths, F.array_append("words", F.col("cur")), start)


def sequential(
    lines: DataFrame, entries: int, max_length: int, min_length: int = 0, seed: int = 0
) -> DataFrame:
    """(path_id, sentence): independent sentences of at most max_length + 1
    words.

    A sentence starts with an occurrence of a start pair; each step emits the
    pending word and draws the next. One that meets the end gets a period; one
    that runs out of steps drops its pending word. During the first
    ``min_length`` steps the end is not drawn, and a word with no other
    successor sends the path back to its start.
    """
    with Scratch(lines.sparkSession) as scratch:
        counts = scratch.keep(tr.pair_counts(tr.sentence_pairs(lines)))
        picked = weighted_picks(tr.sequential_starts(counts), ["w1", "w2"], entries, seed)
        chain = chain_for(entries, counts, scratch)
        paths = chain.enter(
            picked.select("path_id", F.array("w1").alias("words"), F.col("w2").alias("cur"), F.col("w1").alias("start_word"))
        ).select("*", *[F.col(c).alias(f"start_{c}") for c in ("cur", "tot", "open", "width")])
        early = min(min_length, max_length)
        paths = _advance(paths, entries, chain, scratch, range(early), seed, _restart, early=True)
        paths = _advance(paths, entries, chain, scratch, range(early, max_length), seed, _emit_current)
        return cut(
            paths.select(
                "path_id", tx.to_sentence(F.col("words"), F.col("cur") == tx.END).alias("sentence")
            )
        )


def _population(lines: DataFrame, keys: list[str], counts: DataFrame, target: int, seed) -> DataFrame:
    """Start paths: each occurrence of a start pair is kept with probability
    target / number of occurrences."""
    places = tr.sentence_pairs_with_place(lines, keys)
    starts = tr.population_starts(places).withColumn("path_id", F.concat_ws("-", *keys, "pos"))
    size = tr.population_starts(counts).agg(F.sum("cnt")).scalar()
    return starts.where(keep_about(size, target, seed, F.col("path_id"))).select(
        "path_id", F.array("w1", "w2").alias("words"), F.col("w2").alias("cur")
    )


def _without_end(words: Column) -> Column:
    return F.filter(words, lambda w: w != tx.END)


def population(
    lines: DataFrame,
    keys: list[str],
    min_entries: int,
    min_length: int,
    max_length: int,
    start_entries: int = 1000,
    seed: int = 0,
) -> DataFrame:
    """(path_id, n_words, sentence, done): a sampled population walks at once.

    After each step a population above ``start_entries`` is sampled down to
    it, and finished paths leave from step ``min_length`` on (finished earlier
    they are lost). The walk stops when fewer paths live than entries are
    still wanted; the paths of the last step are returned too.
    """
    finished = F.col("cur") == tx.END
    with Scratch(lines.sparkSession) as scratch:
        counts = scratch.keep(tr.pair_counts(tr.sentence_pairs(lines)))
        starts = scratch.keep(_population(lines, keys, counts, start_entries, seed))
        size = starts.count()
        chain = chain_for(size, counts, scratch)
        wanted, emitted = min_entries, []
        last = live = scratch.keep(chain.enter(starts))
        for step in range(max_length):
            moved = chain.step(live, size, seed, step).where(F.col("nxt").isNotNull())
            last = scratch.keep(_append_next(moved))
            size = last.count()
            if size > start_entries:
                kept = keep_about(F.lit(size), start_entries, seed, F.col("path_id"), step, "cap")
                last = last.where(kept)
            if step >= min_length:
                out = last.where(finished)
                emitted.append(out)
                wanted -= out.count()
                last = last.where(~finished)
            if size < wanted:
                break
            live = last.where(~finished)
        everything = reduce(DataFrame.unionByName, [*emitted, last])
        words = _without_end(F.col("words"))
        return cut(
            everything.select(
                "path_id",
                F.size(words).cast("long").alias("n_words"),
                tx.to_sentence(words, finished).alias("sentence"),
                finished.alias("done"),
            )
        )


def collapsing(
    lines: DataFrame, keys: list[str], entries: int, max_length: int, seed: int = 0
) -> DataFrame:
    """(path_id, sentence): per step one path survives at each current word.

    Returned paths have max_length + 2 tokens, the last of which may be the
    end; shorter ones are gone. The survivor is chosen before it moves: a
    uniform path at the word, then a successor by count.
    """
    with Scratch(lines.sparkSession) as scratch:
        counts = scratch.keep(tr.pair_counts(tr.sentence_pairs(lines)))
        starts = scratch.keep(_population(lines, keys, counts, entries, seed))
        size = starts.count()
        chain = chain_for(size, counts, scratch)
        paths = scratch.keep(chain.enter(starts))
        for step in range(max_length):
            rank = F.struct(seeded.digest(seed, F.col("path_id"), step, "keep"), F.col("path_id"))
            survivors = (
                paths.where(F.col("tot").isNotNull())
                .groupBy("cur")
                .agg(F.min_by(F.struct(*paths.columns), rank).alias("_p"))
                .select("_p.*")
            )
            # All survivors can go on, so a step is one read and one write.
            moved = chain.moves(survivors, size, seed, step)
            paths = scratch.keep(_append_next(moved), instead_of=paths)
        return cut(
            paths.select(
                "path_id",
                tx.to_sentence(_without_end(F.col("words")), F.col("cur") == tx.END).alias("sentence"),
            )
        )


def flat(
    pair_counts: DataFrame,
    unit_counts: DataFrame,
    entries: int,
    length: int,
    seed: int = 0,
    weight: str = "cnt",
) -> DataFrame:
    """(path_id, words): chains over the flat sequence.

    The start is drawn from the units by their frequency (``word``, ``cnt``),
    then up to ``length`` more follow; a chain ends early only at a unit
    without successor.
    """
    with Scratch(pair_counts.sparkSession) as scratch:
        starts = weighted_picks(scratch.keep(unit_counts), ["word"], entries, seed)
        chain = chain_for(entries, scratch.keep(pair_counts), scratch, weight)
        paths = chain.enter(
            starts.select("path_id", F.array("word").alias("words"), F.col("word").alias("cur"))
        )
        walked = _advance(paths, entries, chain, scratch, range(length), seed, _append_next)
        return cut(walked.select("path_id", "words"))
