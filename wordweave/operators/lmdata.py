"""Token sequences laid out for language-model training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordweave.operators import sequence as sq
from wordweave.session import cut

# Number of most frequent words whose ids are broadcast: some megabytes.
FREQUENT = 100_000


def word_counts(sequence: DataFrame) -> DataFrame:
    return (
        sq.exploded(sequence)
        .groupBy("word")
        .agg(F.count("*").alias("cnt"))
    )


def vocabulary(counts: DataFrame) -> DataFrame:
    """(token_id, word, cnt): ids count up from 0 by falling frequency, then
    by word.

    The sorted table is written once. Its partitions follow each other, so an
    id is the row number in the partition plus the sizes of the partitions
    before; only one row per partition is summed up.
    """
    ordered = cut(counts.orderBy(F.desc("cnt"), F.asc("word")))
    numbered = ordered.withColumn("_at", F.monotonically_increasing_id()).select(
        "*",
        F.shiftright("_at", 33).alias("_part"),
        F.col("_at").bitwiseAND((1 << 33) - 1).alias("_row"),
    )
    parts = numbered.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = parts.select(
        "_part",
        (F.sum("_rows").over(Window.orderBy("_part").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)) - F.col("_rows")).alias("_before"),
    )
    return numbered.join(before, "_part").select(
        (F.col("_row") + F.col("_before")).alias("token_id"), "word", "cnt"
    )


def _ids(vocab: DataFrame, word: str, name: str) -> DataFrame:
    return vocab.select(F.col("word").alias(word), F.col("token_id").alias(name))


def _frequent(vocab: DataFrame, word: str, name: str) -> DataFrame:
    """(word, name) of the words whose ids are broadcast."""
    return F.broadcast(_ids(vocab, word, name).where(F.col(name) < FREQUENT))


def with_ids(frame: DataFrame, vocab: DataFrame, word: str, name: str) -> DataFrame:
    """Replace a word column by its token ids.

    Ids are frequency ranks, so the first ``FREQUENT`` ids are a table of
    known size that may be broadcast, and they cover every word that could be
    hot: a word of a later rank holds at most 1/``FREQUENT`` of all rows and
    is safe to join by shuffle.
    """
    probed = frame.join(_frequent(vocab, word, "_known"), word, "left")
    # Known rows take no part in the second join: their salt matches nothing
    # and spreads them, so the frame is read once and no word is hot. They leave
    # their word behind, so the shuffle carries it for rare words only.
    place = F.pmod(F.xxhash64(*frame.columns), F.lit(1 << 20)) + 1
    salted = probed.select(
        *[c for c in frame.columns if c != word],
        F.when(F.col("_known").isNull(), F.col(word)).alias(word),
        F.col("_known"),
        F.when(F.col("_known").isNull(), F.lit(0)).otherwise(place).cast("int").alias("_salt"),
    )
    rare = _ids(vocab, word, "_id").where(F.col("_id") >= FREQUENT).withColumn("_salt", F.lit(0))
    found = salted.join(rare, [word, "_salt"], "left").withColumn(name, F.coalesce("_known", "_id"))
    return found.where(F.col(name).isNotNull()).drop(word, "_known", "_id", "_salt")


def batchify(sequence: DataFrame, keys: Sequence[str], vocab: DataFrame, columns: int) -> DataFrame:
    """(batch_col, row, token_id): the sequence cut into equal contiguous
    columns; the rest is dropped."""
    outline = sq.outlines(sequence, keys)
    index = sq.word_index(sequence, keys, outline)
    height = F.expr("_n div _columns")
    placed = (
        index.withColumn("_n", F.lit(sq.length(outline)).cast("long"))
        .withColumn("_columns", F.lit(columns).cast("long"))
        .withColumn("_height", height)
        .where(F.col("pos") < F.col("_height") * F.col("_columns"))
        .withColumn("batch_col", F.expr("pos div _height"))
        .withColumn("row", F.col("pos") % F.col("_height"))
    )
    return with_ids(placed.select("batch_col", "row", "word"), vocab, "word", "token_id")


def windows(
    sequence: DataFrame, keys: Sequence[str], vocab: DataFrame, columns: int, length: int
) -> DataFrame:
    """(batch_col, window, pos, token_id, target_id): inputs and targets one
    step ahead, in windows of ``length`` rows; the last may be shorter.

    The target is the next word of the sequence, known inside the unit's own
    row, so no column of the batch is ever gathered and sorted. Rows of two frequent
    words, which are most, are not shuffled for their ids.
    """
    outline = sq.outlines(sequence, keys)
    height = F.lit(sq.length(outline) // columns).cast("long")
    pairs = sq.indexed_pairs(sequence, keys, outline).withColumnRenamed("pos", "_pos")
    placed = (
        pairs.withColumn("_height", height)
        .where(F.col("_pos") < F.col("_height") * F.lit(columns).cast("long"))
        .where(F.col("_pos") % F.col("_height") < F.col("_height") - 1)
    )
    # A word needs nothing but its position until the ids are known.
    probed = (
        placed.select("_pos", "w1", "w2")
        .join(_frequent(vocab, "w1", "token_id"), "w1", "left")
        .join(_frequent(vocab, "w2", "target_id"), "w2", "left")
    )
    both = F.col("token_id").isNotNull() & F.col("target_id").isNotNull()
    rare = with_ids(probed.where(~both).select("_pos", "w1", "w2"), vocab, "w1", "token_id")
    found = probed.where(both).select("_pos", "token_id", "target_id").unionByName(
        with_ids(rare, vocab, "w2", "target_id")
    )
    return (
        found.withColumn("_height", height)
        .withColumn("batch_col", F.expr("_pos div _height"))
        .withColumn("_row", F.col("_pos") % F.col("_height"))
        .withColumn("window", F.expr(f"_row div {length}L"))
        .withColumn("pos", F.col("_row") % F.lit(length).cast("long"))
        .select("batch_col", "window", "pos", "token_id", "target_id")
    )


def in_rows_of(paths: DataFrame, per_line: int = 20) -> DataFrame:
    """(path_id, line_no, text): generated words, ``per_line`` to a line."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("words") - 1) / per_line).cast("int")),
        lambda i: F.array_join(F.slice("words", i * per_line + 1, F.lit(per_line)), " "),
    )
    return paths.select("path_id", F.posexplode(pieces).alias("line_no", "text"))
