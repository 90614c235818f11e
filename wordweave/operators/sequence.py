"""The corpus as one flat word sequence.

A *unit* is a row with key columns, which name it, and an array column
``items`` (the words or characters of a document or a line). The sequence lists
units by the digest of their whole key and then by key. Shards, told by the
leading digits of the digest, are even whatever the keys look like, also when
one document owns most lines; positions come from a window inside each shard
plus running sums over the shards. The number of shards follows the number of
rows, and the order does not depend on it.

With ``in_order`` the sequence lists units in the order of their keys instead, as
the corpus has them; shards are then ranges of the keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordweave.functions import seeded
from wordweave.functions import text as tx
from wordweave.session import cut


def units(frame: DataFrame, keys: Sequence[str], unit: str = "word", text: str = "text") -> DataFrame:
    """Key columns, ``digest`` (of the keys) and ``items``; texts
    without any item are left out.

    They are told by the text itself. A filter on ``items`` would be moved
    below the split and split every text a second time.
    """
    if unit not in ("word", "char"):
        raise ValueError(f"unknown unit {unit!r}")
    content = F.col(text)
    split = tx.words if unit == "word" else tx.characters
    filled = tx.has_word(content) if unit == "word" else content != ""
    return frame.where(filled).select(
        *keys, seeded.digest(*[F.col(k) for k in keys]).alias("digest"), split(content).alias("items")
    )


def exploded(sequence: DataFrame, *keys: str) -> DataFrame:
    """(keys..., i, word), one row per item."""
    # The zipped array keeps the optimizer from adding a filter on ``items``.
    return sequence.select(
        *keys, F.posexplode(F.arrays_zip(F.col("items").alias("word"))).alias("i", "_item")
    ).select(*keys, "i", "_item.word")


# Rows of a shard, about.
SHARD_ROWS = 20_000


def _across(shards: DataFrame, upper: Column) -> DataFrame:
    """(_shard, _before, _next) from (_shard, _total, _first): the sum before a
    shard and the first row of the next.

    ``upper`` names groups of neighbouring shards, about as many as a group has
    members. Sums are made inside the groups and then over the groups, so that
    no task holds more rows than about the square root of their number.
    """
    upto = (Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("_upper").orderBy("_shard")
    grouped = shards.withColumn("_upper", upper)
    tops = Window.orderBy("_upper")
    before = (
        grouped.groupBy("_upper")
        .agg(F.sum("_total").alias("_sum"), F.min_by("_first", "_shard").alias("_head"))
        .select(
            "_upper",
            (F.sum("_sum").over(tops.rowsBetween(*upto)) - F.col("_sum")).alias("_base"),
            F.lead("_head").over(tops).alias("_next_group"),
        )
    )
    inside = grouped.select(
        "_shard",
        "_upper",
        (F.sum("_total").over(group.rowsBetween(*upto)) - F.col("_total")).alias("_offset"),
        F.lead("_first").over(group).alias("_next_shard"),
    )
    return inside.join(before, "_upper").select(
        "_shard",
        (F.col("_base") + F.col("_offset")).alias("_before"),
        F.coalesce("_next_shard", "_next_group").alias("_next"),
    )


def ranged(stored: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows in ranges of ``order``, stored with the number of their range as
    ``_shard``. Ranges follow samples of the rows; the order within and over them
    does not depend on where they are cut."""
    parts = max(1, -(-stored.count() // SHARD_ROWS))
    laid = stored.repartitionByRange(parts, *order).withColumn("_shard", F.spark_partition_id())
    return cut(laid)


def placed(
    stored: DataFrame, order: Sequence[str], size: str, head: str, in_order: bool = False
) -> DataFrame:
    """Adds ``start``, the sum of ``size`` over all rows before a row in
    (digest, order...) order, and ``following``, the head of the next row (NULL
    for the last). With ``in_order`` the digest plays no part.

    Both come from one sort inside the shards: digests with the same first
    digits, or ranges of the order. What lies beyond a shard is joined from a table
    of one row per shard. ``stored`` is read more than once.
    """
    if in_order:
        sized = ranged(stored, order)
        shards = sized.agg(F.max("_shard")).first()[0] or 0
        upper, by = F.floor(F.col("_shard") / ceil(sqrt(shards + 1))), list(order)
    else:
        digits = seeded.digits_for(stored.count(), SHARD_ROWS)
        sized = stored.withColumn("_shard", F.substring("digest", 1, digits))
        upper, by = F.substring("_shard", 1, digits // 2), ["digest", *order]
    inside = Window.partitionBy("_shard").orderBy(*by)
    upto = (Window.unboundedPreceding, Window.currentRow)
    shards = _across(
        sized.groupBy("_shard").agg(
            F.sum(size).cast("long").alias("_total"), F.min_by(head, F.struct(*by)).alias("_first")
        ),
        upper,
    )
    return (
        sized.withColumns(
            {
                "_inside": F.sum(size).over(inside.rowsBetween(*upto)) - F.col(size),
                "_following": F.lead(head).over(inside),
            }
        )
        .join(shards, "_shard")
        .select(
            *stored.columns,
            (F.col("_inside") + F.col("_before")).alias("start"),
            F.coalesce("_following", "_next").alias("following"),
        )
    )


def outlines(sequence: DataFrame, keys: Sequence[str], *others: str) -> DataFrame:
    """(keys..., others..., digest, n, first, last) of every unit, made in one
    pass over the texts and stored: all that positions and borders need."""
    return cut(
        sequence.select(
            *keys,
            *others,
            "digest",
            F.size("items").cast("long").alias("n"),
            F.get("items", F.lit(0)).alias("first"),
            F.element_at("items", -1).alias("last"),
        )
    )


def length(outline: DataFrame) -> int:
    """Number of words of the sequence."""
    return outline.agg(F.sum("n")).first()[0] or 0


def _located(
    sequence: DataFrame, keys: Sequence[str], outline: DataFrame | None, in_order: bool
) -> DataFrame:
    """Units with their start and the first word of the next unit."""
    outline = outlines(sequence, keys) if outline is None else outline
    starts = placed(outline, keys, "n", "first", in_order).select(*keys, "start", "following")
    return sequence.drop("digest").join(starts, list(keys))


def _opened(units_with_start: DataFrame) -> DataFrame:
    return units_with_start.select("start", F.posexplode("items").alias("_i", "word")).select(
        (F.col("start") + F.col("_i")).alias("pos"), "word"
    )


def word_index(
    sequence: DataFrame, keys: Sequence[str], outline: DataFrame | None = None, in_order: bool = False
) -> DataFrame:
    """(pos, word) for the whole sequence, positions counted from 0."""
    return _opened(_located(sequence, keys, outline, in_order))


def first_words(sequence: DataFrame, keys: Sequence[str], n: int, in_order: bool = False) -> DataFrame:
    """(pos, word) of the first ``n`` words; units that start later are not
    opened."""
    starts = placed(outlines(sequence, keys), keys, "n", "first", in_order).where(F.col("start") < n)
    begun = sequence.drop("digest").join(starts.select(*keys, "start"), list(keys))
    return _opened(begun).where(F.col("pos") < n)


def flat_pairs(sequence: DataFrame, keys: Sequence[str], in_order: bool = False) -> DataFrame:
    """(w1, w2) for all neighbours of the sequence, crossing unit borders.

    Neighbours inside a unit never leave their row; only the two outer words
    of each unit are shuffled to stitch the borders.
    """
    inside = sequence.select(F.inline(tx.adjacent(F.col("items"))))
    stitched = placed(outlines(sequence, keys), keys, "n", "first", in_order)
    across = stitched.where(F.col("following").isNotNull())
    return inside.unionByName(
        across.select(F.col("last").alias("w1"), F.col("following").alias("w2"))
    )


def parted_pairs(sequence: DataFrame, keys: Sequence[str], part: str) -> DataFrame:
    """(part, w1, w2): ``flat_pairs`` of several parts of a corpus at once.

    ``part`` is a column of numbers below 16. Each part is a sequence of its
    own; all are read in the same two passes.
    """
    inside = sequence.select(part, F.inline(tx.adjacent(F.col("items"))))
    outline = outlines(sequence, keys, part)
    # The part leads the digest, so the units of a part lie together.
    in_parts = outline.withColumn("digest", F.concat(F.lower(F.hex(part)), "digest")).withColumn(
        "_head", F.struct("first", part)
    )
    across = placed(in_parts, keys, "n", "_head").where(F.col(f"following.{part}") == F.col(part))
    return inside.unionByName(
        across.select(part, F.col("last").alias("w1"), F.col("following.first").alias("w2"))
    )


# What parts the items of a stored unit; items that hold it are stored as they are.
BETWEEN = "\n"


def _stored(units: DataFrame) -> DataFrame:
    """Units written with their items as one text, which is a quarter of their size."""
    others = [c for c in units.columns if c != "items"]
    joined = F.array_join("items", BETWEEN)
    parted = F.size(F.split(joined, BETWEEN)) == F.size("items")
    written = cut(units.select(*others, joined.alias("_text"), F.when(~parted, F.col("items")).alias("_items")))
    return written.select(*others, F.coalesce("_items", F.split("_text", BETWEEN)).alias("items"))


def indexed_pairs(
    sequence: DataFrame, keys: Sequence[str], outline: DataFrame | None = None, in_order: bool = False
) -> DataFrame:
    """(pos, w1, w2): every word with its position and the word after it;
    ``w2`` is NULL for the last word of the sequence.

    Units are stored with their start, so that pairs can be read more than once."""
    stitched = _stored(_located(sequence, keys, outline, in_order).select("start", "following", "items"))
    ahead = F.concat(F.slice("items", F.lit(2), F.size("items")), F.array("following"))
    return stitched.select(
        "start",
        F.posexplode(F.arrays_zip(F.col("items").alias("w1"), ahead.alias("w2"))).alias("_i", "_pair"),
    ).select((F.col("start") + F.col("_i")).alias("pos"), "_pair.w1", "_pair.w2")


# Leading digits of a digest that tell the shards of shuffled words, and the words
# of a shard from which on there are more.
SHUFFLE_DIGITS, SHUFFLED_ROWS = 3, 1_000_000


def _digest_shards(hashed: DataFrame, digits: int) -> DataFrame:
    """(_shard, _total, _first), stored: the number of words of each shard and its
    first word.

    The first word is sought among the digests that go on with two zeros after the
    shard, so that a pass over the words gathers counts and few words. Shards
    without such a digest are read again.
    """
    digest = F.hex("digest")
    shard = F.substring(digest, 1, digits).alias("_shard")
    low = F.when(F.substring(digest, digits + 1, 2) == "00", F.struct("digest", "word"))
    counted = hashed.groupBy(shard, low.alias("_low")).agg(F.count("*").alias("_words"))
    shards = cut(counted.groupBy("_shard").agg(F.sum("_words").alias("_total"), F.min("_low").alias("_low")))
    if not shards.where(F.col("_low").isNull()).isEmpty():
        missed = shards.where(F.col("_low").isNull()).select("_shard")
        every = hashed.select(shard, F.struct("digest", "word").alias("_every"))
        found = every.join(F.broadcast(missed), "_shard").groupBy("_shard").agg(F.min("_every").alias("_every"))
        shards = shards.join(found, "_shard", "left").withColumn("_low", F.coalesce("_low", "_every"))
    return cut(shards.select("_shard", "_total", F.col("_low.word").alias("_first")))


def shuffled_and_counted(sequence: DataFrame, keys: Sequence[str], seed: int) -> tuple[DataFrame, int]:
    """``shuffled_words`` and their number."""
    digest = F.unhex(seeded.digest(seed, *[F.col(k) for k in keys], F.col("i"))).alias("digest")
    addressed = exploded(sequence, *keys)
    hashed = addressed.select(digest, "word")
    digits = SHUFFLE_DIGITS
    shards = _digest_shards(hashed, digits)
    total = shards.agg(F.sum("_total")).first()[0] or 0
    if (more := seeded.digits_for(total, SHUFFLED_ROWS)) > digits:
        digits, shards = more, _digest_shards(hashed, more)
    # A digest cannot be packed. Numbers can, so where they are the address of a word, they
    # travel instead, and the digest is made again where they arrive.
    narrow = all(isinstance(addressed.schema[k].dataType, T.IntegralType) for k in keys)
    if narrow:
        dealt = addressed.repartition(F.substring(F.hex(digest), 1, digits)).select(digest, "word")
    else:
        dealt = hashed.repartition(F.substring(F.hex("digest"), 1, digits))
    # Words travel without their shard, which is read off the digest again.
    dealt = dealt.withColumn("_shard", F.substring(F.hex("digest"), 1, digits))
    inside = Window.partitionBy("_shard").orderBy("digest", "word")
    across = _across(shards, F.substring("_shard", 1, digits // 2))
    shuffled = (
        dealt.withColumns({"_place": F.row_number().over(inside), "_following": F.lead("word").over(inside)})
        .join(F.broadcast(across) if digits == SHUFFLE_DIGITS else across, "_shard")
        .select(
            (F.col("_before") + F.col("_place") - 1).alias("pos"), "word", F.coalesce("_following", "_next").alias("w2")
        )
    )
    return shuffled, total


def shuffled_words(sequence: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """(pos, word, w2): the words in a seeded random order, with the word
    that follows in that order.

    The order is that of a digest of the word's own address, so the shuffle is
    even and needs no sampling. Texts are read once for the sizes of the shards and
    once more for the words, which go through one shuffle and are not stored.
    """
    return shuffled_and_counted(sequence, keys, seed)[0]
