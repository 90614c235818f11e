"""Phrases whose words stand together more often than by chance, from stripes.

A stripe is a prefix of one or two words with a counter of the words that follow
it. Tasks count stripes in memory and write them out in rows of bounded size; equal
prefixes then meet and their counters are added element by element. Merged stripes
hold all that scores need: an entry is the count of the phrase that extends the
prefix, the total of a prefix of one word its own count, and the largest entry of a
prefix of two words what it loses to a longer phrase.

Longer stripes are counted only where both pairs of words are frequent, as no
other triple can be. Tasks tell that from a bitmap; pairs it lets through by mistake
are dropped when their counts are known. A prefix with very many entries is split
over shards by the words that follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordweave.llm.common import LOWER
from wordweave.session import Scratch, cut

LEAST, TOP = 10, 2000
# A phrase is dropped for a longer one with at least this share of its count.
SHARE = 50

# Bounds of a task's counters: distinct words, entries, words taken at a time;
# and entries in one row of a stripe.
WORDS, ENTRIES, SLICE, ROW = 1 << 20, 1 << 21, 1 << 18, 128

# Entries of a prefix in one shard, about; prefixes split so, at most; rows a
# task ranks.
SHARD, SPLIT, RANKED = 1 << 20, 10_000, 100_000

# Bits of the map of frequent pairs: per pair, least and most.
BITS_EACH, BITS_LEAST, BITS_MOST = 16, 1 << 20, 1 << 27

# A byte that UTF-8 never has marks the end of a piece.
END = b"\xff"


def _pieces_table() -> bytes:
    table = bytearray(LOWER)
    for code in b".,;:!?\n\x0b\x0c\r":
        table[code] = END[0]
    return bytes(table)


PIECES = _pieces_table()


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, with END after each piece."""
    return (text.translate(PIECES) + END).replace(END, b" \xff ").split()


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = made = len(self)
        return made


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of distinct keys in their order."""
    if len(keys) == 1:
        return keys[0], counts[0]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return distinct, total


def _turned(hashes: np.ndarray) -> np.ndarray:
    return (hashes << np.uint64(17)) | (hashes >> np.uint64(47))


class _Counter:
    """Stripes of one task. Prefixes of one word count the end of a piece as
    well, for their total; prefixes of two words are counted where ``frequent``
    has both pairs."""

    def __init__(self, frequent: np.ndarray | None):
        self.frequent = frequent
        self.words = 1 if frequent is None else 2
        self.clear()

    def clear(self) -> None:
        self.ids, self.parts, self.entries = _Ids(), {}, 0
        self.ids[END]
        self.hashes = np.zeros(1, np.uint64)

    def add(self, lang: str, words: list[bytes]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(words), SLICE):
            if len(self.ids) > WORDS or self.entries > ENTRIES:
                yield from self.stripes()
            # What begins in this slice may reach into the next.
            some = words[at : at + SLICE + self.words]
            ids = np.fromiter(map(self.ids.__getitem__, some), np.int64, len(some))
            self._count(lang, ids)

    def _count(self, lang: str, ids: np.ndarray) -> None:
        if self.words == 1:
            first, last = ids[:-1], ids[1:]
            prefix, following = first[first != 0], last[first != 0]
        else:
            self._hash_new_words()
            a, b, c = ids[:-2], ids[1:-1], ids[2:]
            inside = (a != 0) & (b != 0) & (c != 0)
            a, b, c = a[inside], b[inside], c[inside]
            both = self._is_frequent(lang, a, b)
            a, b, c = a[both], b[both], c[both]
            both = self._is_frequent(lang, b, c)
            prefix, following = (a[both] << 21) | b[both], c[both]
        keys, counts = np.unique((prefix << 21) | following, return_counts=True)
        held = self.parts.setdefault(lang, [])
        held.append((keys, counts))
        self.entries += len(keys)
        if self.entries > ENTRIES:
            for name, parts in self.parts.items():
                self.parts[name] = [_added(*map(list, zip(*parts)))]
            self.entries = sum(len(p[0][0]) for p in self.parts.values())

    def _hash_new_words(self) -> None:
        known, n = len(self.hashes), len(self.ids)
        if known < n:
            new = list(self.ids)[known:]
            made = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in new), np.uint64, len(new))
            self.hashes = np.concatenate([self.hashes, made])

    def _is_frequent(self, lang: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        of_lang = np.uint64(xxhash.xxh64_intdigest(lang.encode(), 42))
        bits = _turned(self.hashes[a]) ^ self.hashes[b] ^ of_lang
        bits &= np.uint64(len(self.frequent) * 64 - 1)
        return (self.frequent[bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1) != 0

    def stripes(self) -> Iterator[pa.RecordBatch]:
        """All that was counted, as (lang, prefix, stripe, total, entries); then
        the counter is empty."""
        if not self.ids:
            return
        words = pa.array(list(self.ids), pa.binary())
        words = pa.concat_arrays([pa.array([b""], pa.binary()), words[1:]]).cast(pa.string())
        for lang, parts in self.parts.items():
            keys, counts = _added(*map(list, zip(*parts)))
            for at in range(0, len(keys), SLICE):
                yield self._rows(lang, words, keys[at : at + SLICE], counts[at : at + SLICE])
        self.clear()

    def _rows(self, lang, words, keys, counts) -> pa.RecordBatch:
        prefix, following = keys >> 21, keys & ((1 << 21) - 1)
        change = np.r_[True, prefix[1:] != prefix[:-1]]
        starts = np.flatnonzero(change)
        sizes = np.diff(np.r_[starts, len(keys)])
        # A long stripe goes on in further rows.
        rows = -(-sizes // ROW)
        number = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
        starts = np.repeat(starts, rows) + number * ROW
        totals = np.add.reduceat(counts, starts)
        # The end of a piece is in the total and no word.
        kept = following != 0
        offsets = np.r_[0, np.cumsum(kept)][np.r_[starts, len(keys)]].astype(np.int32)
        heads = prefix[starts]
        names = words.take(pa.array(heads & ((1 << 21) - 1)))
        if self.words == 2:
            first = words.take(pa.array(heads >> 21))
            names = pa.compute.binary_join_element_wise(first, names, " ")
        stripe = pa.MapArray.from_arrays(
            pa.array(offsets), words.take(pa.array(following[kept])), pa.array(counts[kept])
        )
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(starts), pa.string()),
                names,
                stripe,
                pa.array(totals, pa.int64()),
                pa.array(np.diff(offsets), pa.int32()),
            ],
            ["lang", "prefix", "stripe", "total", "entries"],
        )


def _counting(frequent=None):
    """Stripes of the rows (lang, text) of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(None if frequent is None else np.frombuffer(frequent.value, np.uint64))
        for batch in batches:
            held: dict[str, list[bytes]] = {}
            texts = batch.column(1).cast(pa.binary())
            for lang, text in zip(batch.column(0), texts):
                words = held.setdefault(lang.as_py(), [])
                words += words_of(text.as_py() or b"")
                if len(words) > SLICE:
                    yield from counter.add(lang.as_py(), words)
                    words.clear()
            for lang, words in held.items():
                yield from counter.add(lang, words)
        yield from counter.stripes()

    return run


def _merging(least: int):
    """Adds up the stripes of equal (lang, prefix, shard) in rows sorted by
    them; entries below ``least`` are then left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The key of the last group, its entries so far and its total.
        held: tuple[tuple, pa.Table, int] | None = None
        names = ("lang", "prefix", "shard")

        def added(parts: list[pa.Table]) -> pa.Table:
            both = pa.concat_tables(parts).group_by(["group", "word"], use_threads=False)
            return both.aggregate([("n", "sum")]).rename_columns(["group", "word", "n"])

        def rows(keys: pa.Table, entries: pa.Table, totals: np.ndarray) -> pa.RecordBatch:
            entries = entries.filter(pa.compute.greater_equal(entries["n"], least)).sort_by("group")
            group = entries["group"].to_numpy()
            offsets = np.searchsorted(group, np.arange(len(totals) + 1)).astype(np.int32)
            stripe = pa.MapArray.from_arrays(
                pa.array(offsets),
                entries["word"].combine_chunks(),
                entries["n"].combine_chunks(),
            )
            heads = [keys[c].combine_chunks() for c in names[:2]]
            return pa.RecordBatch.from_arrays([*heads, stripe, pa.array(totals)], ["lang", "prefix", "stripe", "total"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            change = np.zeros(batch.num_rows, bool)
            change[0] = True
            for name in names:
                column = batch.column(name)
                change[1:] |= pa.compute.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            group = np.cumsum(change) - 1
            stripe = batch.column("stripe")
            entries = pa.table(
                {
                    "group": np.repeat(group, batch.column("entries").to_numpy()),
                    "word": stripe.keys,
                    "n": stripe.items,
                }
            )
            totals = np.add.reduceat(batch.column("total").to_numpy(), np.flatnonzero(change))
            keys = table.select(names).take(pa.array(np.flatnonzero(change)))
            parts = [entries]
            if held is not None:
                if held[0] == tuple(keys.slice(0, 1).to_pylist()[0].values()):
                    parts.append(held[1])
                    totals[0] += held[2]
                else:
                    yield rows(*held[3:])
            entries = added(parts)
            last = len(totals) - 1
            if last:
                below = pa.compute.less(entries["group"], last)
                yield rows(keys.slice(0, last), entries.filter(below), totals[:last])
                entries = entries.filter(pa.compute.equal(entries["group"], last))
                entries = entries.set_column(0, "group", pa.array(np.zeros(len(entries), np.int64)))
            key = keys.slice(last, 1)
            held = (tuple(key.to_pylist()[0].values()), entries, totals[last], key, entries, totals[last:])
        if held is not None:
            yield rows(*held[3:])

    return run


COUNTED = "lang string, prefix string, stripe map<string, bigint>, total bigint, entries int"
MERGED = "lang string, prefix string, stripe map<string, bigint>, total bigint"


def merged_stripes(stripes: DataFrame, least: int) -> DataFrame:
    """(lang, prefix, stripe, total): stored stripes added up. A prefix in
    several shards has several rows, its total in parts."""
    sums = stripes.groupBy("lang", "prefix").agg(F.sum("entries").alias("_sum"))
    every = stripes.agg(F.sum("entries")).first()[0] or 0
    # At most SPLIT prefixes hold more than every / SPLIT entries each.
    shard = max(SHARD, every // SPLIT)
    split = sums.where(F.col("_sum") > shard).select(
        "lang", "prefix", F.ceil(F.col("_sum") / shard).cast("int").alias("_shards")
    )
    rows = stripes.join(F.broadcast(split), ["lang", "prefix"], "left")
    alone = rows.where(F.col("_shards").isNull()).withColumn("shard", F.lit(0)).drop("_shards")
    parts = (
        rows.where(F.col("_shards").isNotNull())
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)))
        .withColumn(
            "stripe",
            F.map_filter("stripe", lambda word, n: F.pmod(F.xxhash64(word), F.col("_shards")) == F.col("shard")),
        )
        .withColumn("entries", F.size("stripe"))
        .withColumn("total", F.when(F.col("shard") == 0, F.col("total")).otherwise(0))
        .drop("_shards")
    )
    keys = ["lang", "prefix", "shard"]
    met = alone.unionByName(parts).repartition(*keys).sortWithinPartitions(*keys)
    return met.mapInArrow(_merging(least), MERGED)


def _pair_bit(bits: int) -> Column:
    first, last, lang = (F.xxhash64(c) for c in ("first", "last", "lang"))
    turned = F.shiftleft(first, 17).bitwiseOR(F.shiftrightunsigned(first, 47))
    return turned.bitwiseXOR(last).bitwiseXOR(lang).bitwiseAND(F.lit(bits - 1).cast("bigint"))


def _bitmap(pairs: DataFrame):
    """The frequent pairs (lang, first, last) as a broadcast bitmap of bounded
    size."""
    bits = BITS_LEAST
    wanted = min(pairs.count() * BITS_EACH, BITS_MOST)
    while bits < wanted:
        bits *= 2
    marked = pairs.select(_pair_bit(bits).alias("bit")).select(
        F.shiftright("bit", 6).alias("at"),
        F.expr("shiftleft(1L, int(bit & 63))").alias("mark"),
    )
    rows = marked.groupBy("at").agg(F.bit_or("mark").alias("mark")).toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[rows["at"].to_numpy()] = rows["mark"].to_numpy().view(np.uint64)
    return pairs.sparkSession.sparkContext.broadcast(bitmap.tobytes())


def _score(whole: str, left: str, right: str) -> Column:
    """Exact: the products have up to 38 digits."""
    wide = {c: f"CAST({c} AS DECIMAL(19, 0))" for c in (whole, left, right)}
    return F.expr(
        f"(CAST(1000000 AS DECIMAL(7, 0)) * ({wide[whole]} * {wide[whole]})) div ({wide[left]} * {wide[right]})"
    )


def _first_of_each(found: DataFrame, top: int, scratch: Scratch) -> DataFrame:
    """The first rows of each language, ranked in salted rounds so that no
    task holds all rows of one."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    found = scratch.keep(found)
    rows = found.count()
    while rows > RANKED:
        salts = -(-rows // RANKED) * 4
        salt = F.pmod(F.xxhash64("phrase"), F.lit(salts)).alias("_salt")
        place = F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))
        found = scratch.keep(
            found.select("*", salt).withColumn("_at", place).where(F.col("_at") <= top).drop("_at", "_salt")
        )
        if (left := found.count()) == rows:
            break
        rows = left
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return found.withColumn("rank", place.cast("bigint")).where(F.col("rank") <= top)


def phrases(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of
    two and three words of each language.

    ``a`` counts the phrase, ``l`` and ``r`` its two parts at the cut with the
    lowest score, ``n`` all words of the language; score is a * a / (l * r) in
    millionths, rounded down. Ties go to the larger ``a``, then to the smaller
    phrase by its bytes. A NULL language counts as 'und', a NULL text as empty;
    repeated rows count as often as they occur, long texts whole. No text with a
    phrase gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    read = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    with Scratch(spark) as scratch:
        short = scratch.keep(read.mapInArrow(_counting(), COUNTED))
        short = scratch.keep(merged_stripes(short, least), short)
        sums = scratch.keep(short.groupBy("lang").agg(F.sum("total").alias("n")))
        singles = (
            short.groupBy("lang", F.col("prefix").alias("word"))
            .agg(F.sum("total").alias("f"))
            .where(F.col("f") >= least)
        )
        singles = scratch.keep(singles)
        pairs = scratch.keep(
            short.select("lang", F.col("prefix").alias("first"), F.explode("stripe").alias("last", "a"))
        )
        frequent = _bitmap(pairs)
        long = scratch.keep(read.mapInArrow(_counting(frequent), COUNTED))
        long = scratch.keep(merged_stripes(long, least), long)
        triples = scratch.keep(
            long.select("lang", F.col("prefix").alias("left"), F.explode("stripe").alias("last", "a")).withColumn(
                "right", F.concat_ws(" ", F.element_at(F.split("left", " "), 2), "last")
            )
        )
        pairs = scratch.keep(
            pairs.join(singles.withColumnsRenamed({"word": "first", "f": "l"}), ["lang", "first"])
            .join(singles.withColumnsRenamed({"word": "last", "f": "r"}), ["lang", "last"])
            .select("lang", F.concat_ws(" ", "first", "last").alias("phrase"), "a", "l", "r")
        )
        # What longer phrases take: the largest entry of the stripe of the pair,
        # and the largest one that ends with it.
        taken = (
            long.select("lang", F.col("prefix").alias("phrase"), F.array_max(F.map_values("stripe")).alias("_most"))
            .unionByName(triples.select("lang", F.col("right").alias("phrase"), F.col("a").alias("_most")))
            .groupBy("lang", "phrase")
            .agg(F.max("_most").alias("_most"))
        )
        two = (
            pairs.join(taken, ["lang", "phrase"], "left")
            .where((F.col("_most") * 100 < F.col("a") * SHARE) | F.col("_most").isNull())
            .select("lang", "phrase", "a", "l", "r", _score("a", "l", "r").alias("score"))
        )
        three = (
            triples.join(pairs.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l2"), F.col("l").alias("l1")), ["lang", "left"])
            .join(pairs.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r1"), F.col("r").alias("r2")), ["lang", "right"])
            .withColumns({"s1": _score("a", "l1", "r1"), "s2": _score("a", "l2", "r2")})
        )

        def lower(one: str, two: str) -> Column:
            return F.when(F.col("s1") <= F.col("s2"), F.col(one)).otherwise(F.col(two))

        three = three.select(
            "lang",
            F.concat_ws(" ", "left", "last").alias("phrase"),
            "a",
            lower("l1", "l2").alias("l"),
            lower("r1", "r2").alias("r"),
            lower("s1", "s2").alias("score"),
        )
        ranked = _first_of_each(two.unionByName(three), top, scratch)
        result = cut(ranked.join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
        frequent.destroy()
        return result
