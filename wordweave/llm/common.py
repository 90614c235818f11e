"""What several operators share: folds, word splitting, Arrow columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordweave.session import Scratch, cut

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _word_table() -> bytes:
    """A-Z to lower case; ASCII that is no letter or digit to a space."""
    table = bytearray(LOWER)
    for code in range(128):
        if not chr(table[code]).isalnum():
            table[code] = 32
    return bytes(table)


WORDS = _word_table()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a NULL id counts as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


# Bytes of texts that a task turns into Python strings at a time, about.
PORTION = 1 << 20


def portions(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts, NULL as ''; a slice has one row or a
    bounded number of bytes."""
    if not batch.num_rows:
        return
    first = size = 0
    for at, length in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if size and size + length > PORTION:
            part = batch.slice(first, at - first)
            yield part, [x or "" for x in part.column(column).to_pylist()]
            first, size = at, 0
        size += length
    part = batch.slice(first)
    yield part, [x or "" for x in part.column(column).to_pylist()]


def text_map(
    docs: DataFrame,
    kept: list[str],
    text: str,
    rows: Callable[[list[str]], dict[str, object]],
    schema: str,
) -> DataFrame:
    """Adds to the columns ``kept`` what ``rows`` makes of the texts of one
    Arrow batch: new columns by name, in the order of ``schema``. A NULL text
    counts as ''. ``rows`` is made once per task from a picklable object."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in portions(batch, len(kept)):
                made = rows(texts)
                arrays = [part.column(i) for i in range(len(kept))]
                names = list(kept)
                for name, values in made.items():
                    arrays.append(values if isinstance(values, pa.Array) else pa.array(values))
                    names.append(name)
                yield pa.RecordBatch.from_arrays(arrays, names)

    types = dict(docs.dtypes)
    head = ", ".join(f"`{c}` {types[c]}" for c in kept)
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_text"))
    return source.mapInArrow(run, f"{head}, {schema}")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def labelled_rows(
    docs: DataFrame, labels: DataFrame, target: str, doc_id: str, folds: int, ids: int
) -> DataFrame:
    """The rows of ``docs`` outside fold 0 whose id has a label, as column
    ``_y``; of at most ``ids`` ids, chosen by a hash. Several labels of one id
    count as their maximum. An id may have any number of rows: what is made of
    them has to be ``bounded``."""
    marks = (
        labels.where(F.col(target).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("_labelled"))
        .agg(F.max(target).cast("int").alias("_y"))
        .where(fold("_labelled", folds) != 0)
        .orderBy(F.xxhash64("_labelled"), "_labelled")
        .limit(ids)
    )
    # The bound on the ids bounds the broadcast side: 12 bytes a row.
    return docs.join(F.broadcast(marks), F.col(doc_id) == F.col("_labelled")).drop("_labelled")


def bounded(sample: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows of a sample, chosen by a hash of all their
    columns, so the choice is the same in each run."""
    return sample.orderBy(F.xxhash64(*sample.columns), *sample.columns).limit(rows)


# Rows to drop that are broadcast as they are, of 40 bytes or so; and bits of the
# map that stands for more, per row and at most (16 MB).
FEW_DROPS, DROP_BITS, MOST_BITS = 500_000, 16, 1 << 27


def unused(frame: DataFrame, base: str) -> str:
    """A column name that the frame does not have."""
    own = {c.lower() for c in frame.columns}
    return next(n for n in (f"{base}{i or ''}" for i in count()) if n not in own)


def addressed(docs: DataFrame, name: str) -> DataFrame:
    """``docs``, read from Parquet files as they are, with a column that names
    each row by file and place. Files are told by a hash of 64 bits."""
    place = docs.metadataColumn("_metadata")
    return docs.withColumn(
        name, F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row"))
    )


def without(docs: DataFrame, name: str, dropped: DataFrame) -> DataFrame:
    """The rows of the ``addressed`` docs that ``dropped`` (name) does not hold.

    The texts are not shuffled. Few dropped rows are broadcast; more of them are a
    bitmap of bounded size, and only what it may hold, the dropped rows and some
    hundredths of the others, is joined with them.
    """
    dropped = cut(dropped.select(F.col(name).alias("_dropped")))
    rows = dropped.count()
    here = F.col(name) == F.col("_dropped")
    if rows <= FEW_DROPS:
        return docs.join(F.broadcast(dropped), here, "left_anti").drop(name)
    bits = 1 << 20
    while bits < min(rows * DROP_BITS, MOST_BITS):
        bits *= 2

    def place(column: str) -> Column:
        return F.xxhash64(column).bitwiseAND(F.lit(bits - 1).cast("long"))

    mark = F.expr("shiftleft(1L, int(_bit & 63))")
    marks = (
        dropped.select(place("_dropped").alias("_bit"))
        .groupBy(F.shiftright("_bit", 6).alias("_word"))
        .agg(F.bit_or(mark).alias("_marks"))
    )
    tested = docs.withColumn("_bit", place(name)).join(
        F.broadcast(cut(marks)), F.shiftright("_bit", 6) == F.col("_word"), "left"
    )
    held = F.coalesce(F.col("_marks").bitwiseAND(mark) != 0, F.lit(False))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    open_rows = tested.where(held).select(*kept).join(dropped, here, "left_anti")
    return tested.where(~held).select(*kept).unionByName(open_rows).drop(name)


def is_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` are Parquet files as they are, whose rows have places."""
    plan = docs._jdf.queryExecution().analyzed().getClass().getSimpleName()
    if plan != "LogicalRelation" or not docs.inputFiles():
        return False
    return "row_index" in docs.select(docs.metadataColumn("_metadata")).schema[0].dataType.names


Keep = Callable[[DataFrame], DataFrame]


def by_row(
    docs: DataFrame, doc_id: str, text: str, drops: Callable[[DataFrame, str, Keep], DataFrame]
) -> DataFrame:
    """``docs`` without the rows that ``drops`` returns.

    ``drops`` gets (key, text), the name of the key and what keeps its result for as
    long as it is needed here. The key is (no_id, id, at): it is unique to a row, and its order is that of the ids, NULL last, then that of
    the rows. Parquet files are read where they are; other frames are written out
    first, so that rows have a place, and the result is then a checkpoint.
    """
    name = unused(docs, "_at")

    def kept(rows: DataFrame) -> DataFrame:
        placed = addressed(rows, name)
        key = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.col(name).alias("at"))
        with Scratch(rows.sparkSession) as scratch:
            gone = drops(placed.select(key.alias("key"), F.col(text).alias("text")), "key", scratch.keep)
            return without(placed, name, gone.select(F.col("key.at").alias(name)))

    if is_scan(docs):
        return kept(docs)
    with Scratch(docs.sparkSession) as scratch:
        return cut(kept(scratch.keep(docs)))
