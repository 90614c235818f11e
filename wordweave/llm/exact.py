"""Exact duplicates: a tree merge of sorted digest runs.

Every partition of the scan sorts its digests and folds equal ones into one
entry: a run with each digest once, its smallest id and the number of rows.
Runs then exchange in binomial rounds. In a round, ``FAN_OUT`` neighbouring
runs meet; each hands over one part of its digest range per partner, so that
the number of runs and the share of the digest range a run covers both shrink
by ``FAN_OUT``. What meets is merged in digest order and folded again. After the
last round a run holds one part of the range from all partitions: the entries
of one task stay the same at every level, and no task sees everything. A digest
copied a million times is one entry per run from the start.

Folding compares SHA-256, length and a second, independent hash of the text at
every level; entries that do not agree in all three stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordweave.llm.common import Keep, by_row
from wordweave.session import Scratch, cut

# Runs that meet in one round, as a number of bits.
FAN_BITS = 4
FAN_OUT = 1 << FAN_BITS


def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space; NULL as ''."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sha, length, check, run) of every row."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("_t"))
    return plain.select(
        "doc_id",
        F.sha2(F.col("_t"), 256).alias("sha"),
        F.octet_length("_t").alias("length"),
        F.xxhash64("_t").alias("check"),
        F.spark_partition_id().alias("run"),
    )


SAME = ["sha", "length", "check"]
ENTRY = ["part", "run", *SAME, "keep_id", "group_size"]


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in order -> one per run and digest: the first id, which is the
    smallest, and the sum of the sizes. The last entry of a batch waits for the
    next one."""
    held = []
    for batch in batches:
        # What waits may be NULL by its type where the next batch may not.
        held = [pa.RecordBatch.from_arrays(h.columns, schema=batch.schema) for h in held]
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        if not table.num_rows:
            continue
        new = np.ones(table.num_rows, bool)
        for name in ENTRY[:-2]:
            values = table.column(name)
            differs = pc.not_equal(values[1:], values[:-1]).to_numpy()
            new[1:] = differs if name == ENTRY[0] else new[1:] | differs
        starts = np.flatnonzero(new)
        sizes = np.add.reduceat(table.column("group_size").to_numpy(), starts)
        folded = table.drop_columns("group_size").take(pa.array(starts))
        folded = folded.append_column("group_size", pa.array(sizes)).combine_chunks()
        *_, last = done = folded.to_batches()
        yield from done[:-1]
        yield last[:-1]
        held = [last[-1:]]
    yield from held


def _runs(entries: DataFrame) -> DataFrame:
    """Sort the entries of every run in its partition and fold them."""
    in_order = entries.select(*ENTRY).sortWithinPartitions(
        "part", "run", *SAME, F.col("keep_id").asc_nulls_last()
    )
    kind = dict(entries.dtypes)
    return in_order.mapInArrow(_folded, ", ".join(f"{c} {kind[c]}" for c in ENTRY))


def merged_runs(rows: DataFrame) -> DataFrame:
    """(sha, length, check, keep_id, group_size) from stored rows (doc_id, sha,
    length, check, run), where a run lies in one partition."""
    partitions = 1 + (rows.agg(F.max("run")).first()[0] or 0)
    level = _runs(
        rows.select(
            F.lit("").alias("part"),
            "run",
            *SAME,
            F.col("doc_id").alias("keep_id"),
            F.lit(1).cast("long").alias("group_size"),
        )
    )
    rounds = 1
    while FAN_OUT**rounds < partitions:
        rounds += 1
    # After the last round every ``run`` is 0: one entry per digest.
    for k in range(1, rounds + 1):
        part = F.substring("sha", 1, k * FAN_BITS // 4)
        moved = level.withColumns({"part": part, "run": F.shiftright("run", FAN_BITS)})
        level = _runs(moved.repartition("part", "run"))
    return level.select(*SAME, "keep_id", "group_size")


def duplicate_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: Keep = cut
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row.

    Of equal texts the row with the smallest id stays. NULL texts equal the
    empty text. Rows that repeat an id together with its text count in
    ``group_size`` and are all kept if that id is the smallest: they are one
    document stored twice. NULL ids are larger than any other; a group of only
    NULL ids has a NULL ``keep_id`` and is kept. Long texts are digested whole. An
    empty table gives no rows. Other columns of ``docs`` are not read.
    ``keep`` stores the result.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(digests(docs, doc_id, text))
        groups = scratch.keep(merged_runs(rows)).withColumnsRenamed(
            {"sha": "_sha", "length": "_length", "check": "_check"}
        )
        same = (
            (F.col("sha") == F.col("_sha"))
            & (F.col("length") == F.col("_length"))
            & (F.col("check") == F.col("_check"))
        )
        return keep(
            rows.join(groups, same, "left").select(
                "doc_id",
                "keep_id",
                "group_size",
                F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                F.col("sha").alias("text_sha256"),
            )
        )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of equal texts one row, the
    first by id, then by its place in the files. Rows are dropped as such: an id
    that repeats with another text is safe, a row stored twice stays once, and rows
    without an id come last."""

    def drops(rows: DataFrame, key: str, keep: Keep) -> DataFrame:
        return duplicate_groups(rows, key, keep=keep).where(~F.col("kept")).select(F.col("doc_id").alias(key))

    return by_row(docs, doc_id, text, drops)
