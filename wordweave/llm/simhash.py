"""Near duplicates by SimHash and multi-index hashing.

A fingerprint of 64 bits is cut into three segments. Two fingerprints that
differ in at most four bits differ in at most one bit of the first or of the
second segment, or in none of the third: otherwise they would differ in at
least 2 + 2 + 1 bits. So each fingerprint is listed under its own segment
values, and looks up the values at distance one in the first two; what it meets
is verified over all 64 bits. A single differing bit is set in exactly one of
the two, so only values with one bit *cleared* are looked up, which finds every
pair once.

Equal fingerprints are one node. Under one value, nodes are linked to one
member per local component, never in all pairs; a value listed by very many
nodes is cut into blocks that lie in different tasks and that all of them visit.
Components come from randomised contraction of the links, in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordweave.llm.common import LOWER, Keep, by_row, text_map
from wordweave.session import Scratch, cut

SHINGLE = 4
SEED = 42
LINKED = 4

# First bit and width of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))

# Nodes listed in one block of a segment value, about; and the group size up to
# which rows are compared directly.
BLOCK = 2048
SMALL = 24


def fingerprint(text: str) -> int:
    """SimHash over the 64-bit hashes of the word shingles, repeats included.
    A bit is set if it is set in over half of the hashes; no words: 0."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    count = max(1, len(words) - SHINGLE + 1)
    first, last = starts[:count].tolist(), ends[len(words) - count :].tolist()
    digest, set_bits = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, count, 1 << 16):
        # At most 65,536 hashes at a time, so that long texts need no more.
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first[at : at + (1 << 16)], last[at : at + (1 << 16)])]
        bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8), axis=1)
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > count).tobytes(), "big")


class _Fingerprints:
    def __call__(self, texts: list[str]) -> dict[str, object]:
        made = np.array([fingerprint(t) for t in texts], dtype=np.uint64)
        return {"fp": pa.array(made.view(np.int64), pa.int64())}


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp), one row per row; fp as a signed 64-bit integer."""
    return text_map(docs, [doc_id], text, _Fingerprints(), "fp bigint")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _segment(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _bucket(number: int, value: Column) -> Column:
    """A segment's number and value in one integer."""
    return F.lit(number << 22).cast("long") + value


def _entries(number: int, value: Column, width: int, looks_up: bool) -> Column:
    own = F.array(F.struct(_bucket(number, value).alias("bucket"), F.lit(True).alias("own")))
    if not looks_up:
        return own
    bits = F.array(*[F.lit(1 << b).cast("long") for b in range(width)])
    present = F.filter(bits, lambda b: value.bitwiseAND(b) != 0)
    cleared = F.transform(
        present,
        lambda b: F.struct((_bucket(number, value) - b).alias("bucket"), F.lit(False).alias("own")),
    )
    return F.concat(own, cleared)


def listed(nodes: DataFrame) -> DataFrame:
    """(bucket, own, fp): the segment values of each node and those it looks
    up."""
    values = [
        # The last segment has to be equal.
        _entries(n, _segment(F.col("fp"), first, width), width, n < len(SEGMENTS) - 1)
        for n, (first, width) in enumerate(SEGMENTS)
    ]
    return nodes.select(F.explode(F.concat(*values)).alias("_v"), "fp").select(
        "_v.bucket", "_v.own", "fp"
    )


def in_blocks(
    entries: DataFrame, nodes: DataFrame, keep: Keep = cut
) -> DataFrame:
    """(bucket, block, own, fp): entries of a bucket with many owners go to all
    of its blocks, and are at home in one."""
    counts = nodes.select(
        F.explode(
            F.array(
                *[
                    _bucket(n, _segment(F.col("fp"), first, width))
                    for n, (first, width) in enumerate(SEGMENTS)
                ]
            )
        ).alias("bucket")
    )
    large = keep(
        counts.groupBy("bucket")
        .count()
        .where(F.col("count") > BLOCK)
        .select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    )
    # Few buckets are large; they are broadcast while they fit into a megabyte.
    side = F.broadcast(large) if large.count() <= 50_000 else large
    home = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    spread = entries.join(side, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return spread.select(
        "bucket",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        "own",
        "fp",
        home.alias("_home"),
    ).select("bucket", "block", (F.col("own") & (F.col("_home") == F.col("block"))).alias("own"), "fp")


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= LINKED


class _Group:
    """One large group: its owners, then any number of visitors in turn."""

    def __init__(self):
        self.owners: list[np.ndarray] = []
        self.parts = None

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """The links that span the owners' components."""
        self.owners = np.concatenate(self.owners)
        n = len(self.owners)
        self.parts = np.full(n, -1)
        rest, links = np.arange(n), []
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            self.parts[queue[0]] = root = queue[0]
            while queue:
                at = queue.pop()
                met = _near(self.owners[rest], self.owners[at])
                found, rest = rest[met], rest[~met]
                self.parts[found] = root
                queue.extend(found.tolist())
                links.append(np.stack([np.full(len(found), at), found]))
        a, b = np.concatenate(links, axis=1)
        return self.owners[a], self.owners[b]

    def visit(self, visitors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One link per visitor and component of owners that it touches."""
        left, right = [], []
        for at in range(0, len(visitors), 256):
            some = visitors[at : at + 256]
            who, whom = np.nonzero(_near(some[:, None], self.owners[None, :]))
            touched = np.unique(who * len(self.owners) + self.parts[whom])
            left.append(some[touched // len(self.owners)])
            right.append(self.owners[touched % len(self.owners)])
        return np.concatenate(left), np.concatenate(right)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by (bucket, block, owners first). A group that is
    not over at the end of a batch is carried on: its rows while it is small,
    else its owners only."""

    def frame(a, b):
        different = a != b
        return pa.RecordBatch.from_arrays([pa.array(a[different]), pa.array(b[different])], ["a", "b"])

    held = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool), np.empty(0, np.int64)]
    group = key = None  # a large group in progress

    def feed(own, fp):
        """Rows of the large group in progress -> links. Owners come first, so
        a group that begins with a visitor has none and no links."""
        if own.any():
            group.owners.append(fp[own])
        if len(group.owners) and not own.all():
            if group.parts is None:
                yield frame(*group.close())
            yield frame(*group.visit(fp[~own]))

    def finish():
        if group is not None and group.parts is None and group.owners:
            yield frame(*group.close())

    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        bucket, block, own, fp = (np.concatenate([h, n]) for h, n in zip(held, new))
        if not len(bucket):
            continue
        starts = np.flatnonzero(
            np.r_[True, (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])]
        )
        ends = np.r_[starts[1:], len(bucket)]
        first = 0
        if key == (bucket[0], block[0]):
            yield from feed(own[: ends[0]], fp[: ends[0]])
            first = 1
        if first < len(starts):
            yield from finish()
            group = key = None
            # The last group may go on in the next batch.
            at = starts[-1]
            held = [x[at:] for x in (bucket, block, own, fp)]
            if len(held[0]) > SMALL:
                group, key = _Group(), (bucket[at], block[at])
                yield from feed(own[at:], fp[at:])
                held = [x[:0] for x in held]
            yield from _closed(starts[first:-1], ends[first:-1], own, fp, frame)
        else:
            held = [x[:0] for x in (bucket, block, own, fp)]
    yield from finish()
    if len(held[0]):
        yield from _closed(np.array([0]), np.array([len(held[0])]), held[2], held[3], frame)


def _closed(starts, ends, own, fp, frame) -> Iterator[pa.RecordBatch]:
    """Links of groups that lie whole in a batch; one without owner or with a
    single row has none."""
    sizes = ends - starts
    worth = own[starts] & (sizes > 1) if len(starts) else np.empty(0, bool)
    starts, ends, sizes = starts[worth], ends[worth], sizes[worth]
    small = sizes <= SMALL
    left, right = [], []
    for shift in range(1, int(sizes[small].max(initial=0))):
        s, e = starts[small & (sizes > shift)], ends[small & (sizes > shift)]
        n = e - s - shift
        at = np.repeat(s - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        met = at[_near(fp[at], fp[at + shift])]
        left.append(fp[met])
        right.append(fp[met + shift])
    if left:
        yield frame(np.concatenate(left), np.concatenate(right))
    for s, e in zip(starts[~small], ends[~small]):
        group = _Group()
        group.owners.append(fp[s:e][own[s:e]])
        yield frame(*group.close())
        visitors = fp[s:e][~own[s:e]]
        if len(visitors):
            yield frame(*group.visit(visitors))


def links(nodes: DataFrame, keep: Keep = cut) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that lie
    within ``LINKED`` bits of each other; not every such pair is listed."""
    placed = in_blocks(listed(nodes), nodes, keep)
    rows = placed.repartition("bucket", "block").sortWithinPartitions(
        "bucket", "block", F.col("own").desc()
    )
    return rows.mapInArrow(_links, "a bigint, b bigint")


def components(edges: DataFrame, keep: Keep = cut) -> DataFrame:
    """(node, root) for every node of the edges (a, b). ``keep`` stores what
    the rounds leave.

    Randomised contraction: each node points to the first of itself and its
    neighbours in an order that changes every two rounds, edges are moved to
    the nodes pointed to, and what is left is contracted again. A star is gone
    after two rounds, and any graph shrinks by a constant factor on average.
    """
    edges = keep(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    rounds = []
    while not edges.isEmpty():
        turn = len(rounds) // 2 * 13 % 64
        mask = F.lit((len(rounds) // 2 * 0x1E3779B97F4A7C15) & (2**63 - 1)).cast("long")

        def place(node: Column, turn=turn, mask=mask) -> Column:
            """A one-to-one renaming that sets the order of a round."""
            turned = F.shiftleft(node, turn).bitwiseOR(F.shiftrightunsigned(node, 64 - turn)) if turn else node
            return turned.bitwiseXOR(mask)

        def back(name: Column, turn=turn, mask=mask) -> Column:
            node = name.bitwiseXOR(mask)
            return F.shiftrightunsigned(node, turn).bitwiseOR(F.shiftleft(node, 64 - turn)) if turn else node

        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least(place(F.col("a")), place(F.col("b")))).alias("_p"))
        points = keep(least.select(F.col("a").alias("node"), back(F.col("_p")).alias("root")))
        rounds.append(points)
        moved = edges.join(points.withColumnsRenamed({"node": "a", "root": "ra"}), "a").join(
            points.withColumnsRenamed({"node": "b", "root": "rb"}), "b"
        )
        moved = moved.where(F.col("ra") != F.col("rb"))
        edges = keep(moved.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds[0]
    for points in rounds[1:]:
        later = points.select(F.col("node").alias("root"), F.col("root").alias("_later"))
        roots = keep(
            roots.join(later, "root", "left").select("node", F.coalesce("_later", "root").alias("root"))
        )
    return roots


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", result: Keep = cut
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row.

    Fingerprints that differ in at most four bits are linked;
    ``component_id`` is the smallest id that links reach, itself included.
    NULL texts and texts without words have fingerprint 0 and are linked like
    others; long texts are read whole. Repeated rows share their component. A NULL
    id is no candidate for ``component_id``. An empty table gives no rows; other columns are not read.
    """
    with Scratch(docs.sparkSession) as scratch:
        keep = scratch.keep
        rows = keep(fingerprints(docs, doc_id, text).withColumnRenamed(doc_id, "doc_id"))
        nodes = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
        roots = components(links(nodes, keep), keep).withColumnRenamed("node", "fp")
        placed = keep(
            nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
        )
        smallest = keep(placed.groupBy("root").agg(F.min("first").alias("component_id")))
        classes = keep(placed.join(smallest, "root").select(F.col("fp").alias("_fp"), "component_id"))
        return result(
            rows.join(classes, F.col("fp") == F.col("_fp"), "left").select(
                "doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id"
            )
        )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each component one row,
    the first by id, then by its place in the files; rows without an id come last.
   """

    def drops(rows: DataFrame, key: str, keep: Keep) -> DataFrame:
        found = near_duplicates(rows, key, result=keep)
        return found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(key))

    return by_row(docs, doc_id, text, drops)
