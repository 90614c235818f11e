"""Near-duplicate embeddings by E8 lattice hashing.

Every table projects a unit vector to eight dimensions with a random matrix of
its own and decodes the result to the nearest point of the E8 lattice. The point
names a cell. A vector is listed under its own cell and looks up the cells of
the neighbouring lattice points that lie next nearest; what meets in a cell is
verified by cosine in double precision. At the threshold of 0.98 one table finds
about 77 % of the pairs, six miss 2 in 10,000.

Equal vectors of a label are one node. Pairs are never written out: a cell gives
every node the number of its partners and one link to each local component. A pair
that several cells or tables find is counted in the first of them, which both
vectors tell from their codes. A cell with many vectors is cut into blocks that
lie in different tasks and that all its visitors pass.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordweave.llm.simhash import components
from wordweave.session import Scratch, cut

LINKED = 0.98

# Tables, cells looked up in each beside the own one, and the width of a cell.
TABLES, PROBES, WIDTH = 6, 4, 0.8

# Vectors at home in one block of a cell, about; the group size up to which
# rows are compared directly, and visitors compared at a time.
BLOCK, SMALL, CHUNK = 2048, 24, 256

# The columns of a group of vectors that meet.
KEY = ("label", "dims", "cell", "block")

# Cosines this near the threshold are computed again, term by term.
CLOSE = 1e-9


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The lattice point nearest to each row: E8 is the integer vectors with
    an even sum, and the same moved by a half in every coordinate."""

    def even(y: np.ndarray) -> np.ndarray:
        point = np.rint(y)
        off = y - point
        odd = np.flatnonzero(point.sum(axis=1) % 2 != 0)
        # The coordinate rounded furthest goes to its second nearest integer.
        at = np.abs(off[odd]).argmax(axis=1)
        point[odd, at] += np.where(off[odd, at] >= 0, 1.0, -1.0)
        return point

    whole, half = even(x), even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


@cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    halves = (np.array(s) for s in itertools.product((0.5, -0.5), repeat=8))
    return np.array(found + [s for s in halves if (s < 0).sum() % 2 == 0])


@cache
def projection(table: int, dims: int) -> np.ndarray:
    """Whole numbers, in units of 2^-16 cells."""
    return np.rint(np.random.default_rng([table, dims]).normal(size=(dims, 8)) * (2**16 / WIDTH))


def _packed(points: np.ndarray, table: int) -> np.ndarray:
    """Lattice points as integers: seven bits a coordinate, above them the
    table. Coordinates beyond that wrap round, which only adds candidates."""
    doubled = np.rint(points * 2).astype(np.int64) & 127
    return (doubled << (7 * np.arange(8))).sum(axis=-1) + (table << 56)


def cells(unit: np.ndarray, table: int) -> np.ndarray:
    """Of each unit vector the own cell and the ones it looks up. Sums of whole
    numbers below 2^53 are exact in any order, so a vector has the same cells in
    whatever company it is coded."""
    x = np.rint(unit * 2**24) @ projection(table, unit.shape[1]) / 2**40
    own = nearest_e8(x)
    away = (x - own) @ neighbours().T
    nearest = np.argsort(-away, axis=1, kind="stable")[:, :PROBES]
    points = np.concatenate([own[:, None], own[:, None] + neighbours()[nearest]], axis=1)
    return _packed(points, table)


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Equally long binaries as the rows of a matrix of floats."""
    joined = np.frombuffer(b"".join(column.to_pylist()), np.float32 if width == 4 else np.float64)
    return joined.reshape(len(column), -1)


def _coded(width: int):
    """Adds to the nodes of one Arrow batch their vector as bytes and the
    cells of all tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.cumsum(lengths)[:-1]]
            for dims in np.unique(lengths):
                rows = np.flatnonzero(lengths == dims)
                matrix = flat[starts[rows][:, None] + np.arange(dims)]
                unit = units(matrix)
                listed = np.concatenate([cells(unit, t) for t in range(TABLES)], axis=1)
                some = batch.take(pa.array(rows))
                raw = matrix.tobytes()
                step = dims * width
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("node"),
                        some.column("label"),
                        some.column("size"),
                        pa.array([raw[i * step : (i + 1) * step] for i in range(len(rows))], pa.binary()),
                        pa.array(list(listed), pa.list_(pa.int64())),
                    ],
                    ["node", "label", "size", "vector", "cells"],
                )

    return run


class _Rows:
    """Rows of one or more cells of one table, as arrays."""

    def __init__(self, node, size, own, table, unit):
        self.node, self.size, self.own, self.table, self.unit = node, size, own, table, unit

    def __len__(self) -> int:
        return len(self.node)

    def part(self, rows) -> _Rows:
        return _Rows(self.node[rows], self.size[rows], self.own[rows], self.table[rows], self.unit[rows])

    def then(self, other: _Rows) -> _Rows:
        mine, theirs = vars(self).values(), vars(other).values()
        return _Rows(*[np.concatenate([a, b]) for a, b in zip(mine, theirs)])


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1)


def _first_meeting(left: _Rows, i: np.ndarray, right: _Rows, j: np.ndarray) -> np.ndarray:
    """Whether the pairs (owner i of ``left``, visitor j of ``right``), found
    in the cell of i, have not met in an earlier table nor, with the other as
    owner, in this one. Codes are made once per row of a pair."""
    new = np.ones(len(i), bool)
    if not len(i):
        return new
    ui, at_i = np.unique(i, return_inverse=True)
    uj, at_j = np.unique(j, return_inverse=True)
    tables = left.table[i]
    for table in range(int(tables.max()) + 1):
        of_i, of_j = cells(left.unit[ui], table)[at_i], cells(right.unit[uj], table)[at_j]
        j_visits = (of_j == of_i[:, :1]).any(axis=1)
        i_visits = (of_i == of_j[:, :1]).any(axis=1)
        new &= ~((table < tables) & (j_visits | i_visits))
        # Met both ways in this table: the smaller node's cell counts.
        new &= ~((table == tables) & i_visits & (left.node[i] > right.node[j]))
    return new


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that the links (a, b) reach from each of n rows."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _found(rows: _Rows, a: np.ndarray, b: np.ndarray, counted: np.ndarray) -> pa.RecordBatch | None:
    """What a set of verified pairs says of its rows: per row the partners
    counted here, weighted by size, and a member of its component."""
    if not len(a):
        return None
    links = np.zeros(len(rows), np.int64)
    np.add.at(links, a[counted], rows.size[b[counted]])
    np.add.at(links, b[counted], rows.size[a[counted]])
    root = _roots(len(rows), a, b)
    touched = np.unique(np.concatenate([a, b]))
    return pa.RecordBatch.from_arrays(
        [pa.array(rows.node[touched]), pa.array(rows.node[root[touched]]), pa.array(links[touched])],
        ["node", "root", "links"],
    )


def _dense(owners: _Rows, visitors: _Rows, among: bool) -> Iterator[pa.RecordBatch]:
    """Compares a block of owners with visitors, or with itself, a bounded
    number of rows at a time."""
    for at in range(0, len(visitors), CHUNK):
        some = visitors.part(slice(at, at + CHUNK))
        cosine = owners.unit @ some.unit.T
        i, j = np.nonzero(cosine >= LINKED - CLOSE)
        if among:
            later = i < j + at
            i, j = i[later], j[later]
        value = cosine[i, j]
        near = value < LINKED + CLOSE
        value[near] = _cosines(owners.unit[i[near]], some.unit[j[near]])
        i, j = i[value >= LINKED], j[value >= LINKED]
        if among:
            i, j = _ordered(owners, i, some, j, at)
            counted = _first_meeting(owners, i, owners, j)
            batch = _found(owners, i, j, counted)
        else:
            counted = _first_meeting(owners, i, some, j)
            batch = _found(owners.then(some), i, j + len(owners), counted)
        if batch is not None:
            yield batch


def _ordered(owners: _Rows, i: np.ndarray, some: _Rows, j: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of owners with the smaller node first, both by row of the block."""
    j = j + at
    swap = owners.node[i] > owners.node[j]
    return np.where(swap, j, i), np.where(swap, i, j)


def _short(rows: _Rows, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Groups of few rows, all at once: each row with the ones after it."""
    sizes = ends - starts
    left, right = [], []
    for shift in range(1, int(sizes.max(initial=0))):
        s, e = starts[sizes > shift], ends[sizes > shift]
        n = e - s - shift
        at = np.repeat(s - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        # Owners come first, so a pair with an owner has one on the left.
        at = at[rows.own[at]]
        for part in np.array_split(at, max(1, len(at) * rows.unit.shape[1] // (1 << 22))):
            met = part[_cosines(rows.unit[part], rows.unit[part + shift]) >= LINKED]
            left.append(met)
            right.append(met + shift)
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        swap = rows.own[b] & (rows.node[a] > rows.node[b])
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        batch = _found(rows, a, b, _first_meeting(rows, a, rows, b))
        if batch is not None:
            yield batch


def _meetings(width: int):
    """Partners and links of rows sorted by (label, dims, cell, block, owners
    first). A group not over at the end of a batch is carried on: its rows while
    it is small, else its owners only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # a small group that may go on: key, rows
        owners = key = None  # a large group in progress

        def feed(rows: _Rows):
            nonlocal owners
            mine = rows.part(rows.own)
            if len(mine):
                yield from _dense(mine, mine, True)
                if owners is not None:
                    yield from _pairs_between(owners, mine)
                owners = mine if owners is None else owners.then(mine)
            visitors = rows.part(~rows.own)
            if owners is not None and len(visitors):
                yield from _dense(owners, visitors, False)

        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in KEY], axis=1)
            cell = group[:, 2]
            change = np.r_[True, (group[1:] != group[:-1]).any(axis=1)]
            starts = np.flatnonzero(change)
            ends = np.r_[starts[1:], len(group)]
            # One matrix per length of vectors; lengths change with the group.
            raw = batch.column("vector")
            lengths = np.diff(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1])
            own = batch.column("own").to_numpy(zero_copy_only=False)
            node = batch.column("node").to_numpy(zero_copy_only=False)
            size = batch.column("size").to_numpy(zero_copy_only=False)

            def rows_of(lo: int, hi: int) -> _Rows:
                unit = units(_matrix(raw.slice(lo, hi - lo), width))
                return _Rows(node[lo:hi], size[lo:hi], own[lo:hi], (cell[lo:hi] >> 56).astype(int), unit)

            first = 0
            opening = tuple(group[0])
            if key is not None and key == opening:
                yield from feed(rows_of(0, ends[0]))
                first = 1
            elif held is not None and held[0] == opening:
                rows = held[1].then(rows_of(0, ends[0]))
                held, first = None, 1
                if len(starts) == 1 and len(rows) <= SMALL:
                    held = (opening, rows)
                elif len(rows) <= SMALL:
                    yield from _short(rows, np.array([0]), np.array([len(rows)]))
                else:
                    owners, key = None, opening
                    yield from feed(rows)
            elif held is not None:
                yield from _short(held[1], np.array([0]), np.array([len(held[1])]))
                held = None
            if first == len(starts):
                continue
            owners = key = None
            last = len(starts) - 1
            sizes = ends - starts
            # Groups that lie whole in the batch, have an owner and two rows.
            whole = np.arange(first, last)
            whole = whole[own[starts[whole]] & (sizes[whole] > 1)]
            small = whole[sizes[whole] <= SMALL]
            for dims in np.unique(lengths[starts[small]]):
                some = small[lengths[starts[small]] == dims]
                picked = np.concatenate([np.arange(starts[g], ends[g]) for g in some])
                unit = units(_matrix(raw.take(pa.array(picked)), width))
                rows = _Rows(node[picked], size[picked], own[picked], (cell[picked] >> 56).astype(int), unit)
                stop = np.cumsum(sizes[some])
                yield from _short(rows, stop - sizes[some], stop)
            for g in whole[sizes[whole] > SMALL]:
                owners = None
                yield from feed(rows_of(starts[g], ends[g]))
            owners = None
            tail = rows_of(starts[last], ends[last])
            if len(tail) <= SMALL:
                held = (tuple(group[-1]), tail)
            else:
                key = tuple(group[-1])
                yield from feed(tail)
        if held is not None:
            yield from _short(held[1], np.array([0]), np.array([len(held[1])]))

    return run


def _pairs_between(before: _Rows, mine: _Rows) -> Iterator[pa.RecordBatch]:
    """Owners of one block that came in two batches."""
    both = before.then(mine)
    for at in range(0, len(mine), CHUNK):
        some = mine.part(slice(at, at + CHUNK))
        i, j = np.nonzero(before.unit @ some.unit.T >= LINKED - CLOSE)
        met = _cosines(before.unit[i], some.unit[j]) >= LINKED
        i, j = i[met], j[met] + len(before) + at
        swap = both.node[i] > both.node[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        batch = _found(both, i, j, _first_meeting(both, i, both, j))
        if batch is not None:
            yield batch


def _in_blocks(coded: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per node and cell it is at home in or looks up; the vectors of
    a full cell are at home in one of its blocks and visit the others."""
    large = scratch.keep(
        coded.select("label", "dims", F.explode(F.expr(f"transform(sequence(0, {TABLES - 1}), t -> cells[t * {PROBES + 1}])")).alias("cell"))
        .groupBy("label", "dims", "cell")
        .count()
        .where(F.col("count") > BLOCK)
        .select("label", "dims", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    )
    # Few cells are full; they are broadcast while they fit into some megabytes.
    side = F.broadcast(large) if large.count() <= 50_000 else large
    rows = coded.select(
        "label", "dims", "node", "size", "vector", F.posexplode("cells").alias("_at", "cell")
    ).join(side, ["label", "dims", "cell"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    home = F.pmod(F.xxhash64("node"), blocks).cast("int")
    return rows.select(
        "label",
        "dims",
        "cell",
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"),
        "node",
        "size",
        "vector",
        (F.col("_at") % (PROBES + 1) == 0).alias("own"),
        home.alias("_home"),
    ).withColumn("own", F.col("own") & (F.col("block") == F.col("_home"))).drop("_home")


def near_vectors(
    table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row.

    Vectors of one label are linked where their cosine is 0.98 or more:
    ``n_links`` counts the other rows linked directly, ``component_id`` is the
    smallest id that links reach, itself included, and ``kept`` tells whether it is
    the row's own. Labels are whole numbers; a NULL label, a vector that is NULL,
    empty, zero or has a NULL or non-finite part links with nothing, and vectors
    of different lengths do not link. Repeated rows link with each other. A NULL id
    is no candidate for ``component_id`` and is kept only if it is linked with no
    row that has an id. An empty table gives no rows; other columns are not read.
    """
    kinds = dict(table.dtypes)
    if kinds[label] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"labels are whole numbers, not {kinds[label]}")
    width = 4 if kinds[embedding] == "array<float>" else 8
    wide = "array<float>" if width == 4 else "array<double>"
    rows = table.select(
        F.col(vec_id).alias("vec_id"),
        F.col(embedding).cast(wide).alias("embedding"),
        F.col(label).cast("bigint").alias("label"),
    )
    # NULL parts and labels give NULL, which counts as no.
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = finite & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull()
    able = F.coalesce(sound, F.lit(False))
    with Scratch(table.sparkSession) as scratch:
        nodes = scratch.keep(
            rows.where(able)
            .groupBy("label", "embedding")
            .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("size"))
            .withColumn("node", F.monotonically_increasing_id())
        )
        coded = nodes.select("node", "label", "size", "embedding").mapInArrow(
            _coded(width), "node bigint, label bigint, size bigint, vector binary, cells array<bigint>"
        )
        coded = scratch.keep(coded.withColumn("dims", (F.length("vector") / width).cast("bigint")))
        met = _in_blocks(coded, scratch)
        met = met.repartition(*KEY).sortWithinPartitions(*KEY, F.col("own").desc())
        found = scratch.keep(
            met.mapInArrow(_meetings(width), "node bigint, root bigint, links bigint")
            .groupBy("node", "root")
            .agg(F.sum("links").alias("links"))
        )
        roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch.keep)
        placed = (
            nodes.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
            .join(roots, "node", "left")
            .withColumn("root", F.coalesce("root", "node"))
        )
        placed = scratch.keep(placed)
        smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
        classes = placed.join(smallest, "root").select(
            F.col("label").alias("_label"),
            F.col("embedding").alias("_embedding"),
            (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
            "component_id",
        )
        same = (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding"))
        linked = rows.where(able).join(classes, same)
        alone = rows.where(~able).select(
            "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
        )
        every = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
        return cut(every.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
