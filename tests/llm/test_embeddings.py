import itertools

import duckdb
import numpy as np
import pytest

from wordweave.llm import lattice, queries, sql

SCHEMA = "vec_id long, embedding array<float>, label int, node string, cells string, links string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(3)


def brute(rows):
    """(vec_id, n_links, component_id, kept) of each row, by comparing all."""

    def able(r):
        return (
            r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
        )

    def linked(r, s):
        if not (able(r) and able(s)) or r[2] != s[2] or len(r[1]) != len(s[1]):
            return False
        a, b = (np.array(x[1], np.float32).astype(float) for x in (r, s))
        return (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()) >= lattice.LINKED

    n = len(rows)
    met = [[j for j in range(n) if j != i and linked(rows[i], rows[j])] for i in range(n)]
    out = []
    for i in range(n):
        seen, queue = {i}, [i]
        while queue:
            for j in met[queue.pop()]:
                if j not in seen:
                    seen.add(j)
                    queue.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((rows[i][0], len(met[i]), least, rows[i][0] == least))
    return sorted(out, key=repr)


def found(table):
    got = lattice.near_vectors(table)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def clusters(rng, sizes, dims, spread):
    """Vectors around random centres, with labels in turn."""
    rows = []
    for label, size in enumerate(sizes):
        centre = rng.normal(size=dims)
        for _ in range(size):
            v = centre + spread * np.linalg.norm(centre) / np.sqrt(dims) * rng.normal(size=dims)
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], label % 2))
    return rows


def test_lattice_points_are_the_nearest():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)) * 2
    points = lattice.nearest_e8(x)
    assert ((points * 2) % 2 == (points[:, :1] * 2) % 2).all() and (points.sum(axis=1) % 2 == 0).all()
    # No neighbour of the point is nearer, and the covering radius is one.
    away = ((x - points) ** 2).sum(axis=1)
    assert away.max() <= 1 + 1e-9
    for v in lattice.neighbours():
        assert (((x - points - v) ** 2).sum(axis=1) >= away - 1e-9).all()
    roots = lattice.neighbours()
    assert len(np.unique(roots, axis=0)) == 240 and ((roots**2).sum(axis=1) == 2).all()


def test_cells_do_not_depend_on_company():
    unit = lattice.units(np.random.default_rng(2).normal(size=(500, 64)))
    together = lattice.cells(unit, 3)
    alone = np.concatenate([lattice.cells(unit[i : i + 1], 3) for i in range(500)])
    assert (together == alone).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0], 1),
        (2, [2.0, 0.0, 0.0], 1),
        (3, [1.0, 0.0, 0.0], 2),
        (4, [1.0, 0.0, 0.0], None),
        (5, None, 1),
        (6, [], 1),
        (7, [0.0, 0.0, 0.0], 1),
        (8, [1.0, None, 0.0], 1),
        (9, [1.0, nan, 0.0], 1),
        (10, [inf, 0.0, 0.0], 1),
        (11, [1.0, 0.0], 1),
        (12, [1.0, 0.01, 0.0], 1),
        (12, [1.0, 0.01, 0.0], 1),
        (None, [1.0, 0.0, 0.001], 1),
        (None, [0.0, 1.0, 0.0], 1),
        (13, [-1.0, 0.0, 0.0], 1),
        (14, [3e38, 3e38, 0.0], 3),
        (15, [1e-38, 1e-38, 0.0], 3),
        (16, [0.0, -0.0, 1.0], 4),
        (17, [-0.0, 0.0, 1.0], 4),
    ]
    assert found(frame(spark, rows)) == brute(rows)
    assert found(frame(spark, rows).limit(0)) == []


def test_copies_count_as_links(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(200)] + [(200 + i, [1.0, 2.0, 3.01], 1) for i in range(50)]
    assert found(frame(spark, rows)) == [(i, 249, 0, i == 0) for i in sorted(range(250), key=lambda i: repr((i, 249)))]


@pytest.mark.parametrize("block, small, chunk", [(2048, 24, 256), (7, 2, 3), (40, 1, 11)])
def test_dense_groups_and_chains(spark, monkeypatch, block, small, chunk):
    for name, value in (("BLOCK", block), ("SMALL", small), ("CHUNK", chunk)):
        monkeypatch.setattr(lattice, name, value)
    rng = np.random.default_rng(11)
    rows = clusters(rng, [60, 25, 3, 1, 1, 2], 16, 0.09)
    # A chain whose ends are far apart.
    base, side = rng.normal(size=(2, 16))
    side -= base * (base @ side) / (base @ base)
    side *= np.linalg.norm(base) / np.linalg.norm(side)
    for k in range(40):
        v = np.cos(k * 0.05) * base + np.sin(k * 0.05) * side
        rows.append((1000 - k, [float(x) for x in v.astype(np.float32)], 1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got, expected = found(frame(spark, rows)), brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # Six tables miss hardly any pair, and never add one.
    links = [sum(r[1] for r in rs) for rs in (got, expected)]
    assert 0.99 * links[1] <= links[0] <= links[1]
    assert [r[0] for r in got] == [r[0] for r in expected]
    assert all(a[1] <= b[1] for a, b in zip(sorted(got, key=lambda r: r[0]), sorted(expected, key=lambda r: r[0])))
    if links[0] == links[1]:
        assert got == expected


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    a, b = (lattice.units(rng.normal(size=(4000, 64))) for _ in range(2))
    b = lattice.units(b - (a * b).sum(axis=1, keepdims=True) * a)
    b = lattice.LINKED * a + np.sqrt(1 - lattice.LINKED**2) * b
    met = np.zeros(4000, bool)
    for table in range(lattice.TABLES):
        x, y = lattice.cells(a, table), lattice.cells(b, table)
        met |= (x == y[:, :1]).any(axis=1) | (y == x[:, :1]).any(axis=1)
    assert met.mean() > 0.995


def test_labels_are_numbers(spark):
    with pytest.raises(ValueError):
        lattice.near_vectors(spark.createDataFrame([(1, [1.0], "a")], "vec_id long, embedding array<float>, label string"))


def test_doubles_and_other_names(spark):
    rows = [(1, [1.0, 0.0], 5), (2, [1.0, 0.1], 5), (3, [0.0, 1.0], 5)]
    table = spark.createDataFrame(rows, "k long, v array<double>, g long")
    got = {tuple(r) for r in lattice.near_vectors(table, "k", "v", "g").collect()}
    assert got == {(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)}


def test_sql_counts_the_same(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, v, label) for i, v, label in clusters(rng, [30, 20, 1, 1], 8, 0.08)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(
        f"{tmp_path}/embeddings.parquet"
    )
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    theirs = sorted(db.execute(sql.near_vectors()).fetchall(), key=repr)
    ours = sorted((tuple(r) for r in queries.op12_embeddings(spark, str(tmp_path)).collect()), key=repr)
    assert [(r[0], r[2], r[3]) for r in ours] == [(r[0], r[2], r[3]) for r in theirs]
    assert sum(r[1] for r in ours) >= 0.99 * sum(r[1] for r in theirs)


def test_pairs_meet_once():
    """However many cells find a pair, one of them counts it."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=8)
    unit = lattice.units(base + 0.05 * rng.normal(size=(30, 8)))
    node = rng.permutation(30)
    counted = {p: 0 for p in itertools.combinations(range(30), 2)}
    listed = {t: lattice.cells(unit, t) for t in range(lattice.TABLES)}
    for t, at in listed.items():
        for i, j in itertools.permutations(range(30), 2):
            same = at[i, 0] == at[j, 0]
            if at[i, 0] not in at[j] or (same and node[i] > node[j]):
                continue
            rows = lattice._Rows(node, np.ones(30, int), np.ones(30, bool), np.full(30, t), unit)
            first = lattice._first_meeting(rows, np.array([i]), rows, np.array([j]))
            counted[min(i, j), max(i, j)] += int(first[0])
    meet = {
        (i, j): any(a[i, 0] in a[j] or a[j, 0] in a[i] for a in listed.values()) for i, j in counted
    }
    assert counted == {p: int(m) for p, m in meet.items()}
