import hashlib
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from wordweave.operators import transitions as tr

PAIRS = {
    ("The", "cat"): 2, ("cat", "sat"): 1, ("cat", "ran"): 1, ("sat", ""): 1, ("ran", ""): 1,
    ("Nyt", "dog"): 1, ("dog", ""): 1, ("Hi", ""): 1,
}


def as_dict(frame):
    return {(r.w1, r.w2): r.cnt for r in frame.collect()}


@pytest.fixture
def counts(lines):
    return tr.pair_counts(tr.sentence_pairs(lines))


def test_sentence_pairs(counts):
    assert as_dict(counts) == PAIRS


def test_start_pairs(counts):
    assert as_dict(tr.sequential_starts(counts)) == {("The", "cat"): 2, ("Nyt", "dog"): 1}
    assert as_dict(tr.population_starts(counts)) == {
        ("The", "cat"): 2, ("Nyt", "dog"): 1, ("Hi", ""): 1,
    }


def test_swapped(counts):
    assert tr.swapped(counts).columns == ["w2", "w1", "cnt"]


@pytest.fixture
def skewed(spark):
    """One word owns most rows."""
    rows = [("hot", f"w{i}", 1 + i * i % 37) for i in range(700)]
    rows += [("hot", "heavy", 5000)] + [(f"w{i}", "hot", 3) for i in range(50)]
    return spark.createDataFrame(rows, "w1 string, w2 string, cnt long")


@pytest.mark.parametrize("together, few", [(20_000, 1000), (100, 1000), (100, 0), (0, 1000)])
def test_one_order_for_every_word(spark, monkeypatch, together, few):
    """A word of 5 and one of 5,000 successors follow the same rule however
    the work is laid out, and the end comes last."""
    monkeypatch.setattr(tr, "TOGETHER", together)
    monkeypatch.setattr(tr, "FEW", few)
    rows = [("few", f"w{i}", 1) for i in range(4)] + [("many", f"w{i}", 2) for i in range(4999)]
    rows += [("few", "", 3), ("many", "", 3)]
    counts = spark.createDataFrame(rows, "w1 string, w2 string, cnt long")
    by_word, spans, totals = defaultdict(list), defaultdict(list), {}
    for r in tr.with_intervals(counts).collect():
        by_word[r.w1].append((r.lo, r.w2))
        spans[r.w1].append((r.lo, r.hi))
        totals[r.w1] = r.tot
        assert r.n == {"few": 5, "many": 5000}[r.w1]
    for word in by_word:
        got = [w for _, w in sorted(by_word[word])]
        assert got == sorted(got, key=lambda w: (w == "", hashlib.md5(w.encode()).hexdigest(), w))
        assert sum(r[1] - r[0] for r in spans[word]) == totals[word]


def test_intervals_tile_without_gap(skewed):
    by_word = defaultdict(list)
    for r in tr.with_intervals(skewed).collect():
        by_word[r.w1].append((r.lo, r.hi, r.cnt, r.tot, r.n))
    for rows in by_word.values():
        rows.sort()
        assert [r[0] for r in rows] == [0] + [r[1] for r in rows[:-1]]
        assert all(hi - lo == cnt for lo, hi, cnt, _, _ in rows)
        assert all((tot, n) == (rows[-1][1], len(rows)) for *_, tot, n in rows)


@pytest.mark.parametrize("bucket_rows", [1, 7, 64])
def test_buckets_hold_every_draw_once(skewed, monkeypatch, bucket_rows):
    monkeypatch.setattr(tr, "BUCKET_ROWS", bucket_rows)
    everything = F.lit(skewed.agg(F.sum("cnt")).first()[0])
    totals = {r.cur: (r.tot, r.width) for r in tr.word_totals(skewed, everything).collect()}
    listed = tr.bucketed(tr.with_intervals(skewed), everything).collect()
    seen = defaultdict(list)
    for r in listed:
        assert (r.tot, r.width) == totals[r.w1]
        low, high = max(r.lo, r.bucket * r.width), min(r.hi, (r.bucket + 1) * r.width)
        assert low < high
        seen[r.w1].append((low, high))
    for word, parts in seen.items():
        parts.sort()
        assert [p[0] for p in parts] == [0] + [p[1] for p in parts[:-1]]
        assert parts[-1][1] == totals[word][0]
    assert len(listed) <= 2 * skewed.count() + len(totals) + tr.SPREAD


def test_draws_of_a_hot_word_spread(spark):
    """Two successors and nearly all of the weight: many parts."""
    rows = [("hot", "a", 500_000), ("hot", "b", 400_000)] + [(f"w{i}", "x", 1) for i in range(100)]
    counts = spark.createDataFrame(rows, "w1 string, w2 string, cnt long")
    everything = F.lit(900_100)
    parts = tr.bucketed(tr.with_intervals(counts), everything).where("w1 = 'hot'")
    assert parts.select("bucket").distinct().count() > 900
    assert tr.bucketed(tr.with_intervals(counts), everything).where("w1 = 'w1'").count() == 1


def test_the_end_is_spread_in_the_step_table(spark):
    """No row of the end takes part in the join with the totals of words."""
    rows = [(f"w{i}", "", 1) for i in range(300)] + [("w1", "w2", 5)]
    counts = spark.createDataFrame(rows, "w1 string, w2 string, cnt long")
    everything = F.lit(305)
    table = tr.step_table(tr.with_intervals(counts), tr.word_totals(counts, everything), everything)
    got = {(r.w1, r.nxt): (r.nxt_tot, r.nxt_open) for r in table.collect()}
    assert got["w1", "w2"] == (1, 0) and got["w5", ""] == (None, None)
    assert len(got) == 301


def brute_paths(pairs, steps):
    """All paths of ``steps`` pairs with their multiplicity."""
    paths = Counter({k: c for k, c in pairs.items()})
    for _ in range(steps - 1):
        longer = Counter()
        for (path, c), ((a, b), n) in product(paths.items(), pairs.items()):
            if path[-1] == a:
                longer[(*path, b)] += c * n
        paths = longer
    return paths


def test_enumerated_paths_equal_brute_force(counts):
    got = {tuple(r.words): r.multiplicity for r in tr.enumerate_paths(counts, counts, 2).collect()}
    assert got == dict(brute_paths(PAIRS, 3))


def test_path_counts_equal_brute_force(counts):
    for steps in (1, 2, 3):
        want = Counter()
        for path, c in brute_paths(PAIRS, steps).items():
            want[path[0]] += c
        assert {r.w1: int(r.paths) for r in tr.path_counts(counts, steps).collect()} == want


def test_temperature_weights(spark):
    rows = [("a", "x", 6), ("a", "y", 4), ("b", "x", 1), ("b", "z", 1)]
    counts = spark.createDataFrame(rows, "w1 string, w2 string, cnt long")

    def weights(temperature):
        return {(r.w1, r.w2): r.weight for r in tr.with_temperature(counts, temperature).collect()}

    full = 10**9
    assert weights(1.0) == {("a", "x"): full, ("a", "y"): round(full * 4 / 6), ("b", "x"): full, ("b", "z"): full}
    assert weights(0.5)["a", "y"] == round(full * (4 / 6) ** 2)
    assert weights(0.05)["a", "y"] == round(full * (4 / 6) ** 20)
    # (4/6)**100 and less is below the scale: the best successor is left alone.
    for cold in (0.01, 0.001):
        assert weights(cold) == {("a", "x"): full, ("b", "x"): full, ("b", "z"): full}
    with pytest.raises(ValueError):
        tr.with_temperature(counts, 0.0)


def test_pairs_need_no_shuffle(lines):
    plan = tr.sentence_pairs(lines)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_places_number_the_pairs(lines):
    placed = tr.sentence_pairs_with_place(lines, ["doc_id", "line_no"])
    assert placed.where("line_no = 0").orderBy("pos").select(F.collect_list("w1")).first()[0] == [
        "The", "cat", "sat",
    ]


def test_every_path_to_the_chosen_words_is_listed(spark, tmp_path):
    """More than a few of a first word, with their multiplicities."""
    from wordweave.plans import catalog

    text = "\n".join(f"Go a{i} b{i} idiot" for i in range(9)) + "\nGo a0 b0 idiot"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.words: r.multiplicity for r in catalog.path_enumeration_words(spark, str(tmp_path)).collect()}
    assert got == {f"Go a{i} b{i} idiot": 8 if i == 0 else 1 for i in range(9)}


def test_temperature_sorts_no_pairs(spark):
    counts = spark.createDataFrame([("a", "x", 6), ("a", "y", 4)], "w1 string, w2 string, cnt long")
    plan = tr.with_temperature(counts, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort " not in plan


def test_heaviest_paths_leave_their_result_only(spark, monkeypatch):
    """Levels lie in a scratch folder; many equal paths stay in the order of their words."""
    stored = []
    monkeypatch.setattr(tr, "cut", lambda frame, cut=tr.cut: stored.append(cut(frame)) or stored[-1])
    pairs = {(a, b): 1 + (ord(a) * ord(b or "z")) % 2 for a in "abcde" for b in ["a", "b", "c", "d", "e", ""] if a != b}
    counts = spark.createDataFrame([(*p, c) for p, c in pairs.items()], "w1 string, w2 string, cnt long")
    got = tr.heaviest_paths(counts, counts.where("w2 = ''"), 2, 3).collect()
    want = []
    for first in "abcde":
        paths = [(-c, p) for p, c in brute_paths(pairs, 3).items() if p[0] == first and p[-1] == ""]
        want += [(p, rank, -c) for rank, (c, p) in enumerate(sorted(paths)[:3], 1)]
    assert sorted((tuple(r.words), r["rank"], int(r.multiplicity)) for r in got) == sorted(want)
    assert len(stored) == 1
