"""Walks against a plain Python walk that follows the same draws."""

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wordweave.operators import sequence as sq
from wordweave.operators import transitions as tr
from wordweave.operators import walk as wk
from wordweave.session import Scratch, shared_folder

TEXT = """the cat sat on the mat
the dog sat on the cat
A cat ran to the dog and the cat
Dogs ran
NYT says the dog ran to the mat
the mat
Stop"""
KEYS = ["doc_id", "line_no"]


def draw(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def digest(*parts):
    return hashlib.md5("|".join(parts).encode()).hexdigest()


def sentence_pairs():
    for line_no, line in enumerate(TEXT.split("\n")):
        words = line.split()
        words = [words[0].capitalize(), *words[1:], ""]
        for pos, pair in enumerate(zip(words, words[1:])):
            yield f"1-{line_no}-{pos}", pair


PAIRS = Counter(pair for _, pair in sentence_pairs())


class Model:
    def __init__(self, pairs):
        self.next = defaultdict(list)
        for (a, b), c in sorted(pairs.items(), key=lambda e: (e[0][1] == "", digest(e[0][1]))):
            self.next[a].append((b, c))

    def step(self, path_id, step, cur, seed):
        options = self.next.get(cur)
        if not options:
            return None
        at = draw(seed, path_id, step) % sum(c for _, c in options)
        for word, c in options:
            if at < c:
                return word
            at -= c


def pick(candidates, path_id, seed):
    at = draw(seed, path_id, "start") % sum(candidates.values())
    for item, c in sorted(candidates.items(), key=lambda e: (digest(*e[0]), e[0])):
        if at < c:
            return item
        at -= c


@pytest.fixture
def lines(spark):
    return spark.createDataFrame(
        [(1, i, t) for i, t in enumerate(TEXT.split("\n"))], "doc_id long, line_no int, text string"
    )


def sequential(entries, max_length, min_length, seed):
    full = Model(PAIRS)
    going = Model({p: c for p, c in PAIRS.items() if p[1] != ""})
    starts = {p: c for p, c in PAIRS.items() if p[0][0].isupper() and p[1] != ""}
    for path_id in range(entries):
        first, second = pick(starts, path_id, seed)
        words, cur = [first], second
        for step in range(max_length):
            if cur == "":
                break
            nxt = (going if step < min_length else full).step(path_id, step, cur, seed)
            if nxt is None:
                words, cur = [first], second
            else:
                words, cur = [*words, cur], nxt
        yield path_id, " ".join(words) + ("." if cur == "" else "")


@pytest.mark.parametrize("min_length", [0, 3])
def test_sequential(lines, table, min_length):
    got = table(wk.sequential(lines, 40, 6, min_length, seed=3))
    assert got == list(sequential(40, 6, min_length, 3))
    assert all(len(s.split()) <= 7 for _, s in got)


def start_population(target, seed):
    starts = [(i, p) for i, p in sentence_pairs() if p[0][0].isupper()]
    return {i: list(p) for i, p in starts if draw(seed, i) % len(starts) < target}


def population(entries, min_length, max_length, start, seed):
    model, out = Model(PAIRS), {}
    last = live = start_population(start, seed)
    for step in range(max_length):
        last = {}
        for i, words in live.items():
            nxt = model.step(i, step, words[-1], seed)
            if nxt is not None:
                last[i] = [*words, nxt]
        size = len(last)
        if size > start:
            last = {i: w for i, w in last.items() if draw(seed, i, step, "cap") % size < start}
        if step >= min_length:
            done = {i: w for i, w in last.items() if w[-1] == ""}
            out |= done
            entries -= len(done)
            last = {i: w for i, w in last.items() if w[-1] != ""}
        if size < entries:
            break
        live = {i: w for i, w in last.items() if w[-1] != ""}
    for i, words in {**out, **last}.items():
        clean = [w for w in words if w]
        yield i, len(clean), " ".join(clean) + ("." if words[-1] == "" else ""), words[-1] == ""


@pytest.mark.parametrize(
    "entries, min_length, max_length, start, seed",
    [(2, 1, 5, 100, 1), (100, 0, 5, 100, 1), (1, 4, 3, 100, 2), (1, 1, 6, 3, 4), (1, 1, 6, 3, 5)],
)
def test_population(lines, table, entries, min_length, max_length, start, seed):
    got = table(wk.population(lines, KEYS, entries, min_length, max_length, start, seed))
    assert got == sorted(population(entries, min_length, max_length, start, seed))


def test_collapsing(lines, table):
    seed, steps, model = 9, 3, Model(PAIRS)
    paths = start_population(100, seed)
    for step in range(steps):
        by_word = defaultdict(list)
        for i, words in paths.items():
            if words[-1] != "":
                key = hashlib.md5(f"{seed}|{i}|{step}|keep".encode()).hexdigest()
                by_word[words[-1]].append((key, i))
        kept = [min(group)[1] for group in by_word.values()]
        paths = {i: [*paths[i], model.step(i, step, paths[i][-1], seed)] for i in kept}
    want = sorted(
        (i, " ".join(x for x in w if x) + ("." if w[-1] == "" else "")) for i, w in paths.items()
    )
    got = table(wk.collapsing(lines, KEYS, 100, steps, seed))
    assert got == want
    assert all(len(s.replace(".", " .").split()) == steps + 2 for _, s in got)


def flat_frames(lines):
    items = sq.units(lines, KEYS)
    pairs = tr.pair_counts(sq.flat_pairs(items, KEYS))
    counts = items.select(F.explode("items").alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))
    return pairs, counts


def test_flat(lines, table):
    numbered = sorted(enumerate(TEXT.split("\n")), key=lambda e: (digest("1", str(e[0])), e[0]))
    words = [w for _, line in numbered for w in line.split()]
    model = Model(Counter(zip(words, words[1:])))
    freq = {(w,): c for w, c in Counter(words).items()}
    want = []
    for path_id in range(30):
        chain = [pick(freq, path_id, 2)[0]]
        for step in range(5):
            nxt = model.step(path_id, step, chain[-1], 2)
            if nxt is None:
                break
            chain.append(nxt)
        want.append((path_id, chain))
    assert table(wk.flat(*flat_frames(lines), 30, 5, seed=2)) == want


def test_same_seed_same_paths_in_any_layout(spark, lines, table, monkeypatch):
    want = table(wk.sequential(lines, 20, 5, seed=1))
    monkeypatch.setattr(tr, "BUCKET_ROWS", 1)
    assert table(wk.sequential(lines.repartition(5), 20, 5, seed=1)) == want
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert table(wk.sequential(lines, 20, 5, seed=1)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert table(wk.sequential(lines, 20, 5, seed=2)) != want


@pytest.mark.parametrize("size, join", [(3, "BroadcastHashJoin"), (10**9, "SortMergeJoin")])
def test_step_never_shuffles_the_table(spark, lines, size, join):
    """Few paths are sent to the table; many are shuffled to its buckets, in a
    join that can spill."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with Scratch(spark) as scratch:
            counts = scratch.keep(tr.pair_counts(tr.sentence_pairs(lines)))
            chain = wk.Chain(counts, scratch)
            start = spark.range(3).selectExpr("id AS path_id", "array('The') AS words", "'The' AS cur")
            moved = chain.step(scratch.keep(chain.enter(start)), size, 1, 0)
            plan = moved._jdf.queryExecution().executedPlan().toString()
            assert moved.where("nxt IS NOT NULL").count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert join in plan and "ShuffledHashJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == (join == "SortMergeJoin")


def shared(spark):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    return {p.name for p in folder.iterdir()}


def test_a_walk_leaves_its_result_only(spark, lines):
    before = shared(spark)
    wk.sequential(lines, 5, 4, 2, seed=1)
    left = shared(spark) - before
    assert len(left) == 1 and left.pop().startswith("rdd-")
    assert "wordweave" not in str(spark.sql("SHOW TABLES").collect())


def test_a_failed_walk_leaves_nothing(spark, lines):
    before = shared(spark)
    with pytest.raises(Exception):
        wk.sequential(lines.withColumn("text", F.raise_error(F.lit("no"))), 5, 4)
    with pytest.raises(RuntimeError), Scratch(spark) as scratch:
        scratch.keep(lines)
        raise RuntimeError
    assert shared(spark) == before


def test_a_cold_walk_takes_the_most_frequent_successor(spark, table):
    pairs = spark.createDataFrame([("a", "b", 5), ("a", "c", 4), ("b", "a", 2), ("b", "c", 1), ("c", "a", 1)], "w1 string, w2 string, cnt long")
    counts = tr.with_temperature(pairs, 0.001)
    starts = spark.createDataFrame([("a", 1)], "word string, cnt long")
    made = table(wk.flat(counts, starts, 10, 4, seed=5, weight="weight"))
    assert {tuple(words) for _, words in made} == {("a", "b", "a", "b", "a")}


def test_no_start_gives_no_path(spark):
    lines = spark.createDataFrame([(1, 0, "1 2 3")], "doc_id long, line_no int, text string")
    assert wk.sequential(lines, 5, 3).count() == 0
    assert wk.population(lines, KEYS, 1, 1, 3).count() == 0


def test_packed_rows_hold_every_interval(spark, monkeypatch):
    """One row per word and part, in which each draw finds its successor."""
    monkeypatch.setattr(tr, "BUCKET_ROWS", 3)
    pairs = {("a", f"w{i}"): 1 + i % 4 for i in range(40)} | {("a", ""): 7, ("b", "a"): 2, ("c", ""): 1}
    counts = spark.createDataFrame([(*p, c) for p, c in pairs.items()], "w1 string, w2 string, cnt long")
    everything = F.lit(sum(pairs.values()))
    totals = tr.word_totals(counts, everything)
    table = tr.packed(tr.step_table(tr.with_intervals(counts), totals, everything)).collect()
    assert len({(r.w1, r.bucket) for r in table}) == len(table)
    assert all(list(r.upto) == sorted(r.upto) and len(r.upto) == len(r.ahead) for r in table)
    width = {r.cur: r.width for r in totals.collect()}
    order = sorted((p for p in pairs if p[0] == "a"), key=lambda p: (p[1] == "", digest(p[1])))
    want = [p[1] for p in order for _ in range(pairs[p])]
    draws = spark.createDataFrame([(d, d // width["a"]) for d in range(len(want))], "d long, at long")
    rows = spark.createDataFrame(table).where("w1 = 'a'")
    met = draws.join(rows, draws["at"] == rows["bucket"])
    assert met.count() == len(want)
    got = met.select("d", F.get("ahead", tr.drawn_place(F.col("upto"), F.col("d")))["nxt"].alias("nxt"))
    assert [r.nxt for r in got.orderBy("d").collect()] == want


@pytest.mark.parametrize("size", [1, 2, 3, 63, 64, 65, 1000])
def test_place_of_a_draw(spark, size):
    upto = [3 * i + 2 for i in range(size)]
    asked = [0, 1, 2, 3, upto[-1] - 1, upto[size // 2], upto[size // 2] - 1]
    frame = spark.createDataFrame([(upto, d) for d in asked if d < upto[-1]], "upto array<long>, d long")
    for r in frame.select("d", tr.drawn_place(F.col("upto"), F.col("d")).alias("at")).collect():
        assert upto[r["at"]] > r.d and (r["at"] == 0 or upto[r["at"] - 1] <= r.d)


def test_a_step_joins_one_row_per_path(spark):
    """However many successors a word has."""
    pairs = [("hub", f"s{i}", 1) for i in range(500)] + [(f"s{i}", "hub", 1) for i in range(500)]
    counts = spark.createDataFrame(pairs, "w1 string, w2 string, cnt long")
    with Scratch(spark) as scratch:
        chain = wk.Chain(scratch.keep(counts), scratch)
        paths = spark.range(64).select(F.col("id").alias("path_id"), F.array(F.lit("hub")).alias("words"), F.lit("hub").alias("cur"))
        paths = scratch.keep(chain.enter(paths))
        moved = chain.step(paths, 64, 1, 0)
        assert moved.count() == 64
        assert chain.table.where("w1 = 'hub'").count() <= 500 / tr.BUCKET_ROWS + 1 + tr.SPREAD
        assert chain.table.groupBy("w1", "bucket").count().where("count > 1").isEmpty()


def test_few_paths_walk_alike_without_a_table(spark, lines, table, monkeypatch):
    """Few paths lay out no table of all transitions and draw the same words."""
    laid = []
    monkeypatch.setattr(wk.Scratch, "colocated", lambda *a, f=wk.Scratch.colocated, **b: laid.append(1) or f(*a, **b))
    runs = (
        lambda: table(wk.sequential(lines, 20, 5, 2, seed=1)),
        lambda: table(wk.population(lines, KEYS, 5, 1, 4, 10, seed=1)),
        lambda: table(wk.collapsing(lines, KEYS, 30, 3, seed=1)),
        lambda: table(wk.flat(*flat_frames(lines), 30, 5, seed=2)),
    )
    few = [run() for run in runs]
    assert not laid
    monkeypatch.setattr(wk, "FEW", 0)
    assert [run() for run in runs] == few and len(laid) == len(runs)


def test_few_draws_keep_one_table_of_shards(spark):
    """However many steps were made, the sums of the words reached are one scan."""
    counts = spark.createDataFrame([(a, b, c) for (a, b), c in PAIRS.items()], "w1 string, w2 string, cnt long")
    with Scratch(spark) as scratch:
        chain = wk.FewDraws(scratch.keep(counts), scratch)
        for word in ("The", "cat", "A"):
            reached = chain._reach(spark.createDataFrame([(word,)], "w1 string")).collect()
            assert [r.tot for r in reached] == [sum(c for (a, _), c in PAIRS.items() if a == word)]
        assert "Union" not in chain.shards._jdf.queryExecution().optimizedPlan().toString()
        assert {r.w1 for r in chain.shards.collect()} == {"The", "cat", "A"}
