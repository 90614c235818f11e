"""Stored document frequencies, sketches, exact samples, similar vectors and
heaviest paths."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wordweave.operators import dfstore, sampling, similar, sketches
from wordweave.operators import sequence as sq
from wordweave.operators import termstats as ts
from wordweave.operators import transitions as tr
from wordweave.session import cut


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words[: rng.choice([5, 50, 300])], k=rng.randrange(0, 40)))) for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_merged_counts_equal_recomputed_ones(spark, corpus, tmp_path):
    store = f"{tmp_path}/df"
    low, high = corpus.where("doc_id < 120"), corpus.where("doc_id >= 120")
    dfstore.add(low, store, "low")
    dfstore.add(high, store, "high")
    for _ in range(2):  # A part that is written again counts once.
        dfstore.withdraw(corpus.where("doc_id % 3 = 0"), store, "gone")
    kept = corpus.where("doc_id % 3 <> 0")

    def same(folder, docs):
        assert rows(dfstore.document_frequency(spark, folder)) == rows(ts.document_frequency(docs))
        assert rows(dfstore.inverse_document_frequency(spark, folder)) == rows(ts.inverse_document_frequency(docs))
        assert spark.range(1).select(dfstore.corpus_size(spark, folder)).first()[0] == docs.count()

    same(store, kept)
    dfstore.compacted(spark, store, f"{tmp_path}/small")
    same(f"{tmp_path}/small", kept)
    dfstore.drop(spark, store, "gone")
    same(store, corpus)
    dfstore.withdraw(corpus, store, "all")
    assert dfstore.document_frequency(spark, store).count() == 0


def test_distinct_estimates_lie_within_their_error(spark, corpus):
    units = sq.units(corpus, ["doc_id"])
    exact = units.select(F.explode("items")).distinct().count()
    got = sketches.vocabulary_size(units).first()
    assert abs(got.estimate - exact) <= got.error
    many = spark.range(50_000).select(F.concat_ws("-", F.lit("p"), "id").alias("path_id"))
    got = sketches.population_size(many).first()
    assert abs(got.estimate - 50_000) <= got.error < 2_000
    parts = sketches.distinct_sketch(many.withColumn("part", F.crc32("path_id") % 4), F.col("path_id"), "part")
    assert sketches.estimates(sketches.merged(parts)).first() == got


def test_count_min_is_never_too_low(corpus):
    maker = sketches.CountMin(0.01, 0.01)
    exact = {r.term: r.df for r in ts.document_frequency(corpus).collect()}
    halves = [maker.document_sketch(corpus.where(f"doc_id % 2 = {k}")) for k in (0, 1)]
    sketch = maker.merged(halves[0].unionByName(halves[1]))
    assert rows(sketch) == rows(maker.document_sketch(corpus))
    assert sketch.count() <= maker.rows * maker.width
    terms = ts.document_frequency(corpus).select("term")
    got = {r.term: (r.estimate, r.error) for r in maker.frequencies(sketch, terms).collect()}
    assert got.keys() == exact.keys()
    assert all(exact[t] <= e for t, (e, _) in got.items())
    assert sum(e - exact[t] > bound for t, (e, bound) in got.items()) <= 0.01 * len(exact) + 1
    unknown = terms.limit(1).select(F.lit("nothing").alias("term"))
    assert maker.frequencies(sketch, unknown).first().estimate >= 0
    with pytest.raises(ValueError):
        sketches.CountMin(0.01, 1e-9)


@pytest.mark.parametrize("size", [0, 1, 7, 60, 199, 200, 500])
def test_exact_sample(corpus, size):
    once = rows(sampling.exact_sample(corpus, size, 5, "doc_id"))
    assert len(once) == min(size, 200) and len(set(once)) == len(once)
    assert rows(sampling.exact_sample(corpus.repartition(11), size, 5, "doc_id")) == once
    assert set(once) <= set(rows(sampling.exact_sample(corpus, size + 1, 5, "doc_id")))


def test_exact_sample_with_ties(spark):
    data = [(1, "a")] * 30 + [(1, f"b{i}") for i in range(30)] + [(i, "c") for i in range(2, 40)]
    frame = spark.createDataFrame(data, "k long, v string").repartition(4)
    for size in (1, 15, 40, 61, 97, 98, 99):
        once = rows(sampling.exact_sample(frame, size, 3, "k"))
        assert len(once) == min(size, 98) and not Counter(once) - Counter(data)
        assert rows(sampling.exact_sample(frame.repartition(7), size, 3, "k")) == once


def test_a_sample_is_fair(spark):
    frame = spark.range(300)
    taken = Counter()
    for seed in range(40):
        taken.update(r.id for r in sampling.exact_sample(frame, 30, seed, "id").collect())
    assert sum(taken.values()) == 1200 and max(taken.values()) < 15 and len(taken) > 280


def brute_similar(vectors, threshold):
    norm = {k: math.sqrt(sum(v * v for v in x.values())) for k, x in vectors.items()}
    first = {}
    for k in sorted(vectors):
        first.setdefault(tuple(sorted(vectors[k].items())), k)
    cls = {k: first[tuple(sorted(x.items()))] for k, x in vectors.items()}
    sizes = Counter(cls.values())
    found = defaultdict(dict)
    for a in sizes:
        for b in sizes:
            if a != b:
                dot = sum(v * vectors[b].get(t, 0.0) for t, v in vectors[a].items()) / norm[a] / norm[b]
                if dot >= threshold:
                    found[a][b] = dot
    out = []
    for k in vectors:
        met = found[cls[k]]
        best = min(met, key=lambda b: (-round(met[b], 9), b), default=cls[k])
        out.append((k, cls[k], sizes[cls[k]] - 1, sum(sizes[b] for b in met), best, met.get(best, 0.0)))
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.3, 0.8, 0.999])
def test_similar_vectors_equal_brute_force(spark, threshold):
    rng = random.Random(9)
    vectors = {}
    for k in range(60):
        if k % 5 == 4:
            vectors[k] = dict(vectors[k - 1])
        elif k % 5 == 3:
            vectors[k] = vectors[k - 1] | {"extra": rng.uniform(0.05, 3)}
        else:
            vectors[k] = {f"t{rng.randrange(25)}": rng.choice([1.0, 2.0, -1.5]) for _ in range(rng.randrange(1, 9))}
    data = [(k, t, v) for k, x in vectors.items() for t, v in x.items()]
    frame = spark.createDataFrame([*data, (99, "t1", 0.0)], "k long, term string, value double").repartition(3)
    got = rows(similar.similar(frame, "k", threshold))
    want = brute_similar(vectors, threshold)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want])


def test_few_candidates_are_compared(spark, corpus):
    """Prefixes let through far fewer pairs than there are."""
    tf = ts.term_frequency(corpus, by=["doc_id"])
    members, units = similar.classes(tf, "doc_id", "tf")
    n = units.select("class_id").distinct().count()
    listed = similar.prefixes(units, 0.95).count()
    assert listed < units.count() / 3
    assert similar.candidates(units, 0.95).count() < n * (n - 1) / 2 / 3
    with pytest.raises(ValueError):
        similar.similar_classes(units, 0.0)


@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_pairs_are_compared_in_blocks_and_not_stored(spark, monkeypatch, threshold):
    """Vectors that all share a term: what is stored follows the entries, not the pairs."""
    rng = random.Random(4)
    vectors = {f"k{k:03}": {"every": 1.0 + k % 3, f"t{rng.randrange(12)}": 1.5, f"s{k // 2}": 0.5} for k in range(160)}
    frame = spark.createDataFrame([(k, t, v) for k, x in vectors.items() for t, v in x.items()], "k string, term string, value double")
    stored = []

    def counting(made):
        kept = cut(made)
        stored.append(kept.count())
        return kept

    monkeypatch.setattr(similar, "cut", counting)
    monkeypatch.setattr(similar, "BLOCK_ROWS", 30, raising=False)
    monkeypatch.setattr(similar, "COLUMNS", 2, raising=False)
    monkeypatch.setattr(similar, "PAIRS", 5, raising=False)
    got, want = rows(similar.similar(frame, "k", threshold)), brute_similar(vectors, threshold)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want])
    # Six blocks: every class comes from at most seven comparisons.
    assert max(stored) <= 7 * len(vectors)
    units = similar.classes(frame, "k")[1]
    pairs = rows(similar.similar_classes(units, threshold))
    assert all(a < b for a, b, _ in pairs) and 2 * len(pairs) == sum(r[3] for r in want if r[0] == r[1])


def test_similarity_of_sums(spark):
    """A repeated term of a vector counts as its sum."""
    data = [(1, "a", 1.0), (1, "a", 1.0), (2, "a", 5.0), (3, "a", 2.0), (4, "b", 1.0)]
    frame = spark.createDataFrame(data, "k long, term string, value double")
    got = rows(similar.similar(frame, "k", 0.9))
    assert got == [(1, 1, 1, 1, 2, 1.0), (2, 2, 0, 2, 1, 1.0), (3, 1, 1, 1, 2, 1.0), (4, 4, 0, 0, 4, 0.0)]
    assert similar.similar(frame.limit(0), "k", 0.9).count() == 0


@pytest.mark.parametrize("steps, k", [(0, 5), (1, 2), (2, 5), (3, 5), (3, 1)])
def test_heaviest_paths_equal_brute_force(spark, steps, k):
    rng = random.Random(steps * 10 + k)
    words = [f"w{i}" for i in range(9)]
    pairs = {(a, b): rng.randrange(1, 4) for a in words for b in [*words, ""] if rng.random() < 0.5}
    counts = spark.createDataFrame([(*p, c) for p, c in pairs.items()], "w1 string, w2 string, cnt long")
    ends = counts.where(F.col("w2").isin("", "w3"))
    paths = [((a, b), c) for (a, b), c in pairs.items() if b in ("", "w3")]
    for _ in range(steps):
        paths = [((a, *p), c * m) for (a, b), c in pairs.items() for p, m in paths if p[0] == b]
    by_head = defaultdict(list)
    for p, m in paths:
        by_head[p[0]].append((-m, p))
    want = sorted((list(p), r, -m) for x in by_head.values() for r, (m, p) in enumerate(sorted(x)[:k], 1))
    got = tr.heaviest_paths(counts, ends, steps, k)
    assert sorted((r.words, r["rank"], int(r.multiplicity)) for r in got.collect()) == want


def test_strips_of_a_block_change_nothing(spark, monkeypatch):
    """A block is as large as memory allows, its matrix only a strip of it; few vectors still keep all cores busy."""
    from wordweave.operators import similar

    rng = random.Random(5)
    rows = [(k, f"t{rng.randrange(12)}", 1 + rng.randrange(3)) for k in range(60) for _ in range(4)]
    vectors = spark.createDataFrame(rows, "k int, term string, value int")
    want = sorted(tuple(r) for r in similar.similar(vectors, "k", 0.7).collect())
    assert sum(r[3] for r in want) > 60
    monkeypatch.setattr(similar, "LEAST_ROWS", 30)
    monkeypatch.setattr(similar, "STRIP", 7)
    members, units = similar.classes(vectors, "k")
    sizes = members.groupBy("class_id").agg(F.count("*").alias("size"))
    assert similar.blocks(units, sizes)[1] == 2
    got = sorted(tuple(r) for r in similar.similar(vectors, "k", 0.7).collect())
    assert [r[:-1] for r in got] == [r[:-1] for r in want]
    assert [r[-1] for r in got] == pytest.approx([r[-1] for r in want])
    pairs = {(r.a, r.b) for r in similar.similar_classes(units, 0.7).collect()}
    monkeypatch.setattr(similar, "STRIP", 1_000)
    assert pairs == {(r.a, r.b) for r in similar.similar_classes(units, 0.7).collect()}
