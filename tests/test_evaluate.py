import math
from collections import Counter

import pytest

from wordweave.functions.lexicon import Lexicon
from wordweave.operators import evaluate as ev
from wordweave.operators import sampling as sa
from wordweave.operators import transitions as tr
from wordweave.plans import catalog

TRAIN = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")]
TEST = [("a", "b"), ("a", "b"), ("a", "x"), ("b", "a"), ("z", "a"), ("c", "a")]


@pytest.fixture
def parts(spark):
    return tuple(spark.createDataFrame(p, "w1 string, w2 string") for p in (TRAIN, TEST))


def test_coverage(parts):
    got = ev.coverage(ev.tagged(*parts)).first()
    assert (got.matched, got.test_bigrams, got.test_words) == (3, 6, 4)
    assert (got.score_reference, got.score_bigram) == (0.75, 0.5)


def test_coverage_of_nothing(parts):
    got = ev.coverage(ev.tagged(parts[0], parts[1].where("false"))).first()
    assert (got.matched, got.test_bigrams, got.test_words) == (0, 0, 0)
    assert got.score_reference is None and got.score_bigram is None


def test_seen_pairs(parts, table):
    train, test = parts
    got = table(ev.seen_pairs(train, tr.pair_counts(test)).select("w1", "w2", "cnt"))
    assert got == [("a", "b", 2), ("c", "a", 1)]


@pytest.mark.parametrize("k", [1.0, 0.1])
def test_perplexity(parts, k):
    pair, first = Counter(TRAIN), Counter(a for a, _ in TRAIN)
    size = len({w for p in TRAIN for w in p})
    logs = [math.log((pair[p] + k) / (first[p[0]] + k * size)) for p in TEST]
    got = ev.perplexity(*parts, k).first()
    assert got.n == len(TEST)
    assert got.loss == pytest.approx(-sum(logs) / len(TEST))
    assert got.perplexity == pytest.approx(math.exp(-sum(logs) / len(TEST)))


def test_rescore(spark):
    lex = Lexicon.from_rows([("bad", -2, -0.5)])
    frame = spark.createDataFrame([("bad",), ("bad a",), ("x",), ("bad a b c d",)], "text string")
    got = ev.rescore(frame, 0.5, lex).first()
    assert got.n == 4
    assert got.mean_neg == pytest.approx((1.0 + 0.75 + 0.0 + 0.429) / 4)
    assert got.error_rate == 0.5


def test_sample_to_size(spark, table):
    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    once = table(sa.sample_to_size(ids, 500, 1, "doc_id"))
    assert 400 < len(once) < 600
    assert once == table(sa.sample_to_size(ids.repartition(9), 500, 1, "doc_id"))
    assert sa.sample_to_size(ids, 9999, 1, "doc_id").count() == 5000


def test_hash_split(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    split = ids.select(sa.hash_split(ids.doc_id, 3, (("a", 50), ("b", 50))).alias("s"))
    sizes = {r["s"]: r["count"] for r in split.groupBy("s").count().collect()}
    assert set(sizes) == {"a", "b"} and sum(sizes.values()) == 4000
    assert abs(sizes["a"] - 2000) < 200
    with pytest.raises(ValueError):
        sa.hash_split(ids.doc_id, 3, (("a", 50),))


def test_weighted_picks_follow_the_weights(spark):
    frame = spark.createDataFrame([("a", 1), ("b", 3), ("c", 6)], "word string, cnt long")
    got = Counter(r.word for r in sa.weighted_picks(frame, ["word"], 2000, 5).collect())
    assert sum(got.values()) == 2000
    assert all(abs(got[w] / 2000 - c / 10) < 0.05 for w, c in (("a", 1), ("b", 3), ("c", 6)))


@pytest.fixture
def stored(monkeypatch):
    """What the registered queries store themselves."""
    kept = []

    def keeping(frame):
        kept.append(catalog_cut(frame))
        return kept[-1]

    catalog_cut = catalog.cut
    monkeypatch.setattr(catalog, "cut", keeping)
    return kept


def documents_in(spark, folder, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_only_test_pairs_are_stored_to_be_seen(spark, tmp_path, stored):
    texts = [f"a b w{i} a c v{i % 7} d" for i in range(120)] + ["", None, "one"]
    folder = documents_in(spark, tmp_path, texts)
    parts = catalog._document_parts(spark, folder).groupBy("part", "w1", "w2").count().collect()
    train, test = ({(r.w1, r.w2): r["count"] for r in parts if r.part == p} for p in (0, 1))
    got = catalog.REGISTRY["holdout_seen_pairs"](spark, folder)
    assert got.columns == ["w1", "w2", "cnt"]
    assert sorted(map(tuple, got.collect())) == sorted((*p, n) for p, n in test.items() if p in train)
    assert [f.count() for f in stored] == [len(test)] and len(test) < len(train)


def test_lines_are_scored_once_for_the_negative_generator(spark, tmp_path, stored):
    folder = documents_in(spark, tmp_path, ["bad day\nnice day", "awful lie told\nplain words", "bad bad dog", ""])
    made = catalog.REGISTRY["negative_generator_scores_by_table"](spark, folder).collect()
    assert made[0].n == 100
    assert sorted(r.text for r in stored[0].collect()) == ["awful lie told", "bad bad dog", "bad day"]
