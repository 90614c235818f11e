import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wordweave.functions import seeded
from wordweave.operators import backoff as bo
from wordweave.operators import sequence as sq

TEXTS = [
    "the cat sat on the mat", "the cat ran to the dog", "a dog sat on a cat", "the the the dog", "", "cat",
    "the cat sat on a dog and the dog ran", "a cat and a dog and a cat sat on the mat and ran",
]


@pytest.fixture(scope="module")
def units(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    return sq.units(frame, ["doc_id"])


class Plain:
    """The same model in plain Python."""

    def __init__(self, texts, order):
        self.order, raw, ends = order, Counter(), defaultdict(set)
        for text in texts:
            words = (bo.START, *text.split())
            for n in range(1, order + 1):
                for i in range(n - 1, len(words)):
                    gram = words[i - n + 1 : i + 1]
                    if len(gram) == 1 and gram[0] == bo.START:
                        continue
                    if n == order or gram[0] == bo.START:
                        raw[gram] += 1
                    if len(gram) > 1:
                        ends[gram[1:]].add(gram[0])
        self.c = dict(raw) | {g: len(s) for g, s in ends.items() if len(g) < order and g[0] != bo.START}
        self.words = sorted({g[0] for g in self.c if len(g) == 1})
        self.d = {}
        for n in range(1, order + 1):
            counts = Counter(c for g, c in self.c.items() if len(g) == n)
            self.d[n] = bo._discounts([counts[k] for k in (1, 2, 3, 4)])
        self.after = defaultdict(dict)
        for g, c in self.c.items():
            self.after[g[:-1]][g[-1]] = c

    def lost(self, context, count):
        return self.d[len(context) + 1][min(count, 3) - 1]

    def gamma(self, context):
        counts = self.after[context].values()
        return sum(self.lost(context, c) for c in counts) / sum(counts)

    def p(self, context, word):
        below = self.p(context[1:], word) if context else 1 / (len(self.words) + 1)
        if context not in self.after:
            return below
        counts = self.after[context]
        kept = counts[word] - self.lost(context, counts[word]) if word in counts else 0.0
        return kept / sum(counts.values()) + self.gamma(context) * below


@pytest.fixture(scope="module", params=[2, 3, 5])
def both(request, units):
    return bo.train(units, request.param), Plain(TEXTS, request.param)


def test_grams_and_weights_equal_plain_python(both):
    model, plain = both
    key = lambda r: (*([] if r.ctx == "" else r.ctx.split(" ")), r.w)
    got = {key(r): (r.c, r.p) for r in model.grams.collect()}
    assert got.keys() == plain.c.keys()
    for gram, (c, p) in got.items():
        assert c == plain.c[gram] and p == pytest.approx(plain.p(gram[:-1], gram[-1]))
    for r in model.contexts.collect():
        context = () if r.ctx == "" else tuple(r.ctx.split(" "))
        assert len(context) == r.n - 1 and r.gamma == pytest.approx(plain.gamma(context))
    assert model.words == len(plain.words)


def test_probabilities_add_up_to_one(spark, both):
    model, plain = both
    contexts = {g[:-1] for g in plain.c} | {("cat", "mat"), ("unseen",), ("unseen", "the")}
    contexts = sorted(c for c in contexts if len(c) < model.order)
    rows = [(" ".join(c), w) for c in contexts for w in [*plain.words, "unseen"]]
    frame = spark.createDataFrame(rows, "ctx string, w string")
    sums = Counter()
    for r in bo.probabilities(model, frame).collect():
        context = () if r.ctx == "" else tuple(r.ctx.split(" "))
        assert r.p == pytest.approx(plain.p(context, r.w))
        sums[r.ctx] += r.p
    assert len(sums) == len(contexts) and all(s == pytest.approx(1.0) for s in sums.values())


def test_walk_equals_plain_python(units):
    order, entries, length, seed = 3, 12, 4, 7
    model, plain = bo.train(units, order), Plain(TEXTS, order)

    def draw(*parts):
        return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)

    digest = lambda w: hashlib.md5(w.encode()).hexdigest()
    want = {}
    for path in range(entries):
        history = [bo.START]
        for step in range(length):
            weights = {w: 1 for w in plain.words}
            for n in range(min(len(history), order - 1) + 1, 0, -1):
                context = tuple(history[len(history) - n + 1 :])
                if context in plain.after and draw(seed, path, step, n) / 2**60 >= plain.gamma(context):
                    counts = plain.after[context].items()
                    weights = {w: round((c - plain.lost(context, c)) * bo.SCALE) for w, c in counts}
                    break
            d = draw(seed, path, step) % sum(weights.values())
            for word in sorted(weights, key=digest):
                d -= weights[word]
                if d < 0:
                    history.append(word)
                    break
        want[path] = history[1:]
    assert {r.path_id: r.words for r in bo.walk(model, entries, length, seed).collect()} == want


def test_lower_perplexity_than_a_bigram_model(spark):
    from wordweave.operators import evaluate as ev

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    part = seeded.draw(3, F.col("doc_id")) % 5 == 0
    train, test = (sq.units(docs.where(c), ["doc_id"]) for c in (~part, part))
    kneser = bo.perplexity(bo.train(train, 4), test).first()
    bigram = ev.perplexity(sq.flat_pairs(train, ["doc_id"]), sq.flat_pairs(test, ["doc_id"])).first()
    assert kneser.perplexity < bigram.perplexity
    assert kneser.n == test.agg(F.sum(F.size("items"))).first()[0]


def test_nothing_to_learn_from(units):
    model = bo.train(units.limit(0), 3)
    assert model.words == 0 and model.grams.count() == 0
    assert bo.perplexity(model, units).first().loss == pytest.approx(0.0)
    assert bo.walk(model, 3, 2).count() == 0
    with pytest.raises(ValueError):
        bo.train(units, 1)


def test_discounts():
    assert bo._discounts([0, 3, 1, 1]) == (0.5, 0.5, 0.5)
    share = 10 / 18
    assert bo._discounts([10, 4, 0, 0]) == (share, share, share)
    one, two, three = bo._discounts([10, 4, 2, 1])
    assert (one, two, three) == (1 - 2 * share * 0.4, 2 - 3 * share * 0.5, 3 - 4 * share * 0.5)


def test_training_stores_counts_and_weights_only(units):
    """Each level once: no second copy of the highest order and no table of all probabilities."""
    stored = []
    bo.train(units, 3, lambda frame: stored.append(frame.columns) or frame.localCheckpoint())
    assert len(stored) == 6 and not any("p" in columns for columns in stored)


@pytest.mark.parametrize("order", [2, 3, 5])
def test_full_grams_are_slices_side_by_side(units, order):
    """One gram per word with its longest context, and no function run word by word."""
    grams = bo.full_grams(units, order)
    want = Counter()
    for text in TEXTS:
        words = [bo.START, *text.split()]
        for i in range(1, len(words)):
            gram = words[max(0, i - order + 1) : i + 1]
            want[len(gram), " ".join(gram[:-1]), gram[-1]] += 1
    assert Counter((r.n, r.ctx, r.w) for r in grams.collect()) == want
    assert "transform(" not in grams._jdf.queryExecution().optimizedPlan().toString()


def test_contexts_need_not_be_stored(units):
    """The perplexity asks for some contexts only, which are summed up from the grams."""
    stored = []
    model = bo.train(units, 3, lambda frame: stored.append(frame.columns) or frame.localCheckpoint(), lambda frame: frame)
    assert len(stored) == 3
    plain = bo.perplexity(bo.train(units, 3), units).first()
    assert tuple(bo.perplexity(model, units).first()) == pytest.approx(tuple(plain))


def test_grams_nobody_asks_for_are_left_out_by_a_bitmap(spark):
    grams = spark.range(20_000).select(F.col("id").cast("string").alias("ctx"), F.lit("w").alias("w"), F.lit(1).alias("c"))
    asked = grams.where(F.col("ctx").cast("int") % 50 == 7).select("ctx", "w").localCheckpoint()
    met = bo.possible(grams, asked, "ctx", "w").localCheckpoint()
    assert met.join(asked, ["ctx", "w"]).count() == 400 and met.count() < 4_000 and met.columns == grams.columns
    assert bo.possible(grams, asked.limit(0), "ctx").count() == 0


def test_probabilities_of_longer_contexts_than_the_order(units, spark):
    model = bo.train(units, 2)
    rows = [("the cat", "sat"), ("cat", "sat"), ("a b cat", "sat"), ("the", "dog"), ("cat", "sat")]
    found = {r.ctx: r.p for r in bo.probabilities(model, spark.createDataFrame(rows, "ctx string, w string")).collect()}
    assert len(found) == 4 and found["the cat"] == found["cat"] == found["a b cat"]
