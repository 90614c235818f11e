"""Quality, toxicity and language: models against plain loops, held-out
accuracy, odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordweave.llm import common, langid, quality, toxicity
from wordweave.llm.common import fold


def test_fold(spark):
    import zlib

    rows = spark.createDataFrame([(0,), (17,), (-5,), (None,)], "doc_id long").select(
        "doc_id", fold("doc_id", 5).alias("f")
    )
    assert {r.doc_id: r.f for r in rows.collect()} == {
        i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 for i in (0, 17, -5, None)
    }


def test_quality_features_of_any_text():
    x = quality.features(["", "  \n", "Plain text, with words.", "A!!! B!!!", "é" * 10, "x" * 3_000_000])
    assert x.shape == (6, len(quality.FEATURES))
    assert np.isfinite(x).all() and (x[0] == 0).all()


def test_quality_scores_are_sums_of_table_entries():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)  # an interaction only
    model = quality.fit(x, y)
    scores = model.scores(x)
    for i in range(0, 600, 37):
        total = model.prior
        bins = [sum(v >= e for e in edges) for v, edges in zip(x[i], model.edges)]
        total += sum(model.tables[f][b] for f, b in enumerate(bins))
        for p, (f, g) in enumerate(model.pairs):
            total += model.pair_tables[p][bins[f] * 8 // 32][bins[g] * 8 // 32]
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-total)))
    assert ((scores > 0.5) == y).mean() > 0.9


def held_out_accuracy(scored, labels, target):
    rows = scored.where("held_out").join(labels.where(f"{target} is not null"), "doc_id")
    return rows.select(F.avg((F.col("predicted") == F.col(target)).cast("int"))).first()[0]


def test_quality_held_out(small):
    scored = quality.quality(small["documents"], small["labels"])
    assert scored.count() == small["documents"].count()
    assert held_out_accuracy(scored, small["labels"], "quality") > 0.93


def test_quality_odd_rows(odd, labels, no_rows):
    rows = quality.quality(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality.quality(no_rows, labels).count() == 0
    unlabelled = quality.quality(odd, labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.5}
    assert quality.accepted(odd, labels).columns == odd.columns
    assert quality.accepted(odd, labels.limit(0)).count() == odd.count()


def test_machine_by_hand():
    machine = toxicity.Machine(np.array([3, 8, 20, 21]), -1.0)
    draw = np.random.default_rng(2)
    machine.w, machine.v = draw.normal(size=4), draw.normal(size=(4, toxicity.FACTORS))
    row = machine.known(np.array([1, 3, 20, 21, 99], np.int32))
    assert row.tolist() == [0, 2, 3]
    total = machine.bias + sum(machine.w[i] for i in row)
    total += sum(machine.v[i] @ machine.v[j] for i in row for j in row if i < j)
    assert machine.raw([row])[0] == pytest.approx(total)


def test_machine_learns_a_pair():
    """Neither the insult nor the group mention alone is toxic."""
    draw = random.Random(3)
    texts, y = [], []
    for _ in range(3000):
        insult, group = draw.random() < 0.3, draw.random() < 0.3
        words = [f"w{draw.randint(0, 50)}" for _ in range(12)] + ["insult"] * insult + ["group"] * group
        draw.shuffle(words)
        texts.append(" ".join(words))
        y.append(int(insult and group))
    rows = [toxicity.terms(t) for t in texts]
    machine = toxicity.fit(rows[:2000], np.array(y[:2000]))
    scores = machine.scores([machine.known(r) for r in rows[2000:]])
    assert ((scores >= 0.5) == np.array(y[2000:])).mean() > 0.98


def test_toxicity_held_out(small):
    scored = toxicity.toxicity(small["documents"], small["labels"])
    assert scored.count() == small["documents"].count()
    assert held_out_accuracy(scored, small["labels"], "toxic") > 0.93


def test_toxicity_odd_rows(odd, labels, no_rows):
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.toxicity(no_rows, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.5}


def tree_by_hand(texts):
    counts = Counter()
    for text in texts:
        for word in langid.words_of(text):
            word = b" " + word + b" "
            for at in range(1, len(word)):
                for order in range(min(at, langid.ORDER) + 1):
                    counts[word[at - order : at + 1]] += 1
    return counts


def bits_by_hand(counts, word):
    word, total = b" " + word + b" ", 0.0
    for at in range(1, len(word)):
        for order in range(min(at, langid.ORDER), -1, -1):
            context = word[at - order : at]
            below = {g: n for g, n in counts.items() if len(g) == order + 1 and g[:-1] == context}
            n, kinds = sum(below.values()), len(below)
            seen = below.get(word[at - order : at + 1], 0)
            if seen:
                total -= math.log2(seen / (n + kinds))
                break
            if kinds:
                total -= math.log2(kinds / (n + kinds))
        else:
            total += 8
    return total


@pytest.mark.parametrize("nodes", [4_000_000, 60, 1])
def test_code_lengths_by_hand(spark, monkeypatch, nodes):
    monkeypatch.setattr(langid, "NODES", nodes)
    texts = {"aa": ["the cat sat on the mat the end", "cats and mats"], "bb": ["le chat été là", "le fin é"]}
    frame = spark.createDataFrame(
        [(t, lang) for lang, ts in texts.items() for t in ts] + [("x", None), (None, "aa")],
        "text string, lang string",
    )
    parts = list(langid.trained(langid.counts(frame)))
    trees = parts[0]
    assert trees.langs == ["aa", "bb"] and trees.parts == len(parts)
    assert (len(parts) > 1) == (nodes < 100) and sum(p.here.sum() for p in parts) == 256
    words = [w.encode() for w in ("the", "cat", "été", "zzz", "chatte", "m")]
    ours = sum(p.lengths(words) for p in parts)
    for i, word in enumerate(words):
        for k, lang in enumerate(trees.langs):
            assert ours[i, k] == pytest.approx(bits_by_hand(tree_by_hand(texts[lang]), word))


def test_counts_flushed_early(spark, small, monkeypatch):
    docs = small["documents"].limit(60)
    whole = {tuple(r)[:3]: r.n for r in langid.counts(docs).collect()}
    monkeypatch.setattr(langid, "WORDS_KEPT", 50)
    assert {tuple(r)[:3]: r.n for r in langid.counts(docs).collect()} == whole


def test_language_held_out(small):
    docs = small["documents"]
    found = langid.language(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.98


def test_language_odd_rows(odd, no_rows):
    rows = langid.language(odd).collect()
    assert len(rows) == odd.count()
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 10)} == {"und"}
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 6, 7)} == {"en"}
    assert all(0 <= r.score <= 1 for r in rows)
    assert langid.language(no_rows).count() == 0
    nothing = langid.language(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_trees_of_any_size(spark, small, monkeypatch):
    """Nothing is cut off: more than 400,000 grams count like few, and trees in
    several passes predict the same."""
    docs = small["documents"].limit(80)
    once = sorted(map(tuple, langid.language(docs).collect()))
    monkeypatch.setattr(langid, "NODES", 3_000)
    again = sorted(map(tuple, langid.language(docs).collect()))
    assert [r[:3] for r in again] == [r[:3] for r in once]
    assert [r[3] for r in again] == pytest.approx([r[3] for r in once])
    text = " ".join("".join(chr(0x4E00 + (i * 7 + k * 13) % 20_000) for k in range(3)) for i in range(60_000))
    frame = spark.createDataFrame([(1, text, "zz")], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "NODES", 4_000_000)
    counted = {}
    for word in langid.words_of(text):
        word = b" " + word + b" "
        for at in range(1, len(word)):
            for order in range(min(at, langid.ORDER) + 1):
                gram = word[at - order : at + 1]
                counted[order, int.from_bytes(gram, "big")] = counted.get((order, int.from_bytes(gram, "big")), 0) + 1
    assert len(counted) > 400_000 / 4
    (trees,) = langid.trained(langid.counts(frame))
    assert sum(len(level[0]) for level in trees.levels) == len(counted)


def spoken(kind, n, seed):
    """Made-up texts: label 1 is one of insult and group mention (xor), or an
    insult beside one of 400 rare group words."""
    draw = random.Random(seed)
    rows, y = [], []
    for _ in range(n):
        words = [f"word{draw.randrange(300)}" for _ in range(12)]
        insult, group = draw.random() < 0.5, draw.random() < 0.5
        words += ["insultx"] * insult
        if group:
            words.append("groupx" if kind == "xor" else f"grp{draw.randrange(400)}")
        rows.append(toxicity.terms(" ".join(words)))
        y.append(int(insult != group) if kind == "xor" else int(insult and group))
    return rows, np.array(y)


@pytest.mark.parametrize("kind", ["xor", "rare"])
def test_pairs_that_tell_nothing_singly(kind):
    machine = toxicity.fit(*spoken(kind, 4000, 1))
    rows, y = spoken(kind, 2000, 2)
    found = machine.scores([machine.known(r) for r in rows]) >= 0.5
    assert (found == y).mean() > 0.95
    assert found[y == 1].mean() > 0.9


def test_chance_admits_few_pairs():
    """Labels that depend on no term leave the second screen empty."""
    rows, _ = spoken("xor", 1500, 3)
    y = np.random.default_rng(1).integers(0, 2, 1500)
    p = np.full(1500, y.mean())
    assert len(toxicity.in_pairs(rows, y, p)) < 20


def test_samples_are_bounded(spark):
    """One labelled id on very many rows."""
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    marked = common.labelled_rows(docs, labels, "toxic", "doc_id", 5, 10)
    chosen = common.bounded(marked, 10)
    assert chosen.count() == 10
    again = common.bounded(marked.repartition(7), 10)
    assert sorted(r.text for r in again.collect()) == sorted(r.text for r in chosen.collect())
