import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordweave.functions import seeded
from wordweave.operators import lmdata as lm
from wordweave.operators import sequence as sq

TEXTS = {
    1: "the cat sat", 2: "", 3: "the cat ran", 4: "NYT dog", 5: "   ", 6: "Hi", 7: "a b a b a",
    8: "cat", 9: "", 10: "the end of it",
}


def digest(key):
    return hashlib.md5(str(key).encode()).hexdigest()


def flat():
    return [w for k in sorted(TEXTS, key=lambda k: (digest(k), k)) for w in TEXTS[k].split()]


@pytest.fixture
def items(spark):
    frame = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").repartition(3)
    return sq.units(frame, ["doc_id"])


def test_word_index(items):
    got = {r.pos: r.word for r in sq.word_index(items, ["doc_id"]).collect()}
    assert got == dict(enumerate(flat()))


def test_first_words(items):
    got = {r.pos: r.word for r in sq.first_words(items, ["doc_id"], 7).collect()}
    assert got == dict(enumerate(flat()[:7]))


def test_flat_pairs_cross_borders_and_skip_empty_units(items, table):
    got = Counter(table(sq.flat_pairs(items, ["doc_id"])))
    assert got == Counter(zip(flat(), flat()[1:]))


def test_indexed_pairs(items):
    got = sorted((r.pos, r.w1, r.w2) for r in sq.indexed_pairs(items, ["doc_id"]).collect())
    words = flat()
    assert got == list(zip(range(len(words)), words, [*words[1:], None]))


def test_lines_of_one_document_spread_over_shards(spark, table):
    texts = {(1, i): f"a{i} b{i}" if i % 3 else "" for i in range(200)}
    frame = spark.createDataFrame(
        [(*k, t) for k, t in texts.items()], "doc_id long, line_no int, text string"
    )
    keys = ["doc_id", "line_no"]
    lines = sq.units(frame, keys)
    assert lines.select("digest").distinct().count() == sum(map(bool, texts.values()))
    in_order = sorted(texts, key=lambda k: (digest(f"{k[0]}|{k[1]}"), k))
    words = [w for k in in_order for w in texts[k].split()]
    assert table(sq.flat_pairs(lines, keys)) == sorted(zip(words, words[1:]))


def test_shuffle_is_a_permutation_and_stable(items, table):
    once = table(sq.shuffled_words(items, ["doc_id"], 5))
    assert once == table(sq.shuffled_words(items.repartition(7), ["doc_id"], 5))
    assert once != table(sq.shuffled_words(items, ["doc_id"], 6))
    words = [w for _, w, _ in once]
    assert [p for p, _, _ in once] == list(range(len(words)))
    assert Counter(words) == Counter(flat())
    assert [n for _, _, n in once] == [*words[1:], None]


def test_vocabulary_orders_by_count_then_word(items):
    vocab = lm.vocabulary(lm.word_counts(items))
    counts = Counter(flat())
    want = sorted(counts, key=lambda w: (-counts[w], w))
    assert [r.word for r in vocab.orderBy("token_id").collect()] == want
    assert [r.token_id for r in vocab.orderBy("token_id").collect()] == list(range(len(want)))


def alphabet(spark):
    """One document, so the sequence is in text order."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    frame = spark.createDataFrame([(1, " ".join(letters))], "doc_id long, text string")
    items = sq.units(frame, ["doc_id"])
    return items, lm.vocabulary(lm.word_counts(items))


def test_batchify_the_alphabet(spark):
    items, vocab = alphabet(spark)
    got = lm.batchify(items, ["doc_id"], vocab, 4).orderBy("batch_col", "row").collect()
    text = "".join(chr(97 + r.token_id) for r in got)
    assert [text[i : i + 6] for i in range(0, 24, 6)] == ["abcdef", "ghijkl", "mnopqr", "stuvwx"]


@pytest.mark.parametrize("frequent", [0, 10, 10_000])
def test_windows_of_the_alphabet(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    items, vocab = alphabet(spark)
    got = lm.windows(items, ["doc_id"], vocab, 4, 2).where("batch_col = 1").orderBy("window", "pos")
    pairs = [(r.window, r.pos, chr(97 + r.token_id), chr(97 + r.target_id)) for r in got.collect()]
    assert pairs == [
        (0, 0, "g", "h"), (0, 1, "h", "i"), (1, 0, "i", "j"), (1, 1, "j", "k"), (2, 0, "k", "l"),
    ]


def test_generated_words_in_rows(spark):
    paths = spark.createDataFrame([(1, [str(i) for i in range(45)]), (2, ["x"])], "path_id long, words array<string>")
    got = [(r.path_id, r.line_no, len(r.text.split())) for r in lm.in_rows_of(paths).orderBy("path_id", "line_no").collect()]
    assert got == [(1, 0, 20), (1, 1, 20), (1, 2, 5), (2, 0, 1)]
    assert lm.in_rows_of(paths, 50).where("path_id = 1").select(F.size(F.split("text", " "))).first()[0] == 45


def test_the_number_of_shards_changes_nothing(items, table, monkeypatch):
    want = table(sq.word_index(items, ["doc_id"])), table(sq.shuffled_words(items, ["doc_id"], 5))
    for digits in (1, 2, 5):
        monkeypatch.setattr(seeded, "digits_for", lambda rows, digits=digits: digits)
        assert (table(sq.word_index(items, ["doc_id"])), table(sq.shuffled_words(items, ["doc_id"], 5))) == want


def test_shards_follow_the_rows():
    assert [seeded.digits_for(n) for n in (0, 320_000, 320_001, 10**10)] == [1, 1, 2, 5]


def test_texts_are_read_twice_at_most(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(path)
    items = sq.units(spark.read.parquet(path), ["doc_id"])
    vocab = lm.vocabulary(lm.word_counts(items))
    for frame in (
        sq.flat_pairs(items, ["doc_id"]),
        sq.word_index(items, ["doc_id"]),
        sq.shuffled_words(items, ["doc_id"], 1),
        lm.batchify(items, ["doc_id"], vocab, 2),
        lm.windows(items, ["doc_id"], vocab, 2, 3),
    ):
        # The outline was read before; the plan holds what is still to read.
        assert frame._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") <= 1


def test_parts_are_sequences_of_their_own(spark):
    rows = [(k, k % 3, t) for k, t in TEXTS.items()]
    frame = spark.createDataFrame(rows, "doc_id long, part int, text string")
    items = sq.units(frame, ["doc_id", "part"]).withColumn("digest", seeded.digest(F.col("doc_id")))
    got = Counter(tuple(r) for r in sq.parted_pairs(items, ["doc_id"], "part").collect())
    want = Counter()
    for part in range(3):
        own = [k for k in TEXTS if k % 3 == part]
        words = [w for k in sorted(own, key=lambda k: (digest(k), k)) for w in TEXTS[k].split()]
        want.update((part, *pair) for pair in zip(words, words[1:]))
    assert got == want


def test_in_order_of_the_corpus(spark, items, monkeypatch, table):
    words = [w for k in sorted(TEXTS) for w in TEXTS[k].split()]
    for rows in (20_000, 2, 1):
        monkeypatch.setattr(sq, "SHARD_ROWS", rows)
        index = sq.word_index(items, ["doc_id"], in_order=True)
        assert {r.pos: r.word for r in index.collect()} == dict(enumerate(words))
        first = sq.first_words(items, ["doc_id"], 7, in_order=True)
        assert {r.pos: r.word for r in first.collect()} == dict(enumerate(words[:7]))
        assert Counter(table(sq.flat_pairs(items, ["doc_id"], in_order=True))) == Counter(zip(words, words[1:]))
        pairs = sq.indexed_pairs(items, ["doc_id"], in_order=True)
        assert sorted((r.pos, r.w1, r.w2) for r in pairs.collect()) == list(
            zip(range(len(words)), words, [*words[1:], None])
        )


def test_lines_stay_together_in_order(spark, monkeypatch):
    monkeypatch.setattr(sq, "SHARD_ROWS", 7)
    keys = ["doc_id", "line_no"]
    texts = {(d, i): f"{d}a{i} {d}b{i}" if (d + i) % 3 else "" for d in (3, 1, 20) for i in range(60)}
    frame = spark.createDataFrame([(*k, t) for k, t in texts.items()], "doc_id long, line_no int, text string")
    words = [w for k in sorted(texts) for w in texts[k].split()]
    got = sq.word_index(sq.units(frame.repartition(5), keys), keys, in_order=True).orderBy("pos").collect()
    assert [r.word for r in got] == words


@pytest.mark.parametrize("rows", [20_000, 5, 1])
def test_sums_over_shards_have_two_levels(spark, items, monkeypatch, rows):
    """No window without a partition over more than the groups of shards."""
    monkeypatch.setattr(sq, "SHARD_ROWS", rows)
    assert {r.pos: r.word for r in sq.word_index(items, ["doc_id"]).collect()} == dict(enumerate(flat()))
    once = sq.shuffled_words(items, ["doc_id"], 5).orderBy("pos").collect()
    words = [r.word for r in once]
    assert [r.pos for r in once] == list(range(len(words))) and [r.w2 for r in once] == [*words[1:], None]


def test_no_rows_in_order(items):
    assert sq.word_index(items.limit(0), ["doc_id"], in_order=True).collect() == []
    assert sq.first_words(items.limit(0), ["doc_id"], 5).collect() == []


def test_shuffled_words_are_not_stored(spark, monkeypatch):
    """What is written before the shuffle is one row per shard, and only a word and its digest travel."""
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(300))) for i in range(40)]
    items = sq.units(spark.createDataFrame(texts, "doc_id long, text string"), ["doc_id"])
    stored = []
    monkeypatch.setattr(sq, "cut", lambda frame, cut=sq.cut: stored.append(cut(frame)) or stored[-1])
    made, total = sq.shuffled_and_counted(items, ["doc_id"], 5)
    want = sorted((digest(f"5|{i}|{j}"), w) for i, text in texts for j, w in enumerate(text.split()))
    assert [tuple(r) for r in made.orderBy("pos").select("pos", "word").collect()] == [(k, w) for k, (_, w) in enumerate(want)]
    assert total == 12_000 and all(frame.count() <= 16**sq.SHUFFLE_DIGITS for frame in stored)


def test_more_shards_of_shuffled_words_change_nothing(items, table, monkeypatch):
    want = table(sq.shuffled_words(items, ["doc_id"], 5))
    for digits, rows in ((1, 10), (2, 1), (1, 1)):
        monkeypatch.setattr(sq, "SHUFFLE_DIGITS", digits)
        monkeypatch.setattr(sq, "SHUFFLED_ROWS", rows)
        assert table(sq.shuffled_words(items, ["doc_id"], 5)) == want


def test_words_travel_with_their_position_only(spark, monkeypatch):
    """Batch, window and place in it follow from the position once the ids are known."""
    seen = []
    monkeypatch.setattr(lm, "with_ids", lambda frame, *a, f=lm.with_ids: seen.append(frame.columns) or f(frame, *a))
    items, vocab = alphabet(spark)
    assert lm.windows(items, ["doc_id"], vocab, 4, 2).columns == ["batch_col", "window", "pos", "token_id", "target_id"]
    assert seen == [["_pos", "w1", "w2"], ["_pos", "w2", "token_id"]]


def test_rows_of_frequent_words_are_not_shuffled_for_their_ids(spark, monkeypatch):
    """Only rows with a rare word reach the shuffle joins; the targets of the others are known as well."""
    monkeypatch.setattr(lm, "FREQUENT", 20)
    seen = []
    monkeypatch.setattr(lm, "with_ids", lambda frame, *a, f=lm.with_ids: seen.append(frame.count()) or f(frame, *a))
    items, vocab = alphabet(spark)
    assert lm.windows(items, ["doc_id"], vocab, 1, 2).count() == 25
    assert seen == [6, 6]


def test_stored_units_keep_their_items(spark):
    """Also items that are empty, NULL or hold what parts the others."""
    rows = [["a", "b"], [""], ["", ""], ["a\nb", "c"], ["a", None], ["\n"], ["é", "b", ""]]
    units = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "start long, items array<string>")
    assert [r["items"] for r in sq._stored(units).orderBy("start").collect()] == rows


@pytest.mark.parametrize("kind", ["long", "string"])
def test_numbers_travel_instead_of_the_digest_of_a_word(spark, kind):
    """A digest takes the most room of a shuffled word. The order is the same by either."""
    texts = [(i % 5 + 7, i // 5, " ".join(f"w{i}x{j}" for j in range(i % 4))) for i in range(20)]
    items = sq.units(spark.createDataFrame(texts, f"doc_id {kind}, line_no int, text string"), ["doc_id", "line_no"])
    made, total = sq.shuffled_and_counted(items, ["doc_id", "line_no"], 3)
    want = sorted((digest(f"3|{d}|{n}|{j}"), w) for d, n, text in texts for j, w in enumerate(text.split()))
    assert [r.word for r in made.orderBy("pos").collect()] == [w for _, w in want] and total == len(want)
    plan = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = next(plan[i + 1] for i, line in enumerate(plan) if "RepartitionByExpression" in line)
    assert ("digest" in below) == (kind == "string")
