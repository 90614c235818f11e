import pytest

from wordweave.functions.lexicon import Lexicon
from wordweave.functions.scoring import Modifiers
from wordweave.operators import evaluate as ev
from wordweave.operators import sentiment as st
from wordweave.sources.corpus import LEXICON

LEX = Lexicon.from_rows(
    [("worthless", -2, -0.5), ("idiot", -2, -1.0), ("best", 3, 1.0), ("nice", 2, 0.6)]
)
TEXTS = ["worthless idiot", "best day", "nice idiot talk", "", "Idiot! 123", "IDIOT idiot best"]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(
        [(1, i, t) for i, t in enumerate(TEXTS)], "doc_id long, line_no int, text string"
    )


def test_valence_scores(texts):
    got = {r.text: (r.compound, r.pos, r.neg, r.neu) for r in st.valence(texts, LEX).collect()}
    assert got["worthless idiot"] == (-0.7184, 0.0, 1.0, 0.0)
    assert got["best day"] == (0.6124, 0.8, 0.0, 0.2)
    assert got["nice idiot talk"] == (0.0, 0.429, 0.429, 0.143)
    assert got[""] == (0.0, 0.0, 0.0, 0.0)
    assert got["Idiot! 123"] == (-0.4588, 0.0, 1.0, 0.0)


KEYS = ["doc_id", "line_no"]


def test_every_scorer_takes_a_table(spark, texts, table):
    lexicon = spark.createDataFrame(list(LEX.entries), "term string, valence double, polarity double")
    for by_list, by_table in (
        (st.valence(texts, LEX), st.valence(texts, lexicon)),
        (st.valence(texts, LEX), st.valence(texts, lexicon, KEYS)),
        (st.polarity(texts, LEX), st.polarity(texts, lexicon)),
        (st.sentiment(texts, st.POLARITY, LEX), st.sentiment(texts, st.POLARITY, lexicon, KEYS)),
        (st.score_between(texts, -1, -0.2, lexicon=LEX), st.score_between(texts, -1, -0.2, lexicon=lexicon)),
        (st.negative_lines(texts, 0.4, LEX), st.negative_lines(texts, 0.4, lexicon)),
        (ev.rescore(texts, 0.4, LEX), ev.rescore(texts, 0.4, lexicon)),
    ):
        assert by_table.columns == by_list.columns
        assert table(by_table) == table(by_list)
    assert Lexicon.from_table(lexicon).ratings("valence") == LEX.ratings("valence")


def test_a_lexicon_of_any_size(spark, texts, table):
    entries = [*LEX.entries, *[(f"term{'abcdefghij'[i % 10]}{'x' * (i % 7)}{i}", 1.0, 0.5) for i in range(10_001)]]
    large = spark.createDataFrame(entries, "term string, valence double, polarity double")
    assert table(st.valence(texts, large)) == table(st.valence(texts, LEX))
    assert table(st.polarity(texts, Lexicon.from_rows(entries))) == table(st.polarity(texts, LEX))


def test_a_term_rated_twice_counts_with_its_mean(spark, texts):
    entries = [("best", 2.0, 0.0), ("best", 4.0, 1.0)]
    lexicon = spark.createDataFrame(entries, "term string, valence double, polarity double")
    got = {r.text: r.compound for r in st.valence(texts, lexicon).collect()}
    assert got["best day"] == 0.6124


def test_polarity_is_the_mean_over_hits(texts):
    got = {r.text: r.polarity for r in st.polarity(texts, LEX).collect()}
    assert got["worthless idiot"] == pytest.approx(-0.75)
    assert got["nice idiot talk"] == pytest.approx(-0.2)
    assert got[""] == 0.0


def test_interval_is_closed_and_checked(texts):
    kept = {r.text for r in st.score_between(texts, -0.7184, -0.4588, lexicon=LEX).collect()}
    assert kept == {"worthless idiot", "Idiot! 123"}
    assert st.score_between(texts, lexicon=LEX).count() == len(TEXTS)
    assert st.score_between(texts, -1.0, -0.7, st.POLARITY, LEX).count() == 2
    with pytest.raises(ValueError):
        st.score_between(texts, 0.5, 0.1)
    with pytest.raises(NotImplementedError):
        st.sentiment(texts, "unknown")


def test_negative_threshold_is_strict(spark):
    rows = [(1, 0, "idiot a b c"), (1, 1, "idiot a b"), (1, 2, "idiot a")]
    frame = spark.createDataFrame(rows, "doc_id long, line_no int, text string")
    # "idiot" weighs 3, each other word 1: shares 3/6, 3/5 and 3/4.
    kept = st.negative_lines(frame, 0.5, LEX).orderBy("line_no").collect()
    assert [(r.line_no, r.neg) for r in kept] == [(1, 0.6), (2, 0.75)]


def test_scoring_does_not_shuffle(texts):
    plan = st.valence(texts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_lexicon_terms_are_rated_once():
    with pytest.raises(ValueError):
        Lexicon.from_rows([("a", 1, 1), ("a", 2, 1)])


def total_of(compound):
    """The total behind a compound score."""
    return compound * (15 / (1 - compound**2)) ** 0.5


@pytest.mark.parametrize(
    "text, rules, total",
    [
        ("a best day", {}, 3.0),
        ("not the best day", {"negation": True}, 3.0 * -0.74),
        ("not that it was best", {"negation": True}, 3.0),
        ("very nice", {"boosters": True}, 2.293),
        ("very much nice", {"boosters": True}, 2 + 0.293 * 0.95),
        ("slightly worthless", {"boosters": True}, -2 + 0.293),
        ("a BEST day", {"capitals": True}, 3.733),
        ("A BEST DAY", {"capitals": True}, 3.0),
        ("nice!!", {"exclamation": True}, 2 + 2 * 0.292),
        ("idiot!!!!!!", {"exclamation": True}, -2 - 4 * 0.292),
        ("nice but worthless", {"but": True}, 2 * 0.5 - 2 * 1.5),
        ("nice idiot", {"but": True}, 0.0),
        ("not very nice!", {"negation": True, "boosters": True, "exclamation": True}, 2.293 * -0.74 - 0.292),
        ("", {"negation": True, "but": True, "exclamation": True}, 0.0),
    ],
)
def test_modifiers(spark, text, rules, total):
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    scored = st.valence(frame, LEX, modifiers=Modifiers(**rules)).first()
    assert total_of(scored.compound) == pytest.approx(total, abs=2e-3)
    if not rules:
        assert scored == st.valence(frame, LEX).first()


def as_table(spark, lexicon):
    return spark.createDataFrame(list(lexicon.entries), "term string, valence double, polarity double")


def test_lines_of_a_table_need_no_key(spark, table):
    """Repeated, NULL and no keys, repeated and NULL texts."""
    rows = [(1, t) for t in [*TEXTS, None, "best day"]] + [(None, "worthless idiot"), (None, None), (2, "best day")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lexicon = as_table(spark, LEX)
    for lines in (frame, frame.select("text")):
        for by_list, by_table in (
            (st.valence(lines, LEX), st.valence(lines, lexicon)),
            (st.polarity(lines, LEX), st.polarity(lines, lexicon)),
            (st.polarity(lines, LEX, chunks=True), st.polarity(lines, lexicon, chunks=True)),
            (ev.rescore(lines, 0.4, LEX), ev.rescore(lines, 0.4, lexicon)),
        ):
            got, want = (sorted(map(repr, f.collect())) for f in (by_table, by_list))
            assert got == want and by_table.columns == by_list.columns
    worst = st.valence(frame.select("text"), lexicon).where("text = 'worthless idiot'").collect()
    assert [(r.neg, r.neu, r.pos, r.compound) for r in worst] == [(1.0, 0.0, 0.0, -0.7184)] * 2


RULED = Lexicon.from_rows(
    [
        ("best", 3, 1.0), ("nice", 2, 0.6), ("idiot", -2, -1.0), ("bomb", -2, -0.5), ("bad", -2, -0.7),
        ("the bomb", 3, 0.8), ("not the bomb", -1, -0.2), (":)", 2, 0.5), (":D", 2.5, 0.6), ("<3", 2, 0.5),
    ]
)


@pytest.mark.parametrize(
    "text, rules, total, words",
    [
        ("it is the bomb", {"idioms": True}, 3.0, [4.0, 2.0]),
        ("it is the bomb", {}, -2.0, [-3.0, 3.0]),
        ("not the bomb bomb", {"idioms": True}, -3.0, None),
        ("the the bomb", {"idioms": True}, 3.0, None),
        ("very the bomb", {"idioms": True, "boosters": True}, 3.293, None),
        ("nice :)", {"emoticons": True}, 4.0, None),
        ("nice :)", {}, 2.0, None),
        (":D <3 -", {"emoticons": True}, 4.5, None),
        ("not :)", {"emoticons": True, "negation": True}, 2 * -0.74, None),
        ("BAD day the BOMB! but nice", {"idioms": True, "capitals": True, "but": True, "exclamation": True}, None, None),
    ],
)
def test_idioms_and_emoticons(spark, text, rules, total, words):
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rules = Modifiers(**rules)
    inline = st.valence(frame, RULED, modifiers=rules).collect()
    assert st.valence(frame, as_table(spark, RULED), modifiers=rules).collect() == inline
    if total is not None:
        assert total_of(inline[0].compound) == pytest.approx(total, abs=2e-3)
    if words:
        hit, neutral = words
        whole = abs(hit) + neutral
        share = inline[0].pos if hit > 0 else inline[0].neg
        assert share == pytest.approx(abs(hit) / whole, abs=1e-3)


def test_modifiers_are_the_same_by_table(spark):
    texts = ["not the best day", "very nice", "slightly bad", "a BEST day", "nice!!", "nice but bad", "", "BAD bad"]
    texts += ["never really very nice but hardly the best idiot!!!", "- not - nice -", "the bomb but not the bomb :)"]
    frame = spark.createDataFrame([(t,) for t in texts * 2], "text string").repartition(2)
    every = Modifiers(*[True] * 7)
    inline, by_table = (st.valence(frame, x, modifiers=every) for x in (RULED, as_table(spark, RULED)))
    assert sorted(map(tuple, by_table.collect())) == sorted(map(tuple, inline.collect()))


@pytest.mark.parametrize(
    "text, polarity",
    [
        ("nice", 0.6),
        ("very nice", 0.6 * 1.3),
        ("slightly nice", 0.6 * 0.7),
        ("very very very best", 1.0),
        ("not nice", -0.3),
        ("not very nice", -0.5 / 1.3 * 0.6),
        ("very not nice", -0.3),
        ("not a nice", -0.3),
        ("not one nice", 0.6),
        ("not nice nice", 0.15),
        ("very bad but nice", (-0.7 * 1.3 + 0.6) / 2),
        ("not", 0.0),
        ("", 0.0),
    ],
)
def test_polarity_of_chunks(spark, text, polarity):
    frame = spark.createDataFrame([(text,)], "text string")
    for lexicon in (RULED, as_table(spark, RULED)):
        assert st.polarity(frame, lexicon, chunks=True).first().polarity == pytest.approx(polarity)


def test_a_table_is_joined_in_bounded_groups(spark, texts):
    """Terms meet the table by term and salt; the lines are joined by the
    digest of their text, which AQE may split."""
    plan = st.valence(texts, as_table(spark, LEX))._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "_text" in plan


def test_a_small_table_is_looked_up_in_the_row(spark, monkeypatch):
    """The same scores in the row and by the join, and only one of them has lines."""
    texts = [*TEXTS, None, "the bomb not :)", "not very NICE! but bad", "best day", None, "<3 the bomb the bomb"] * 2
    lines = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    entries = [*RULED.entries, ("best", 1, 0.5), (None, 9, 9.0), ("day", None, None)]
    lexicon = spark.createDataFrame([(t, v and float(v), p) for t, v, p in entries], LEXICON)
    every = Modifiers(*[True] * 7)

    def scores(table):
        frames = (
            st.valence(lines, table),
            st.valence(lines, table, modifiers=every),
            st.polarity(lines, table),
            st.polarity(lines, table, chunks=True),
        )
        return [sorted(map(repr, f.collect())) for f in frames]

    met = []
    joined = st._joined
    monkeypatch.setattr(st, "_joined", lambda lines, *rest: met.append(lines) or joined(lines, *rest))
    inside = scores(lexicon)
    assert len(met) == 4 and all(m.isEmpty() for m in met)
    monkeypatch.setattr(st, "IN_ROW", 3)
    assert scores(lexicon) == inside
    assert all(m.count() == len(texts) for m in met[4:])
    monkeypatch.setattr(st, "IN_ROW", 4_096)
    assert scores(lexicon.limit(0)) == scores(Lexicon(()))
