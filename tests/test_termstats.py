import math

import pytest
from pyspark.sql import functions as F

from wordweave.operators import termstats as ts

TF = {"a": 2, "cat": 3, "dog": 1, "ran": 1, "sat": 1, "the": 2, "élan": 2}
DF = {"a": 1, "cat": 2, "dog": 1, "ran": 1, "sat": 1, "the": 1, "élan": 1}


def as_dict(frame):
    return {r[0]: r[1] for r in frame.collect()}


def test_frequencies(docs):
    assert as_dict(ts.term_frequency(docs)) == TF
    assert as_dict(ts.document_frequency(docs)) == DF
    assert {r.term: (r.tf, r.df) for r in ts.term_table(docs).collect()} == {
        t: (TF[t], DF[t]) for t in TF
    }


def test_idf_counts_the_empty_document(docs):
    got = as_dict(ts.inverse_document_frequency(docs))
    assert got == pytest.approx({t: math.log(4 / (DF[t] + 1)) for t in DF})


def test_joined_and_fused_tfidf_agree(docs):
    joined = ts.tfidf(ts.term_frequency(docs), ts.inverse_document_frequency(docs))
    want = {t: TF[t] * math.log(4 / (DF[t] + 1)) for t in TF}
    assert as_dict(joined) == pytest.approx(want)
    assert as_dict(ts.corpus_tfidf(docs)) == pytest.approx(want)


def test_idf_may_be_zero_or_negative(spark):
    docs = spark.createDataFrame([(1, "x y"), (2, "x")], "doc_id long, text string")
    assert as_dict(ts.inverse_document_frequency(docs)) == pytest.approx(
        {"x": math.log(2 / 3), "y": 0.0}
    )


def test_join_multiplies_repeated_terms(spark):
    tf = spark.createDataFrame([("x", 2), ("x", 3), ("y", 1)], "term string, tf long")
    idf = spark.createDataFrame([("x", 1.0), ("x", 10.0)], "term string, idf double")
    assert sorted(r.tfidf for r in ts.tfidf(tf, idf).collect()) == [2.0, 3.0, 20.0, 30.0]


def test_top_terms_break_ties_by_term(spark):
    vector = spark.createDataFrame([(f"t{i:02}", 1.0) for i in range(30)], "term string, v double")
    assert [r.term for r in ts.top_terms(vector, "v").collect()] == [f"t{i:02}" for i in range(20)]


@pytest.mark.parametrize(
    "left, right, want",
    [
        ({"cat": 3, "dog": 4}, {"cat": 4, "bird": 3}, 0.48),
        ({"cat": 3}, {"dog": 1}, 0.0),
        ({"cat": 0}, {"cat": 1}, None),
        ({"cat": 3, "dog": 4}, {"cat": 3, "dog": 4}, 1.0),
    ],
)
def test_cosine(spark, left, right, want):
    def vector(d):
        return spark.createDataFrame([(t, float(v)) for t, v in d.items()], "term string, value double")

    got = ts.cosine(vector(left), vector(right)).first()[0]
    assert got == (want if want is None else pytest.approx(want))
    assert ts.cosine(vector(right), vector(left)).first()[0] == pytest.approx(got)


def test_cosine_of_repeated_terms_equals_the_join(spark):
    a = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 5.0)], "term string, value double")
    b = spark.createDataFrame([("x", 4.0), ("x", 1.0)], "term string, value double")
    dot = a.join(b.withColumnRenamed("value", "w"), "term").agg(F.sum(F.col("value") * F.col("w"))).first()[0]
    assert ts.cosine(a, b).first()[0] == pytest.approx(dot / (math.sqrt(30) * math.sqrt(17)))


def test_tf_adds_up_to_the_number_of_terms(docs):
    assert ts.term_frequency(docs).agg(F.sum("tf")).first()[0] == sum(TF.values())


def test_one_shuffle_for_both_frequencies(docs):
    plan = ts.term_table(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
