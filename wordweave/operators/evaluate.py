"""Scores of generated text and of transition models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordweave.functions.lexicon import DEFAULT_LEXICON, Lexicon
from wordweave.operators import sentiment as st
from wordweave.session import cut


def rescore(
    texts: DataFrame,
    threshold: float = 0.5,
    lexicon: Lexicon | DataFrame = DEFAULT_LEXICON,
    keys: list[str] | None = None,
) -> DataFrame:
    """(n, mean_neg, error_rate) of generated texts; the error rate is the
    share of texts whose negative score is not above the threshold."""
    scored = st.valence(texts, lexicon, keys)
    return scored.agg(
        F.count("*").alias("n"),
        F.avg("neg").alias("mean_neg"),
        (1 - F.avg(F.when(F.col("neg") > threshold, 1.0).otherwise(0.0))).alias("error_rate"),
    )


def tagged(train: DataFrame, test: DataFrame) -> DataFrame:
    """(w1, w2, in_train, in_test) of two pair frames, the tags being 0 or 1."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    return train.select("w1", "w2", one.alias("in_train"), zero.alias("in_test")).unionByName(
        test.select("w1", "w2", zero.alias("in_train"), one.alias("in_test"))
    )


def coverage(pairs: DataFrame) -> DataFrame:
    """How much of the test pairs the training pairs cover, from tagged pairs.

    Both sides meet in one aggregate by pair. ``score_reference`` divides the
    matched occurrences by the distinct first words and may exceed 1;
    ``score_bigram`` divides them by all test occurrences.
    """
    zero = F.lit(0).cast("long")
    by_pair = pairs.groupBy("w1", "w2").agg(
        F.sum("in_train").alias("a"), F.sum("in_test").alias("b")
    )
    by_word = (
        by_pair.where(F.col("b") > 0)
        .groupBy("w1")
        .agg(
            F.sum(F.when(F.col("a") > 0, F.col("b")).otherwise(0)).alias("matched"),
            F.sum("b").alias("pairs"),
        )
    )
    return by_word.agg(
        F.coalesce(F.sum("matched"), zero).alias("matched"),
        F.coalesce(F.sum("pairs"), zero).alias("test_bigrams"),
        F.count("*").alias("test_words"),
    ).select(
        "*",
        (F.col("matched") / F.nullif(F.col("test_words"), zero)).alias("score_reference"),
        (F.col("matched") / F.nullif(F.col("test_bigrams"), zero)).alias("score_bigram"),
    )


def seen_pairs(train: DataFrame, test_counts: DataFrame) -> DataFrame:
    """Counted test pairs that occur in the training pairs. Both sides hold a
    pair once, so no pair is hot in the join."""
    return test_counts.join(train.select("w1", "w2").distinct(), ["w1", "w2"], "left_semi")


def perplexity(train: DataFrame, test: DataFrame, k: float = 1.0) -> DataFrame:
    return tagged_perplexity(tagged(train, test), k)


def tagged_perplexity(pairs: DataFrame, k: float = 1.0) -> DataFrame:
    """(n, loss, perplexity) of an add-k bigram model on test pairs, from
    tagged pairs.

    p(w2|w1) = (c(w1,w2) + k) / (c(w1) + k V), V being the number of distinct
    words of the training pairs.
    """
    zero = F.lit(0).cast("long")
    # Everything comes from one aggregate over both parts, stored once.
    by_pair = cut(
        pairs.groupBy("w1", "w2")
        .agg(F.sum("in_train").alias("a"), F.sum("in_test").alias("b"))
    )
    # Pairs whose first word and training count agree have the same
    # probability, so they are merged before the join with c(w1).
    merged = by_pair.where(F.col("b") > 0).groupBy("w1", "a").agg(F.sum("b").alias("b"))
    first = by_pair.groupBy("w1").agg(F.sum("a").alias("c1"))
    learned = by_pair.where(F.col("a") > 0)
    size = F.lit(learned.select(F.explode(F.array("w1", "w2"))).distinct().count())
    p = (F.col("a") + F.lit(float(k))) / (
        F.coalesce("c1", zero) + F.lit(float(k)) * size
    )
    return (
        merged.join(first, "w1", "left")
        .agg(F.sum("b").alias("n"), (-F.sum(F.col("b") * F.log(p)) / F.sum("b")).alias("loss"))
        .select("n", "loss", F.exp("loss").alias("perplexity"))
    )
