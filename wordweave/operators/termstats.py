"""Term statistics: frequency, document frequency, weights, similarity.

Score vectors are frames (term, value); ``by`` columns key several vectors in
one frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordweave.functions import text as tx


def term_frequency(docs: DataFrame, by: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Raw count of every term over the whole input, (by..., term, tf)."""
    return (
        docs.select(*by, F.explode(tx.terms(F.col(text))).alias("term"))
        .groupBy(*by, "term")
        .agg(F.count("*").alias("tf"))
    )


def document_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """Number of documents holding a term, (term, df).

    A document is one row, so its terms are made distinct inside the row; only
    the per-term counts are shuffled.
    """
    return (
        docs.select(F.explode(F.array_distinct(tx.terms(F.col(text)))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )


def term_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """Term and document frequency from one scan and one shuffle.

    In the sorted term array of a document the first of each run of equal
    terms marks the document's contribution to ``df``.
    """
    ordered = docs.select(F.sort_array(tx.terms(F.col(text))).alias("terms"))
    marked = F.transform(
        "terms",
        lambda t, i: F.struct(
            t.alias("term"),
            F.when((i == 0) | (F.get("terms", i - 1) != t), 1).otherwise(0).alias("first"),
        ),
    )
    return (
        ordered.select(F.inline(marked))
        .groupBy("term")
        .agg(F.count("*").alias("tf"), F.sum("first").alias("df"))
    )


def idf_weight(corpus_size, df):
    """ln(N / (df + 1)): zero when all documents but one hold the term,
    negative when all do."""
    return F.log(corpus_size / (df + F.lit(1.0)))


def corpus_size(docs: DataFrame):
    """Number of documents, empty ones included, as a scalar subquery."""
    return docs.agg(F.count("*")).scalar()


def inverse_document_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    return document_frequency(docs, text).select(
        "term", idf_weight(corpus_size(docs), F.col("df")).alias("idf")
    )


def tfidf(tf: DataFrame, idf: DataFrame) -> DataFrame:
    """Product of two vectors joined on term; terms of only one are dropped
    and repeated terms multiply. Extra columns of ``tf`` are kept."""
    keys = [c for c in tf.columns if c not in ("term", "tf")]
    return tf.join(idf, "term", "inner").select(
        *keys, "term", (F.col("tf") * F.col("idf")).alias("tfidf")
    )


def corpus_tfidf(docs: DataFrame, text: str = "text") -> DataFrame:
    """TF-IDF of a corpus against itself without a join: both frequencies
    come from the same aggregate."""
    return term_table(docs, text).select(
        "term",
        (F.col("tf") * idf_weight(corpus_size(docs), F.col("df"))).alias("tfidf"),
    )


def top_terms(vector: DataFrame, value: str, k: int = 20) -> DataFrame:
    """The ``k`` largest values; equal values in term order."""
    return vector.orderBy(F.desc(value), F.asc("term")).limit(k)


def norms(vectors: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Euclidean norm of each vector."""
    return vectors.groupBy(*by).agg(
        F.sqrt(F.sum(F.col(value).cast("double") * F.col(value))).alias("norm")
    )


def cosine(left: DataFrame, right: DataFrame, value: str = "value") -> DataFrame:
    """Cosine similarity of two vectors as a one-row frame.

    Both vectors meet in one aggregate by term instead of a join: the dot
    product of a term is the product of its two sums, which also holds when a
    term is repeated. Disjoint vectors give 0, a zero vector gives NULL.
    """
    v = F.col(value).cast("double")
    zero = F.lit(0.0)
    both = left.select("term", v.alias("l"), zero.alias("r")).unionByName(
        right.select("term", zero.alias("l"), v.alias("r"))
    )
    by_term = both.groupBy("term").agg(
        F.sum("l").alias("l"),
        F.sum("r").alias("r"),
        F.sum(F.col("l") * F.col("l")).alias("ll"),
        F.sum(F.col("r") * F.col("r")).alias("rr"),
    )
    norms = F.sqrt(F.sum("ll")) * F.sqrt(F.sum("rr"))
    return by_term.agg(
        (F.sum(F.col("l") * F.col("r")) / F.nullif(norms, zero)).alias("similarity")
    )
