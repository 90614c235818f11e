"""Document frequencies kept up to date in a folder of parts.

A change, documents added or withdrawn, is a part: (term, df) with the change
of each term, and one row without a term for the number of documents. Parts are
merged by addition, so a change costs what its own documents cost. Writing a part
again under its name replaces it; a repeated task or a repeated run counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordweave.operators import termstats as ts
from wordweave.session import delete

SCHEMA = "term string, df long"


def part(docs: DataFrame, text: str = "text", sign: int = 1) -> DataFrame:
    """(term, df) of documents: their change of the counts."""
    by_term = ts.document_frequency(docs, text).withColumn("df", F.col("df") * sign)
    size = docs.agg((F.count("*") * sign).alias("df")).select(F.lit(None).cast("string").alias("term"), "df")
    return by_term.unionByName(size)


def add(docs: DataFrame, folder: str, name: str, text: str = "text") -> None:
    part(docs, text).write.mode("overwrite").parquet(f"{folder}/part={name}")


def withdraw(docs: DataFrame, folder: str, name: str, text: str = "text") -> None:
    """Documents as they were added."""
    part(docs, text, -1).write.mode("overwrite").parquet(f"{folder}/part={name}")


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """(term, df) of all parts together, without terms that are gone; the
    number of documents is the row without a term."""
    parts = spark.read.schema(SCHEMA).parquet(folder)
    merged = parts.groupBy("term").agg(F.sum("df").alias("df"))
    return merged.where((F.col("df") != 0) | F.col("term").isNull())


def compacted(spark: SparkSession, folder: str, target: str) -> None:
    """The merged counts as the only part of a new folder."""
    counts(spark, folder).write.mode("overwrite").parquet(f"{target}/part=merged")


def document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return counts(spark, folder).where(F.col("term").isNotNull())


def corpus_size(spark: SparkSession, folder: str):
    """The number of documents as a scalar subquery."""
    stored = spark.read.schema(SCHEMA).parquet(folder).where(F.col("term").isNull())
    return stored.agg(F.coalesce(F.sum("df"), F.lit(0))).scalar()


def inverse_document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """(term, idf) from the stored counts."""
    return document_frequency(spark, folder).select(
        "term", ts.idf_weight(corpus_size(spark, folder), F.col("df")).alias("idf")
    )


def drop(spark: SparkSession, folder: str, name: str) -> None:
    """Forget a part, as if it had not been written."""
    delete(spark, f"{folder}/part={name}")
