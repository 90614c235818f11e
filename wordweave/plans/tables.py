"""The input tables as corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordweave.operators.sentiment import lines_of
from wordweave.sources.corpus import spread


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return spread(docs.select("doc_id", *columns, "text"))


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines_of(documents(spark, folder))


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    return spread(turns.select("conv_id", "turn", "text"))


def benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text")
