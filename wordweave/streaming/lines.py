"""The sentiment interval filter on a growing folder of text files.

Scoring is a column expression, so the batch operators apply unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from wordweave.functions.lexicon import DEFAULT_LEXICON, Lexicon
from wordweave.operators.sentiment import VALENCE, score_between


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder).withColumnRenamed("value", "text")


def filter_lines(
    spark: SparkSession,
    folder: str,
    lower: float = -1.0,
    upper: float = 1.0,
    method: str = VALENCE,
    lexicon: Lexicon = DEFAULT_LEXICON,
) -> DataFrame:
    """Streaming frame of the lines whose score lies in the interval."""
    return score_between(stream_lines(spark, folder), lower, upper, method, lexicon)


def store_filtered(
    lines: DataFrame,
    target: str,
    checkpoint: str,
    lower: float = -1.0,
    upper: float = 1.0,
    method: str = VALENCE,
    lexicon: Lexicon | DataFrame = DEFAULT_LEXICON,
) -> DataStreamWriter:
    """A writer of the lines whose score lies in the interval, as Parquet
    below ``target``; the caller sets the trigger and starts it.

    A lexicon table gathers the ratings of a text, which a stream cannot do line by
    line, so each micro-batch is scored as a batch. It has a folder of its own that
    a repeated batch replaces: every line is stored once, also after a failure.
    """

    def store(batch: DataFrame, number: int) -> None:
        kept = score_between(batch, lower, upper, method, lexicon)
        kept.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
