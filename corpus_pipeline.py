"""A pipeline from raw documents to token ids, in stages over the whole corpus.

Each stage works on all that its predecessor kept. ``run`` writes every stage's
result as Parquet to the shared folder and reads it again, so a lost executor
costs at most one stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wordweave.llm import contamination, exact, pieces, quality, simhash
from wordweave.llm.common import table
from wordweave.llm.queries import PIECE_MODEL
from wordweave.session import delete, shared_folder


# Each stage gets documents as Parquet files hold them and returns those that stay,
# all columns; the last one returns their codes. A row is kept or dropped as such, by
# its own text: NULL and empty texts, long texts, ids that repeat or are NULL, and
# columns of any name pass. No rows give no rows.


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose text the classifier rejects; a NULL text is
    judged as an empty one."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that with the smallest id; NULL equals empty, and
    a row stored twice stays once."""
    return exact.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest id; texts
    without words are one group."""
    return simhash.deduplicated(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that hold a passage of the benchmark; texts without
    words hold none."""
    return contamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, n_tokens, token_ids, decoded), one row
    per row; a NULL text is encoded as an empty one."""
    kept = ["doc_id", "lang", "source", "n_chars"]
    return pieces.encoded(docs, public_tokenizers.path(PIECE_MODEL), kept)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("sentencepiece", pieces_stage),
]

# Fingerprints, trained tables and encodings are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            # What a stage has read is not needed once its own result is written.
            delete(spark, f"{folder}/{number - 1}")
    return docs
