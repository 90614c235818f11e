"""The registered queries of this subpackage."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordweave.llm import (
    alignment,
    collocation,
    contamination,
    exact,
    langid,
    lattice,
    licences,
    pieces,
    quality,
    simhash,
    sql,
    tokencount,
    toxicity,
    urls,
)
from wordweave.llm.common import table

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"

# The rules of the URL filter: verdict, host, path.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    coded = pieces.encoded(docs, public_tokenizers.path(PIECE_MODEL))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_licences(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.licences(table(spark, folder, "documents"), reserved=True)
    return found.where("confirmed")


def op6_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.filtered(table(spark, folder, "pages"), URL_RULES).drop("score")


def op7_exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact.duplicate_groups(table(spark, folder, "documents"))


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.language(table(spark, folder, "documents"))


def op9_contamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return contamination.contaminated(docs, items)


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return tokencount.token_counts(docs, public_tokenizers.path(PIECE_MODEL))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    both = public_tokenizers.path(BYTE_MODEL), public_tokenizers.path(PIECE_MODEL)

    def digest(groups: str, ends: list[int]) -> str:
        return hashlib.sha256(groups.encode()).hexdigest() if groups else ""

    return alignment.aligned(docs, *both, results={"groups_sha256": (digest, "string")}, spans=False)


def op12_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.near_vectors(table(spark, folder, "embeddings"))


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocation.phrases(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_simhash,
        op3_toxicity,
        op4_pieces,
        op5_licences,
        op6_urls,
        op7_exact,
        op8_language,
        op9_contamination,
        op10_token_counts,
        op11_alignment,
        op12_embeddings,
        op13_phrases,
    )
}

ORACLE: dict[str, str] = {
    "op6_urls": sql.url_filter(URL_RULES),
    "op7_exact": sql.exact_duplicates(),
    "op12_embeddings": sql.near_vectors(),
    "op13_phrases": sql.phrases(),
}
