"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordweave.operators.lmdata import in_rows_of


def as_pair(term: str, value: str) -> Column:
    """The text form of a vector entry, ``('term', 1.5)``."""
    return F.concat(F.lit("('"), F.col(term), F.lit("', "), F.col(value).cast("string"), F.lit(")"))


def write_vector(vector: DataFrame, value: str, path: str, stored: str = "parquet") -> None:
    if stored == "parquet":
        vector.select("term", F.col(value).cast("double").alias("value")).write.parquet(path)
    elif stored == "text":
        vector.select(as_pair("term", value)).write.text(path)
    else:
        raise ValueError(f"unknown form {stored!r}")


def write_lines(lines: DataFrame, path: str, column: str = "text") -> None:
    """Surviving lines or generated sentences, one per line."""
    lines.select(column).write.text(path)


def write_top(top: DataFrame, value: str, path: str) -> None:
    """A top-k report as one file in rank order; bounded by its k."""
    ranked = top.orderBy(F.desc(value), F.asc("term"))
    ranked.coalesce(1).select(as_pair("term", value)).write.text(path)


def write_similarity(similarity: DataFrame, left: str, right: str, path: str) -> None:
    """One tab-separated line: left name, right name, similarity."""
    similarity.select(F.lit(left), F.lit(right), "similarity").coalesce(1).write.csv(path, sep="\t")


def write_generated_words(paths: DataFrame, path: str, per_line: int = 20) -> None:
    """Generated words, ``per_line`` to a line, the lines of a path in order."""
    rows = in_rows_of(paths, per_line)
    rows.repartitionByRange("path_id").sortWithinPartitions("path_id", "line_no").select(
        "text"
    ).write.text(path)
