"""Readers. All paths may be a file, a directory or a glob."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordweave.functions import text as tx
from wordweave.session import is_local

VECTOR = T.StructType(
    [T.StructField("term", T.StringType()), T.StructField("value", T.DoubleType())]
)
LEXICON = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("valence", T.DoubleType()),
        T.StructField("polarity", T.DoubleType()),
    ]
)

# Fixed value: one stored pair, ('term', 1.5) or ("it's", np.float64(1.5)).
PAIR = r"""^\(\s*(?:'(.*)'|"(.*)")\s*,\s*(?:np\.float64\()?([^()\s]+)\)?\)\s*$"""


def spread(frame: DataFrame) -> DataFrame:
    """On a local master, deal rows out evenly: the test tables are one file
    with one row group, which is one task. On a cluster the scan stays as it
    is."""
    if not is_local(frame.sparkSession):
        return frame
    return frame.repartition(4 * frame.sparkSession.sparkContext.defaultParallelism)


def read_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(text), one row per line."""
    lines = spark.read.text(path).withColumnRenamed("value", "text")
    return lines if partitions is None else lines.repartition(partitions)


def read_documents(spark: SparkSession, path: str, empty: DataFrame | None = None) -> DataFrame:
    """(doc_id, text), one row per file.

    Spark's file sources leave out empty files. ``empty`` (doc_id) names them
    where they have to count: a manifest, or ``empty_files``.
    """
    texts = (
        spark.read.option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    )
    if empty is None:
        return texts
    return texts.unionByName(empty.select("doc_id", F.lit("").alias("text")))


def empty_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id) of the empty files below a folder or file. The driver walks
    the listing and keeps the names of the empty ones only; with very many
    files give ``read_documents`` a manifest instead."""
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(context._jsc.hadoopConfiguration()).listFiles(root, True)
    names = []
    while files.hasNext():
        file = files.next()
        if file.getLen() == 0 and file.getPath().getName()[0] not in "._":
            names.append((file.getPath().toUri().toString().replace("file:/", "file:///"),))
    return spark.createDataFrame(names, "doc_id string")


def read_headlines(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """(text) of a headline CSV: whole raw lines, or one named column."""
    if column is None:
        return read_lines(spark, path)
    return spark.read.csv(path, header=True).select(F.col(column).alias("text"))


def read_genres(spark: SparkSession, path: str, empty: DataFrame | None = None) -> DataFrame:
    """(mode, genre, file, text) of a corpus laid out as mode/genre/file."""
    docs = read_documents(spark, path, empty)
    place = r"([^/]+)/([^/]+)/([^/]+)$"
    return docs.select(
        F.regexp_extract("doc_id", place, 1).alias("mode"),
        F.regexp_extract("doc_id", place, 2).alias("genre"),
        F.regexp_extract("doc_id", place, 3).alias("file"),
        "text",
    )


def read_characters(spark: SparkSession, path: str) -> DataFrame:
    """(char), one row per character, line ends included."""
    return spark.read.text(path, wholetext=True).select(
        F.explode(tx.characters(F.col("value"))).alias("char")
    )


def parse_pairs(lines: DataFrame) -> DataFrame:
    """(term, value) from text lines ``('term', 1.5)``; a line of another
    form gives NULLs."""
    text = F.col("text")
    matched = text.rlike(PAIR)
    term = F.concat(F.regexp_extract(text, PAIR, 1), F.regexp_extract(text, PAIR, 2))
    return lines.select(
        F.when(matched, term).alias("term"),
        F.when(matched, F.regexp_extract(text, PAIR, 3).try_cast("double")).alias("value"),
    )


def read_vector(spark: SparkSession, path: str, stored: str = "parquet") -> DataFrame:
    """A stored score vector, from Parquet or from its text form."""
    if stored == "parquet":
        return spark.read.schema(VECTOR).parquet(path)
    if stored == "text":
        return parse_pairs(read_lines(spark, path))
    raise ValueError(f"unknown form {stored!r}")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=LEXICON, header=True)


def partition_sizes(frame: DataFrame) -> DataFrame:
    """(partition, rows) as the frame is laid out now."""
    return frame.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("rows"))
