"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from math import ceil

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", name: str = "wordweave") -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller's
    session is used as it is."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether everything runs in one process; false for local-cluster."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster. Only a
    local session without one gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not is_local(spark):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by the executors")
            configured = tempfile.mkdtemp(prefix="wordweave-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


# The setting by which Spark deletes the shuffle files of a query at its end. Left alone,
# they stay until the driver happens to collect what refers to them.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Queries begun inside leave no shuffle files. For those whose result is stored:
    what is run again later has to be another frame."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there."""
    shared_folder(df.sparkSession)
    # Selected, it is a frame of its own: the caller's can be run again.
    with freeing(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


# Rows a bucket of a stored table holds, about.
BUCKET_ROWS = 500_000


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder wherever it is stored."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Intermediate results in a folder of their own under the shared folder.
    Used as a context: whatever it holds is deleted at its end, also after an
    error, so a result that is to stay has to be ``cut`` inside."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.tables: list[str] = []
        self.written = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, self.folder)

    def keep(self, df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
        """Write ``df`` and go on from there; then forget ``instead_of``."""
        self.written += 1
        path = f"{self.folder}/{self.written}"
        with freeing(self.spark):
            df.write.parquet(path, compression="zstd")
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = path
        if instead_of is not None and (old := self.paths.pop(id(instead_of), None)):
            delete(self.spark, old)
        return kept

    def colocated(
        self, df: DataFrame, rows: int, *keys: str, gathered: Callable[[DataFrame], DataFrame] | None = None
    ) -> DataFrame:
        """Write ``df``, of about ``rows`` rows, as a table bucketed by
        ``keys``. ``gathered`` may group the rows of equal keys, which are then
        in one task, before they are written.

        A later join on the keys reads the buckets in place: the stored side
        is neither shuffled nor recomputed, however many steps join it, and it
        survives the loss of the executors that made it.
        """
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(least, ceil(rows / BUCKET_ROWS))
        name = f"wordweave_{uuid.uuid4().hex}"
        self.tables.append(name)
        laid = df.repartition(buckets, *keys)
        with freeing(self.spark):
            (
                (gathered(laid) if gathered else laid)
                .write.format("parquet")
                .bucketBy(buckets, *keys)
                .option("path", f"{self.folder}/{name}")
                .saveAsTable(name)
            )
        return self.spark.table(name)
