from pyspark.sql import functions as F

from wordweave.session import FREED, Scratch, cut


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {name for name in names if name.startswith("shuffle_")}


def test_stored_frames_leave_no_shuffle_files(spark):
    """They used to stay until the driver collected what refers to them."""
    sums = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    before = shuffle_files(spark)
    with Scratch(spark) as scratch:
        kept, stored = scratch.keep(sums), cut(sums)
        assert shuffle_files(spark) <= before
        assert kept.count() == stored.count() == sums.count() == 7
    assert spark.conf.get(FREED, None) in (None, "false")
