"""Written tables and what they leave behind."""

import time

from pyspark.sql import functions as F

from tidewright.llm import store


def shuffles(spark):
    """Names of the shuffle files that this session has on disk."""
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f.rsplit("/", 1)[-1] for f in files if "/shuffle_" in f}


def test_shuffle_files_go_with_the_write(spark):
    df = spark.range(50_000).repartition(5, "id").groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n"))
    before, setting = shuffles(spark), spark.conf.get(store._CLEANUP, None)
    df.collect()
    assert shuffles(spark) - before  # as any query's, until the driver collects its garbage
    before = shuffles(spark)
    got = store.written(df)
    for _ in range(40):
        if not shuffles(spark) - before:
            break
        time.sleep(0.25)
    assert not shuffles(spark) - before
    assert spark.conf.get(store._CLEANUP, None) == setting
    assert got.count() == 1000 and df.count() == 1000 and got.agg(F.sum("n")).first()[0] == 50_000
