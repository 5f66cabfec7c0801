"""Session helpers: settings a caller may want, and lineage cutting that survives lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster managers supply master and sizes themselves."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: the one ``spark.checkpoint.dir`` names, or the session's checkpoint folder.

    Only where none is set and the session runs in local mode (tests) a temporary folder is used.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return os.path.join(tempfile.gettempdir(), f"tidewright-{os.getpid()}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back: what follows survives a lost executor without
    running the plan behind them again.  The files go when the application ends."""
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"step-{uuid.uuid4().hex}")
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
