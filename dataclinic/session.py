"""Spark session and checkpoint-directory helpers.

Library code never creates its own session: every operator takes a DataFrame
(or a SparkSession) and stays lazy.  ``get_spark`` is for tests, the bench and
scripts; on a cluster the session comes from the platform.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}
LOCAL_CONF = {
    # local mode: the driver JVM is the executor, so it gets the memory.
    "spark.driver.memory": "16g",
}


def get_spark(master: str | None = None, app: str = "dataclinic",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        conf.update(LOCAL_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if os.environ.get("DATACLINIC_SCRATCH"):  # tests and local scripts name their folder
        conf["spark.checkpoint.dir"] = os.environ["DATACLINIC_SCRATCH"]
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    The setting must name storage that the driver and all executors share; there is
    no fallback to a machine-local folder."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        raise ValueError("spark.checkpoint.dir is not set: name a folder on storage that all executors share")
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df):
    """Cut the lineage by writing a parquet table into the shared folder named
    by ``spark.checkpoint.dir`` and reading it back (never ``localCheckpoint``).

    The plan runs once, the table is columnar and compressed, and it lives on
    shared storage, so later stages survive the loss of any executor."""
    import uuid
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)
