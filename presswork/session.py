"""Session settings that the results depend on, or that keep plans adaptive; tables between jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting for the removal of shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "presswork", master: str | None = None, **settings: str) -> SparkSession:
    """A session with UTC time and adaptive plans; `settings` are further Spark settings, with underscores for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """A new folder for tables between jobs, in the shared folder that the cluster names in `spark.checkpoint.dir`.

    Without that setting, and only where all tasks run in this process, it is a temporary folder, which is then also set as
    the checkpoint folder. On a cluster each executor would write such a folder on its own disk, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="presswork-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/presswork/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes all tables between jobs of this application. Results that haven't been written yet may still need them."""
    jvm, folder = spark.sparkContext._jvm, shared_dir(spark).rsplit("/", 1)[0]
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """Writes `df` to the shared folder and reads it again: later jobs neither redo it nor need its executors.

    The shuffle files of the write go as soon as it has ended, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path, before = shared_dir(spark), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
