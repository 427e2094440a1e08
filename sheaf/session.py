"""Session settings shared by tests, the bench and the command line."""

from __future__ import annotations

import os
import tempfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession


def session(cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session that is there."""
    cpus = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the fixture tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only in local mode, where it may be unset, a folder of this machine."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sheaf-checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """A copy of df in the shared folder, cut off from its plan: it stays as it is, whatever executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def observed(observation: Observation, name: str = "n") -> int:
    """A counter that was observed; 0 where Spark saw before the job that there was no row, and left it out."""
    try:
        return observation.get[name] or 0
    except Py4JJavaError:
        return 0
