"""Where operators put what must outlive a lost executor: the shared folder the cluster names."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset, in local mode (tests), a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isDefined():
            return context.getCheckpointDir().get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder")
        found = tempfile.mkdtemp(prefix="sheaf-checkpoints-")
    return found


#: Spark's setting by which a query's shuffle files go as soon as it has ended.
ENDS_WITH_QUERY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame) -> DataFrame:
    """A copy in the shared folder, cut off from the plan that made it; no executor holds the only one.

    Its shuffle files go when it is written; should something else need them Spark makes them again.
    """
    spark = df.sparkSession
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    before = spark.conf.get(ENDS_WITH_QUERY)
    spark.conf.set(ENDS_WITH_QUERY, str(releases(spark)).lower())
    try:
        return df.select("*").checkpoint(eager=True)  # a query of its own, which sees the setting
    finally:
        spark.conf.set(ENDS_WITH_QUERY, before)


def releases(spark: SparkSession) -> bool:
    """Whether shuffle files of finished steps are dropped at once; spark.sheaf.release = false leaves them to Spark's own pace."""
    return spark.conf.get("spark.sheaf.release", "true") != "false"


def release(spark: SparkSession, rounds: int = 2, pause: float = 0.4) -> None:
    """Let Spark drop the shuffle files of other steps, whose results are written; call it once nothing refers to them.

    What the first collection leaves for the JVM's finalisers only the second one frees; the
    pauses are for Spark's cleaner, which works in the background. It only saves disk: where there
    is plenty, spark.sheaf.release = false leaves it to Spark's own pace.
    """
    if not releases(spark):
        return
    for _ in range(rounds):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)
