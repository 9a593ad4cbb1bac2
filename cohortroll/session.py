"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Call-site capture costs milliseconds per column expression while a plan is built.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


TASK_ROWS = 500_000  # rows that ``dealt`` gives a task, about

KEPT: list[str] = []  # paths of the tables that ``keep`` has written in this process


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "16g"):
    """A local session for tests and the bench; on a cluster use the session you are given."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("cohortroll")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` as the cluster names it.

    Only a local session without that setting gets a folder of its own; a cluster without it is
    an error, because executors do not share the driver's disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured:
        folder = configured
    elif sc.getCheckpointDir():
        folder = sc.getCheckpointDir()
    elif sc.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="spark-cohortroll-")
    else:
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so a lost executor never replays the whole history."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame, label: str = "kept") -> DataFrame:
    """Writes a roll-up that several consumers read, so the fact table is scanned once for all.

    The copy lives in the shared folder: it survives lost executors and carries file sizes, which
    lets Spark pick broadcast joins from what was really written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    KEPT.append(path)
    return spark.read.parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by a hash of ``keys`` in as many partitions as keep a task to about ``TASK_ROWS`` of its ``rows`` rows.

    For groups by keys that hardly repeat, where summing up before the shuffle saves nothing: the session's number of shuffle
    partitions is fixed, and with it each task's table of groups would grow with the input. Small tables stay as they are.
    """
    if rows <= 2 * TASK_ROWS:
        return df
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), *keys)


def release_kept(spark: SparkSession) -> int:
    """Deletes what ``keep`` has written so far, and says how many tables those were.

    For the owner of a result, once it is written: frames that still read a kept table fail afterwards.
    """
    configuration = spark._jsc.hadoopConfiguration()
    count = len(KEPT)
    while KEPT:
        path = spark._jvm.org.apache.hadoop.fs.Path(KEPT.pop())
        path.getFileSystem(configuration).delete(path, True)
    return count
