"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "agropanel", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("AGROPANEL_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="agropanel-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and go on from the written table.

    The plan is computed a single time, survives lost executors, and stays
    columnar, so later steps still prune columns.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that this package wrote, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def replace_folder(spark: SparkSession, new: str, old: str) -> None:
    """Put the folder ``new`` in the place of ``old``, which stays aside until that is done."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    where, aside = path(old).getFileSystem(spark._jsc.hadoopConfiguration()), f"{old.rstrip('/')}-old-{uuid.uuid4().hex}"
    held = where.exists(path(old))
    if held and not where.rename(path(old), path(aside)):
        raise OSError(f"cannot move {old}")
    if not where.rename(path(new), path(old)):
        if held:
            where.rename(path(aside), path(old))
        raise OSError(f"cannot move {new} to {old}")
    if held:
        where.delete(path(aside), True)
    spark.catalog.refreshByPath(old)
