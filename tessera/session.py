"""Session settings the engine expects, and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: ANSI mode gives the warehouse dialect's errors on overflow and bad casts; UTC pins instants.
DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.timeType.enabled": "true",
}


def build(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the engine's defaults; on a cluster, call :func:`configure` on yours."""
    builder = SparkSession.builder.master(master).appName("tessera")
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session; partition counts stay the caller's."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); our own only where that is unset and nothing is shared.

    A cluster's executors can't see a folder of one machine, so there the setting has to be made.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all scratch folders: to be called between jobs, when no frame that was read from one is in use."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tessera")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and reread it: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small iterative state through a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
