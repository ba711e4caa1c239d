"""Session factory, table access and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "graticule", cores: str | int = "*", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own session and settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("GRATICULE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a scale directory (a file or a directory of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder of spark.checkpoint.dir.

    The folder is set here only where the session names none, as in tests on one machine; on a cluster the setting must
    name storage that all executors share.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            where = tempfile.mkdtemp(prefix="graticule-checkpoint-")
        sc.setCheckpointDir(where)
    return df.checkpoint()


def released(spark: SparkSession) -> None:
    """Let go of the files of frames that nothing refers to any more.

    Spark deletes shuffle and checkpoint files when the driver's objects that stand for them are collected; a driver whose
    heap seldom fills puts that off beyond the end of a query.
    """
    spark.sparkContext._jvm.System.gc()
