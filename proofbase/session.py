"""Session settings and table access shared by every query."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, shared: str = "/tmp/proofbase-checkpoints") -> SparkSession:
    """A session for tests and the bench. A cluster brings its own settings; only result-affecting ones are set here."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("proofbase")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PROOFBASE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session may go without naming one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or f"file://{tempfile.gettempdir()}/proofbase-checkpoints").rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written below the shared folder and read back: what is used more than once is made once."""
    path = f"{work_dir(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
