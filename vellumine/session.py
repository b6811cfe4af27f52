"""Session helpers shared by the queries, the tests and the bench."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", name: str = "vellumine") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Only a local master, as in tests, gets a private one where it is unset."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        there = spark.conf.get("spark.checkpoint.dir", None)
        if not there:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            there = tempfile.mkdtemp(prefix="vellumine-", dir=os.environ.get("TMPDIR"))
        sc.setCheckpointDir(there)
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """The folder of the checkpoints itself, for tables and models that several queries share."""
    return checkpoint_dir(spark).rstrip("/").rsplit("/", 1)[0]


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """A reliable checkpoint of df, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
