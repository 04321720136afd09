"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str = "*", shuffle_partitions: int = 8, conf: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.config(map=conf or {}).master(f"local[{cores}]")
        .appName("auxoline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only on a local master."""
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder")
    return tempfile.mkdtemp(prefix="auxoline-checkpoint-")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the written rows.

    Used for frames that several later jobs read (optimiser steps, model
    results), so that they are computed once and survive lost executors.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """As many partitions as the session plans for shuffles, or ``least`` if that is more, by key.

    Adaptive execution sizes partitions by bytes and would merge small ones; work that is heavy
    per row (a matrix per subject) needs the tasks rather than the bytes.
    """
    return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)
