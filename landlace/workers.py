"""What Python workers need."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession | None = None) -> None:
    """Let workers import this package, also where the driver was started from another folder; on a cluster, --py-files does."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    env = spark.sparkContext.environment
    if ROOT not in (now := env.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, now) if x)


_local: list[str] = []  # the temporary folder of a local session, if one had to be made


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one the cluster names in spark.checkpoint.dir. Where it names none, a local session (one machine, as in
    tests) takes a temporary one that goes with the process; a cluster is told so."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and sc.master.startswith("local") and not sc.master.startswith("local-"):
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="landlace-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        base = "file://" + _local[0]
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/landlace-{sc.applicationId}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The rows as a table written in the shared folder and read again: the lineage ends there, a lost executor loses nothing, and the size
    that plans are made by is the table's own (checkpoint() keeps the estimate of the whole lineage, which multiplies from round to round)."""
    folder = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
