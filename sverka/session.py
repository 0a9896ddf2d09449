"""Session helpers: a shared place for checkpoints and written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (tests, a single machine) is a local folder used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        if context.master.startswith("local-cluster") or not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="sverka-")
        spark.conf.set("spark.checkpoint.dir", named)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; it survives a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as parquet in the shared folder and read it back: cuts lineage, keeps columns prunable."""
    path = fresh_path(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def importable(spark: SparkSession) -> None:
    """Lets Python workers find this package where it stands, whatever their working folder.

    On a cluster whose machines don't share that folder, ship the package with addPyFile.
    """
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
