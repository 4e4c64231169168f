"""Session set-up that the library needs."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> None:
    """Python workers on this machine find the package; a checkpoint folder is set where the cluster names none."""
    sc = spark.sparkContext
    root = str(Path(__file__).resolve().parents[1])
    known = sc.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        sc.environment["PYTHONPATH"] = f"{root}:{known}" if known else root
    if not sc.getConf().get("spark.checkpoint.dir") and not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="transect-"))


def shared_dir(spark: SparkSession) -> str:
    prepare(spark)
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
