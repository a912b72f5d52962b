"""Cutting lineage by tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where none is set, a temporary folder in local
    mode, where there is one machine, and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not at:
        at = tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/graphloom/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)  # half of what it writes by default
    return df.sparkSession.read.schema(df.schema).parquet(path)
