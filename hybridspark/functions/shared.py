"""Folders that all executors share, and tables in them that are computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..types import StoreError


def scratch(spark: SparkSession) -> str:
    """A new folder in that of spark.checkpoint.dir; where this is unset a temporary one, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise StoreError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="hybridspark-")
    path = f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def table(df: DataFrame) -> DataFrame:
    """``df``, computed now and written to a scratch folder, which goes when the driver ends: what reads it doesn't compute it again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
