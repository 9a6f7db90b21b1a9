"""Where queries put the tables that they write and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which a cluster shares; a local one only where Spark runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="chronofold-")
    return f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` as a table in a new folder, read back: work on it isn't done twice, nor again when an executor is lost."""
    path = f"{folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
