"""An append-only event log of JSON lines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_events(events: DataFrame, path: str, checked_at: datetime) -> None:
    """Add events and a marker row; the marker is written even when there are no events."""
    kept = events.withColumn("checked_at", F.lit(checked_at)).withColumn("marker", F.lit(False))
    marker = events.sparkSession.createDataFrame([(checked_at, True)], "checked_at timestamp, marker boolean")
    kept.unionByName(marker, allowMissingColumns=True).write.mode("append").json(path)


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, checked_at timestamp, marker boolean").json(path).where("NOT marker").drop("marker")


def last_checked(spark: SparkSession, path: str) -> datetime | None:
    return spark.read.schema("checked_at timestamp, marker boolean").json(path).where("marker").agg(F.max("checked_at")).first()[0]


def unread(events: DataFrame) -> int:
    """How many events are more than minor."""
    return events.where("materiality IN ('critical', 'material')").count()
