"""Streaming ingestion of facts by their availability (an addition: the batch operators are the core).

Facts arrive late and more than once. A stream keeps each fact once within its watermark and appends it
to the table that as-of operators read, partitioned by the day on which it became available.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def facts_stream(spark: SparkSession, path: str, schema: StructType, keys: list[str], available_time: str = "available_time", lateness: str = "2 days") -> DataFrame:
    """Facts of a growing folder of Parquet files, each once; those later than the watermark are left out."""
    stream = spark.readStream.schema(schema).parquet(path).withWatermark(available_time, lateness)
    return stream.dropDuplicatesWithinWatermark([*keys, available_time])


def append_facts(stream: DataFrame, path: str, checkpoint: str, available_time: str = "available_time", once: bool = True) -> StreamingQuery:
    """Append to the history table; with ``once`` the query ends when what is there is read."""
    writer = stream.withColumn("available_day", F.to_date(available_time)).writeStream.format("parquet").partitionBy("available_day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, available_time: str = "available_time", window: str = "1 day", by: tuple[str, ...] = ()) -> DataFrame:
    """Facts by window of availability, final once the watermark has passed."""
    return stream.groupBy(F.window(available_time, window), *by).agg(F.count(F.lit(1)).alias("facts"))
