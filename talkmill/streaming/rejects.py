"""Reject loading and timestamp reading over streams: both are row by row, so the batch operators run unchanged on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions.instants import single_instants
from talkmill.operators.rejects import load_records


def stream_table(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_records(lines: DataFrame, source_files: DataFrame, action_catalog: DataFrame) -> DataFrame:
    """Typed rows and rejects of a stream of sheet lines; the small tables are static and broadcast."""
    return load_records(lines, source_files, action_catalog)


def stream_instants(rows: DataFrame, words: dict[str, int], *, raw: str, zone: str, order: str) -> DataFrame:
    """Rows with `event_time` for watermarks and windows; null where the value has not exactly one instant."""
    us = single_instants(words, F.col(raw), F.col(zone), F.col(order))
    return rows.withColumn("event_time", F.timestamp_micros(us))


def messages_per_hour(rows: DataFrame, conversation: str, late: str = "2 hours") -> DataFrame:
    """Messages of each conversation in each hour, with a bound on lateness."""
    return rows.filter("event_time is not null").withWatermark("event_time", late).groupBy(F.window("event_time", "1 hour").alias("hour"), conversation).agg(F.count("*").alias("n"))
