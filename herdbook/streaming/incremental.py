"""Incremental versions of keep-first and resume, by Structured Streaming. An extension: batches are the reference form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_keys(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The rows of a stream whose key hasn't been seen within `late` of event time; state beyond that is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, group: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, end, group, n) of tumbling windows; rows later than `late` are dropped."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), group).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream over all that is there and appends it to a Parquet table; a second run only takes what is new."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
