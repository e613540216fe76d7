"""Streaming forms: files of a growing folder cleaned as they arrive, and windows of events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import clean


def stream_csv(spark: SparkSession, folder: str, types: dict[str, str]) -> DataFrame:
    """New CSV files of a folder as typed rows; cells that don't parse are null, as in a batch beyond its validated rows."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in types])
    rows = spark.readStream.csv(folder, schema=schema, header=True, escape='"', nullValue="")
    return rows.select(*(clean(F.col(f"`{c}`"), t).alias(c) for c, t in types.items()))


def windowed_counts(events: DataFrame, time_col: str = "ts", key_col: str = "event_type", value_col: str = "value", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``(period, key, n, total)`` of each window; on a stream events later than ``late`` are left out."""
    rows = events.withWatermark(time_col, late) if events.isStreaming else events
    found = rows.groupBy(F.window(time_col, width), F.col(key_col)).agg(F.count(F.lit(1)).alias("n"), F.sum(value_col).alias("total"))
    return found.select(F.col("window.start").alias("period"), F.col(key_col), "n", "total")
