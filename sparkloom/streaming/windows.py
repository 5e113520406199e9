"""Structured Streaming: resampling with a watermark, and files in chunks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType


def resample_stream(df: DataFrame, ts: str, width: str, value: str, by: Sequence[str] = (), late: str = "1 hour") -> DataFrame:
    """by, window_start, sum, mean and count of a streaming (or batch) frame; rows later than the
    watermark are dropped and their windows closed."""
    w = F.window(ts, width)
    grouped = df.withWatermark(ts, late).groupBy(w.alias("w"), *by)
    out = grouped.agg(F.sum(value).alias(f"{value}_sum"), F.avg(value).alias(f"{value}_mean"), F.count(F.lit(1)).alias(f"{value}_count"))
    return out.select(*by, F.col("w.start").alias("window_start"), f"{value}_sum", f"{value}_mean", f"{value}_count")


def read_ndjson_stream(spark: SparkSession, path: str, schema: StructType, files_per_chunk: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_chunk).json(path)


def for_each_chunk(df: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls back with each chunk until the source is used up; an error of the callback ends the query."""
    return df.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_ndjson_stream(df: DataFrame, path: str, checkpoint: str, compression: str = "none") -> StreamingQuery:
    """Appends a streaming frame to NDJSON files until the source is used up; each chunk is written once."""
    out = df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
    return out.option("compression", compression).option("ignoreNullFields", False).outputMode("append").trigger(availableNow=True).start()
