"""Streams: run logs and geocode results as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.logs import STAGE, STAGES
from ..sources.tables import CACHE


def stage_seconds(lines: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """lines (ts, line), a stream or a table -> window, stage, runs, seconds; lines later than `late` are left out."""
    get = lambda i: F.regexp_extract("line", STAGE, i)
    timed = lines.where(F.col("line").rlike(STAGE)).select("ts", get(1).alias("stage"), get(3).try_cast("decimal(18,3)").alias("secs")).where(F.col("stage").isin(STAGES))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "stage").agg(F.count("*").alias("runs"), F.sum("secs").cast("double").alias("seconds")).select(F.col("w.start").alias("start"), "stage", "runs", "seconds")


def cache_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New records of a geocode cache folder that have a place."""
    return spark.readStream.schema(CACHE).json(folder).where("key IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL")
