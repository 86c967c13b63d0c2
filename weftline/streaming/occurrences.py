"""Interactions and popularity kept up as files of occurrences (playlist_id, song_id, pos, at) arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "playlist_id long, song_id long, pos long, at timestamp"


def read(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def interactions(stream: DataFrame) -> DataFrame:
    """The sparse matrix so far: occurrences, and the position of the first."""
    return stream.groupBy(F.col("playlist_id").alias("row_id"), F.col("song_id").alias("col_id")).agg(F.count("*").cast("double").alias("value"), F.min("pos").alias("date"))


def hourly_popularity(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Occurrences of each song an hour; an hour is closed, and its state dropped, once events are ``late`` past it."""
    return stream.withWatermark("at", late).groupBy(F.window("at", "1 hour"), "song_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "song_id", "n")


def write(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Append closed rows to Parquet until all files there are have been read; a restart goes on where this one ended."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
