"""Ranked lists: (playlist_id, song_id, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topn(scored: DataFrame, n: int, by: str = "playlist_id", item: str = "song_id", score: str = "score") -> DataFrame:
    """The n best of each list with their rank from 1; equal scores go by the smaller id."""
    order = Window.partitionBy(by).orderBy(F.desc(score), item)
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= n)


def exclude(scored: DataFrame, seen: DataFrame) -> DataFrame:
    return scored.join(seen.select("playlist_id", "song_id"), ["playlist_id", "song_id"], "left_anti")


def standardized(score: str, by: str = "playlist_id") -> Column:
    """z-score within a list; a list whose deviation is 1e-5 or less stays as it is."""
    w = Window.partitionBy(by)
    std = F.stddev_pop(score).over(w)
    return F.when(std > 1e-5, (F.col(score) - F.avg(score).over(w)) / std).otherwise(F.col(score))


def backfill(scored: DataFrame, spare: DataFrame, n: int) -> DataFrame:
    """Lists of n: what is scored above 0 first, then what only spare ranks, with score 0."""
    own = scored.filter("score > 0").select("playlist_id", "song_id", "score", F.lit(0).alias("src"), F.lit(0).cast("long").alias("spare_rank"))
    more = exclude(spare, own).select("playlist_id", "song_id", F.lit(0.0).alias("score"), F.lit(1).alias("src"), F.col("rank").alias("spare_rank"))
    order = Window.partitionBy("playlist_id").orderBy("src", F.desc("score"), "spare_rank", "song_id")
    return own.unionByName(more).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= n).select("playlist_id", "song_id", "score", "rank")


def hash_sample(df: DataFrame, by: list[str], n: int, order: Column) -> DataFrame:
    """At most n rows of each group, by a hash order any engine reproduces."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("_k") <= n).drop("_k")
