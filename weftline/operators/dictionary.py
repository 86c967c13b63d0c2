"""Categories as dense ids, and features of them as sparse matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import hashed_order
from weftline.sources.scratch import saved


def numbered(df: DataFrame, *order: str, name: str = "idx", blocks: int | None = None) -> DataFrame:
    """df with name, its rows' numbers from 0 in a total order, dense and unique.

    The rows are dealt out once by ranges of their order (blocks: how many, else as many as shuffles have partitions), sorted inside each range, and written with their place. Places and the
    ranges' sizes are both read from that table, so they cannot follow different cut points, and no task sees all rows.
    """
    own, blocks = [c for c in df.columns if c != name], blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(own).repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    dealt = saved(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")  # (range << 33) + place
    part, place = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1)
    ends = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy(part).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(ends), F.lit(0)).alias("_first"))  # a row a range
    return dealt.withColumn("_part", part).join(F.broadcast(before), "_part").select(*own, (F.col("_first") + place).cast("long").alias(name))


def permuted(df: DataFrame, *ids: str, seed: str = "0", name: str = "idx", blocks: int | None = None) -> DataFrame:
    """df with name, places from 0 of a shuffle of the whole table by MD5 of the seed and the ids, which tell its rows apart."""
    return numbered(df.withColumn("_turn", hashed_order(seed, *ids)), "_turn", *ids, name=name, blocks=blocks).drop("_turn")


def first_seen(df: DataFrame, category: str, *order: str, blocks: int | None = None) -> DataFrame:
    """(category, idx): ids from 0 in the order in which categories first come; equal places by category."""
    firsts = df.filter(F.col(category).isNotNull()).groupBy(category).agg(F.min(F.struct(*order)).alias("_first_at"))
    return numbered(firsts, "_first_at", category, blocks=blocks).select(category, "idx")


def encode(df: DataFrame, category: str, dictionary: DataFrame) -> DataFrame:
    """df with idx; categories that the dictionary does not hold are dropped, as it is frozen."""
    return df.join(dictionary, category)


def numeric_feature(df: DataFrame, row: str, value: str) -> DataFrame:
    """One column 0 with the value; rows without it are absent."""
    return df.filter(F.col(value).isNotNull()).select(F.col(row).alias("row_id"), F.lit(0).cast("long").alias("col_id"), F.col(value).cast("double").alias("value"))


def category_feature(df: DataFrame, row: str, category: str, dictionary: DataFrame) -> DataFrame:
    """A one at the category's id."""
    return encode(df, category, dictionary).select(F.col(row).alias("row_id"), F.col("idx").alias("col_id"), F.lit(1.0).alias("value"))


def bag_feature(df: DataFrame, row: str, category: str, dictionary: DataFrame) -> DataFrame:
    """How often a row has each category; rows without categories are absent."""
    return encode(df, category, dictionary).groupBy(F.col(row).alias("row_id"), F.col("idx").alias("col_id")).agg(F.count("*").cast("double").alias("value"))


def text_feature(df: DataFrame, row: str, words: Column, dictionary: DataFrame, category: str) -> DataFrame:
    """A bag of the words of a text column."""
    return bag_feature(df.select(row, F.explode(words).alias(category)), row, category, dictionary)
