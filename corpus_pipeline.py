"""A corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, line_dedup, near_copies, packing, quality_rules, simhash
from weftline.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    scored = rules.score(docs.select(F.struct(*docs.columns).alias("_row"), "text"))
    return scored.select(F.inline(F.when(F.col("kept"), F.array("_row"))))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose template recurs; n_chars follows the text."""
    out = line_dedup.deduplicate(docs)
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word Jaccard similarity of 0.8 or more) one row: the smallest by (doc_id, text hash), those without doc_id last."""
    scratch = Scratch(spark, "first")
    # SimHash groups what differs in 3 bits, far fewer than texts at 0.8 do; its links are held to the threshold, and MinHash bands bring in the rest
    near = simhash.linked(docs.select(F.xxhash64("text").alias("doc_id"), "text"), words=near_copies.WORDS)
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")
    rows = docs.select("doc_id", F.xxhash64("text").alias("txt"), key.alias("_key"))
    groups = scratch.save(rows.join(near_copies.roots(docs, more=near), "txt", "left").withColumn("root", F.coalesce("root", "txt")), "groups")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "txt", "_key")).alias("first"))
    first = scratch.save(first.select("first._key"), "keys")
    one = docs.groupBy(key.alias("_key")).agg(F.min(F.struct(*docs.columns)).alias("_row"))  # repeated rows
    return one.join(first.hint("merge"), "_key", "left_semi").select("_row.*")  # most rows: never small at scale


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, mixed by source."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("packing", pack),
]

#: Learned rules, tokenizers and connected components are beyond SQL; tests/llm holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
