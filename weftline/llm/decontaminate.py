"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

An item of the benchmark is cut into windows of ``n`` consecutive words (an item of
fewer words is one window). A document word inside an occurrence of a window is hit.

Any occurrence of a window of ``l`` words holds, whole, one of the document's
blocks of ``b = (l + 1) // 2`` words that start at multiples of ``b``. So the scan hashes only
those blocks (each word once) and looks them up in the hash set of all b-grams of
all windows; a match is then verified word by word against the window. The set is
broadcast while its measured size is under ``broadcast_bytes`` and joined by a shuffle beyond.
Everything is DataFrame expressions; documents are never shuffled, only hits are.

Defined results: null and empty texts have no words and no hits; every row is judged by its own text,
as hits go back to rows by doc_id and the text's hash, with a null doc_id as good as any; items without item_id hit
but are not counted or named; an empty benchmark hits nothing; columns of the input other than those named are not read by ``report`` and pass
through ``decontaminate``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, table

#: Everything in ASCII that is neither letter nor digit separates words; A-Z count as a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PIECES = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> Column:
    """Words in their own case."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SEPARATORS), lambda w: w != "")


def _joined(words: Column | str, start: Column, n: Column | int) -> Column:
    """n words from the 0-based start, A-Z lower-cased."""
    return F.translate(F.array_join(F.slice(words, start + 1, n), " "), UPPER, LOWER)


def _key(words: Column | str, start: Column, n: Column | int) -> Column:
    """Hash of n words. lower() folds more than A-Z, so it may only let more through; verification is exact."""
    return F.xxhash64(F.lower(F.array_join(F.slice(words, start + 1, n), " ")))


def item_windows(items: DataFrame, n: int = 13) -> DataFrame:
    """(item_id, window, l): the distinct windows of each item."""
    df = items.select("item_id", _words("text").alias("_w")).filter(F.size("_w") > 0)
    df = df.withColumn("l", F.least(F.lit(n), F.size("_w")))
    starts = F.sequence(F.lit(0), F.size("_w") - F.col("l"))
    return df.select("item_id", "l", "_w", F.explode(starts).alias("_s")).select("item_id", _joined("_w", F.col("_s"), F.col("l")).alias("window"), "l").distinct()


def _blocks(length: int) -> Column:
    """Hashes of the blocks of (length + 1) // 2 words at multiples of that; none in a text shorter than length."""
    b = (length + 1) // 2
    last = F.greatest(F.floor(F.size("_w") / b).cast("int") - 1, F.lit(0))
    found = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.lit(length).alias("l"), (i * b).alias("at"), _key("_w", i * b, b).alias("key")))
    return F.when(F.size("_w") >= length, found).otherwise(F.array().cast("array<struct<l:int,at:int,key:bigint>>"))


def hits(docs: DataFrame, windows: DataFrame, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, txt, start, l, window): where windows occur, start counted in words from 0; txt is the text's hash."""
    distinct = windows.select("window", "l").distinct()
    size, lengths = distinct.agg(F.coalesce(F.sum((F.length("window") + 48) * F.col("l")), F.lit(0)), F.sort_array(F.collect_set("l"))).first()
    grams = distinct.withColumns({"_w": F.split("window", " "), "b": F.floor((F.col("l") + 1) / 2).cast("int")})
    grams = grams.select("window", "l", "b", "_w", F.explode(F.sequence(F.lit(0), F.col("l") - F.col("b"))).alias("o"))
    grams = grams.select("window", "l", "o", _key("_w", F.col("o"), F.col("b")).alias("key"))
    if size <= broadcast_bytes:
        grams = F.broadcast(grams)
    tokens = docs.select("doc_id", F.xxhash64("text").alias("txt"), _words("text").alias("_w"))
    blocks = [_blocks(length) for length in lengths]  # at most n different lengths
    if not blocks:
        return docs.select("doc_id", F.xxhash64("text").alias("txt"), F.lit(0).alias("start"), F.lit(0).alias("l"), F.lit("").alias("window")).limit(0)
    blocks = reduce(lambda a, b: F.concat(a, b), blocks)
    # explode_outer: for explode Spark adds a filter on the exploded column, which would compute all of it twice
    found = tokens.withColumn("_b", blocks).select("doc_id", "txt", "_w", F.explode_outer("_b").alias("_b")).select("doc_id", "txt", "_w", F.col("_b.l").alias("l"), F.col("_b.at").alias("at"), F.col("_b.key").alias("key"))
    found = found.join(grams, ["l", "key"]).withColumn("start", F.col("at") - F.col("o"))
    found = found.filter((F.col("start") >= 0) & (F.col("start") + F.col("l") <= F.size("_w")))
    return found.filter(_joined("_w", F.greatest("start", F.lit(0)), F.col("l")) == F.col("window")).select("doc_id", "txt", "start", "l", "window").distinct()


def spans(found: DataFrame) -> DataFrame:
    """(doc_id, txt, spans, n_hit): the windows' places in each document in order, and the words they cover."""
    per = found.groupBy("doc_id", "txt").agg(F.sort_array(F.collect_set(F.struct("start", "l"))).alias("spans"))
    return per.withColumn(
        "n_hit",
        F.aggregate(
            "spans",
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, x: F.struct(
                (a["n"] + F.greatest(F.lit(0), x["start"] + x["l"] - F.greatest(a["end"], x["start"]))).alias("n"),
                F.greatest(a["end"], x["start"] + x["l"]).alias("end"),
            ),
            lambda a: a["n"],
        ).cast("long"),
    )


def _rejoin(rows: DataFrame, txt: Column, marks: DataFrame, how: str = "inner") -> DataFrame:
    """rows with marks (doc_id, txt, ...) of their doc_id, which may be null, and their text."""
    marks = marks.withColumnsRenamed({"doc_id": "_mark_id", "txt": "_mark_txt"})
    out = rows.join(marks, rows["doc_id"].eqNullSafe(marks["_mark_id"]) & (txt == marks["_mark_txt"]), how)
    return out.drop("_mark_id", "_mark_txt")


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, items: DataFrame, n: int = 13, scratch: Scratch | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted as strings), spans, contaminated."""
    scratch = scratch or Scratch(docs.sparkSession, "decontamination")
    windows = item_windows(items, n)
    found = scratch.save(hits(docs, windows), "hits")  # read twice
    owners = windows.select("window", F.col("item_id").cast("string").alias("item"))
    per_item = found.select("doc_id", "txt", "window").distinct().join(owners, "window").groupBy("doc_id", "txt").agg(F.sort_array(F.collect_set("item")).alias("items"))
    per = spans(found)
    per = _rejoin(per, per["txt"], per_item, "left")
    rows = docs.select("doc_id", F.xxhash64("text").alias("_txt"), F.size(_words("text")).cast("long").alias("n_words"))
    out = _rejoin(rows, rows["_txt"], per, "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", contaminated().alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 13, remove: str = "documents") -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the hit words cut from every text.

    A word goes with the separators before it. Columns stay as they are.
    """
    found = hits(docs, item_windows(items, n))
    marks = spans(found).withColumnRenamed("spans", "_spans").withColumnRenamed("n_hit", "_n_hit")
    if remove == "documents":
        rows = docs.select("doc_id", "text", F.xxhash64("text").alias("txt"))
        words = _rejoin(rows, rows["txt"], marks).select("doc_id", "txt", F.size(_words("text")).alias("n_words"), F.col("_n_hit").alias("n_hit"))
        return _rejoin(docs, F.xxhash64(docs["text"]), words.filter(contaminated()).select("doc_id", "txt").distinct(), "left_anti")
    pieces = F.regexp_extract_all("text", F.lit(PIECES), F.lit(0))
    rest = F.regexp_extract("text", SEPARATORS + "$", 0)
    cut = F.filter(pieces, lambda _, k: ~F.exists("_spans", lambda x: (k >= x["start"]) & (k < x["start"] + x["l"])))
    out = _rejoin(docs, F.xxhash64(docs["text"]), marks, "left")
    return out.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.concat(F.array_join(cut, ""), rest))).select(docs.columns)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")
