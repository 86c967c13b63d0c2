"""Removal of repeated byte strings by a parse of the corpus into phrases.

Triggers of a rolling hash cut every text into phrases (see ``windows``): a text is a sequence of phrases, the
corpus a dictionary of distinct phrases and the order in which they come. Strings of 400 bytes that are equal are cut by
the same triggers, so all their occurrences stand together when the occurrences of phrases are ordered
by what follows each trigger; phrases found once are ordered among those with the same trigger by what
surrounds it, in steps of 64, 16, 4 and 1 byte. The order is by hash, not by byte value: for repeats only equality counts,
and a hash order is dealt out evenly where an order by bytes gives one task all texts that begin alike.

Phrases of exact and near copies collapse into one dictionary entry where they are read,
which is what makes the method cheap on highly repetitive text.

Defined results: null and empty texts have no bytes; a text shorter than 400 bytes loses nothing; a row is known by its
doc_id and its text together, so rows with one doc_id or with none are judged each by its own text, and equal rows
are occurrences of each other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, table
from weftline.llm.substring_dedup import covered, key, spans_by_key
from weftline.llm.windows import Windows, byte_symbols


def deduplicate(docs: DataFrame, width: int = 400, gram: int = 200, scratch: Scratch | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary)."""
    scratch = scratch or Scratch(docs.sparkSession, "suffix")
    windows = Windows(width, gram, byte_symbols, steps=tuple(s for s in (64, 16, 4, 1) if s < width - gram))
    texts = docs.select("doc_id", key().alias("key"), F.col("text").cast("binary").alias("text"))
    parse = scratch.save(windows.blocks(texts), "parse")
    dictionary = scratch.save(windows.summary(parse), "dictionary")
    again = scratch.save(dictionary.filter("times > 1").select("anchor", "block"), "again")
    whole = scratch.save(parse.join(again, ["anchor", "block"]).select("key", "a", "n"), "covered")
    close = windows.doubtful(dictionary, scratch)
    scratch.drop("parse", "again", "dictionary")
    spans = scratch.save(spans_by_key(whole.unionByName(windows.partly(texts.select("key", "text"), close, scratch))), "spans")
    none = F.array().cast("array<int>")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                out: list[list] = [[], [], [], []]
                for text, a, n in zip(part.column(1), part.column(2), part.column(3)):
                    own = byte_symbols(text.as_py())
                    gone = covered(len(own), width, np.array(a.as_py(), np.int64), np.array(n.as_py(), np.int64))
                    edges = np.diff(np.concatenate(([False], gone)).astype(np.int8))
                    for column, x in zip(out, (len(own), int(gone.sum()), int((edges == 1).sum()), own[~gone].tobytes())):
                        column.append(x)
                yield pa.record_batch([part.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = texts.join(spans, "key", "left").select("doc_id", "text", F.coalesce("a", none), F.coalesce("n", none))
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
