"""Substring deduplication with a log-structured index of window fingerprints.

The index takes batches of documents. Each batch becomes a *run*: an immutable table of the fingerprints of its
blocks (see ``windows``: every 35-word window belongs to one block, and equal windows to blocks with one trigger
fingerprint), with how often each is found and one place of it. Runs are bucketed and sorted by fingerprint, so
that a new run is merge-joined with the runs of the past without moving any of them.

``add``. What the merge join meets is verified by an independent hash of the whole block, and gives the words to
remove at once: in the batch, and in the one earlier document whose block was alone until now.
``compact``. When ``fan_in`` runs have gathered they are merged on the fingerprint into one run. Blocks that share
a trigger with another block, one of them new since the last compaction, but equal none are in doubt; they are verified window by window,
for which the texts of the documents that hold them are read from ``store``.
``spans`` gives all of it. A document without a block in doubt is never read again once it has been added.

Defined results: null and empty texts have no words; a text shorter than a window loses nothing; a row is known by
its doc_id and its text together, so rows with one doc_id or with none are judged each by its own text, and equal rows are
occurrences of each other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, table
from weftline.llm.windows import Windows, split_words, word_symbols

FINGERPRINT = ("anchor", "block")


def key() -> Column:
    """What a row of documents is known by."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(key().alias("key"), F.col("text").cast("binary").alias("text"))


def covered(length: int, width: int, a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which of ``length`` places lie in one of the n windows that start at a, a + 1, ..."""
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, np.minimum(a, length), 1)
    np.add.at(edge, np.minimum(a + n - 1 + width, length), -1)
    return np.cumsum(edge)[:length] > 0


def spans_by_key(repeated: DataFrame) -> DataFrame:
    return repeated.groupBy("key").agg(F.collect_list("a").alias("a"), F.collect_list("n").alias("n"))


class FingerprintIndex:
    def __init__(self, scratch: Scratch, store: DataFrame, width: int = 35, gram: int = 8, fan_in: int = 4):
        """store: the documents (doc_id, text) that have been or will be added; may be set anew as it grows."""
        self.scratch, self.store, self.fan_in = scratch, store, fan_in
        self.windows = Windows(width, gram, word_symbols)
        self.runs: list[DataFrame] = []
        self.found: list[DataFrame] = []
        self.old = 0  # runs that a compaction has made
        self.batches = self.merges = 0

    def add(self, docs: DataFrame) -> DataFrame:
        """Take in docs (doc_id, text); (key, a, n): the runs of n repeated windows from word a that whole blocks show, in the batch or in earlier ones."""
        k, self.batches = self.batches, self.batches + 1
        batch = self.scratch.save(self.windows.blocks(keyed(docs)), f"batch{k}")
        run = self.scratch.save_sorted(self.windows.summary(batch), FINGERPRINT, f"run{k}")
        met = self.scratch.save(self._met(run), f"met{k}")
        here = self.scratch.save(batch.join(met.select(*FINGERPRINT), list(FINGERPRINT)).select("key", "a", "n"), f"here{k}")
        self.scratch.drop(f"batch{k}")
        self.runs.append(run)
        seen = here.unionByName(met.filter("before = 1").select("one.key", "one.a", "one.n"))
        self.found.append(seen)
        if len(self.runs) >= self.fan_in:
            self.compact()
        return seen

    def _met(self, run: DataFrame) -> DataFrame:
        """(anchor, block, before, one): the blocks of a run that are found again, in it or in past runs; how often before, and one place there."""
        out, before, places = run.select(*FINGERPRINT, "times"), F.lit(0), []
        for k, past in enumerate(self.runs):
            past = past.select(*FINGERPRINT, F.col("times").alias(f"times{k}"), F.col("one").alias(f"one{k}"))
            out = out.join(past.hint("merge"), list(FINGERPRINT), "left")
            before, places = before + F.coalesce(f"times{k}", F.lit(0)), [*places, f"one{k}"]
        one = F.coalesce(*places) if places else F.lit(None).cast(run.schema["one"].dataType)
        return out.select(*FINGERPRINT, "times", before.cast("long").alias("before"), one.alias("one")).filter("times > 1 or before > 0").drop("times")

    def compact(self) -> None:
        """Merge all runs into one and settle what is in doubt since the last time."""
        if len(self.runs) <= self.old:
            return
        marked = [run.select(*FINGERPRINT, "times", "one", F.lit(k >= self.old).alias("fresh")) for k, run in enumerate(self.runs)]
        merged = reduce(DataFrame.unionByName, marked).groupBy(*FINGERPRINT).agg(F.sum("times").alias("times"), F.min("one").alias("one"), F.max("fresh").alias("fresh"))
        merged = self.scratch.save_sorted(merged, FINGERPRINT, f"compacted{self.merges}")
        name = f"doubt{self.merges}"
        close = self.windows.doubtful(merged, self.scratch, name)
        self.found.append(self.windows.partly(keyed(self.store), close, self.scratch, name))
        self.runs, self.old, self.merges = [merged], 1, self.merges + 1

    def spans(self) -> DataFrame:
        """(key, a, n): runs of n repeated windows from word a, over all batches."""
        self.compact()
        return reduce(DataFrame.unionByName, self.found)


def deduplicate(docs: DataFrame, batches: int = 4, width: int = 35, fan_in: int = 4, scratch: Scratch | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
    scratch = scratch or Scratch(docs.sparkSession, "substring")
    docs = docs.select("doc_id", "text")
    index = FingerprintIndex(scratch, docs, width, fan_in=fan_in)
    for k in range(batches):
        index.add(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    spans = scratch.save(spans_by_key(index.spans()), "spans")
    joined = docs.select("doc_id", key().alias("key"), F.col("text").cast("binary").alias("text")).join(spans, "key", "left")
    none = F.array().cast("array<int>")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                counts, removed, kept = [], [], []
                for text, a, n in zip(part.column(1), part.column(2), part.column(3)):
                    words = split_words(text.as_py())
                    gone = covered(len(words), width, np.array(a.as_py(), np.int64), np.array(n.as_py(), np.int64))
                    counts.append(len(words))
                    removed.append(int(gone.sum()))
                    kept.append(b" ".join(compress(words, (~gone).tolist())).decode())
                yield pa.record_batch([part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.select("doc_id", "text", F.coalesce("a", none), F.coalesce("n", none)).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
