"""Mixture-controlled packing of documents into sequences, by deficit round-robin over source queues.

Each source is a queue of its documents' tokens. In every round a queue earns its target share
of one sequence; what it has earned is spent in slots of ``slot`` tokens, and what is left
over, its deficit, carries on to the next round. Rounds, slots and sequences are cut freely out of the
queues, so every sequence but the last is full. Unless ``weights`` are given, the targets are the
sources' own shares, so all queues end together and the mixture holds from the first sequence to the last.

With integer earnings the schedule has a closed form: after j rounds queue q has been served
min(T_q, slot * floor(j * Q_q / slot)) tokens. So the place of any slot follows from the queues' totals
alone, and deficits carry over partitions without any task waiting for another:
documents are tokenised once, get a number each that spreads them evenly whatever their doc_id, take their place in their queue by a two-level prefix sum
(in chunks, then over chunk totals), and each task cuts its own documents.

The ``max_queues`` - 1 largest sources have a queue each and the others share one, which bounds
the table of totals that every task holds. Defined results: a null source is the source ''; null and
empty texts are the end token alone; rows repeating a doc_id are packed as documents of their own; an empty
table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, table

END = 1
#: Earnings are counted in 1/UNIT of a token.
UNIT = 1 << 16


@lru_cache(2)
def _encoder(name: str):
    """Ids of a text, as the ``tokenizers`` file ``name`` gives them, by ``tiktoken`` over the same ranks, several times faster.

    A special token's string in a text is that token, as ``tokenizers`` reads it unless told otherwise.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        return own.encode(text, allowed_special="all") if any(x in text for x in special) else own.encode_ordinary(text)

    return encode


def tokenised(docs: DataFrame, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """(row, doc_id, source, n, ids): row is a number of its own; ids are little-endian unsigned 16-bit numbers, the end token last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for b in batches:
            ids = [np.array([*encode(x.as_py() or ""), END], "<u2") for x in b.column(3)]
            yield pa.record_batch(
                [*b.columns[:3], pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                names=["row", "doc_id", "source", "n", "ids"],
            )

    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), "text")
    return named.mapInArrow(run, "row long, doc_id long, source string, n long, ids binary")


class Schedule:
    """Where the slots of each queue go. totals and earned (1/UNIT tokens a round) by queue."""

    def __init__(self, totals: list[int], weights: list[float], slot: int, sequence: int):
        self.totals = np.array(totals, np.int64)
        share = np.array(weights, float) / (sum(weights) or 1)
        self.earned = np.maximum(np.rint(share * sequence * UNIT), 1).astype(np.int64)
        self.slot, self.sequence = slot, sequence

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens of each queue (columns) served after so many rounds (rows)."""
        return np.minimum(self.totals, rounds[:, None] * self.earned // (self.slot * UNIT) * self.slot)

    def place(self, queue: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place of the first token of slot k of each queue among all tokens."""
        out = np.empty(len(k), np.int64)
        step = max(1, (1 << 20) // max(1, len(self.totals)))
        for a in range(0, len(k), step):
            q, s = queue[a : a + step], k[a : a + step]
            rounds = -((-(s + 1) * self.slot * UNIT) // self.earned[q])
            before, after = self.served(rounds - 1), self.served(rounds)
            within = np.concatenate((np.zeros((len(q), 1), np.int64), np.cumsum(after - before, axis=1)), axis=1)
            rows = np.arange(len(q))
            out[a : a + step] = before.sum(axis=1) + within[rows, q] + s * self.slot - before[rows, q]
        return out

    def pieces(self, queue: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start, length, sequence, offset) of documents of n tokens that begin at first in their queue."""
        slots = (first + n - 1) // self.slot - first // self.slot + 1
        row = np.repeat(np.arange(len(n)), slots)
        k = first[row] // self.slot + np.arange(len(row)) - np.repeat(np.cumsum(slots) - slots, slots)
        a = np.maximum(first[row], k * self.slot)
        b = np.minimum(first[row] + n[row], (k + 1) * self.slot)
        at = self.place(queue[row], k) + a - k * self.slot
        start, length = a - first[row], b - a
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + length[:-1])))  # else the slot goes on where the last one ended
        at, start, row = at[new], start[new], row[new]
        length = np.add.reduceat(length, np.flatnonzero(new)) if len(new) else length
        parts = (at + length - 1) // self.sequence - at // self.sequence + 1
        own = np.repeat(np.arange(len(at)), parts)
        s = at[own] // self.sequence + np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
        x, y = np.maximum(at[own], s * self.sequence), np.minimum(at[own] + length[own], (s + 1) * self.sequence)
        return row[own], start[own] + x - at[own], y - x, s, x - s * self.sequence


def pack(docs: DataFrame, sequence: int = 2048, slot: int = 256, weights: dict[str, float] | None = None, max_queues: int = 4096, chunk_tokens: int = 1 << 17, tokenizer: str = "byte_bpe_50k", scratch: Scratch | None = None) -> DataFrame:
    """Pieces: doc_id, source, start, length, ids (32-bit little-endian), doc_tokens, sequence_id, offset.

    weights: target share of each source in a sequence; sources without one share what their tokens are of all.
    """
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    tokens = scratch.save(tokenised(docs, tokenizer), "tokens")
    by_source = tokens.groupBy("source").agg(F.sum("n").alias("total"))
    named = by_source.orderBy(F.desc("total"), "source").limit(max_queues - 1).collect()
    total = by_source.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    totals = [r["total"] for r in named] + [total - sum(r["total"] for r in named)]
    wanted = [(weights or {}).get(r["source"], r["total"] / max(total, 1)) for r in named] + [totals[-1] / max(total, 1)]
    schedule = Schedule(totals, wanted, slot, sequence)
    spark = docs.sparkSession
    queues = F.broadcast(spark.createDataFrame([(r["source"], k) for k, r in enumerate(named)], "source string, queue int"))  # max_queues rows at most
    chunks = int(min(max(total // chunk_tokens, 1), 1 << 16))
    placed = tokens.join(queues, "source", "left").withColumns({"queue": F.coalesce("queue", F.lit(len(named))), "chunk": F.pmod(F.xxhash64("doc_id", "row"), F.lit(chunks))})
    ends = placed.groupBy("queue", "chunk").agg(F.sum("n").alias("chunk_total"))
    ends = ends.withColumn("chunk_first", F.sum("chunk_total").over(Window.partitionBy("queue").orderBy("chunk")) - F.col("chunk_total")).drop("chunk_total")
    order = Window.partitionBy("queue", "chunk").orderBy("doc_id", "row")
    placed = placed.withColumn("in_chunk", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    placed = placed.join(ends, ["queue", "chunk"]).select("doc_id", "source", "queue", (F.col("chunk_first") + F.col("in_chunk")).alias("first"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            queue, first, n = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3, 4))
            row, start, length, seq, offset = schedule.pieces(queue, first, n)
            ids, last, own = [], -1, None
            for r, a, m in zip(row.tolist(), start.tolist(), length.tolist()):
                if r != last:
                    own, last = np.frombuffer(b.column(5)[r].as_py(), "<u2").astype("<u4"), r
                ids.append(own[a : a + m].tobytes())
            take = pa.array(row)
            for k in range(0, len(ids), 4096):
                s = slice(k, k + 4096)
                yield pa.record_batch(
                    [b.column(0).take(take[s]), b.column(1).take(take[s]), pa.array(start[s]), pa.array(length[s]), pa.array(ids[s], pa.binary()), b.column(4).take(take[s]), pa.array(seq[s]), pa.array(offset[s])],
                    names=["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return placed.mapInArrow(cut, "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))
