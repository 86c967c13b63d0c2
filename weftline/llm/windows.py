"""Repeated windows of words or bytes, found through trigger positions instead of all windows.

A rolling hash over ``gram`` symbols runs along each text. Every window of ``width`` symbols has one *trigger*,
the leftmost place of the smallest hash in it, and equal windows have it at the same place. Consecutive windows
with one trigger form a *block*: the stretch of text they span, cut out by its triggers. So the corpus
becomes a few blocks per hundred symbols, (hash of the gram at the trigger, hash of the stretch).

1. Blocks found twice or more: all their windows repeat.
2. A block found once, whose trigger gram occurs in another block as well, may share some windows with it. One
   occurrence of each such block is looked at closely: its windows are halved into runs (``steps``) aligned to the
   trigger, and a run is hashed in two ways. If the part common to all its windows is nowhere else,
   none of them repeats; if its whole stretch is found twice, all do; else it goes on to the next step,
   down to single windows.

All of it is grouping and joining by hash, with pre-aggregation before every shuffle, so that copies collapse where
they are read; joins that give rows back to their documents have freshly read tables on both sides, where
Spark splits skewed keys. Equality means that two independent 64-bit hashes are equal, of the
trigger's gram and of the stretch, or of the same window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch

U = np.uint64
HIGH, LOW = U(0xFFFFFFFF00000000), U(0xFFFFFFFF)
BASES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9))
BYTES = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, (2, 256), dtype=np.uint64)
KEPT_POWERS = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Rolling:
    """Hashes of ranges of a sequence of symbols, by prefix sums modulo 2^64."""

    def __init__(self, symbols: np.ndarray, family: int):
        n = len(symbols)
        have = _powers.get(family)
        if have is None or len(have[0]) <= n:
            size = max(n + 1, KEPT_POWERS)
            inverse = U(pow(int(BASES[family]), -1, 1 << 64))
            have = tuple(np.cumprod(np.concatenate((np.ones(1, U), np.full(size, x)))) for x in (BASES[family], inverse))
            if size == KEPT_POWERS:  # those of longer texts go with the text
                _powers[family] = have
        self.back = have[1]
        self.sums = np.concatenate((np.zeros(1, U), np.cumsum(symbols * have[0][:n])))

    def ranges(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.back[start] + U(1) * np.asarray(length).astype(U))

    def grams(self, k: int) -> np.ndarray:
        return mix((self.sums[k:] - self.sums[:-k]) * self.back[: len(self.sums) - k])


def split_words(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def word_symbols(text: bytes | None) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in split_words(text)], U)


def byte_symbols(text: bytes | None) -> np.ndarray:
    return np.frombuffer(text or b"", np.uint8)


def families(symbols: np.ndarray) -> tuple[Rolling, Rolling]:
    """Two independent rolling hashes of words (64-bit symbols) or bytes."""
    if symbols.dtype == np.uint8:
        return Rolling(BYTES[0][symbols], 0), Rolling(BYTES[1][symbols], 1)
    return Rolling(symbols, 0), Rolling(mix(symbols ^ U(0x2545F4914F6CDD1D)), 1)


def _minima(keys: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each ``size`` consecutive keys, in log(size) passes."""
    span = 1
    while span * 2 <= size:
        keys, span = np.minimum(keys[:-span], keys[span:]), span * 2
    return np.minimum(keys[: len(keys) - (size - span)], keys[size - span :])


@dataclass(frozen=True)
class Windows:
    width: int
    gram: int
    symbols: Callable[[bytes | None], np.ndarray]
    #: Sizes of runs of windows, largest first; the last is 1.
    steps: tuple[int, ...] = (1,)

    # ---- inside a task

    def blocks_of(self, symbols: np.ndarray) -> tuple[np.ndarray, ...]:
        """(p, a, n, anchor, block): trigger, first window, number of windows, and the two hashes."""
        if len(symbols) < self.width:
            return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, U, U))
        one, two = families(symbols)
        grams = one.grams(self.gram)
        trigger = _minima((grams & HIGH) | np.arange(len(grams), dtype=U), self.width - self.gram + 1) & LOW
        a = np.concatenate(([0], np.flatnonzero(trigger[1:] != trigger[:-1]) + 1))
        n = np.diff(np.concatenate((a, [len(trigger)])))
        p = trigger[a].astype(np.int64)
        return p, a, n, grams[p], two.ranges(a, n - 1 + self.width) ^ mix((p - a).astype(U))

    def runs_of(self, text: list[bytes], p: np.ndarray, first: np.ndarray, a: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        """(row, a, n, core, span) of the runs of ``size`` windows of contexts that begin at first."""
        symbols = np.frombuffer(b"".join(text), np.uint8 if self.symbols is byte_symbols else U)
        lengths = np.fromiter(map(len, text), np.int64, len(text)) // symbols.itemsize
        shift = np.cumsum(lengths) - lengths - first  # from a place in its text to one in symbols
        one, two = families(symbols)
        low, high = (p - (a + n - 1)) // size, (p - a) // size
        count = high - low + 1
        row = np.repeat(np.arange(len(p)), count)
        at = (low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * size
        p, s0, s1 = p[row], np.maximum(a[row], p[row] - at - size + 1), np.minimum((a + n - 1)[row], p[row] - at)
        core = one.ranges(p - at + shift[row], self.width - size + 1) ^ mix(at.astype(U))
        span = two.ranges(s0 + shift[row], s1 - s0 + self.width) ^ mix((p - s0).astype(U))
        return row, s0, s1 - s0 + 1, core, span

    # ---- on tables; docs have (key, text as binary)

    def blocks(self, docs: DataFrame) -> DataFrame:
        """(key, p, a, n, anchor, block) of every text."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [self.blocks_of(self.symbols(x.as_py())) for x in b.column(1)]
                if found:
                    key = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(x[0]) for x in found])
                    p, a, n, anchor, block = map(np.concatenate, zip(*found))
                    yield _batch(key=key, p=p.astype(np.int32), a=a.astype(np.int32), n=n.astype(np.int32), anchor=anchor.view(np.int64), block=block.view(np.int64))

        return docs.select("key", "text").mapInArrow(run, "key long, p int, a int, n int, anchor long, block long")

    @staticmethod
    def summary(blocks: DataFrame) -> DataFrame:
        """(anchor, block, times, one): how often each block is found, and one occurrence (key, p, a, n)."""
        return blocks.groupBy("anchor", "block").agg(F.count("*").alias("times"), F.min(F.struct("key", "p", "a", "n")).alias("one"))

    @staticmethod
    def doubtful(summary: DataFrame, scratch: Scratch, name: str = "close") -> DataFrame:
        """(key, p, a, n, open): one occurrence of each block that shares its anchor with others, where one of them is found once (open) and one is new.

        summary may say which blocks are new by a column ``fresh``; else all are.
        """
        fresh = F.col("fresh") if "fresh" in summary.columns else F.lit(True)
        return _mixed(summary.withColumns({"open": F.col("times") == 1, "fresh": fresh}), "anchor", scratch, name)

    def partly(self, docs: DataFrame, close: DataFrame, scratch: Scratch, name: str = "partly") -> DataFrame:
        """(key, a, n): the runs of n repeated windows from a in the open ones of the doubtful blocks; their texts are read from docs."""
        marks = scratch.save(close.groupBy("key").agg(F.collect_list(F.struct("p", "a", "n", "open")).alias("marks")), f"{name}-marks")
        contexts = scratch.save(self._contexts(docs.join(marks, "key")), f"{name}-contexts")
        rows = contexts.select("key", "p", "first", "a", "n", "open", "context")
        covered = []
        for k, size in enumerate(self.steps):
            runs = scratch.save(self._runs(rows, size), f"{name}-runs{k}")
            found = scratch.save(
                runs.groupBy("core", "span").agg(F.count("*").alias("times"), F.max("open").alias("any_open"), F.min(F.struct("key", "p", "a", "n")).alias("one")), f"{name}-found{k}"
            )
            again = scratch.save(found.filter("times > 1 and any_open").select("core", "span"), f"{name}-again{k}")
            covered.append(scratch.save(runs.filter("open").join(again, ["core", "span"]).select("key", "a", "n"), f"{name}-covered{k}"))
            scratch.drop(f"{name}-runs{k}")
            if size > 1:
                left = _mixed(found.withColumns({"open": (F.col("times") == 1) & F.col("any_open"), "fresh": F.lit(True)}), "core", scratch, f"{name}-left{k}")
                rows = left.join(contexts.select("key", "p", "first", "context"), ["key", "p"]).select("key", "p", "first", "a", "n", "open", "context")
        scratch.drop(f"{name}-contexts", f"{name}-marks")
        out = covered[0]
        for more in covered[1:]:
            out = out.unionByName(more)
        return out

    def _contexts(self, marked: DataFrame) -> DataFrame:
        """The symbols that the windows of each mark span."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(0, b.num_rows, 512):
                    part = b.slice(k, 512)
                    keys, context, marks = [], [], []
                    for key, text, own in zip(part.column(0), part.column(1), part.column(2)):
                        symbols, key = self.symbols(text.as_py()), key.as_py()
                        for m in own.as_py():
                            keys.append(key)
                            marks.append((m["p"], m["a"], m["n"], m["open"]))
                            context.append(symbols[m["a"] : m["a"] + m["n"] - 1 + self.width].tobytes())
                    p, a, n, is_open = (np.array(x) for x in zip(*marks)) if marks else (np.empty(0, int),) * 4
                    yield _batch(key=np.array(keys, np.int64), p=p.astype(np.int32), first=a.astype(np.int32), a=a.astype(np.int32), n=n.astype(np.int32), open=is_open.astype(bool), context=pa.array(context, pa.binary()))

        return marked.select("key", "text", "marks").mapInArrow(run, "key long, p int, first int, a int, n int, open boolean, context binary")

    def _runs(self, rows: DataFrame, size: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(0, b.num_rows, 2048):
                    part = b.slice(k, 2048)
                    p, first, a, n = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 5))
                    row, a, n, core, span = self.runs_of(part.column(6).to_pylist(), p, first, a, n, size)
                    key, is_open = (part.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 5))
                    yield _batch(key=key, p=p[row].astype(np.int32), a=a.astype(np.int32), n=n.astype(np.int32), open=is_open, core=core.view(np.int64), span=span.view(np.int64))

        return rows.mapInArrow(run, "key long, p int, a int, n int, open boolean, core long, span long")


def _batch(**columns) -> pa.RecordBatch:
    return pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def _mixed(found: DataFrame, by: str, scratch: Scratch, name: str) -> DataFrame:
    """One occurrence (key, p, a, n, open) of each row of found whose ``by`` other rows share, some of these being open and some fresh."""
    shared = found.groupBy(by).agg(F.count("*").alias("rows"), F.max("open").alias("some"), F.max("fresh").alias("new")).filter("rows > 1 and some and new").select(by)
    shared = scratch.save(shared, f"{name}-shared")
    return scratch.save(found.join(shared, by).select("one.*", "open"), name)
