"""SimHash near-duplicates by a self-join of a binary trie of fingerprints.

Fingerprints. A bit is 1 if it is set in over half the hashes of a text's word shingles.

Self-join. Of two fingerprints that differ in at most 3 bits, at least one of the four
16-bit quarters is equal. So there are four tries, each with another quarter as its first 16 levels, and
only pairs inside one 16-level subtree are traversed: the subtrees are the units that Spark
deals out. In a subtree, pairs of nodes go down together one bit at a time, the differing bits add up, and a pair
is pruned when they exceed the budget, or when all leaves of both nodes are known
to be in one component. A subtree beyond ``split_above`` leaves is dealt out again as pairs of its
own lower nodes, by the same pruning. Only a spanning forest of the links of each subtree leaves
a task, so a dense group costs no quadratic output, and no component loses a member.

Defined results: null and empty texts have the fingerprint zero, linked like any other; equal
texts have equal fingerprints; rows repeating a doc_id stay and share its component; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, table
from weftline.llm.components import components

BITS = 3
#: Most bits by which a large part is dealt out again.
WIDEST = 16
CHUNK = 1 << 16


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text with A-Z lower-cased."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    if len(w) < words:
        return xxhash.xxh64_intdigest(b" ".join(w), 42)
    joined, n = b" ".join(w), len(w) - words + 1
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        part = [digest(joined[a:b], 42) for a, b in zip(starts[k : k + CHUNK], stops[k : k + CHUNK])]
        total += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), words) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def roots_of(n: int, i: np.ndarray, j: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """The smallest member of each of n nodes' components under the links (i, j), and those of start."""
    root = np.arange(n) if start is None else start.copy()
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while not (root[root] == root).all():
            root = root[root]


def trie_links(keys: np.ndarray, group: np.ndarray, depth: int, budget: int = BITS, frontier: int = 1 << 19) -> np.ndarray:
    """Roots of the components that links within ``budget`` bits make of sorted distinct (group, keys).

    Keys of a group share their first ``depth`` bits.
    """
    n = len(keys)
    root = np.arange(n)
    if n < 2:
        return root
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    last = np.concatenate((first[1:], [n]))
    some = last - first > 1
    first, last = first[some], last[some]
    zeros: dict[int, np.ndarray] = {}
    for most in range(1, budget + 1):
        change = np.concatenate(([0], np.cumsum(root[1:] != root[:-1])))
        stack = [(depth, first, last, first, last, np.zeros(len(first), np.int8))]
        links_i, links_j = [], []
        while stack:
            d, l1, h1, l2, h2, diff = stack.pop()
            if len(l1) > frontier:
                half = len(l1) // 2
                stack += [(d, *(x[:half] for x in (l1, h1, l2, h2, diff))), (d, *(x[half:] for x in (l1, h1, l2, h2, diff)))]
                continue
            one = (root[l1] == root[l2]) & (change[h1 - 1] == change[l1]) & (change[h2 - 1] == change[l2])
            l1, h1, l2, h2, diff = (x[~one] for x in (l1, h1, l2, h2, diff))
            small = ((h1 - l1) * (h2 - l2) <= 16) | (d >= 64)
            i, j = _pairs(*(x[small] for x in (l1, h1, l2, h2)))
            near = np.bitwise_count(keys[i] ^ keys[j]) <= most
            links_i.append(i[near])
            links_j.append(j[near])
            l1, h1, l2, h2, diff = (x[~small] for x in (l1, h1, l2, h2, diff))
            if not len(l1):
                continue
            if d not in zeros:
                zeros[d] = np.concatenate(([0], np.cumsum((keys >> np.uint64(63 - d)) & np.uint64(1) == 0)))
            z = zeros[d]
            m1, m2, same = l1 + z[h1] - z[l1], l2 + z[h2] - z[l2], l1 == l2
            new = [(l1, m1, l2, m2, diff), (m1, h1, m2, h2, diff), (l1, m1, m2, h2, diff + 1), tuple(x[~same] for x in (m1, h1, l2, m2, diff + 1))]
            new = [np.concatenate(x) for x in zip(*new)]
            ok = (new[1] > new[0]) & (new[3] > new[2]) & (new[4] <= most)
            ok &= ~((new[0] == new[2]) & (new[1] - new[0] == 1))
            stack.append((d + 1, *(x[ok] for x in new)))
        if links_i:
            root = roots_of(n, np.concatenate(links_i), np.concatenate(links_j), root)
    return root


def _pairs(l1: np.ndarray, h1: np.ndarray, l2: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with i in [l1, h1), j in [l2, h2) for each row."""
    w = h2 - l2
    count = (h1 - l1) * w
    row = np.repeat(np.arange(len(l1)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return l1[row] + at // w[row], l2[row] + at % w[row]


def _rotated(fp: np.ndarray, quarter: np.ndarray) -> np.ndarray:
    q = quarter.astype(np.uint64) * np.uint64(16)
    return (fp << q) | (fp >> ((np.uint64(64) - q) & np.uint64(63))) * (q > 0)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, fp, quarter) sorted by part; the links of each part as stars."""
    held: list[tuple[np.ndarray, ...]] = []

    def links(part: np.ndarray, fp: np.ndarray, quarter: np.ndarray) -> pa.RecordBatch:
        fp = fp.view(np.uint64)
        keys = _rotated(fp, quarter)
        _, group = np.unique(part, return_inverse=True)
        order = np.lexsort((keys, group))
        keys, group, fp = keys[order], group[order], fp[order].view(np.int64)
        root = trie_links(keys, group, 16)
        own = root != np.arange(len(root))
        return pa.record_batch([pa.array(fp[own]), pa.array(fp[root[own]])], names=["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(tuple(b.column(k).to_numpy(zero_copy_only=False) for k in range(3)))
        if sum(len(x[0]) for x in held) >= CHUNK:
            rows = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last part may go on in the next batch
            if cut:
                yield links(*(x[:cut] for x in rows))
            held = [tuple(x[cut:] for x in rows)]
    if held:
        yield links(*(np.concatenate(x) for x in zip(*held)))


def _balls(bits: int, budget: int) -> list[int]:
    return [sum(1 << b for b in c) for k in range(budget + 1) for c in combinations(range(bits), k)]


def links(fps: DataFrame, scratch: Scratch, split_above: int = 1 << 16) -> DataFrame:
    """Links (u, v) between distinct fingerprints (fp) whose components are those of all pairs within BITS bits."""
    quarters = fps.select("fp", F.explode(F.array(*map(F.lit, range(4)))).alias("quarter"))
    # the quarter's bits, counted from the highest, are what the rotation brings to the front
    block = F.expr("shiftrightunsigned(fp, 48 - 16 * quarter) & 65535")
    rows = quarters.select("fp", "quarter", (F.col("quarter") * 65536 + block).alias("part"))
    sizes = rows.groupBy("part").count().filter(F.col("count") > split_above)
    bits = F.least(F.lit(WIDEST), F.ceil(F.log2(F.col("count") / split_above)).cast("int") + 1)
    large = scratch.save(sizes.select("part", bits.alias("bits")), "large")  # 4 * 65536 rows at most, as there are no more parts
    rows = rows.join(F.broadcast(large), "part", "left")
    # a large part is dealt out by pairs of its lower nodes: the next bits below the quarter, and those within the budget of them
    turned = "shiftleft(fp, 16 * quarter) | if(quarter > 0, shiftrightunsigned(fp, (64 - 16 * quarter) % 64), 0L)"
    rows = rows.withColumn("lower", F.expr(f"shiftrightunsigned({turned}, 48 - bits) & (shiftleft(1L, bits) - 1)"))
    masks = F.filter(F.array(*map(F.lit, _balls(WIDEST, BITS))), lambda x: x < F.expr("shiftleft(1L, bits)"))
    pairs = F.transform(masks, lambda x: F.least("lower", F.col("lower").bitwiseXOR(x)) * (1 << 17) + F.greatest("lower", F.col("lower").bitwiseXOR(x)))
    pairs = F.when(F.col("bits").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)
    rows = rows.select("fp", "quarter", "part", F.explode_outer(pairs).alias("pair")).withColumn("part", F.col("pair") * (1 << 18) + F.col("part"))
    rows = rows.select(F.col("part").cast("long"), "fp", F.col("quarter").cast("int"))
    dealt = rows.repartition("part").sortWithinPartitions("part")
    return scratch.save(dealt.mapInArrow(_forest, "u long, v long").distinct(), "forest")


def near_duplicates(docs: DataFrame, words: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """Per row of docs: doc_id, fp, component_id (the smallest doc_id that links lead to)."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, words), "fingerprints")
    fps = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct")
    roots = components(links(fps.select("fp"), scratch), scratch)
    grouped = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    grouped = scratch.save(grouped, "grouped")
    least = scratch.save(grouped.groupBy("root").agg(F.min("first_doc").alias("component_id")), "least")
    named = scratch.save(grouped.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def linked(docs: DataFrame, words: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """(u, v): pairs of doc_ids that connect each component of ``near_duplicates``, as far as one subtree of the trie shows it."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, words), "fingerprints")
    fps = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct")
    same = prints.join(fps, "fp").select(F.col("doc_id").alias("u"), F.col("first_doc").alias("v"))
    across = links(fps.select("fp"), scratch)
    for x in "uv":
        across = across.join(fps.select(F.col("fp").alias(x), F.col("first_doc").alias(f"{x}_doc")), x)
    return same.unionByName(across.select(F.col("u_doc").alias("u"), F.col("v_doc").alias("v"))).filter("u <> v").distinct()


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
