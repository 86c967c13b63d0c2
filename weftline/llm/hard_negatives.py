"""Hard-negative mining with segment summaries.

Stored with every vector are, for 4 and again for 16 segments of it, the mean and the deviation of the segment's numbers. The inner
product of two segments is the product of their means (times their length) plus or minus at most that of their deviations, so the
summaries bound the score of two vectors. Pairs outside what is asked for go by the bounds of 4 segments, the rest by those of 16, and
only what is left is scored exactly, in whole numbers.

The anchors meet all rows in blocks of both: a task holds one block of each, works through it in tiles, and only the best few per
list leave it. Neither side is ever whole in one place, and a label that a third of all rows bear is dealt out like any other.

Two passes: an anchor's positives are its best rows of its own label (the bound to beat is the n-th best of some exact scores); then, with the
positives' scores known, its negatives are the best of other labels whose score lies within each positive's range.

Defined results: rows without vec_id, label or vector, or with a null or non-finite component, take no part; of rows that share a vec_id
the one with the smallest (label, vector) does; vectors meet only vectors of their own length; a positive score below 0 has
no negatives, as its range is empty; equal scores go by the smaller vec_id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, table

#: Segments of a vector at the levels of the summary.
LEVELS = (4, 16)
ANCHORS, ROWS, TILE = 1024, 8192, 2048
SCALE = 256


def summaries(q: np.ndarray) -> np.ndarray:
    """Per row: for each level the segments' means, times the root of their length, then the norms of what deviates from them."""
    out = []
    for parts in LEVELS:
        cuts = np.array_split(np.arange(q.shape[1]), min(parts, max(1, q.shape[1])))
        x = [q[:, c].astype(float) for c in cuts]
        mean = [s.sum(axis=1) / np.sqrt(max(1, s.shape[1])) for s in x]
        out += [np.stack(mean, axis=1), np.stack([np.sqrt(((s - (s.mean(axis=1, keepdims=True) if s.shape[1] else 0)) ** 2).sum(axis=1)) for s in x], axis=1)]
    return np.concatenate(out, axis=1)


def _levels(s: np.ndarray, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for parts in LEVELS:
        n = min(parts, max(1, dim))
        out.append((s[:, at : at + n], s[:, at + n : at + 2 * n]))
        at += 2 * n
    return out


def stored(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q, summary) of (vec_id, label, embedding): whole-number components and the segments' summaries."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & fine)
    q = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), q.alias("q"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("row")).select("vec_id", "row.label", "row.q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(2).to_pylist()
            sums = [summaries(np.array([v], np.int64).reshape(1, len(v)))[0] for v in own] if len(set(map(len, own))) > 1 else summaries(np.array(own, np.int64).reshape(len(own), -1)) if own else []
            yield pa.record_batch([*b.columns, pa.array(list(sums), pa.list_(pa.float64()))], names=["vec_id", "label", "q", "summary"])

    return rows.mapInArrow(run, "vec_id long, label long, q array<long>, summary array<double>")


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    return t[name].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)


def _bounds(a: tuple, r: tuple, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (i, j) the least and largest score that one level leaves possible."""
    mid, off = np.einsum("ij,ij->i", a[0][i], r[0][j]), np.einsum("ij,ij->i", a[1][i], r[1][j])
    slack = 1 + 1e-9 * (np.abs(mid) + off)
    return mid - off - slack, mid + off + slack


def _exact(a: np.ndarray, r: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", a[i[k : k + (1 << 17)]], r[j[k : k + (1 << 17)]]) for k in range(0, len(i), 1 << 17)]) if len(i) else np.zeros(0, np.int64)


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best of each group."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return order[place < n]


class _Side:
    def __init__(self, t: pa.Table):
        self.ids, self.labels, self.q = t["vec_id"].to_numpy(), t["label"].to_numpy(), _matrix(t, "q")
        self.levels = _levels(_matrix(t, "summary"), self.q.shape[1])

    def some(self, at: np.ndarray) -> _Side:
        out = object.__new__(_Side)
        out.ids, out.labels, out.q, out.levels = self.ids[at], self.labels[at], self.q[at], [(m[at], d[at]) for m, d in self.levels]
        return out


def _positives(a: _Side, r: _Side, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score): the n best rows of each anchor's label but itself."""
    found = []
    for label in np.intersect1d(a.labels, r.labels):
        x, mine = a.some(np.flatnonzero(a.labels == label)), np.flatnonzero(r.labels == label)
        for k in range(0, len(mine), TILE):
            y = r.some(mine[k : k + TILE])
            (ma, da), (mr, dr) = x.levels[0], y.levels[0]
            mid, off = ma @ mr.T, da @ dr.T
            most = mid + off + 1 + 1e-9 * (np.abs(mid) + off)
            most[x.ids[:, None] == y.ids[None, :]] = -np.inf
            probes = min(4 * n, most.shape[1])
            j = np.argpartition(-most, probes - 1, axis=1)[:, :probes].ravel()
            i = np.repeat(np.arange(len(x.ids)), probes)
            real = x.ids[i] != y.ids[j]
            exact = np.where(real, _exact(x.q, y.q, i, j).astype(float), -np.inf).reshape(-1, probes)
            beat = np.sort(exact, axis=1)[:, -n] if probes >= n else np.full(len(x.ids), -np.inf)
            i, j = np.nonzero((most >= beat[:, None]) & (most > -np.inf))
            fine = _bounds(x.levels[1], y.levels[1], i, j)[1] >= beat[i]
            i, j = i[fine], j[fine]
            score = _exact(x.q, y.q, i, j)
            top = _best(i, score, y.ids[j], n)
            found.append((x.ids[i[top]], y.ids[j[top]], score[top]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _negatives(a: _Side, r: _Side, owner: np.ndarray, positive: np.ndarray, p: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(anchor, positive, positive score, row, score): the n best rows of other labels in the range of each (owner's place, positive, p)."""
    found = []
    sure = p >= 0
    owner, positive, p = owner[sure], positive[sure], p[sure]
    low, high = np.full(len(a.ids), np.inf), np.full(len(a.ids), -np.inf)
    np.minimum.at(low, owner, 0.8 * p - 1)
    np.maximum.at(high, owner, p)
    for k in range(0, len(r.ids), TILE):
        y = r.some(np.arange(k, min(k + TILE, len(r.ids))))
        (ma, da), (mr, dr) = a.levels[0], y.levels[0]
        mid, off = ma @ mr.T, da @ dr.T
        off += 1 + 1e-9 * (np.abs(mid) + off)
        i, j = np.nonzero((mid + off >= low[:, None]) & (mid - off <= high[:, None]) & (a.labels[:, None] != y.labels[None, :]))
        least, most = _bounds(a.levels[1], y.levels[1], i, j)
        fine = (most >= low[i]) & (least <= high[i])
        i, j = i[fine], j[fine]
        score = _exact(a.q, y.q, i, j)
        fine = (score >= low[i]) & (score <= high[i])
        i, j, score = i[fine], j[fine], score[fine]
        if not len(i):
            continue
        order = np.argsort(owner, kind="stable")
        start = np.searchsorted(owner[order], np.arange(len(a.ids) + 1))
        times = start[i + 1] - start[i]
        pair = np.repeat(np.arange(len(i)), times)
        of = order[np.repeat(start[i], times) + np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)]
        fine = (80 * p[of] <= 100 * score[pair]) & (score[pair] <= p[of])
        pair, of = pair[fine], of[fine]
        top = _best(of, score[pair], y.ids[j[pair]], n)
        pair, of = pair[top], of[top]
        found.append((a.ids[i[pair]], positive[of], p[of], y.ids[j[pair]], score[pair]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 5


def _met(anchors: DataFrame, rows: DataFrame, f, columns: tuple[str, ...]) -> DataFrame:
    """f(anchors' table, rows' table) for every block of anchors and every block of rows of one vector length."""
    many = lambda df, size: max(1, -(-df.count() // size))
    blocks = {"ab": many(anchors, ANCHORS), "rb": many(rows, ROWS)}

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(blocks[own])).cast("int")).withColumn("dim", F.size("q"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(blocks[other] - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right) if left.num_rows and right.num_rows else (np.zeros(0, np.int64),) * len(columns)
        return pa.table([pa.array(np.asarray(c, np.int64)) for c in out], names=list(columns))

    left, right = dealt(anchors, "ab", "rb").groupBy("dim", "ab", "rb"), dealt(rows, "rb", "ab").groupBy("dim", "ab", "rb")
    return left.cogroup(right).applyInArrow(run, ", ".join(f"{c} long" for c in columns))


def _ranked(found: DataFrame, by: list[str], score: str, other: str, n: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), other)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def mine(vectors: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchor: which of (vec_id, label, embedding) are anchors."""
    scratch = scratch or Scratch(vectors.sparkSession, "hard-negatives")
    rows = scratch.save(stored(vectors), "stored")
    anchors = scratch.save(rows.filter(anchor), "anchors")

    def best(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, ...]:
        return _positives(_Side(left), _Side(right), n_positives)

    found = _met(anchors, rows, best, ("anchor_id", "positive_id", "score"))
    positives = scratch.save(_ranked(found, ["anchor_id"], "score", "positive_id", n_positives), "positives")
    lists = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("positive_id", "score"))).alias("own"))
    held = anchors.join(lists, "vec_id").select(*anchors.columns, F.col("own.positive_id").alias("positives"), F.col("own.score").alias("scores"))
    held = scratch.save(held, "held")

    def within(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, ...]:
        owner = np.repeat(np.arange(left.num_rows), [len(x) for x in left["positives"]])
        of = lambda c: left[c].combine_chunks().flatten().to_numpy()
        return _negatives(_Side(left), _Side(right), owner, of("positives"), of("scores"), n_negatives)

    found = _met(held, rows, within, ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"))
    out = _ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", n_negatives)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")


def relabelled(vectors: DataFrame) -> DataFrame:
    """Every seventh vector under the next label: a planted disagreement."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", label.alias("label"), "embedding")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(relabelled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 5
"""
