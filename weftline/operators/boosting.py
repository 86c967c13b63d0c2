"""Boosted trees on the pairwise ranking loss, learned as Spark aggregations over binned rows.

Columns are cut into quantile bins once, and a row is then a byte a column. Each round takes the loss over all pairs of a positive and a
negative row, log(1 + exp(s_neg - s_pos)), divided by the number of negatives. No pairs are made: scores are summed up in ``GRID`` cells
a label, and a row's gradient follows from the cells of the other label alone. A tree grows level by level. For a level, each task adds up
gradients and hessians by (node, column, bin), one aggregation adds the tasks' sums, and the best split of each node is the largest gain
over their running sums. What reaches the driver is the cells and one split a node.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.sources.scratch import saved

GRID, BINS = 4096, 64


def as_array(columns: list[str], vectors: dict[str, int] | None = None) -> Column:
    """The columns' numbers in one array; vectors contribute as many as their length. Nothing known is NaN."""
    from pyspark.ml.functions import vector_to_array

    parts = [vector_to_array(c) if c in (vectors or {}) else F.array(F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))) for c in columns]
    return F.concat(*parts)


def names(columns: list[str], vectors: dict[str, int] | None = None) -> list[str]:
    return [n for c in columns for n in ([c, *(f"{c}_{k}" for k in range(1, vectors[c]))] if c in (vectors or {}) else [c])]


def cuts_of(x: DataFrame, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Distinct quantiles of each place of the arrays x: a value goes to the bin of the number of cuts that are not above it."""
    grid = F.array(*[F.lit(k / (bins - 1)) for k in range(1, bins - 1)])
    flat = x.select(F.posexplode("x").alias("at", "value")).filter(~F.isnan("value"))
    found = {r["at"]: r["q"] for r in flat.groupBy("at").agg(F.percentile_approx("value", grid, F.lit(10_000)).alias("q")).collect()}  # bins numbers a column
    return [np.unique(found.get(k, [])).astype(float) for k in range(width)]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bytes: 0 for NaN, else 1 and the number of cuts that are not above the value."""
    out = np.zeros(x.shape, np.uint8)
    for k, c in enumerate(cuts):
        out[:, k] = np.where(np.isnan(x[:, k]), 0, 1 + np.searchsorted(c, x[:, k], side="right"))
    return out


@dataclass
class Tree:
    """Nodes in the order of their making; a leaf has column -1. Rows whose bin is below the limit go left."""

    column: list[int] = field(default_factory=lambda: [-1])
    limit: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, column: int, limit: int, gain: float) -> tuple[int, int]:
        at = len(self.column)
        self.column[node], self.limit[node], self.left[node], self.gain[node] = column, limit, at, gain
        for values, new in ((self.column, -1), (self.limit, 0), (self.left, -1), (self.value, 0.0), (self.gain, 0.0)):
            values += [new, new]
        return at, at + 1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        column, limit, left = np.array(self.column), np.array(self.limit), np.array(self.left)
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while (inner := column[at] >= 0).any():
            go = left[at] + (bins[rows, np.maximum(column[at], 0)] >= limit[at])
            at = np.where(inner, go, at)
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class PairwiseTrees:
    """A fitted model. ``transform`` adds ``score``; ``save`` and ``load`` keep it as text files."""

    columns: list[str]
    vectors: dict[str, int]
    cuts: list[np.ndarray]
    trees: list[Tree]
    history: list[dict]

    def transform(self, rows: DataFrame) -> DataFrame:
        cuts, trees, own = self.cuts, self.trees, [c for c in rows.columns if c != "score"]

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            bins = binned(np.stack(x.to_list()).astype(float), cuts)
            return pd.Series(sum((t.scores(bins) for t in trees), np.zeros(len(bins))))

        return rows.select(*own, score(as_array(self.columns, self.vectors)).alias("score"))

    def importance(self, spark: SparkSession) -> DataFrame:
        """(feature, importance, splits): the gain's share and how many nodes split on it."""
        told = names(self.columns, self.vectors)
        gain, splits = np.zeros(len(told)), np.zeros(len(told), int)
        for t in self.trees:
            for c, g in zip(t.column, t.gain):
                if c >= 0:
                    gain[c], splits[c] = gain[c] + g, splits[c] + 1
        total = gain.sum() or 1.0
        return spark.createDataFrame([(n, float(g / total), int(s)) for n, g, s in zip(told, gain, splits)], "feature string, importance double, splits long")

    def save(self, spark: SparkSession, path: str) -> None:
        head = {"columns": self.columns, "vectors": self.vectors, "cuts": [c.tolist() for c in self.cuts], "history": self.history}
        lines = [(0, json.dumps(head)), *((k + 1, json.dumps(vars(t))) for k, t in enumerate(self.trees))]
        spark.createDataFrame(lines, "at long, value string").write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PairwiseTrees:
        head, *trees = (json.loads(r["value"]) for r in spark.read.schema("at long, value string").parquet(path).orderBy("at").collect())
        return cls(head["columns"], head["vectors"], [np.array(c) for c in head["cuts"]], [Tree(**t) for t in trees], head["history"])


def gradients(score: np.ndarray, positive: np.ndarray, cells: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of each row, from the cells (mean score, number) of the negative (0) and the positive (1) rows."""
    total = max(1.0, cells[0][1].sum())
    values, back = np.unique(score, return_inverse=True)
    out = []
    for label in (0, 1):
        mean, n = cells[1 - label]
        g, h = np.zeros(len(values)), np.zeros(len(values))
        for k in range(0, len(values), 1024):
            d = values[k : k + 1024, None] - mean[None, :]
            p = 1 / (1 + np.exp(np.clip(d if label else -d, -60, 60)))
            g[k : k + 1024], h[k : k + 1024] = (-p if label else p) @ n / total, (p * (1 - p)) @ n / total
        out.append((g[back], h[back]))
    return tuple(np.where(positive, out[1][k], out[0][k]) for k in (0, 1))


def _cells(rows: DataFrame, grid: int) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], float]:
    """Cells of equal width of the scores of each label, and the area under the ROC curve that they show."""
    low, high = rows.agg(F.coalesce(F.min("score"), F.lit(0.0)), F.coalesce(F.max("score"), F.lit(0.0))).first()
    cell = F.least(F.floor((F.col("score") - low) / (max(high - low, 1e-12) / grid)), F.lit(grid - 1))
    found = rows.groupBy("label", cell.alias("cell")).agg(F.avg("score").alias("mean"), F.count("*").alias("n")).collect()  # 2 * grid rows at most
    cells = {k: tuple(np.array([r[c] for r in found if r["label"] == k], float) for c in ("mean", "n")) for k in (0, 1)}
    by = sorted((r["cell"], r["label"], r["n"]) for r in found)
    below, area, k = 0.0, 0.0, 0
    while k < len(by):
        same = [x for x in by[k : k + 2] if x[0] == by[k][0]]
        neg, pos = sum(n for _, y, n in same if not y), sum(n for _, y, n in same if y)
        area, below, k = area + pos * (below + neg / 2), below + neg, k + len(same)
    pairs = cells[0][1].sum() * cells[1][1].sum()
    return cells, float(area / pairs) if pairs else float("nan")


def fit(
    rows: DataFrame, columns: list[str], rounds: int = 150, depth: int = 10, step: float = 0.1, share: float = 0.6, vectors: dict[str, int] | None = None,
    min_child_weight: float = 1.0, penalty: float = 1.0, bins: int = BINS, grid: int = GRID, valid: DataFrame | None = None, keep_every: int = 8,
) -> PairwiseTrees:
    """Trees on label (0 or 1) over numbers and vectors (with their lengths).

    share: of the columns that a tree may use, chosen by a hash of its number. Scores are written with the rows every ``keep_every`` rounds; in
    between tasks add what the newest trees say. history has the area under the ROC curve of each round on rows and on valid.
    """
    vectors = vectors or {}
    width = len(names(columns, vectors))
    x = saved(rows.select(F.col("label").cast("int").alias("label"), as_array(columns, vectors).alias("x")), "boosting-rows")
    cuts = cuts_of(x, width, bins)

    def packed(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield pd.DataFrame({"label": b["label"], "bins": [r.tobytes() for r in binned(np.stack(b["x"].to_list()).astype(float), cuts)], "score": 0.0})

        return df.mapInPandas(run, "label int, bins binary, score double")

    def rescored(df: DataFrame, trees: list[Tree]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    own = np.frombuffer(b"".join(b["bins"]), np.uint8).reshape(len(b), width)
                    yield b.assign(score=sum((t.scores(own) for t in trees), b["score"].to_numpy()))

        return df.mapInPandas(run, "label int, bins binary, score double") if trees else df

    held = [saved(packed(x), "boosting-bins")]
    if valid is not None:
        held.append(saved(packed(valid.select(F.col("label").cast("int").alias("label"), as_array(columns, vectors).alias("x"))), "boosting-valid"))
    trees, fresh, history = [], [], []
    for k in range(rounds + 1):
        now = [rescored(df, fresh) for df in held]
        if len(fresh) >= keep_every:
            now = held = [saved(df, "boosting-scored") for df in now]
            fresh = []
        found = [_cells(df.select("label", "score"), grid) for df in now]
        history.append({"round": k, "train_auc": found[0][1], "valid_auc": found[1][1] if valid is not None else None})
        if k == rounds:
            break
        turn = sorted(range(width), key=lambda c: hashlib.md5(f"{k}#{c}".encode()).hexdigest())
        tree = _grow(now[0], found[0][0], sorted(turn[: max(1, math.ceil(share * width))]), width, depth, step, min_child_weight, penalty)
        trees.append(tree)
        fresh = [*fresh, tree]
    return PairwiseTrees(columns, vectors, cuts, trees, history)


def _grow(rows: DataFrame, cells: dict, used: list[int], width: int, depth: int, step: float, least: float, penalty: float) -> Tree:
    tree, open_nodes = Tree(), {0}
    for level in range(depth + 1):
        at = Tree(**vars(tree))
        wanted, last = np.array(sorted(open_nodes)), level == depth
        use = np.array(used[:1] if last else used)  # the leaves of the last level need no more than their sums

        def run(batches: Iterator[pd.DataFrame], at: Tree = at, wanted: np.ndarray = wanted, use: np.ndarray = use) -> Iterator[pd.DataFrame]:
            sums = np.zeros((2, len(wanted), len(use), 256))
            for b in batches:
                if not len(b):
                    continue
                own = np.frombuffer(b"".join(b["bins"]), np.uint8).reshape(len(b), width)
                g, h = gradients(b["score"].to_numpy(), b["label"].to_numpy() == 1, cells)
                node = at.nodes(own)
                place = np.minimum(np.searchsorted(wanted, node), len(wanted) - 1)
                fine = wanted[place] == node
                place, own, g, h = place[fine], own[fine], g[fine], h[fine]
                for j, c in enumerate(use):
                    key = place * 256 + own[:, c]
                    for total, w in zip(sums, (g, h)):
                        total[:, j] += np.bincount(key, w, len(wanted) * 256).reshape(len(wanted), 256)
            i, j, b = np.nonzero(sums[1])
            yield pd.DataFrame({"node": wanted[i], "column": use[j], "bin": b, "g": sums[0][i, j, b], "h": sums[1][i, j, b]})

        found = rows.mapInPandas(run, "node long, column long, bin long, g double, h double").groupBy("node", "column", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        whole = Window.partitionBy("node", "column")
        before = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # 256 bins at most
        sums = found.select("node", "column", "bin", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"{c}l") for c in "gh"], *[F.sum(c).over(whole).alias(f"{c}t") for c in "gh"])
        part = lambda g, h: F.pow(g, F.lit(2)) / (h + penalty)
        gain = part(F.col("gl"), F.col("hl")) + part(F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")) - part(F.col("gt"), F.col("ht"))
        fine = (F.col("hl") >= least) & (F.col("ht") - F.col("hl") >= least)
        gain = F.when(fine, F.round(gain, 12)).otherwise(F.lit(0.0))
        best = sums.groupBy("node").agg(F.max(F.struct(gain.alias("gain"), (-F.col("column")).alias("c"), (-F.col("bin")).alias("b"))).alias("best"), F.max_by(F.struct("gt", "ht"), -F.col("column")).alias("total"))
        open_nodes = set()
        for r in sorted(best.collect(), key=lambda r: r["node"]):  # a row a node of the level
            tree.value[r["node"]] = float(-step * r["total"]["gt"] / (r["total"]["ht"] + penalty))
            if not last and r["best"]["gain"] > 1e-9:
                open_nodes |= set(tree.split(r["node"], -r["best"]["c"], -r["best"]["b"], r["best"]["gain"]))
        if not open_nodes:
            break
    return tree
