"""Hard negatives against all pairs in plain Python."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, score long, q string"


def plain(rows, n=5):
    """rows: (vec_id, label, whole-number vector)."""
    out = []
    for a, la, qa in rows:
        if a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(qa, q)), i, lb) for i, lb, q in rows if i != a and len(q) == len(qa)]
        best = sorted(((-s, i) for s, i, lb in scored if lb == la))[:n]
        for neg, i in best:
            p = -neg
            fine = sorted((-s, j) for s, j, lb in scored if lb != la and 80 * p <= 100 * s <= 100 * p)[:n]
            out += [(a, i, k + 1, j, p, -s) for k, (s, j) in enumerate(fine)]
    return sorted(out)


def held(spark, rows, partitions=3):
    df = spark.createDataFrame([(i, lb, v, 1, "x") for i, lb, v in rows], SCHEMA).repartition(partitions)
    return hn.mine(hn.relabelled(df), F.col("vec_id") % 100 == 0)


def whole(rows):
    at = {}
    for i, lb, v in rows:
        if i is None or lb is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((lb + 1) % 10 if i % 7 == 0 else lb, [math.floor(256 * float(np.float32(x))) for x in v])
        at[i] = min(row, at.get(i, row))
    return [(i, *row) for i, row in at.items()]


def test_equals_all_pairs_on_mixed_rows(spark, monkeypatch):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(4)]
    rows = [(k, c, [x + rng.gauss(0, 0.6) for x in centres[c]]) for k in range(900) for c in [rng.choice([0, 0, 0, 1, 2, 3])]]
    rows += [(1000 + k, 1, [round(rng.gauss(0, 1)) * 0.5 for _ in range(5)]) for k in range(120)]  # another length, many ties
    rows += [(3000 + k, 9, rows[7][2]) for k in range(40)] + [(100, 2, rows[8][2]), rows[200], rows[300]]
    rows += [(2001, None, rows[3][2]), (None, 1, rows[3][2]), (2002, 1, None), (2003, 1, [None] * 24), (2100, 1, [math.nan] * 24), (2200, 1, [math.inf] + [0.0] * 23), (2300, 1, []), (2301, 2, [])]
    monkeypatch.setattr(hn, "ANCHORS", 3)
    monkeypatch.setattr(hn, "ROWS", 100)
    monkeypatch.setattr(hn, "TILE", 37)
    got = held(spark, rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain(whole(rows))
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want
    assert held(spark, rows[:0]).count() == 0


def test_bounds_hold_every_score():
    rng = np.random.default_rng(4)
    for dim in (1, 3, 16, 50, 64):
        a, r = (rng.integers(-300, 300, (40, dim)) + rng.integers(-200, 200, (40, 1)) for _ in range(2))
        i, j = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40)))
        exact, width = (a[i] * r[j]).sum(axis=1), []
        for x, y in zip(hn._levels(hn.summaries(a), dim), hn._levels(hn.summaries(r), dim)):
            low, high = hn._bounds(x, y, i, j)
            assert (low <= exact).all() and (exact <= high).all()
            width.append((high - low).mean())
        assert width[1] <= width[0] + 1e-6


def test_equals_sql(spark, sf_dir):
    import compare

    assert not compare.differences(hn.op13_hard_negatives(spark, sf_dir), compare.connect(sf_dir), hn.SQL)
