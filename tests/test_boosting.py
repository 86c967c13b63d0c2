"""Pairwise trees against a plain numpy version with all pairs written out."""

import hashlib
import math

import numpy as np
import pytest

from weftline.operators import boosting, stage2


def plain(x, y, cuts, rounds, depth, step, share, least, penalty):
    bins, score, width = boosting.binned(x, cuts), np.zeros(len(y)), x.shape[1]
    for k in range(rounds):
        p = 1 / (1 + np.exp(score[y == 1][:, None] - score[y == 0][None, :]))  # positives x negatives
        n = (y == 0).sum()
        g, h = np.zeros(len(y)), np.zeros(len(y))
        g[y == 1], g[y == 0] = -p.sum(axis=1) / n, p.sum(axis=0) / n
        h[y == 1], h[y == 0] = (p * (1 - p)).sum(axis=1) / n, (p * (1 - p)).sum(axis=0) / n
        turn = sorted(range(width), key=lambda c: hashlib.md5(f"{k}#{c}".encode()).hexdigest())
        used = sorted(turn[: max(1, math.ceil(share * width))])
        out = np.zeros(len(y))

        def grow(rows, level):
            gt, ht = g[rows].sum(), h[rows].sum()
            best = (1e-9, 0, 0)
            if level < depth:
                for c in used:
                    for b in range(1, 256):
                        left = rows[bins[rows, c] < b]
                        gl, hl = g[left].sum(), h[left].sum()
                        if hl >= least and ht - hl >= least:
                            gain = round(gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty), 12)
                            if (gain, -c, -b) > best and (gain, -c) > best[:2]:
                                best = (gain, -c, -b)
            if best[0] > 1e-9:
                right = bins[rows, -best[1]] >= -best[2]
                grow(rows[~right], level + 1)
                grow(rows[right], level + 1)
            else:
                out[rows] = -step * gt / (ht + penalty)

        grow(np.arange(len(y)), 0)
        score += out
    return score


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(200, 4)), 1)
    x[rng.random((200, 4)) < 0.05] = np.nan
    y = (np.nan_to_num(x[:, 0]) + np.nan_to_num(x[:, 1] * x[:, 2]) + rng.normal(size=200) * 0.5 > 0.3).astype(int)
    return x, y


def test_equals_all_pairs(spark, data, tmp_path):
    x, y = data
    rows = spark.createDataFrame([(k, int(b), *(None if np.isnan(v) else float(v) for v in a)) for k, (a, b) in enumerate(zip(x, y))], "id long, label int, a double, b double, c double, d double").repartition(3)
    model = boosting.fit(rows.filter("id % 5 <> 9"), list("abcd"), rounds=3, depth=3, step=0.3, share=0.75, valid=rows.filter("id % 5 = 0"), keep_every=2)
    got = np.array([r["score"] for r in model.transform(rows).orderBy("id").collect()])
    want = plain(x, y, model.cuts, 3, 3, 0.3, 0.75, 1.0, 1.0)
    assert np.allclose(got, want, atol=1e-6)
    aucs = [r["train_auc"] for r in model.history]
    pairs = got[y == 1][:, None] - got[y == 0][None, :]
    assert aucs[0] == 0.5 and abs(aucs[-1] - ((pairs > 0).mean() + (pairs == 0).mean() / 2)) < 2e-3 and model.history[-1]["valid_auc"] > 0.6
    model.save(spark, str(tmp_path / "m"))
    again = boosting.PairwiseTrees.load(spark, str(tmp_path / "m"))
    assert np.allclose([r["score"] for r in again.transform(rows).orderBy("id").collect()], got)
    top = {r["feature"]: r for r in model.importance(spark).collect()}
    assert abs(sum(r["importance"] for r in top.values()) - 1) < 1e-9 and sum(r["splits"] for r in top.values()) > 3


def test_one_label_or_no_rows(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 2.0)], "label int, a double")
    assert [r["score"] for r in boosting.fit(rows, ["a"], rounds=1, depth=2).transform(rows).collect()] == [0.0, 0.0]
    assert boosting.fit(rows.limit(0), ["a"], rounds=1, depth=2).transform(rows).count() == 2


def test_auc(spark, data):
    x, y = data
    rows = spark.createDataFrame([(int(b), float(k % 17)) for k, b in enumerate(y)], "label int, score double")
    s = np.arange(200) % 17
    pairs = s[y == 1][:, None] - s[y == 0][None, :]
    assert abs(stage2.area(rows) - ((pairs > 0).mean() + (pairs == 0).mean() / 2)) < 1e-9
