"""SetSketch near-duplicates against plain sets, with families of near copies far beyond one bucket."""

import random

import numpy as np
from brute import WORD, low

from weftline.llm import minhash_dedup, near_sets, setsketch
from weftline.llm.common import Scratch


def plain_set(text, words=4):
    w = WORD.findall(low(text))
    return frozenset(" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def plain(rows, words=4):
    """(doc_id, n_shingles, component_id, kept) of each row, by comparing all pairs."""
    sets = list({plain_set(t, words) for _, t in rows} - {frozenset()})
    root = list(range(len(sets)))

    def of(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if 4 * len(a) <= 5 * len(sets[j]) and 4 * len(sets[j]) <= 5 * len(a) and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[of(i)] = of(j)
    at, least = {s: of(k) for k, s in enumerate(sets)}, {}
    for d, t in rows:
        s = plain_set(t, words)
        if s and d is not None:
            least[at[s]] = min(d, least.get(at[s], d))
    out = []
    for d, t in rows:
        s = plain_set(t, words)
        c = least.get(at[s]) if s else d
        out.append((d, len(s), c, d == c))
    return sorted(out, key=repr)


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def changed(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


def families():
    """Near copies of two texts by none to ten changes, texts around a shared passage that makes up half to nearly all of them, and loose ones."""
    rng = random.Random(5)
    rows = []
    for base in (prose(rng, 150), prose(rng, 70)):
        rows += [changed(rng, base, rng.randrange(11)) for _ in range(160)]
        rows += [changed(rng, base, 5)[: -rng.randrange(1, 30)] for _ in range(40)]
    passage = prose(rng, 100)
    rows += [passage + prose(rng, rng.choice([8, 12, 14, 20, 30, 60, 100])) for _ in range(200)]
    far = changed(rng, passage, 6) + prose(rng, 14)
    rows += [changed(rng, far, rng.randrange(3)) for _ in range(50)]
    rows += [prose(rng, rng.randrange(1, 60)) for _ in range(40)]
    rows = [" ".join(w) for w in rows]
    return [(k, t) for k, t in enumerate(rows + rows[:60])]


def test_families_lose_no_link(spark):
    rows = families()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    scratch = Scratch(spark, "test")
    signed = scratch.save(near_sets.sketches(docs, 4), "signed")
    near_sets.links(signed, docs, 4, scratch)
    assert spark.read.parquet(f"{scratch.path}/differences").filter("open").count() > 100  # the large buckets' way is taken
    got = minhash_dedup.near_duplicates(docs).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_bad_rows(spark, docs, texts, docs_dir):
    got = minhash_dedup.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(texts)
    assert minhash_dedup.op11_setsketch(spark, docs_dir[1]).count() == 0
    rows = [(None, "a b c d e"), (None, "a b c d e"), (3, "A B  c d e"), (None, "z"), (None, None), (4, "Ä b c d"), (5, "ä b c d")]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 2, 3, False), (None, 2, 3, False), (3, 2, 3, True), (None, 1, None, True), (None, 0, None, True), (4, 1, 4, True), (5, 1, 5, True)], key=repr)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    for n, common in ((300, 0), (300, 150), (1000, 900), (40, 36)):
        x = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
        a, b = x[:n], x[n - common :]
        ra, rb = setsketch.registers(a), setsketch.registers(b)
        assert (setsketch.merged(ra, rb) == setsketch.registers(x)).all()
        assert abs(setsketch.cardinality(ra) / n - 1) < 0.3
        true, got = common / len(x), setsketch.jaccard(ra[None], rb[None], np.array([n]), np.array([n]))[0]
        assert abs(got - true) < 0.12


def test_a_pair_at_the_threshold_is_a_candidate():
    rng, met = np.random.default_rng(3), 0
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
        a, b = setsketch.registers(x[:108]), setsketch.registers(x[12:])  # 96 of 120
        est = setsketch.jaccard(a[None], b[None], np.array([108]), np.array([108]))[0]
        met += (a == b).reshape(setsketch.BANDS, setsketch.ROWS).all(axis=1).any() and est >= near_sets.LEAST
    assert met == 300
