"""The pipeline's near-duplicate stage, on planted near copies."""

import random

import corpus_pipeline
from weftline.llm import near_copies, setsketch

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=300):
    rng = random.Random(seed)
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def changed(words, places):
    return [f"other{k}" if k in places else w for k, w in enumerate(words)]


def jaccard(a, b):
    x, y = (set(setsketch.shingles(" ".join(t).encode(), near_copies.WORDS).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def kept(spark, rows):
    docs = spark.createDataFrame([(i, None if w is None else " ".join(w), "en", "s", 1) for i, w in rows], COLUMNS)
    return sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=repr)


def test_near_copies_at_the_threshold_go(spark):
    rows = []
    for g in range(20):
        w = prose(g)
        near, far = changed(w, range(20, 84, 12)), changed(w, range(20, 290, 12))
        assert jaccard(w, near) >= 0.8 > jaccard(w, far)
        rows += [(10 * g, w), (10 * g + 1, near), (10 * g + 2, far)]
    assert sorted(d for d, _ in kept(spark, rows)) == sorted(10 * g + k for g in range(20) for k in (0, 2))


def test_large_groups(spark):
    rng = random.Random(3)
    rows = [(1000 * g + k, changed(w, {rng.randrange(300) for _ in range(2)})) for g, w in enumerate((prose(1), prose(2))) for k in range(60)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert near_copies.roots(docs).select("root").distinct().count() == 2


def test_pairs_inside_a_shared_passage_are_found(spark):
    """30 planted pairs at 0.81 among 150 texts that all share a passage at 0.74 or so."""
    passage = [f"p{k}" for k in range(170)]
    rows = []
    for k in range(120):
        w = passage + [f"own{k}x{j}" for j in range(30)]
        rows += [(k, w)] + ([(1000 + k, changed(w, range(172, 200, 7)))] if k < 30 else [])
    assert all(0.8 <= jaccard(rows[2 * k][1], rows[2 * k + 1][1]) < 0.85 for k in range(30)) and 0.6 < jaccard(rows[0][1], rows[2][1]) < 0.8
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert near_copies.roots(docs).select("root").distinct().count() == 120


def test_one_row_a_group(spark):
    a, b, c, d = prose(4), prose(5), prose(6), prose(7)
    near = lambda w: changed(w, {9})
    rows = [(None, a), (None, a), (None, near(a)), (None, b), (5, b), (7, c), (7, c), (7, c), (8, near(c)), (5, near(d)), (3, d), (None, None), (None, [])]
    got = kept(spark, rows)
    assert len(got) == 5
    assert {i for i, t in got if t in (" ".join(a), " ".join(near(a)))} == {None}
    assert {(i, t) for i, t in got if i is not None} == {(5, " ".join(b)), (7, " ".join(c)), (3, " ".join(d))}
