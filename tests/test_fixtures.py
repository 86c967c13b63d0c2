"""Hand-computed cases, properties, and operators that SQL cannot express."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import coo, dictionary, evaluate, latent, rank, recommend, split, stage2
from weftline.sources import playlists as src

COO = "row_id long, col_id long, value double, date long"


def values(df, *keys, of="value"):
    return {tuple(r[k] for k in keys): r[of] for r in df.collect()}


@pytest.fixture(scope="module")
def toy(spark):
    """Playlists p0..p2 over songs a..d."""
    cells = [(0, 0, 2.0), (0, 1, 1.0), (1, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (2, 2, 1.0), (2, 3, 1.0)]
    m = spark.createDataFrame([(*c, None) for c in cells], COO)
    names = spark.createDataFrame([(0, "n0"), (1, "n0"), (2, "n1")], "playlist_id long, name string")
    return m, names


def test_popularity(toy):
    got = {r["song_id"]: r["popularity"] for r in recommend.popularity(toy[0]).collect()}
    assert got == pytest.approx({0: 0.375, 1: 0.25, 2: 0.25, 3: 0.125})


def test_neighbours_votes_profile_and_blend(spark, toy):
    m, names = toy
    target = spark.createDataFrame([(0,)], "playlist_id long")
    near = recommend.neighbours(m, names, target, 3)
    assert values(near, "other", of="sim") == pytest.approx({(0,): 1.393939, (1,): 0.942809, (2,): 0.445362}, abs=2e-6)
    votes = recommend.user_user(m, near, 10)
    assert values(votes, "song_id", of="score") == pytest.approx({(2,): 1.594590, (3,): 0.548305}, abs=2e-6)
    ii = recommend.item_item(m, votes)
    assert values(ii, "song_id", of="score") == pytest.approx({(2,): 1.207872, (3,): 0.622969}, abs=2e-6)
    scores = votes.select("playlist_id", "song_id", F.col("score").alias("uu")).join(ii.select("playlist_id", "song_id", F.col("score").alias("ii")), ["playlist_id", "song_id"])
    scores = scores.withColumn("latent", F.when(F.col("song_id") == 2, 0.3).otherwise(0.1)).withColumn("latent2", F.col("latent"))
    assert values(recommend.blend(scores, 10), "song_id", of="score") == pytest.approx({(2,): 0.6, (3,): -0.6}, abs=1e-6)


def test_als_toy(spark):
    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 1.0)], "row_id long, col_id long, value double")
    v = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])], "id long, features array<double>")
    u = latent.als_half_step(m, v, 2, 10, 0.0)
    got = {r["id"]: list(r["features"]) for r in u.collect()}
    assert np.allclose([got[k] for k in range(3)], [[-1.25, 1.15625], [-1, 1], [-0.5, 0.59375]])
    split_up = {r["id"]: list(r["features"]) for r in latent.als_half_step(m, v, 2, 10, 0.0, part=1).collect()}
    assert np.allclose([split_up[k] for k in range(3)], [got[k] for k in range(3)])  # rows summed in parts
    turned = m.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "value")
    back = {r["id"]: list(r["features"]) for r in latent.als_half_step(turned, u, 2, 10, 0.0).collect()}
    assert np.allclose([back[k] for k in range(3)], [[0.060858, 0.973721], [3.259259, 4.345679], [5.416321, 6.329184]], atol=1e-5)


def test_svd_finds_the_singular_values(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 6)) @ rng.normal(size=(6, 12))
    m = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(30) for j in range(12)], "row_id long, col_id long, value double")
    us, s, v = latent.svd(m, rank=3, iterations=8)
    want = np.linalg.svd(a)[1][:3]
    assert np.allclose(s, want, rtol=1e-3)
    right = np.array([r["features"] for r in v.orderBy("id").collect()])
    assert np.allclose(right.T @ right, np.eye(3), atol=1e-8)
    left = np.array([r["features"] for r in us.orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(left, axis=0), want, rtol=1e-3)


def test_standardized_skips_flat_lists(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (1, 5.0), (1, 5.0)], "playlist_id long, score double")
    got = sorted(r["z"] for r in df.select(rank.standardized("score").alias("z")).collect())
    assert got == pytest.approx([-1.224745, 0, 1.224745, 5, 5], abs=1e-6)


def test_metrics(spark):
    ranked = spark.createDataFrame([(0, 7, 1), (0, 1, 2), (0, 3, 3)], "playlist_id long, song_id long, rank long")
    targets = spark.createDataFrame([(0, 3), (0, 7)], "playlist_id long, song_id long")
    songs = spark.createDataFrame([(1, "x"), (3, "x"), (7, "y")], "song_id long, artist string")
    assert values(evaluate.ndcg(ranked, targets, [3, 5]), "threshold") == pytest.approx({(3,): 0.919721, (5,): 0.919721}, abs=1e-6)
    assert evaluate.r_precision(ranked, targets).first()["value"] == 0.5
    assert evaluate.r_precision_artist(ranked, targets, songs).first()["value"] == 0.625
    for first, want in ((1, 0), (11, 1), (500, 49), (None, 51)):
        one = spark.createDataFrame([(0, 3 if first else 99, first or 1)], "playlist_id long, song_id long, rank long")
        assert evaluate.clicks(one, targets).first()["value"] == want
    assert evaluate.ndcg(ranked, targets.limit(0), [3]).count() == 0


def test_coo_rules(spark):
    m = spark.createDataFrame([(0, 0, 3.0, 1), (1, 0, 1.0, 2), (2, 0, 1.0, 3), (0, 1, 1.0, 4), (1, 1, 1.0, 5), (0, 2, 2.0, 6), (1, 2, 2.0, 7), (2, 2, 2.0, 8)], COO)
    kept = coo.select_columns(m, 2)
    assert {r["col_id"] for r in kept.collect()} == {0, 1} and kept.count() == 6
    assert sorted(coo.transpose(coo.transpose(m)).collect()) == sorted(m.collect())
    one = spark.createDataFrame([(0, 0, 3.0, None), (1, 0, 1.0, None)], COO)
    assert values(coo.tfidf(one, 4), "row_id")[(0,)] == pytest.approx(np.log(4) * np.log(2))
    assert all(abs(r["norm"] - 1) < 1e-9 for r in coo.norms(coo.normalize(m, "row_id"), "row_id").collect())
    assert coo.subtract(m, m).count() == 0
    ids = spark.createDataFrame([(x,) for x in (5, -3, 900, 5)], "id long")
    assert {tuple(r) for r in coo.dense_ids(ids, "id").collect()} == {(-3, 0), (5, 1), (900, 2)}


def test_text(spark):
    df = spark.createDataFrame([("  Rock & Roll!! 80's ", "PowerShot500-abc XLS2018 my_mix")], "a string, b string")
    row = df.select(text.normalized_name("a").alias("a"), text.tokens("b").alias("b"), text.char_ngrams(F.array(F.lit("abcd"), F.lit("x")), 2, 3).alias("c")).first()
    assert row["a"] == "rock roll 80 s"
    assert row["b"] == ["power", "shot", "500", "abc", "xls", "2018", "my", "mix"]
    assert row["c"] == ["ab", "bc", "cd", "abc", "bcd"]


def test_many_categories_are_dense_and_unique(spark):
    df = spark.range(300_000).selectExpr("id as at", "concat('c', pmod(xxhash64(id), 1000000007)) as cat").repartition(7)
    got = dictionary.first_seen(df, "cat", "at").toPandas().merge(df.toPandas().groupby("cat")["at"].min().reset_index(), on="cat")
    assert sorted(got["idx"]) == list(range(len(got))) and got.sort_values("at")["idx"].is_monotonic_increasing


def test_a_table_is_permuted(spark):
    df = spark.range(50_000).selectExpr("id", "id % 7 as x")
    got = dictionary.permuted(df, "id", seed="s").orderBy("idx").collect()
    want = sorted(range(50_000), key=lambda i: hashlib.md5(f"s#{i}".encode()).hexdigest())
    assert [r["id"] for r in got] == want and [r["idx"] for r in got] == list(range(50_000)) and all(r["x"] == r["id"] % 7 for r in got)
    assert dictionary.permuted(df.limit(0), "id").count() == 0


def test_first_seen_is_dense_and_ordered(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 0), (None, 5)], "cat string, at long")
    assert values(dictionary.first_seen(df, "cat", "at"), "cat", of="idx") == {("c",): 0, ("b",): 1, ("a",): 2}


def test_split_by_date(spark):
    m = spark.createDataFrame([(0, 0, 1.0, 3), (0, 1, 1.0, 7), (1, 0, 1.0, 6), (1, 1, 1.0, 7), (2, 0, 1.0, 1), (2, 1, 1.0, 2)], COO)
    assert values(split.by_date(m, 5), "row_id", "col_id", of="part") == {(0, 0): "train", (0, 1): "valid", (2, 0): "train", (2, 1): "train"}


def test_matching_uses_each_playlist_once(spark, sf_dir):
    tests = spark.createDataFrame([(k, 1 + k % 5) for k in range(40)], "test_id long, size long")
    pool = spark.createDataFrame([(1000 + k, 1 + k % 9) for k in range(100)], "playlist_id long, size long")
    rows = split.matching(tests, pool).collect()
    assert len({r["playlist_id"] for r in rows}) == len(rows) and len({(r["test_id"], r["repeat"]) for r in rows}) == len(rows)
    size = {1000 + k: 1 + k % 9 for k in range(100)}
    for r in rows:
        assert (size[r["playlist_id"]] == 1 + r["test_id"] % 5) if r["exact"] else (size[r["playlist_id"]] > 1 + r["test_id"] % 5)


def test_matching_leaves_no_place_that_a_larger_playlist_could_take(spark):
    rng = np.random.default_rng(3)
    for n, m in ((3, 2), (30, 25), (25, 60)):
        sizes = [[10, 3, 3], [9, 8]] if n == 3 else [rng.integers(1, 12, n).tolist(), rng.integers(1, 12, m).tolist()]
        tests = spark.createDataFrame(list(enumerate(sizes[0])), "test_id long, size long")
        pool = spark.createDataFrame(list(enumerate(sizes[1])), "playlist_id long, size long")
        rows = split.matching(tests, pool, repeats=1).collect()
        assert all((sizes[0][r["test_id"]] == sizes[1][r["playlist_id"]]) == r["exact"] and sizes[0][r["test_id"]] <= sizes[1][r["playlist_id"]] for r in rows)
        free = sorted(set(range(len(sizes[0]))) - {r["test_id"] for r in rows})
        spare = sorted(set(range(len(sizes[1]))) - {r["playlist_id"] for r in rows})
        assert len({r["playlist_id"] for r in rows}) == len(rows) and not any(sizes[1][p] >= sizes[0][t] for t in free for p in spare)


def test_svd_of_a_badly_conditioned_matrix(spark):
    rng = np.random.default_rng(9)
    want = np.array([1.0, 1e-2, 1e-4, 1e-6, 1e-8])
    a = np.linalg.qr(rng.normal(size=(40, 5)))[0] * want @ np.linalg.qr(rng.normal(size=(30, 5)))[0].T
    m = spark.createDataFrame([(i, j, float(a[i, j]), 0) for i in range(40) for j in range(30)], COO)
    us, s, v = latent.svd(m, rank=5, iterations=2, oversample=3)
    assert np.allclose(s, want, rtol=1e-6, atol=0)
    vs = np.stack([r["features"] for r in v.orderBy("id").collect()])
    assert np.allclose(vs.T @ vs, np.eye(5), atol=1e-9)
    assert np.allclose(np.stack([r["features"] for r in us.orderBy("id").collect()]) @ vs.T, a, atol=1e-12)


def test_json_sources(spark, tmp_path):
    track = {"pos": 0, "track_uri": "t:1", "track_name": "x", "artist_uri": "a", "artist_name": "A", "album_uri": "l", "album_name": "L", "duration_ms": 5}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text(json.dumps({"playlists": [{"pid": "0", "name": "n", "tracks": [track, track]}, {"pid": "1", "tracks": []}, {"pid": "2"}]}, indent=1))
    pl = src.read_playlists(spark, str(tmp_path / "p"))
    assert {(r["pid"], r["name"]) for r in pl.collect()} == {("0", "n"), ("1", None), ("2", None)}
    assert src.tracks_of(pl).count() == 2
    (tmp_path / "audio.json").write_text(json.dumps([None, {"key": 3}, {"uri": "t:1", "key": 3, "tempo": 1.5}]))
    assert {tuple(r) for r in src.read_audio(spark, str(tmp_path / "audio.json")).collect()} == {("t:1", "tempo", 1.5, None), ("t:1", "key", None, "3")}


def test_dense_binary_and_submission(spark, tmp_path):
    a = np.arange(6, dtype=">f4").reshape(2, 3)
    (tmp_path / "m.bin").write_bytes(a.tobytes())
    got = src.read_dense_binary(spark, str(tmp_path / "m.bin"), 3).orderBy("row").collect()
    assert [list(r["features"]) for r in got] == a.tolist()
    with pytest.raises(Exception, match="no whole rows"):
        src.read_dense_binary(spark, str(tmp_path / "m.bin"), 4).collect()
    ranked = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "pid long, rank long, uri string")
    src.write_submission(ranked, str(tmp_path / "out"), "team,x")
    assert {r["value"] for r in spark.read.text(str(tmp_path / "out" / "*")).collect()} == {"team,x", "1, a, b"}


def test_libsvm_round_trip(spark):
    m = spark.createDataFrame([(0, 3, 1.0, None), (0, 1, 0.25, None), (7, 0, 2.0, None)], COO)
    lines = src.format_libsvm(m).select(F.concat_ws(" ", F.col("row_id").cast("string"), "line").alias("value"))
    assert {r["value"] for r in lines.collect()} == {"0 1:0.25000 3:1", "7 0:2"}
    assert values(src.parse_libsvm(lines), "row_id", "col_id") == {(0, 3): 1.0, (0, 1): 0.25, (7, 0): 2.0}


def test_trees_learn(spark):
    rows = spark.createDataFrame([(k, k % 7, int(k % 7 > 3), float(k % 7), float(k % 3)) for k in range(200)], "playlist_id long, song_id long, label long, a double, b double")
    model = stage2.train_trees(rows, ["a", "b"], rounds=3, depth=2)
    top = stage2.reranked(model, rows.filter("playlist_id < 7").withColumn("playlist_id", F.lit(0).cast("long")), 3)
    assert {r["song_id"] for r in top.collect()} == {4, 5, 6}
    assert sum(r["splits"] for r in model.importance(spark).collect()) > 0
