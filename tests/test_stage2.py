"""Factors at larger ranks, stage-two inputs and files, and what a cluster asks of scratch folders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import boosting, dense, latent, recommend, split, stage2
from weftline.plans.views import Views
from weftline.sources import playlists as src
from weftline.sources import scratch


def matrix(spark, a):
    return spark.createDataFrame([(i, j, float(x)) for (i, j), x in np.ndenumerate(a) if x], "row_id long, col_id long, value double")


def features(df):
    return {r["id"]: np.array(r["features"]) for r in df.collect()}


def test_gram_equals_numpy(spark):
    x = np.random.default_rng(0).normal(size=(50, 64))
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "id long, features array<double>").repartition(3)
    got = np.zeros((64, 64))
    for r in dense.gram(df, 64).collect():
        got[r["i"], r["j"]] = r["value"]
    assert np.allclose(got, x.T @ x)
    assert dense.gram(df.limit(0), 64).count() == 0


@pytest.mark.parametrize("dealt", [{}, {"part": 3, "per_block": 10}])
def test_als_at_rank_64_equals_plain_solutions(spark, dealt):
    rng = np.random.default_rng(1)
    a = (rng.random((12, 40)) < 0.3) * rng.integers(1, 4, (12, 40))
    v = rng.normal(size=(40, 64))
    fixed = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(v)], "id long, features array<double>")
    got = features(latent.als_half_step(matrix(spark, a), fixed, 64, 10, 0.1, **dealt))
    for i in range(12):
        own = a[i] > 0
        left = v.T @ v + 10 * (v[own].T * a[i, own]) @ v[own] + 0.1 * np.eye(64)
        assert np.allclose(got[i], np.linalg.solve(left, (1 + 10 * a[i, own]) @ v[own]), atol=1e-8)


@pytest.mark.parametrize("dealt", [{}, {"part": 2, "per_block": 5}])
def test_products_by_blocks(spark, dealt):
    rng = np.random.default_rng(2)
    a, x = (rng.random((9, 20)) < 0.4) * rng.normal(size=(9, 20)), rng.normal(size=(20, 5))
    got = features(latent.times(matrix(spark, a), spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "id long, features array<double>"), **dealt))
    assert all(np.allclose(got[i], a[i] @ x) for i in got) and set(got) == set(np.flatnonzero((a != 0).any(1)))


def test_svd_at_rank_64_and_its_parts(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(120, 64)) @ rng.normal(size=(64, 90))
    us, s, v = latent.svd(matrix(spark, a), rank=64, iterations=2)
    assert np.allclose(s, np.linalg.svd(a)[1][:64], rtol=1e-3)
    first, rest = (features(x) for x in latent.parts(us, 100))
    right = np.stack([x for _, x in sorted(features(v).items())])
    back = np.stack([*[x for _, x in sorted(first.items())], *[x for _, x in sorted(rest.items())]]) @ right.T
    assert len(first) == 100 and sorted(rest) == list(range(20)) and np.allclose(back, a, atol=1e-3 * abs(a).max())


def test_als_fits_and_svd_fits_the_given_tables(spark, sf_dir):
    v = Views(spark, sf_dir).hold()
    u, w = (features(x) for x in latent.als(v.train, rank=64, iterations=2))
    rows = v.train.select("row_id", "col_id").collect()
    seen = np.mean([u[r["row_id"]] @ w[r["col_id"]] for r in rows])
    others = np.mean([a @ b for a in list(u.values())[:30] for b in list(w.values())[:30]])
    assert seen > 0.9 and others < 0.6


def test_labelled_lines(spark):
    rows = spark.createDataFrame([(1, 3.0, 0.0, 0.123456), (0, 0.0, 0.0, 0.0)], "label long, a double, b double, c double")
    lines = rows.select(src.format_labelled(rows, ["a", "b", "c"]).alias("value"))
    assert [r["value"] for r in lines.collect()] == ["1 0:3 2:0.12346", "0"]
    assert [tuple(r) for r in src.parse_labelled(lines, ["a", "b", "c"]).collect()] == [(1, 3.0, 0.0, 0.12346), (0, 0.0, 0.0, 0.0)]


def test_triples_by_column_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("u\ti\td\n7\t1\t30\n7\t1\t20\n8\t2\t5\n")
    got = src.read_triples(spark, str(tmp_path), row=0, col=1, date=2, sep="\t", header=True)
    assert sorted(map(tuple, got.collect())) == [(7, 1, 2.0, 30), (8, 2, 1.0, 5)]


def test_filled_ids(spark):
    ids, spare = (spark.createDataFrame([(x,) for x in xs], "col_id long") for xs in ([1, 2, 2], range(10)))
    got = {r["col_id"] for r in split.filled_ids(ids, spare, "col_id", 5, "s").collect()}
    assert len(got) == 5 and {1, 2} <= got and split.filled_ids(spare, ids, "col_id", 99, "s").count() == 10


def test_album_bags_and_a_saved_model(spark, tmp_path):
    rng = np.random.default_rng(4)
    lists = spark.createDataFrame([(k,) for k in range(60)], "playlist_id long")
    bags = spark.createDataFrame([(k, 100 if k % 2 else 7, 1.0) for k in range(59)], "playlist_id long, idx long, value double")
    vectors, size = stage2.album_bags(lists, bags, spark.createDataFrame([(7,), (100,)], "idx long"))
    own = {r["playlist_id"]: r["album_bag"].toArray().tolist() for r in vectors.collect()}
    assert size == 2 and own[0] == [1, 0] and own[1] == [0, 1] and own[59] == [0, 0]
    rows = vectors.join(spark.createDataFrame([(k, k, int(k % 2), float(rng.random())) for k in range(60)], "playlist_id long, song_id long, label long, x double"), "playlist_id")
    model = stage2.train_trees(rows, ["x", "album_bag"], rounds=2, depth=2, vectors={"album_bag": size})
    model.save(spark, str(tmp_path / "m"))
    again = boosting.PairwiseTrees.load(spark, str(tmp_path / "m"))
    scored = lambda m: {(r["playlist_id"], r["score"]) for r in stage2.reranked(m, rows, 5).collect()}
    assert scored(model) == scored(again) and stage2.auc(again, rows) > 0.95
    assert {r["feature"] for r in model.importance(spark).collect()} == {"x", "album_bag", "album_bag_1"}


def test_held_views_equal_the_others(spark, sf_dir):
    one, two = Views(spark, sf_dir), Views(spark, sf_dir).hold()
    for name in ("playlists", "train", "hidden"):
        assert sorted(map(tuple, getattr(one, name).collect())) == sorted(map(tuple, getattr(two, name).collect()))


def test_cold_lists_by_name(spark):
    u = spark.createDataFrame([(1, [1.0, 0.0])], "playlist_id long, u array<double>")
    w = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(5)], "song_id long, v array<double>")
    seen = spark.createDataFrame([], "playlist_id long, song_id long")
    named = recommend.latent_topn(u, w, seen, 2)
    popular = spark.createDataFrame([(9, 0.5), (8, 0.4), (7, 0.1)], "song_id long, popularity double")
    got = recommend.cold_start(spark.createDataFrame([(1,), (2,)], "playlist_id long"), named, popular, 2)
    assert sorted(map(tuple, got.collect())) == [(1, 3, 2), (1, 4, 1), (2, 8, 2), (2, 9, 1)]


def test_the_whole_course(spark, sf_dir):
    """Every challenge playlist has one line, of different songs that it does not hold yet."""
    from weftline.plans import registry

    v = Views(spark, sf_dir)
    seen = {(r["row_id"], r["col_id"]) for r in v.train.select("row_id", "col_id").collect()}
    tests = {r["playlist_id"] for r in v.playlists.filter("is_test").collect()}
    lines = [r["line"].split(", ") for r in registry.QUERIES["challenge_submission"](spark, sf_dir).collect()]
    assert sorted(int(x[0]) for x in lines) == sorted(tests)
    for pid, *uris in lines:
        songs = [int(u.rpartition(":")[2]) for u in uris]
        assert 0 < len(songs) <= 500 and len(set(songs)) == len(songs) and not any((int(pid), x) in seen for x in songs)


class Session:
    """What scratch asks of a session."""

    def __init__(self, **conf):
        self.own = conf
        self.conf = self

    def get(self, key, default=None):
        return self.own.get(key, default)

    def set(self, key, value):
        self.own[key] = value


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="checkpoint"):
        scratch.root(Session(**{"spark.master": "spark://host:7077"}))
    assert scratch.root(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    local = Session(**{"spark.master": "local[4]"})
    assert scratch.root(local).startswith("file://") and scratch.root(local) == scratch.root(local)


def test_scratch_gives_its_space_back(spark):
    own = scratch.Scratch(spark, "t")
    table = own.save_sorted(spark.range(100).groupBy("id").count(), ("id",), "s")
    other = table.select("id", F.lit(1).alias("one"))
    assert own.save(table.join(other, "id"), "x").count() == 100
    own.clear()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own.path)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path) and not own.sorted
