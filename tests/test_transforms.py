"""Fitted transforms against plain sums, saved and loaded; the data source of dense files."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from weftline.operators import transforms as T
from weftline.sources.dense_binary import DenseBinary, DenseReader

COO = "row_id long, col_id long, value double, date long"
TRAIN = [(0, 2, 3.0, 5), (1, 2, 4.0, None), (2, 2, 0.0, 1), (0, 7, 2.0, 1), (1, 7, 2.0, 1), (0, 9, 1.0, 1)]


def cells(m):
    return {(r["row_id"], r["col_id"]): r["value"] for r in m.collect()}


@pytest.fixture()
def train(spark):
    return spark.createDataFrame(TRAIN, COO)


def again(model, path):
    model.write().save(path)
    return type(model).load(path)


def test_norms_and_selection_apply_to_one_row(spark, train, tmp_path):
    one = spark.createDataFrame([(50, 2, 10.0, 1), (50, 9, 5.0, 1), (50, 11, 8.0, 1)], COO)
    norm = again(T.ColumnNorm().fit(train), str(tmp_path / "norm"))
    assert cells(norm.transform(one)) == {(50, 2): 2.0, (50, 9): 5.0, (50, 11): 8.0} and norm.getOrDefault("least") == 1e-10
    chosen = again(T.ColumnSelector(cutoff=1.0).fit(train), str(tmp_path / "chosen"))
    assert cells(chosen.transform(one)) == {(50, 0): 10.0}
    names = chosen.names(spark.createDataFrame([(2, "a"), (7, "b"), (9, "c")], "col_id long, name string"))
    assert {tuple(r) for r in names.collect()} == {(0, "a"), (1, "b")}
    assert cells(T.RowNorm(p=1.0).transform(one)) == {(50, 2): 10 / 23, (50, 9): 5 / 23, (50, 11): 8 / 23}


def test_standardizer_uses_statistics_of_training(spark, train, tmp_path):
    model = again(T.Standardizer(cutoff=2.0).fit(train), str(tmp_path / "z"))
    x = np.array([3.0, 4.0, 0.0])
    other = spark.createDataFrame([(8, 2, 5.0, 1), (8, 7, 2.0, 1), (9, 7, 2.5, 1), (9, 2, 100.0, 1), (9, 11, 1.0, 1)], COO)
    assert cells(model.transform(other)) == pytest.approx({(8, 2): (5 - x.mean()) / x.std(), (9, 7): 0.5, (9, 2): 2.0})


def test_categories_are_frozen(spark, tmp_path):
    schema = "pid long, at long, album string, idx long"  # idx: a clashing name
    rows = spark.createDataFrame([(1, 3, "x", 0), (1, 1, "y", 0), (2, 2, None, 0), (2, 4, "z", 0), (2, 5, "x", 0)], schema)
    model = again(T.Categories(row="pid", category="album", order=["at"]).fit(rows), str(tmp_path / "c"))
    new = spark.createDataFrame([(7, 1, "x", 0), (7, 2, "x", 0), (7, 3, "new", 0), (8, 1, None, 0), (9, 1, "z", 0)], schema)
    assert cells(model.transform(new)) == {(7, 1): 2.0, (9, 2): 1.0}


def test_pipeline_is_saved_whole_and_empty_training_has_no_columns(spark, train, tmp_path):
    chain = Pipeline(stages=[T.ColumnSelector(cutoff=1.0), T.RowNorm(), T.ColumnNorm(p=1.0)])
    chain.write().save(str(tmp_path / "chain"))
    model = Pipeline.load(str(tmp_path / "chain")).fit(train)
    model.write().save(str(tmp_path / "model"))
    assert cells(PipelineModel.load(str(tmp_path / "model")).transform(train)) == cells(model.transform(train)) != {}
    assert T.ColumnSelector().fit(train.limit(0)).transform(train).count() == 0
    assert cells(T.ColumnNorm().fit(train.limit(0)).transform(train)) == {(r, c): v for r, c, v, _ in TRAIN}


def test_dense_files_are_split_and_written(spark, tmp_path):
    spark.dataSource.register(DenseBinary)
    x = np.random.default_rng(0).normal(size=(1000, 3)).astype(">f4")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(x[:900].tobytes())
    (tmp_path / "in" / "b.bin").write_bytes(x[900:].tobytes())
    (tmp_path / "in" / "_SUCCESS").write_bytes(b"?")
    read = lambda path, **more: spark.read.format("dense_binary").option("columns", 3).options(**more).load(str(path))
    got = read(tmp_path / "in", splitBytes=12 * 100)
    assert got.rdd.getNumPartitions() == 10
    rows = got.orderBy("path", "row").collect()
    assert np.array_equal(np.array([r["features"] for r in rows]), x.astype(float)) and [r["row"] for r in rows] == [*range(900), *range(100)]
    out = tmp_path / "out"
    for _ in range(2):
        got.select("features", F.lit(1).alias("more")).write.format("dense_binary").option("columns", 3).mode("append").save(str(out))
    assert read(out).count() == 2000 and not [p for p in out.iterdir() if p.name.startswith("_")]
    got.select("features").write.format("dense_binary").option("columns", 3).mode("overwrite").save(str(out))
    assert sorted(map(tuple, (r["features"] for r in read(out).collect()))) == sorted(map(tuple, x.astype(float)))
    with pytest.raises(Exception, match="not all rows"):
        got.select(F.when(F.col("row") != 5, F.col("features")).alias("features")).write.format("dense_binary").option("columns", 3).mode("append").save(str(out))
    assert read(out).count() == 1000  # whatever killed tasks leave is no data


def test_dense_files_of_odd_size_are_errors(spark, tmp_path):
    (tmp_path / "none").mkdir()
    spark.dataSource.register(DenseBinary)
    assert spark.read.format("dense_binary").option("columns", 3).load(str(tmp_path / "none")).count() == 0
    (tmp_path / "big.bin").write_bytes(b"")
    with (tmp_path / "big.bin").open("r+b") as f:
        f.truncate(1 << 30)  # sparse: its spans are counted, not read
    assert len(DenseReader(str(tmp_path / "big.bin"), 64, 64 << 20).partitions()) == 16
    with pytest.raises(ValueError, match="no whole rows"):
        DenseReader(str(tmp_path / "big.bin"), 3, 64 << 20).partitions()
    with pytest.raises(FileNotFoundError):
        DenseReader(str(tmp_path / "absent"), 3, 64 << 20).partitions()
