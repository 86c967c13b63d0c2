"""Dense vectors held as arrays: (id, features array<double>)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def standardize(df: DataFrame, clip: float = 5.0) -> DataFrame:
    """(id, pos, value): each place centred and scaled by its population deviation (only centred if that is 0), clipped."""
    long = df.select("id", F.posexplode("features").alias("pos", "value"))
    stats = long.groupBy("pos").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = F.when(F.col("s") > 0, (F.col("value") - F.col("m")) / F.col("s")).otherwise(F.col("value") - F.col("m"))
    return long.join(F.broadcast(stats), "pos").select("id", "pos", F.greatest(F.lit(-clip), F.least(F.lit(clip), z)).alias("value"))  # one row a place


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The first ``size`` places of an Arrow column of arrays, a row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)[:, :size]


def gram(df: DataFrame, size: int) -> DataFrame:
    """(i, j, value) of the Gram matrix of the first ``size`` places: every task adds up its own rows, and size * size sums are all that leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0), size)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices((size, size), np.int32)
            yield pa.record_batch([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "value"])

    parts = df.filter("features is not null").select("features").mapInArrow(run, "i int, j int, value double")
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))
