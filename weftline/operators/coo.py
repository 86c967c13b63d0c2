"""Algebra over sparse matrices held as long tables (row_id, col_id, value, date).

An absent row has no rows in the table; it is not a row of zeros, and no aggregate counts it. ``date`` may be null.
Transposition is a projection, products are equi-joins with pre-aggregated sums, concatenation is a union with an offset,
so that Catalyst plans each as it would any join or aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COO = ("row_id", "col_id", "value", "date")


def from_rows(df: DataFrame, row: str, col: str, value: str | None = None, date: str | None = None) -> DataFrame:
    """Duplicates are summed and keep the latest date; values default to 1."""
    v = F.col(value).cast("double") if value else F.lit(1.0)
    d = F.col(date).cast("long") if date else F.lit(None).cast("long")
    rows = df.select(F.col(row).cast("long").alias("row_id"), F.col(col).cast("long").alias("col_id"), v.alias("value"), d.alias("date"))
    return rows.groupBy("row_id", "col_id").agg(F.sum("value").alias("value"), F.max("date").alias("date"))


def sums(m: DataFrame, by: str) -> DataFrame:
    return m.groupBy(by).agg(F.sum("value").alias("total"))


def counts(m: DataFrame, by: str) -> DataFrame:
    return m.groupBy(by).agg(F.count("*").alias("nnz"))


def _norm(p: float, over: Column | None = None) -> Column:
    value = F.abs("value") if p == 1 else F.pow("value", F.lit(float(p)))
    total = F.sum(value) if over is None else F.sum(value).over(over)
    return total if p == 1 else F.pow(total, F.lit(1.0 / p))


def norms(m: DataFrame, by: str, p: float = 2) -> DataFrame:
    """The Lp norm of each row or column; for p other than 1 values enter with their sign."""
    return m.groupBy(by).agg(_norm(p).alias("norm"))


def normalize(m: DataFrame, by: str, p: float = 2, least: float = 1e-5) -> DataFrame:
    """Divide by the norm where that is above least; other rows (or columns) stay as they are."""
    return divided(m, norms(m, by, p), by, least)


def divided(m: DataFrame, norms: DataFrame, by: str, least: float, how: str = "inner") -> DataFrame:
    """Entries divided by the norm of their row or column in (by, norm), where that is above least."""
    return m.join(norms, by, how).withColumn("value", F.when(F.col("norm") > least, F.col("value") / F.col("norm")).otherwise(F.col("value"))).select(m.columns)


def transpose(m: DataFrame) -> DataFrame:
    return m.withColumnsRenamed({"row_id": "_r"}).withColumnRenamed("col_id", "row_id").withColumnRenamed("_r", "col_id").select(m.columns)


def shape(m: DataFrame) -> DataFrame:
    """(n_rows, n_cols, nnz), one more than the largest ids."""
    return m.agg((F.max("row_id") + 1).alias("n_rows"), (F.max("col_id") + 1).alias("n_cols"), F.count("*").alias("nnz"))


def binarize(m: DataFrame) -> DataFrame:
    return m.withColumn("value", F.lit(1.0))


def by_date(m: DataFrame, cut: int, later: bool) -> DataFrame:
    return m.filter(F.col("date") > cut if later else F.col("date") <= cut)


def select_columns(m: DataFrame, cutoff: int) -> DataFrame:
    """Columns with more than cutoff entries, numbered densely in their order."""
    return renumbered(m, frequent_columns(m, cutoff))


def frequent_columns(m: DataFrame, cutoff: float) -> DataFrame:
    """(col_id, idx): the columns with more than cutoff entries and their numbers."""
    return dense_ids(counts(m, "col_id").filter(F.col("nnz") > cutoff).select("col_id"), "col_id")


def renumbered(m: DataFrame, ids: DataFrame) -> DataFrame:
    """The columns of ids (col_id, idx) under their numbers."""
    return m.join(ids, "col_id").drop("col_id").withColumnRenamed("idx", "col_id").select(m.columns)


def dense_ids(ids: DataFrame, col: str, blocks: int = 64) -> DataFrame:
    """(col, idx): idx counts distinct ids in their order from 0.

    Ids are ranked in blocks of equal span and the blocks' sizes are added up, so that no task sees all of them.
    """
    span = ids.agg(F.min(col), F.max(col)).first()
    width = max(1, ((span[1] or 0) - (span[0] or 0)) // blocks + 1)
    cut = ids.distinct().withColumn("_block", F.floor((F.col(col) - F.lit(span[0] or 0)) / width).cast("long"))
    sizes = cut.groupBy("_block").agg(F.count("*").alias("_n"))
    firsts = sizes.withColumn("_first", F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy("_block").orderBy(col)))
    return ranked.join(F.broadcast(firsts), "_block").select(col, (F.col("_first") + F.col("_rank") - 1).cast("long").alias("idx"))  # one row a block


def rows_in(m: DataFrame, rows: DataFrame) -> DataFrame:
    return m.join(rows.select("row_id"), "row_id", "left_semi")


def row_average(m: DataFrame, members: DataFrame, mean: bool = True) -> DataFrame:
    """For each group of rows (group_id, row_id): the sum of its rows, divided by how many of them are present if mean."""
    present = members.join(m, "row_id")
    total = present.groupBy("group_id", "col_id").agg(F.sum("value").alias("value"))
    if not mean:
        return total
    n = present.select("group_id", "row_id").distinct().groupBy("group_id").agg(F.count("*").alias("n"))
    return total.join(n, "group_id").select("group_id", "col_id", (F.col("value") / F.col("n")).alias("value"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product; zeros are dropped."""
    left = a.select("row_id", F.col("col_id").alias("_k"), F.col("value").alias("_a"))
    right = b.select(F.col("row_id").alias("_k"), "col_id", F.col("value").alias("_b"))
    return left.join(right, "_k").groupBy("row_id", "col_id").agg(F.sum(F.col("_a") * F.col("_b")).alias("value")).filter("value <> 0")


def vector_times(v: DataFrame, m: DataFrame) -> DataFrame:
    """(col_id, value) of the row vector v (id, value) times m."""
    return m.join(v.select(F.col("id").alias("row_id"), F.col("value").alias("_v")), "row_id").groupBy("col_id").agg(F.sum(F.col("value") * F.col("_v")).alias("value"))


def times_vector(m: DataFrame, v: DataFrame) -> DataFrame:
    """(row_id, value) of m times the column vector v (id, value)."""
    return m.join(v.select(F.col("id").alias("col_id"), F.col("value").alias("_v")), "col_id").groupBy("row_id").agg(F.sum(F.col("value") * F.col("_v")).alias("value"))


def beside(a: DataFrame, b: DataFrame, a_cols: int) -> DataFrame:
    """b's columns after a's."""
    return a.unionByName(b.withColumn("col_id", F.col("col_id") + a_cols))


def below(a: DataFrame, b: DataFrame, a_rows: int) -> DataFrame:
    """b's rows after a's."""
    return a.unionByName(b.withColumn("row_id", F.col("row_id") + a_rows))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values are summed, the latest date is kept."""
    return a.unionByName(b).groupBy("row_id", "col_id").agg(F.sum("value").alias("value"), F.max("date").alias("date"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """a - b without the zeros."""
    minus = b.select("row_id", "col_id", (-F.col("value")).alias("value"))
    return a.select("row_id", "col_id", "value").unionByName(minus).groupBy("row_id", "col_id").agg(F.sum("value").alias("value")).filter("value <> 0")


def pair_dots(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(left, right, dot, shared) for pairs (left, right) of rows of a and of b; pairs without a shared column have zeros."""
    left = a.select(F.col("row_id").alias("left"), "col_id", F.col("value").alias("_a"))
    right = b.select(F.col("row_id").alias("right"), "col_id", F.col("value").alias("_b"))
    met = pairs.join(left, "left").join(right, ["right", "col_id"]).groupBy("left", "right").agg(F.sum(F.col("_a") * F.col("_b")).alias("dot"), F.count("*").alias("shared"))
    return pairs.join(met, ["left", "right"], "left").select("left", "right", F.coalesce("dot", F.lit(0.0)).alias("dot"), F.coalesce("shared", F.lit(0).cast("long")).alias("shared"))


def row_stats(m: DataFrame) -> DataFrame:
    return m.groupBy("row_id").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"))


def tfidf(m: DataFrame, n_rows: int | Column) -> DataFrame:
    """ln(1 + tf) * ln(n_rows / df); n_rows counts empty rows as well."""
    n = F.lit(n_rows) if isinstance(n_rows, int) else n_rows
    return m.join(counts(m, "col_id"), "col_id").select("row_id", "col_id", (F.ln(1 + F.col("value")) * F.ln(n / F.col("nnz"))).alias("value"))


def standardize_columns(m: DataFrame, cutoff: float) -> DataFrame:
    """z-scores over the entries of each column, clipped at cutoff; entries within 1e-5 of the mean vanish."""
    return standardized(m, column_stats(m), cutoff)


def column_stats(m: DataFrame) -> DataFrame:
    """(col_id, mean, std) over the entries of each column."""
    return m.groupBy("col_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def standardized(m: DataFrame, stats: DataFrame, cutoff: float) -> DataFrame:
    """z-scores by the statistics of columns."""
    stats = stats.select("col_id", F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    moved = m.join(stats, "col_id").withColumn("_c", F.col("value") - F.col("_mean")).filter(F.abs("_c") > 1e-5)
    z = F.when(F.col("_std") > 1e-5, F.col("_c") / F.col("_std")).otherwise(F.col("_c"))
    return moved.select("row_id", "col_id", F.greatest(F.lit(-cutoff), F.least(F.lit(cutoff), z)).alias("value"))
