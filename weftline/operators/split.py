"""Train and validation splits of (row_id, col_id, value, date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import hashed_order
from weftline.operators.dictionary import numbered
from weftline.sources.scratch import saved


def by_date(m: DataFrame, cut: int) -> DataFrame:
    """m with part: train until the cut, valid after it. A row with everything after the cut has no part at all."""
    early = F.min("date").over(Window.partitionBy("row_id"))
    return m.withColumn("_first", early).filter(F.col("_first") <= cut).withColumn("part", F.when(F.col("date") > cut, "valid").otherwise("train")).drop("_first")


def restrict(split: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None, cold: bool = False) -> DataFrame:
    """Keep validation to some rows and columns; cold takes the training entries of the validation rows away."""
    train, valid = split.filter("part = 'train'"), split.filter("part = 'valid'")
    if rows is not None:
        valid = valid.join(rows.select("row_id"), "row_id", "left_semi")
    if cols is not None:
        valid = valid.join(cols.select("col_id"), "col_id", "left_semi")
    if cold:
        train = train.join(valid.select("row_id").distinct(), "row_id", "left_anti")
    return train.select(split.columns).unionByName(valid.select(split.columns))


def by_fraction(m: DataFrame, fraction: float, order: list[Column], least: int = 2) -> DataFrame:
    """The first ceil(fraction * n) entries of each row in the order given are valid; rows with fewer than least entries are train."""
    n = F.count("*").over(Window.partitionBy("row_id"))
    place = F.row_number().over(Window.partitionBy("row_id").orderBy(*order))
    marked = m.withColumns({"_n": n, "_k": place})
    valid = (F.col("_n") >= least) & (F.col("_k") <= F.ceil(F.lit(fraction) * F.col("_n")))
    return marked.withColumn("part", F.when(valid, "valid").otherwise("train")).drop("_n", "_k")


def by_position(m: DataFrame, n: Column, keep: str = "last") -> DataFrame:
    """n entries of each row are train: the last by position (as it is done) or the first (as it is described)."""
    at = F.desc("date") if keep == "last" else F.asc("date")
    place = F.row_number().over(Window.partitionBy("row_id").orderBy(at, "col_id"))
    return m.withColumn("part", F.when(place <= n, "train").otherwise("valid"))


def sample_ids(ids: DataFrame, col: str, n: int, seed: str) -> DataFrame:
    """n distinct ids in the order of a hash that any engine reproduces."""
    return ids.select(col).distinct().orderBy(hashed_order(seed, col), col).limit(n)


def filled_ids(ids: DataFrame, spare: DataFrame, col: str, n: int, seed: str) -> DataFrame:
    """n distinct ids: of ids in hash order, and where these are fewer, of spare as well."""
    first = ids.select(col).distinct().withColumn("_src", F.lit(0))
    rest = spare.select(col).distinct().join(first.select(col), col, "left_anti").withColumn("_src", F.lit(1))
    return first.unionByName(rest).orderBy("_src", hashed_order(seed, col), col).limit(n).select(col)


def sizes_met(wanted: DataFrame, pool: DataFrame) -> DataFrame:
    """For each size wanted: how many playlists of the pool have it (equal) or more (larger). Only distinct sizes meet."""
    by_size = pool.groupBy(F.col("size").alias("pool_size")).agg(F.count("*").alias("n"))
    sizes = wanted.groupBy("size").agg(F.count("*").alias("wanted"))
    met = sizes.join(F.broadcast(by_size), F.col("pool_size") >= F.col("size"), "left")  # one row a size, a few hundred
    n = F.coalesce("n", F.lit(0))
    return met.groupBy("size", "wanted").agg(F.sum(F.when(F.col("pool_size") == F.col("size"), n).otherwise(0)).alias("equal"), F.sum(F.when(F.col("pool_size") > F.col("size"), n).otherwise(0)).alias("larger"))


def _ranked(df: DataFrame, *ids: str) -> DataFrame:
    """df with rank from 1 by falling size, then hash order, and k, the rank within its size; no size is ranked in one task."""
    dealt = numbered(df.withColumn("_down", -F.col("size")), "_down", "_h", *ids, name="rank").withColumn("rank", F.col("rank") + 1).drop("_down")
    sizes = dealt.groupBy("size").agg((F.min("rank") - 1).alias("_above"))
    return dealt.join(F.broadcast(sizes), "size").withColumn("k", F.col("rank") - F.col("_above")).drop("_above")  # one row a size


def matching(tests: DataFrame, pool: DataFrame, repeats: int = 3) -> DataFrame:
    """(test_id, repeat, playlist_id, exact): playlists of the pool (playlist_id, size) shaped like the tests (test_id, size).

    Each test has ``repeats`` places, to which different playlists of just its size go. Places left over take larger playlists left over, as
    many as can be: from the largest size down, each size fills what places the larger playlists not yet taken allow, so no place stays free
    while a larger playlist does. With S the running number of places and O that of larger playlists, that number is S + min(0, least O - S so
    far). The filled places and the playlists meet by rank. Everything is in the order of a hash, so that the outcome depends on no timing.
    """
    places = tests.select("test_id", "size", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")).withColumn("_h", hashed_order("slot", "test_id", "repeat"))
    offers = pool.select("playlist_id", "size").withColumn("_h", hashed_order("pool", "playlist_id"))
    places, offers = _ranked(places, "test_id", "repeat").drop("rank"), _ranked(offers, "playlist_id").drop("rank")
    exact = saved(places.join(offers.select("playlist_id", "size", "k"), ["size", "k"]).select("test_id", "repeat", "playlist_id"), "exact")
    left_places = _ranked(places.drop("k").join(exact.select("test_id", "repeat"), ["test_id", "repeat"], "left_anti"), "test_id", "repeat")
    left_offers = _ranked(offers.drop("k").join(exact.select("playlist_id"), "playlist_id", "left_anti"), "playlist_id")
    offered = left_offers.groupBy("size").agg(F.lit(0).cast("long").alias("places"), F.count("*").alias("offers"))
    both = left_places.groupBy("size").agg(F.count("*").alias("places"), F.lit(0).cast("long").alias("offers")).unionByName(offered).groupBy("size").agg(F.sum("places").alias("places"), F.sum("offers").alias("offers"))
    down = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)  # over one row a size
    both = both.select("size", F.sum("places").over(down).alias("s"), (F.sum("offers").over(down) - F.col("offers")).alias("o"))
    filled = both.select("size", (F.col("s") + F.least(F.lit(0), F.min(F.col("o") - F.col("s")).over(down))).alias("c"))
    filled = filled.select("size", "c", F.coalesce(F.lag("c").over(Window.orderBy(F.desc("size"))), F.lit(0)).alias("before"))
    taken = left_places.join(F.broadcast(filled), "size").filter(F.col("before") + F.col("k") <= F.col("c")).select("test_id", "repeat", (F.col("before") + F.col("k")).alias("rank"))
    larger = taken.join(left_offers.select("playlist_id", "rank"), "rank")
    named = lambda df, is_exact: df.select("test_id", F.col("repeat").cast("long").alias("repeat"), "playlist_id", F.lit(is_exact).alias("exact"))
    return named(exact, True).unionByName(named(larger, False))


def drop_half(rows: DataFrame, by: str, seed: str) -> DataFrame:
    """Rows (playlist_id, by) without the first half of each group in hash order, rounded down."""
    w = Window.partitionBy(by)
    k = F.row_number().over(w.orderBy(hashed_order(seed, "playlist_id"), "playlist_id"))
    return rows.withColumns({"_k": k, "_n": F.count("*").over(w)}).filter(F.col("_k") > F.floor(F.col("_n") / 2)).drop("_k", "_n")


def in_ranges(x: Column, *ranges: tuple[int, int]) -> Column:
    out = F.lit(False)
    for a, b in ranges:
        out = out | x.between(a, b)
    return out
