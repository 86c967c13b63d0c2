"""Ranking quality: ranked (playlist_id, song_id, rank from 1) against targets (playlist_id, song_id).

Playlists without targets or without a ranking are not counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _base(ranked: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(playlist_id, n_targets, n_ranked) of counted playlists, and the hits."""
    n = targets.groupBy("playlist_id").agg(F.count("*").alias("n_targets"))
    m = ranked.groupBy("playlist_id").agg(F.count("*").alias("n_ranked"))
    return n.join(m, "playlist_id"), ranked.join(targets.select("playlist_id", "song_id"), ["playlist_id", "song_id"])


def ndcg(ranked: DataFrame, targets: DataFrame, thresholds: list[int]) -> DataFrame:
    """(playlist_id, threshold, value) with gain 1 / log2(rank + 1)."""
    base, hits = _base(ranked, targets)
    ks = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    gains = hits.select("playlist_id", "rank", ks).filter("rank <= threshold").groupBy("playlist_id", "threshold").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_targets"), F.col("threshold")).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    each = base.select("playlist_id", "n_targets", ks)
    return each.join(gains, ["playlist_id", "threshold"], "left").select("playlist_id", F.col("threshold").cast("long").alias("threshold"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("value"))


def r_precision(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    base, hits = _base(ranked, targets)
    m = base.withColumn("m", F.least("n_targets", "n_ranked"))
    found = hits.join(m, "playlist_id").filter("rank <= m").groupBy("playlist_id").agg(F.count("*").alias("n"))
    return m.join(found, "playlist_id", "left").select("playlist_id", (F.coalesce("n", F.lit(0)) / F.col("m")).alias("value"))


def r_precision_artist(ranked: DataFrame, targets: DataFrame, songs: DataFrame) -> DataFrame:
    """R-precision plus a quarter, once for each target artist met by a miss; over the first m."""
    base, _ = _base(ranked, targets)
    m = base.withColumn("m", F.least("n_targets", "n_ranked"))
    first = ranked.join(m, "playlist_id").filter("rank <= m").select("playlist_id", "song_id").join(songs.select("song_id", "artist"), "song_id")
    own = targets.select("playlist_id", "song_id", F.lit(1).alias("hit"))
    marked = first.join(own, ["playlist_id", "song_id"], "left")
    hits = marked.groupBy("playlist_id").agg(F.count("hit").alias("n"))
    artists = targets.join(songs.select("song_id", "artist"), "song_id").select("playlist_id", "artist").distinct()
    misses = marked.filter("hit is null").select("playlist_id", "artist").distinct().join(artists, ["playlist_id", "artist"]).groupBy("playlist_id").agg(F.count("*").alias("a"))
    out = m.join(hits, "playlist_id", "left").join(misses, "playlist_id", "left")
    return out.select("playlist_id", ((F.coalesce("n", F.lit(0)) + 0.25 * F.coalesce("a", F.lit(0))) / F.col("m")).alias("value"))


def clicks(ranked: DataFrame, targets: DataFrame, k: int = 500, page: int = 10) -> DataFrame:
    """Pages to turn before the first hit; k // page + 1 without one."""
    base, hits = _base(ranked, targets)
    first = hits.filter(F.col("rank") <= k).groupBy("playlist_id").agg(F.min("rank").alias("rank"))
    turned = F.floor((F.col("rank") - 1) / page).cast("double")
    return base.join(first, "playlist_id", "left").select("playlist_id", F.coalesce(turned, F.lit(float(k // page + 1))).alias("value"))


def summary(metric: str, values: DataFrame, threshold: int | None = None) -> DataFrame:
    """(metric, threshold, value, n_eval): the mean over counted playlists; null if there are none."""
    by = F.col("threshold") if threshold is None else F.lit(threshold).cast("long")
    return values.groupBy(by.alias("threshold")).agg(F.avg("value").alias("value"), F.count("*").alias("n_eval")).select(F.lit(metric).alias("metric"), "threshold", "value", "n_eval")
