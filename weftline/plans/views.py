"""The given tables read as collections of items, for the DataFrame side and, as SQL, for the check against it.

A customer is a playlist, a part a song, an order line an occurrence at a position; brand is the artist,
brand and type the album, nation and segment the name. Every tenth playlist is a challenge playlist, of which 0, 1, 5, 10 or 25
first positions are seeds. Embeddings stand for factors.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators import coo
from weftline.sources.scratch import saved

SEEDS = (0, 1, 5, 10, 25)
SECONDS = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {})"


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.held = spark, sf_dir, False

    def hold(self) -> Views:
        """Write what a query reads more than once: interactions, playlists and train."""
        for name in ("interactions", "playlists", "train"):
            self.__dict__[name] = saved(getattr(self, name), name)
            self.held = True
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def occurrences(self) -> DataFrame:
        """(playlist_id, song_id, pos)"""
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        place = Window.partitionBy("o_custkey").orderBy("o_orderdate", "l_orderkey", "l_linenumber", "l_partkey")
        joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.select(F.col("o_custkey").alias("playlist_id"), F.col("l_partkey").alias("song_id"), (F.row_number().over(place) - 1).cast("long").alias("pos"))

    @cached_property
    def interactions(self) -> DataFrame:
        """row_id: playlist, col_id: song, value: occurrences, date: position of the first."""
        occ = self.occurrences.groupBy("playlist_id", "song_id").agg(F.count("*").cast("double").alias("value"), F.min("pos").alias("date"))
        return occ.select(F.col("playlist_id").alias("row_id"), F.col("song_id").alias("col_id"), "value", "date")

    @cached_property
    def songs(self) -> DataFrame:
        p = self.table("part")
        return p.select(
            F.col("p_partkey").alias("song_id"),
            F.col("p_brand").alias("artist"),
            F.concat("p_brand", F.lit("#"), "p_type").alias("album"),
            F.floor("p_retailprice").cast("long").alias("duration"),
            F.col("p_name").alias("track_name"),
        )

    @cached_property
    def playlists(self) -> DataFrame:
        """(playlist_id, name, n_tracks, is_test, seeds); n_tracks is 0 for playlists without tracks."""
        c = self.table("customer").join(F.broadcast(self.table("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nation: 25 rows by definition
        if self.held:
            n = self.interactions.groupBy(F.col("row_id").alias("playlist_id")).agg(F.sum("value").cast("long").alias("n_tracks"))
        else:
            n = self.occurrences.groupBy("playlist_id").agg(F.count("*").alias("n_tracks"))
        test = F.col("playlist_id") % 10 == 0
        seeds = F.element_at(F.array(*map(F.lit, SEEDS)), (F.floor(F.col("playlist_id") / 10) % 5 + 1).cast("int"))
        named = c.select(F.col("c_custkey").alias("playlist_id"), F.concat_ws(" ", "n_name", "c_mktsegment").alias("name"))
        return named.join(n, "playlist_id", "left").select(
            "playlist_id", "name", F.coalesce("n_tracks", F.lit(0).cast("long")).alias("n_tracks"), test.alias("is_test"), F.when(test, seeds).otherwise(F.lit(0)).cast("long").alias("seeds")
        )

    @cached_property
    def train(self) -> DataFrame:
        """Interactions of training playlists, and the seeds of challenge playlists."""
        pl = self.playlists.select(F.col("playlist_id").alias("row_id"), "is_test", "seeds")
        return self.interactions.join(pl, "row_id").filter("not is_test or date < seeds").select("row_id", "col_id", "value", "date")

    @cached_property
    def hidden(self) -> DataFrame:
        """Interactions of challenge playlists beyond their seeds."""
        pl = self.playlists.select(F.col("playlist_id").alias("row_id"), "is_test", "seeds")
        return self.interactions.join(pl, "row_id").filter("is_test and date >= seeds").select("row_id", "col_id", "value", "date")

    @cached_property
    def events(self) -> DataFrame:
        """row_id: user, col_id: k of props, value: summed, date: the latest second."""
        e = self.table("events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "value", F.expr(SECONDS.format("ts")).alias("date"))
        return coo.from_rows(e, "user_id", "k", "value", "date")

    @cached_property
    def factors(self) -> DataFrame:
        """(id, features): 64 numbers each."""
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))

    def playlist_factors(self) -> DataFrame:
        """(playlist_id, u, name_u, album_u, artist_u): factors dealt to playlists, parts of which stand for the factors of a kind."""
        n = self.factors.count()
        key = self.playlists.select("playlist_id", ((F.col("playlist_id") * 7 + 3) % n).alias("id"))
        return key.join(self.factors, "id").select("playlist_id", F.col("features").alias("u"), *kinds("u"))

    def song_factors(self) -> DataFrame:
        """(song_id, v, name_v, album_v, artist_v): factors dealt to songs."""
        n = self.factors.count()
        return self.songs.select("song_id", (F.col("song_id") % n).alias("id")).join(self.factors, "id").select("song_id", F.col("features").alias("v"), *kinds("v"))


#: Kinds of factors beside the main ones, and where they stand in a dealt one: first place and length.
KINDS = {"name": (1, 32), "album": (33, 16), "artist": (49, 16)}


def kinds(side: str) -> list[Column]:
    return [F.slice("features", at, n).alias(f"{kind}_{side}") for kind, (at, n) in KINDS.items()]


#: The same views in DuckDB's SQL.
BASE = """occ AS (SELECT o_custkey AS playlist_id, l_partkey AS song_id,
    ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey) - 1 AS pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT playlist_id AS row_id, song_id AS col_id, CAST(COUNT(*) AS DOUBLE) AS value, CAST(MIN(pos) AS BIGINT) AS date FROM occ GROUP BY ALL),
songs AS (SELECT p_partkey AS song_id, p_brand AS artist, p_brand || '#' || p_type AS album, CAST(floor(p_retailprice) AS BIGINT) AS duration, p_name AS track_name FROM part),
pl AS (SELECT c_custkey AS playlist_id, n_name || ' ' || c_mktsegment AS name, coalesce(n, 0) AS n_tracks, c_custkey % 10 = 0 AS is_test,
    CASE WHEN c_custkey % 10 = 0 THEN [0, 1, 5, 10, 25][CAST((c_custkey // 10) % 5 + 1 AS INT)] ELSE 0 END AS seeds
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT playlist_id, count(*) AS n FROM occ GROUP BY 1) o ON o.playlist_id = c_custkey),
train AS (SELECT r.* FROM r JOIN pl ON row_id = playlist_id WHERE NOT is_test OR date < seeds),
hidden AS (SELECT r.* FROM r JOIN pl ON row_id = playlist_id WHERE is_test AND date >= seeds),
e AS (SELECT user_id AS row_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS col_id, sum(value) AS value, CAST(max(floor(epoch(ts))) AS BIGINT) AS date FROM events GROUP BY ALL),
f AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS features FROM embeddings),
uf AS (SELECT playlist_id, features AS u FROM pl JOIN f ON f.id = (playlist_id * 7 + 3) % (SELECT count(*) FROM f)),
vf AS (SELECT song_id, features AS v FROM songs JOIN f ON f.id = song_id % (SELECT count(*) FROM f))"""
