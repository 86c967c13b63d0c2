"""Queries of retrieval, ranking and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import blocks, dictionary, evaluate, rank, recommend, split
from weftline.plans.registry import query, r6
from weftline.plans.views import Views
from weftline.sources.playlists import submission_lines
from weftline.sources.scratch import saved

NEIGHBOURS, CANDIDATES, STORED = 200, 200, 100

POP = "pop AS (SELECT col_id AS song_id, sum(value) / (SELECT sum(value) FROM train) AS popularity FROM train GROUP BY 1)"
TARGETS = "tg AS (SELECT playlist_id FROM pl WHERE is_test AND playlist_id IN (SELECT row_id FROM train))"
NEAR = f"""{TARGETS}, {POP}, x AS (SELECT row_id, 's' || col_id AS k, value FROM train UNION ALL SELECT playlist_id, 'n' || name, 1.0 FROM pl),
rn AS (SELECT row_id, sqrt(sum(value * value)) AS n FROM x GROUP BY 1), x1 AS (SELECT row_id, k, CASE WHEN n > 1e-5 THEN value / n ELSE value END AS value FROM x JOIN rn USING (row_id)),
cn AS (SELECT k, sqrt(sum(value * value)) AS n FROM x1 GROUP BY 1), x2 AS (SELECT row_id, k, CASE WHEN n > 1e-10 THEN value / n ELSE value END AS value FROM x1 JOIN cn USING (k)),
sim AS (SELECT a.row_id AS playlist_id, b.row_id AS other, round(sum(a.value * b.value), 6) AS sim FROM x2 a JOIN x2 b USING (k) WHERE a.row_id IN (SELECT playlist_id FROM tg) GROUP BY ALL),
near AS (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY playlist_id ORDER BY sim DESC, other) <= {NEIGHBOURS})"""
UU = f"""{NEAR}, vote AS (SELECT playlist_id, col_id AS song_id, round(sum(sim * pow(popularity, -0.1)), 6) AS score FROM near JOIN train ON other = row_id JOIN pop ON song_id = col_id GROUP BY ALL),
uu AS (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY score DESC, song_id) AS rank FROM vote v WHERE NOT EXISTS (FROM train WHERE row_id = v.playlist_id AND col_id = v.song_id) QUALIFY rank <= {CANDIDATES})"""
II = f"""{UU}, pn AS (SELECT row_id, sqrt(sum(value * value)) AS n FROM train GROUP BY 1), y1 AS (SELECT col_id AS song, row_id AS p, value / n AS value FROM train JOIN pn USING (row_id)),
sn AS (SELECT song, sqrt(sum(value * value)) AS n FROM y1 GROUP BY 1), y2 AS (SELECT song, p, value / n AS value FROM y1 JOIN sn USING (song)),
lm AS (SELECT row_id AS playlist_id, col_id AS song FROM train WHERE row_id IN (SELECT playlist_id FROM uu)), mc AS (SELECT playlist_id, count(*) AS c FROM lm GROUP BY 1),
prof AS (SELECT playlist_id, p, sum(value) / any_value(c) AS value FROM lm JOIN y2 USING (song) JOIN mc USING (playlist_id) GROUP BY ALL),
ii AS (SELECT u.playlist_id, u.song_id, round(coalesce(sum(f2.value * t.value), 0) * pow(any_value(popularity), -0.4), 6) AS score
  FROM uu u JOIN pop USING (song_id) JOIN train t ON t.col_id = u.song_id LEFT JOIN prof f2 ON f2.playlist_id = u.playlist_id AND f2.p = t.row_id GROUP BY ALL)"""
SC = f"{II}, sc AS (SELECT u.playlist_id, u.song_id, u.score AS uu, round(list_inner_product(uf.u, v), 6) AS latent, ii.score AS ii FROM uu u JOIN ii USING (playlist_id, song_id) JOIN uf USING (playlist_id) JOIN vf USING (song_id))"
Z = "CASE WHEN stddev_pop({0}) OVER w > 1e-5 THEN ({0} - avg({0}) OVER w) / stddev_pop({0}) OVER w ELSE {0} END"
BLEND = f"""{SC}, bz AS (SELECT *, round(0.2 * {Z.format('uu')} + 0.15 * {Z.format('latent')} + 0.1 * {Z.format('ii')} + 0.15 * {Z.format('latent')}, 6) AS score FROM sc WINDOW w AS (PARTITION BY playlist_id)),
bl AS (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY score DESC, song_id) AS rank FROM bz QUALIFY rank <= {STORED})"""
HID = "tr AS (SELECT row_id AS playlist_id, col_id AS song_id FROM hidden)"


def targets(v: Views) -> DataFrame:
    return v.playlists.filter("is_test").select("playlist_id").join(v.train.select(F.col("row_id").alias("playlist_id")), "playlist_id", "left_semi")


def near(v: Views) -> DataFrame:
    return recommend.neighbours(v.train, v.playlists, targets(v), NEIGHBOURS)


def uu(v: Views, candidates: int = CANDIDATES) -> DataFrame:
    return recommend.user_user(v.train, near(v), candidates)


def scores(v: Views, u: DataFrame | None = None, w: DataFrame | None = None, candidates: int = CANDIDATES) -> DataFrame:
    """Every candidate with its user-user, latent and item-item score; the candidates are written once, as three joins read them.

    u, w: factors of playlists and of songs; the dealt ones if not given.
    """
    found = saved(uu(v, candidates), "candidates")
    ii = recommend.item_item(v.train, found).select("playlist_id", "song_id", F.round("score", 6).alias("ii"))
    both = found.select("playlist_id", "song_id", F.col("score").alias("uu")).join(ii, ["playlist_id", "song_id"])
    both = blocks.dots(both, u or v.playlist_factors(), w or v.song_factors(), {"latent": ("u", "v")})
    return both.select("playlist_id", "song_id", "uu", r6("latent", "latent"), "ii")


def blended(v: Views, u: DataFrame | None = None, w: DataFrame | None = None, candidates: int = CANDIDATES, stored: int = STORED) -> DataFrame:
    return recommend.blend(scores(v, u, w, candidates).withColumn("latent2", F.col("latent")), stored).drop("latent2")


def hidden(v: Views) -> DataFrame:
    return v.hidden.select(F.col("row_id").alias("playlist_id"), F.col("col_id").alias("song_id"))


@query("popularity", f"{POP} SELECT song_id, round(popularity, 9) AS popularity FROM pop")
def popularity(v: Views) -> DataFrame:
    return recommend.popularity(v.train).select("song_id", F.round("popularity", 9).alias("popularity"))


@query("popular_topk", f"{POP} SELECT song_id, round(popularity, 9) AS popularity FROM pop ORDER BY 2 DESC, 1 LIMIT 500")
def popular_topk(v: Views) -> DataFrame:
    return popularity(v).orderBy(F.desc("popularity"), "song_id").limit(500)


@query("target_rows", f"{TARGETS} SELECT playlist_id FROM tg", hold=True)
def target_rows(v: Views) -> DataFrame:
    return targets(v)


@query("cold_start_rows", "SELECT playlist_id FROM pl WHERE is_test AND playlist_id NOT IN (SELECT row_id FROM train)", hold=True)
def cold_start_rows(v: Views) -> DataFrame:
    return v.playlists.filter("is_test").select("playlist_id").join(v.train.select(F.col("row_id").alias("playlist_id")), "playlist_id", "left_anti")


@query("uu_neighbors", f"{NEAR} SELECT playlist_id, other, sim FROM near", hold=True)
def uu_neighbors(v: Views) -> DataFrame:
    return near(v)


@query("user_user", f"{UU} SELECT playlist_id, song_id, score, rank FROM uu", hold=True)
def user_user(v: Views) -> DataFrame:
    return uu(v).select("playlist_id", "song_id", "score", "rank")


@query("item_item", f"{II} SELECT playlist_id, song_id, score FROM ii", hold=True)
def item_item(v: Views) -> DataFrame:
    return recommend.item_item(v.train, saved(uu(v), "candidates")).select("playlist_id", "song_id", r6("score", "score"))


@query("latent_score", f"{UU} SELECT playlist_id, song_id, round(list_inner_product(u, v), 6) AS score FROM uu JOIN uf USING (playlist_id) JOIN vf USING (song_id)", hold=True)
def latent_score(v: Views) -> DataFrame:
    both = blocks.dots(uu(v).select("playlist_id", "song_id"), v.playlist_factors(), v.song_factors(), {"score": ("u", "v")})
    return both.select("playlist_id", "song_id", r6("score", "score"))


LATENT_TOP = f"""{TARGETS}, lt AS (SELECT playlist_id, song_id, round(list_inner_product(u, v), 6) AS score FROM tg JOIN uf USING (playlist_id), vf),
lr AS (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY score DESC, song_id) AS rank FROM lt WHERE NOT EXISTS (FROM train WHERE row_id = playlist_id AND col_id = song_id) QUALIFY rank <= {STORED})"""


def latent_lists(v: Views) -> DataFrame:
    seen = v.train.select(F.col("row_id").alias("playlist_id"), F.col("col_id").alias("song_id"))
    return recommend.latent_topn(v.playlist_factors().join(targets(v), "playlist_id", "left_semi"), v.song_factors(), seen, STORED)


@query("latent_topn", f"{LATENT_TOP} SELECT playlist_id, song_id, score, rank FROM lr", hold=True)
def latent_topn(v: Views) -> DataFrame:
    return latent_lists(v).select("playlist_id", "song_id", "score", "rank")


BLOCKS = f"""{TARGETS}, ib AS (SELECT song_id, v, sqrt(list_inner_product(v, v)) AS norm, (row_number() OVER (ORDER BY sqrt(list_inner_product(v, v)) DESC, song_id) - 1) // 256 AS ib FROM vf),
f0 AS (SELECT playlist_id, round(list_inner_product(u, v), 6) AS score FROM tg JOIN uf USING (playlist_id), ib WHERE ib = 0 AND NOT EXISTS (FROM train WHERE row_id = playlist_id AND col_id = song_id)),
fl AS (SELECT playlist_id, CASE WHEN count(*) = 10 THEN min(score) ELSE -1e300 END AS floor FROM (FROM f0 QUALIFY row_number() OVER (PARTITION BY playlist_id ORDER BY score DESC) <= 10) GROUP BY 1),
mx AS (SELECT ib, max(norm) AS most FROM ib GROUP BY 1)"""


@query("latent_blocks", f"{BLOCKS} SELECT playlist_id, 1 + (SELECT count(*) FROM mx WHERE ib > 0 AND most * sqrt(list_inner_product(u, u)) >= floor - 2e-6) AS met, (SELECT count(*) FROM mx) AS blocks FROM tg JOIN uf USING (playlist_id) JOIN fl USING (playlist_id)", hold=True)
def latent_blocks(v: Views) -> DataFrame:
    """What the bound leaves to multiply, for lists of ten over blocks of 256 songs."""
    seen = v.train.select(F.col("row_id").alias("playlist_id"), F.col("col_id").alias("song_id"))
    return recommend.latent_blocks(v.playlist_factors().join(targets(v), "playlist_id", "left_semi"), v.song_factors(), seen, 10, item_block=256)


@query("blend", f"{BLEND} SELECT playlist_id, song_id, score, rank FROM bl", hold=True)
def blend(v: Views) -> DataFrame:
    return blended(v).select("playlist_id", "song_id", "score", "rank")


@query("topn", "SELECT row_id, col_id, round(value, 6) AS value, row_number() OVER (PARTITION BY row_id ORDER BY round(value, 6) DESC, col_id) AS rank FROM e QUALIFY rank <= 10")
def topn(v: Views) -> DataFrame:
    return rank.topn(v.events.select("row_id", "col_id", r6("value", "value")), 10, by="row_id", item="col_id", score="value")


@query("exclude_seen", "SELECT row_id AS playlist_id, col_id AS song_id, value AS score FROM r ANTI JOIN train USING (row_id, col_id)", hold=True)
def exclude_seen(v: Views) -> DataFrame:
    named = lambda m: m.select(F.col("row_id").alias("playlist_id"), F.col("col_id").alias("song_id"), F.col("value").alias("score"))
    return rank.exclude(named(v.interactions), named(v.train))


@query("standardize", f"SELECT row_id, col_id, round({Z.format('value')}, 6) AS z FROM e WINDOW w AS (PARTITION BY row_id)")
def standardize(v: Views) -> DataFrame:
    return v.events.select("row_id", "col_id", r6(rank.standardized("value", "row_id"), "z"))


@query(
    "backfill",
    f"""{UU}, lr AS (SELECT playlist_id, song_id, row_number() OVER (PARTITION BY playlist_id ORDER BY value DESC, song_id) AS rank FROM (SELECT h.row_id AS playlist_id, h.col_id AS song_id, h.value FROM hidden h)),
own AS (SELECT playlist_id, song_id, score, 0 AS src, 0 AS sr FROM uu WHERE rank <= 50), sp AS (SELECT playlist_id, song_id, 0.0 AS score, 1 AS src, rank AS sr FROM lr ANTI JOIN own USING (playlist_id, song_id))
SELECT playlist_id, song_id, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY playlist_id ORDER BY src, score DESC, sr, song_id) AS rank FROM (FROM own UNION ALL FROM sp) QUALIFY rank <= 80""",
    hold=True,
)
def backfill(v: Views) -> DataFrame:
    spare = v.hidden.select(F.col("row_id").alias("playlist_id"), F.col("col_id").alias("song_id"), F.col("value").alias("score"))
    return rank.backfill(uu(v).filter("rank <= 50"), rank.topn(spare, 1 << 30), 80)


@query("hash_shuffle", "SELECT playlist_id, row_number() OVER (PARTITION BY name ORDER BY md5(concat_ws('#', '7', playlist_id)), playlist_id) AS place FROM pl")
def hash_shuffle(v: Views) -> DataFrame:
    order = Window.partitionBy("name").orderBy(text.hashed_order("7", "playlist_id"), "playlist_id")
    return v.playlists.select("playlist_id", F.row_number().over(order).cast("long").alias("place"))


@query("table_shuffle", "SELECT playlist_id, name, row_number() OVER (ORDER BY md5(concat_ws('#', '7', playlist_id)), playlist_id) - 1 AS place FROM pl")
def table_shuffle(v: Views) -> DataFrame:
    """A seeded permutation of the whole table."""
    return dictionary.permuted(v.playlists.select("playlist_id", "name"), "playlist_id", seed="7", name="place")


@query("distinct_sets", "SELECT 'artist' AS kind, artist AS value FROM songs GROUP BY ALL UNION ALL SELECT 'album', album FROM songs GROUP BY ALL UNION ALL SELECT 'name', name FROM pl GROUP BY ALL")
def distinct_sets(v: Views) -> DataFrame:
    kind = lambda df, c: df.select(F.lit(c).alias("kind"), F.col(c).alias("value")).distinct()
    return kind(v.songs, "artist").union(kind(v.songs, "album")).union(kind(v.playlists, "name"))


@query("set_intersect", f"{UU}, {HID} SELECT playlist_id, song_id FROM uu INTERSECT SELECT playlist_id, song_id FROM tr", hold=True)
def set_intersect(v: Views) -> DataFrame:
    return uu(v).select("playlist_id", "song_id").intersect(hidden(v))


@query("set_except", f"{UU}, {HID} SELECT playlist_id, song_id FROM uu EXCEPT SELECT playlist_id, song_id FROM tr", hold=True)
def set_except(v: Views) -> DataFrame:
    return uu(v).select("playlist_id", "song_id").subtract(hidden(v))


EVAL = f"{UU}, {HID}, nt AS (SELECT playlist_id, count(*) AS nt FROM tr GROUP BY 1), nr AS (SELECT playlist_id, count(*) AS nr FROM uu GROUP BY 1), base AS (SELECT *, least(nt, nr) AS m FROM nt JOIN nr USING (playlist_id)), hit AS (SELECT uu.playlist_id, uu.song_id, rank FROM uu JOIN tr USING (playlist_id, song_id))"
NDCG = f"""{EVAL}, ks AS (SELECT unnest([10, 50, 100]) AS threshold), dcg AS (SELECT playlist_id, threshold, sum(1 / log2(rank + 1)) AS dcg FROM hit, ks WHERE rank <= threshold GROUP BY ALL),
nd AS (SELECT playlist_id, CAST(threshold AS BIGINT) AS threshold, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(nt, threshold) + 1), lambda i: 1 / log2(i + 1))) AS value FROM (SELECT * FROM base, ks) LEFT JOIN dcg USING (playlist_id, threshold))"""
RP = "rp AS (SELECT playlist_id, (SELECT count(*) FROM hit h WHERE h.playlist_id = b.playlist_id AND rank <= m) / m AS value FROM base b)"
RPA = """mk AS (SELECT uu.playlist_id, artist, tr.song_id IS NOT NULL AS is_hit FROM uu JOIN base USING (playlist_id) JOIN songs USING (song_id) LEFT JOIN tr ON tr.playlist_id = uu.playlist_id AND tr.song_id = uu.song_id WHERE rank <= m),
ta AS (SELECT DISTINCT playlist_id, artist FROM tr JOIN songs USING (song_id)), ms AS (SELECT playlist_id, count(*) AS a FROM (SELECT DISTINCT playlist_id, artist FROM mk WHERE NOT is_hit) JOIN ta USING (playlist_id, artist) GROUP BY 1),
hs AS (SELECT playlist_id, count(*) FILTER (is_hit) AS n FROM mk GROUP BY 1),
ra AS (SELECT playlist_id, (coalesce(n, 0) + 0.25 * coalesce(a, 0)) / m AS value FROM base LEFT JOIN hs USING (playlist_id) LEFT JOIN ms USING (playlist_id))"""
CL = "ck AS (SELECT playlist_id, CAST(coalesce((min(rank) - 1) // 10, 21) AS DOUBLE) AS value FROM base LEFT JOIN hit USING (playlist_id) GROUP BY 1)"


@query("ndcg", f"{NDCG} SELECT playlist_id, threshold, round(value, 6) AS value FROM nd", hold=True)
def ndcg(v: Views) -> DataFrame:
    return evaluate.ndcg(saved(uu(v), "ranked"), hidden(v), [10, 50, 100]).select("playlist_id", "threshold", r6("value", "value"))


@query("r_precision", f"{EVAL}, {RP} SELECT playlist_id, round(value, 6) AS value FROM rp", hold=True)
def r_precision(v: Views) -> DataFrame:
    return evaluate.r_precision(saved(uu(v), "ranked"), hidden(v)).select("playlist_id", r6("value", "value"))


@query("r_precision_artist", f"{EVAL}, {RPA} SELECT playlist_id, round(value, 6) AS value FROM ra", hold=True)
def r_precision_artist(v: Views) -> DataFrame:
    return evaluate.r_precision_artist(saved(uu(v), "ranked"), hidden(v), v.songs).select("playlist_id", r6("value", "value"))


@query("clicks", f"{EVAL}, {CL} SELECT playlist_id, value FROM ck", hold=True)
def clicks(v: Views) -> DataFrame:
    return evaluate.clicks(saved(uu(v), "ranked"), hidden(v), k=200)


@query(
    "metric_table",
    f"""{NDCG}, {RP}, {RPA}, {CL} SELECT 'ndcg' AS metric, threshold, printf('%.4f', avg(value)) AS value, count(*) AS n_eval FROM nd GROUP BY ALL
UNION ALL SELECT 'r_precision', 200, printf('%.4f', avg(value)), count(*) FROM rp UNION ALL SELECT 'r_precision_artist', 200, printf('%.4f', avg(value)), count(*) FROM ra UNION ALL SELECT 'clicks', 200, printf('%.4f', avg(value)), count(*) FROM ck""",
    hold=True,
)
def metric_table(v: Views) -> DataFrame:
    ranked, wanted = saved(uu(v), "ranked"), hidden(v)
    return metrics(ranked, wanted, v.songs, [10, 50, 100], 200).select("metric", "threshold", F.format_string("%.4f", "value").alias("value"), "n_eval")


def metrics(ranked: DataFrame, wanted: DataFrame, songs: DataFrame, thresholds: list[int], k: int) -> DataFrame:
    """(metric, threshold, value, n_eval) of all four measures."""
    out = evaluate.summary("ndcg", evaluate.ndcg(ranked, wanted, thresholds))
    for name, values in (("r_precision", evaluate.r_precision(ranked, wanted)), ("r_precision_artist", evaluate.r_precision_artist(ranked, wanted, songs)), ("clicks", evaluate.clicks(ranked, wanted, k=k))):
        out = out.unionByName(evaluate.summary(name, values, k))
    return out


@query(
    "submission_lines",
    f"{BLEND} SELECT playlist_id AS pid, playlist_id || ', ' || string_agg('x:track:' || song_id, ', ' ORDER BY rank) AS line FROM bl GROUP BY 1",
    hold=True,
)
def submission(v: Views) -> DataFrame:
    return submission_lines(blended(v).select(F.col("playlist_id").alias("pid"), "rank", F.concat(F.lit("x:track:"), "song_id").alias("uri")))


COLD = f"""{POP}, cold AS (SELECT playlist_id, name FROM pl WHERE is_test AND playlist_id NOT IN (SELECT row_id FROM train)), top AS (SELECT song_id, row_number() OVER (ORDER BY round(popularity, 9) DESC, song_id) AS rank FROM pop QUALIFY rank <= 100)"""
COLD_LISTS = """nl AS (SELECT playlist_id, song_id, round(list_inner_product(u[1:32], v[1:32]), 6) AS score FROM named JOIN uf USING (playlist_id), vf),
nm AS (SELECT playlist_id, song_id, row_number() OVER (PARTITION BY playlist_id ORDER BY score DESC, song_id) AS rank FROM nl QUALIFY rank <= 100)
SELECT playlist_id, song_id, rank FROM nm UNION ALL SELECT playlist_id, song_id, rank FROM cold, top WHERE playlist_id NOT IN (SELECT playlist_id FROM nm)"""


def cold_lists(v: Views, u: DataFrame, w: DataFrame, n: int, named: DataFrame | None = None) -> DataFrame:
    """Lists for playlists without seeds: by the product of their name's factors with the songs' for every one with a name, for the others what is popular.

    named: which have one, in place of the playlists' own names.
    """
    cold = cold_start_rows(v)
    named = v.playlists.filter("name is not null") if named is None else named
    named = saved(cold.join(named.select("playlist_id"), "playlist_id", "left_semi"), "named")
    users = u.join(named, "playlist_id", "left_semi").select("playlist_id", F.col("name_u").alias("u"))
    seen = v.train.select(F.col("row_id").alias("playlist_id"), F.col("col_id").alias("song_id"))
    ranked = recommend.latent_topn(users, w.select("song_id", F.col("name_v").alias("v")), seen, n)
    return recommend.cold_start(cold, ranked, popularity(v), n)


@query("cold_start", f"{COLD}, named AS (SELECT playlist_id FROM cold WHERE name IS NOT NULL), {COLD_LISTS}", hold=True)
def cold_start(v: Views) -> DataFrame:
    return cold_lists(v, v.playlist_factors(), v.song_factors(), 100)


@query(
    "cold_start_names_lost",
    f"{COLD}, named AS (SELECT playlist_id FROM cold QUALIFY row_number() OVER (ORDER BY md5(concat_ws('#', 'cold', playlist_id)), playlist_id) > count(*) OVER () // 2), {COLD_LISTS}",
    hold=True,
)
def cold_start_names_lost(v: Views) -> DataFrame:
    """The same where a splitter has taken the names of half of them."""
    cold = dictionary.permuted(cold_start_rows(v), "playlist_id", seed="cold", name="place")
    kept = cold.filter(F.col("place") >= F.lit(cold.count() // 2))
    return cold_lists(v, v.playlist_factors(), v.song_factors(), 100, kept)
