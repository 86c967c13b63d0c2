"""Queries of factorisations and of the second stage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import boosting, coo, dictionary, latent, stage2
from weftline.plans.features import audio_table
from weftline.plans.ranking import BLEND, CANDIDATES, HID, STORED, UU, blended, cold_lists, hidden, metrics, uu
from weftline.plans.registry import query, r6
from weftline.plans.views import Views
from weftline.sources import playlists as src
from weftline.sources.playlists import submission_lines
from weftline.sources.scratch import folder, saved

ALS1 = """h AS (SELECT song_id, v[1] AS h FROM vf), g AS (SELECT sum(h * h) AS g FROM h WHERE song_id IN (SELECT col_id FROM train))
SELECT row_id AS playlist_id, round(sum(h * (1 + 10 * value)) / (any_value(g) + 10 * sum(value * h * h) + 0.1), 6) AS u FROM train JOIN h ON col_id = song_id, g GROUP BY 1"""


@query("als_rank1_step", ALS1, hold=True)
def als_rank1_step(v: Views) -> DataFrame:
    """A half-step of rank one, with the first place of the songs' factors fixed."""
    one = v.song_factors().select(F.col("song_id").alias("id"), F.slice("v", 1, 1).alias("features"))
    one = saved(one.join(v.train.select(F.col("col_id").alias("id")).distinct(), "id", "left_semi"), "rank1")
    step = latent.als_half_step(v.train, one, 1, 10, 0.1)
    return step.select(F.col("id").alias("playlist_id"), F.round(F.get("features", F.lit(0)), 6).alias("u"))


@query("als_fit", hold=True)
def als_fit(v: Views) -> DataFrame:
    u, w = latent.als(v.train, rank=64, iterations=3, alpha=100, lam=0.001)
    named = lambda df, side: df.select(F.lit(side).alias("side"), "id", "features")
    return named(u, "playlist").unionByName(named(w, "song"))


def stacked(v: Views, kind: str) -> DataFrame:
    """One-hot rows of songs above the sums of the songs of each playlist; columns are albums or artists."""
    ids = saved(dictionary.first_seen(v.songs, kind, "song_id"), "dictionary")
    own = dictionary.category_feature(v.songs, "song_id", kind, ids)
    members = v.train.select(F.col("row_id").alias("playlist_id"), F.col("col_id").alias("song_id")).join(v.songs, "song_id")
    n_songs = v.songs.agg(F.max("song_id") + 1).first()[0]
    return coo.below(own, dictionary.bag_feature(members, "playlist_id", kind, ids), n_songs)


def _stacked_sql(kind: str) -> str:
    return f"""d AS (SELECT {kind}, row_number() OVER (ORDER BY min(song_id)) - 1 AS idx FROM songs GROUP BY 1), m AS (
SELECT song_id AS row_id, idx AS col_id, CAST(1 AS DOUBLE) AS value FROM songs JOIN d USING ({kind})
UNION ALL SELECT row_id + (SELECT max(song_id) + 1 FROM songs), idx, CAST(count(*) AS DOUBLE) FROM train JOIN songs ON col_id = song_id JOIN d USING ({kind}) GROUP BY ALL)"""


@query("svd_input_album", f"{_stacked_sql('album')} SELECT * FROM m", hold=True)
def svd_input_album(v: Views) -> DataFrame:
    return stacked(v, "album")


@query("svd_input_artist", f"{_stacked_sql('artist')} SELECT * FROM m", hold=True)
def svd_input_artist(v: Views) -> DataFrame:
    return stacked(v, "artist")


@query(
    "svd_input_name",
    """d AS (SELECT name, row_number() OVER (ORDER BY min(playlist_id)) - 1 AS idx FROM pl GROUP BY 1)
SELECT col_id AS row_id, idx AS col_id, CAST(count(*) AS DOUBLE) AS value FROM train JOIN pl ON row_id = playlist_id JOIN d USING (name) GROUP BY ALL
UNION ALL SELECT playlist_id + (SELECT max(song_id) + 1 FROM songs), idx, 1.0 FROM pl JOIN d USING (name)""",
    hold=True,
)
def svd_input_name(v: Views) -> DataFrame:
    """Names of the playlists a song is in, above each playlist's own name."""
    ids = saved(dictionary.first_seen(v.playlists, "name", "playlist_id"), "dictionary")
    inside = v.train.join(v.playlists.select(F.col("playlist_id").alias("row_id"), "name"), "row_id")
    own = dictionary.category_feature(v.playlists, "playlist_id", "name", ids)
    return coo.below(dictionary.bag_feature(inside, "col_id", "name", ids), own, v.songs.agg(F.max("song_id") + 1).first()[0])


POWER = f"""{_stacked_sql('album')}, y1 AS (SELECT row_id, sum(value) AS y FROM m GROUP BY 1), z1 AS (SELECT col_id, sum(value * y) AS z FROM m JOIN y1 USING (row_id) GROUP BY 1),
x1 AS (SELECT col_id, z / sqrt(sum(z * z) OVER ()) AS x FROM z1), y2 AS (SELECT row_id, sum(value * x) AS y FROM m JOIN x1 USING (col_id) GROUP BY 1), z2 AS (SELECT col_id, sum(value * y) AS z FROM m JOIN y2 USING (row_id) GROUP BY 1)
SELECT col_id, round(z / sqrt(sum(z * z) OVER ()), 6) AS x FROM z2"""


@query("svd_power1", POWER, hold=True)
def svd_power1(v: Views) -> DataFrame:
    """Two power steps to the first right singular vector of the album matrix."""
    m = saved(stacked(v, "album"), "album")
    x = m.select(F.col("col_id").alias("id")).distinct().withColumn("value", F.lit(1.0))
    for _ in range(2):
        y = coo.times_vector(m, x).withColumnRenamed("row_id", "id")
        z = saved(coo.vector_times(y, m), "power")
        norm = z.agg(F.sqrt(F.sum(F.col("value") * F.col("value")))).first()[0]
        x = z.select(F.col("col_id").alias("id"), (F.col("value") / norm).alias("value"))
    return x.select(F.col("id").alias("col_id"), r6("value", "x"))


@query("svd_fit", hold=True)
def svd_fit(v: Views) -> DataFrame:
    """Factors of albums and their singular values."""
    _, s, right = latent.svd(stacked(v, "album"), rank=64, iterations=2)
    return right.select("id", "features", F.array(*map(F.lit, s)).alias("singular"))


@query("svd_parts", hold=True)
def svd_parts(v: Views) -> DataFrame:
    """Factors of names, albums and artists for songs and for playlists: the two parts of the rows of each stacked matrix."""
    u, w = fitted_kinds(v)
    sides = [df.select(F.lit(kind).alias("kind"), F.lit(side).alias("side"), F.col(key).alias("id"), F.col(f"{kind}_{x}").alias("features")) for kind in stage2.KINDS for side, df, key, x in (("playlist", u, "playlist_id", "u"), ("song", w, "song_id", "v"))]
    return reduce(DataFrame.unionByName, sides)


def fitted_kinds(v: Views, rank: int = 8, iterations: int = 2) -> tuple[DataFrame, DataFrame]:
    """(playlist_id, name_u, album_u, artist_u) and (song_id, name_v, ...): zeros where a playlist or a song is in no row of a matrix."""
    n_songs = v.songs.agg(F.max("song_id") + 1).first()[0]
    u, w = v.playlists.select("playlist_id"), v.songs.select("song_id")
    for kind in stage2.KINDS:
        us, _, _ = latent.svd(svd_input_name(v) if kind == "name" else stacked(v, kind), rank, iterations)
        songs, lists = latent.parts(saved(us, "factors"), n_songs)
        u = u.join(lists.select(F.col("id").alias("playlist_id"), F.col("features").alias(f"{kind}_u")), "playlist_id", "left")
        w = w.join(songs.select(F.col("id").alias("song_id"), F.col("features").alias(f"{kind}_v")), "song_id", "left")
    size = lambda x: {f"{kind}_{x}": rank for kind in stage2.KINDS}
    return stage2.complete(v.playlists.select("playlist_id"), u, "playlist_id", size("u")), stage2.complete(v.songs.select("song_id"), w, "song_id", size("v"))


def fitted(v: Views, rank: int = 32, iterations: int = 3) -> tuple[DataFrame, DataFrame]:
    """Factors of playlists and songs, by ALS and, by kind, by SVD."""
    u, w = latent.als(v.train, rank=rank, iterations=iterations)
    ku, kw = fitted_kinds(v)
    u = stage2.complete(v.playlists.select("playlist_id"), u.select(F.col("id").alias("playlist_id"), F.col("features").alias("u")), "playlist_id", {"u": rank})
    w = stage2.complete(v.songs.select("song_id"), w.select(F.col("id").alias("song_id"), F.col("features").alias("v")), "song_id", {"v": rank})
    return saved(u.join(ku, "playlist_id"), "playlist-factors"), saved(w.join(kw, "song_id"), "song-factors")


def members(v: Views) -> DataFrame:
    return v.train.select(F.col("row_id").alias("playlist_id"), F.col("col_id").alias("song_id"))


PC = """mem AS (SELECT row_id AS playlist_id, col_id AS song_id, artist, album, duration FROM train JOIN songs ON col_id = song_id),
pc AS (SELECT 'song' AS kind, CAST(song_id AS VARCHAR) AS key, count(DISTINCT playlist_id) AS n FROM mem GROUP BY ALL UNION ALL SELECT 'artist', artist, count(DISTINCT playlist_id) FROM mem GROUP BY ALL
  UNION ALL SELECT 'album', album, count(DISTINCT playlist_id) FROM mem GROUP BY ALL),
sp AS (SELECT s.*, coalesce(a.n, 0) AS song_pop, coalesce(b.n, 0) AS artist_pop, coalesce(c.n, 0) AS album_pop FROM songs s LEFT JOIN pc a ON a.kind = 'song' AND a.key = CAST(song_id AS VARCHAR)
  LEFT JOIN pc b ON b.kind = 'artist' AND b.key = artist LEFT JOIN pc c ON c.kind = 'album' AND c.key = album)"""
PS = f"""{PC}, ps AS (SELECT m.playlist_id, sum(song_pop) / count(*) AS song_pop, sum(artist_pop) / count(*) AS artist_pop, sum(album_pop) / count(*) AS album_pop, sum(sp.duration) / count(*) AS duration,
  sum(list_inner_product(u, v)) / count(*) AS uv, sum(list_inner_product(u[1:32], v[1:32])) / count(*) AS name_uv, count(DISTINCT sp.artist) / count(*) AS artists, count(DISTINCT sp.album) / count(*) AS albums, count(*) AS n
  FROM mem m JOIN sp USING (song_id) JOIN uf ON uf.playlist_id = m.playlist_id JOIN vf USING (song_id) GROUP BY 1)"""
SAMPLE = "smp AS (SELECT col_id AS song_id, row_id AS playlist_id FROM train QUALIFY row_number() OVER (PARTITION BY col_id ORDER BY md5(concat_ws('#', 'song', col_id, row_id)), row_id) <= 20)"
SS = f"{SAMPLE}, ss AS (SELECT song_id, avg(n_tracks) AS n_tracks, avg(list_inner_product(u, v)) AS uv, avg(list_inner_product(u[1:32], v[1:32])) AS name_uv FROM smp JOIN pl USING (playlist_id) JOIN uf USING (playlist_id) JOIN vf USING (song_id) GROUP BY 1)"


def counted(v: Views) -> DataFrame:
    return stage2.popularity_counts(members(v).join(v.songs, "song_id"))


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    """Doubles to six places."""
    return df.select(*keys, *[r6(c, c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


@query("pop_stats", f"{PC} SELECT kind, key, n FROM pc", hold=True)
def pop_stats(v: Views) -> DataFrame:
    return counted(v)


PS_COLUMNS = "song_pop artist_pop album_pop duration uv name_uv artists albums".split()


@query("playlist_stats", f"{PS} SELECT playlist_id, {', '.join(f'round({c}, 6) AS {c}' for c in PS_COLUMNS)}, n FROM ps", hold=True)
def playlist_stats(v: Views) -> DataFrame:
    songs = stage2.with_popularity(v.songs, saved(counted(v), "counts"))
    return rounded(stage2.playlist_stats(members(v), songs, v.playlist_factors(), v.song_factors()), "playlist_id")


@query(
    "playlist_albums",
    "b AS (SELECT row_id AS playlist_id, album, CAST(count(*) AS DOUBLE) AS value FROM train JOIN songs ON col_id = song_id GROUP BY ALL) SELECT playlist_id, album, value FROM b WHERE album IN (SELECT album FROM b GROUP BY 1 HAVING count(*) > 20)",
)
def playlist_albums(v: Views) -> DataFrame:
    """Albums of playlists, if more than twenty playlists have them."""
    ids = saved(dictionary.first_seen(v.songs, "album", "song_id"), "dictionary")
    bags = dictionary.bag_feature(members(v).join(v.songs, "song_id"), "playlist_id", "album", ids)
    kept = coo.counts(bags, "col_id").filter("nnz > 20").select("col_id")
    named = bags.join(kept, "col_id", "left_semi").join(ids, F.col("col_id") == F.col("idx"))
    return named.select(F.col("row_id").alias("playlist_id"), "album", "value")


@query("song_stats", f"{SS} SELECT song_id, round(n_tracks, 6) AS n_tracks, round(uv, 6) AS uv, round(name_uv, 6) AS name_uv FROM ss", hold=True)
def song_stats(v: Views) -> DataFrame:
    return rounded(stage2.song_stats(stage2.sampled(members(v), 20), v.playlists, v.playlist_factors(), v.song_factors()), "song_id")


def song_features(v: Views, u: DataFrame, w: DataFrame) -> DataFrame:
    songs = stage2.with_popularity(v.songs, saved(counted(v), "counts"))
    stats = stage2.song_stats(stage2.sampled(members(v), 20), v.playlists, u, w)
    zero = [r6(F.coalesce(c, F.lit(0.0)), c) for c in ("n_tracks", "uv", "name_uv")]
    return songs.join(stats, "song_id", "left").select("song_id", "duration", *zero, "song_pop", "artist_pop", "album_pop")


@query("feat_song", f"{PC}, {SS} SELECT song_id, sp.duration, round(coalesce(n_tracks, 0), 6) AS n_tracks, round(coalesce(uv, 0), 6) AS uv, round(coalesce(name_uv, 0), 6) AS name_uv, song_pop, artist_pop, album_pop FROM sp LEFT JOIN ss USING (song_id)", hold=True)
def feat_song(v: Views) -> DataFrame:
    return song_features(v, v.playlist_factors(), v.song_factors())


#: An album is in the bags if more playlists than this have it.
ALBUM_SUPPORT = 20


def bags(v: Views) -> tuple[DataFrame, DataFrame]:
    """(playlist_id, idx, value): how many songs of each album a playlist has; and the albums (idx) of many playlists."""
    ids = saved(dictionary.first_seen(v.songs, "album", "song_id"), "dictionary")
    own = saved(dictionary.bag_feature(members(v).join(v.songs, "song_id"), "playlist_id", "album", ids), "bags")
    kept = coo.counts(own, "col_id").filter(F.col("nnz") > ALBUM_SUPPORT).select(F.col("col_id").alias("idx"))
    return own.select(F.col("row_id").alias("playlist_id"), F.col("col_id").alias("idx"), "value"), saved(kept, "kept")


def playlist_features(v: Views, u: DataFrame, w: DataFrame) -> DataFrame:
    """Statistics, the number of tracks, and the name's id as a number (0 without a name)."""
    songs = stage2.with_popularity(v.songs, saved(counted(v), "counts"))
    stats = rounded(stage2.playlist_stats(members(v), songs, u, w), "playlist_id")
    named = v.playlists.join(saved(dictionary.first_seen(v.playlists, "name", "playlist_id"), "dictionary"), "name", "left")
    own = named.select("playlist_id", F.col("n_tracks").cast("long").alias("n_tracks"), F.coalesce("idx", F.lit(0).cast("long")).alias("name_index"))
    return stats.join(own, "playlist_id").select("playlist_id", "n_tracks", "name_index", *PS_COLUMNS, "n")


@query(
    "feat_playlist",
    f"""{PS}, d AS (SELECT name, row_number() OVER (ORDER BY min(playlist_id)) - 1 AS idx FROM pl GROUP BY 1), da AS (SELECT album, row_number() OVER (ORDER BY min(song_id)) - 1 AS a FROM songs GROUP BY 1),
ba AS (SELECT playlist_id, a, count(*) AS c FROM mem JOIN da USING (album) GROUP BY ALL), bs AS (SELECT playlist_id, string_agg(a || ':' || c, ' ' ORDER BY a) AS album_bag FROM ba WHERE a IN (SELECT a FROM ba GROUP BY 1 HAVING count(*) > {ALBUM_SUPPORT}) GROUP BY 1)
SELECT playlist_id, CAST(n_tracks AS BIGINT) AS n_tracks, idx AS name_index, {', '.join(f'round({c}, 6) AS {c}' for c in PS_COLUMNS)}, n, coalesce(album_bag, '') AS album_bag FROM ps JOIN pl USING (playlist_id) JOIN d USING (name) LEFT JOIN bs USING (playlist_id)""",
    hold=True,
)
def feat_playlist(v: Views) -> DataFrame:
    """The features, and the bag of albums as "idx:n ..."."""
    own, kept = bags(v)
    cells = own.join(kept, "idx", "left_semi").groupBy("playlist_id").agg(F.sort_array(F.collect_list(F.struct("idx", F.concat_ws(":", "idx", F.col("value").cast("long")).alias("cell")))).alias("cells"))
    text = cells.select("playlist_id", F.array_join("cells.cell", " ").alias("album_bag"))
    return playlist_features(v, v.playlist_factors(), v.song_factors()).join(text, "playlist_id", "left").withColumn("album_bag", F.coalesce("album_bag", F.lit("")))


PAIR = f"{UU}, m2 AS (SELECT row_id AS playlist_id, col_id AS member FROM train)"


@query(
    "feat_pair_song",
    f"""{PAIR} SELECT playlist_id, u.song_id, round(avg(CASE WHEN a.artist = b.artist THEN 1.0 ELSE 0.0 END), 6) AS same_artist, round(avg(CASE WHEN a.album = b.album THEN 1.0 ELSE 0.0 END), 6) AS same_album,
  round(avg(a.duration - b.duration), 6) AS d_duration, round(avg(list_inner_product(x.v, y.v)), 6) AS vv, round(avg(list_inner_product(x.v[1:32], y.v[1:32])), 6) AS name_vv,
  round(avg(list_inner_product(x.v[33:48], y.v[33:48])), 6) AS album_vv, round(avg(list_inner_product(x.v[49:64], y.v[49:64])), 6) AS artist_vv,
  round(any_value(list_inner_product(p.u[1:32], x.v[1:32])), 6) AS name_uv, round(any_value(list_inner_product(p.u[33:48], x.v[33:48])), 6) AS album_uv, round(any_value(list_inner_product(p.u[49:64], x.v[49:64])), 6) AS artist_uv
  FROM uu u JOIN m2 USING (playlist_id) JOIN songs a ON a.song_id = u.song_id JOIN songs b ON b.song_id = member JOIN vf x ON x.song_id = u.song_id JOIN vf y ON y.song_id = member JOIN uf p ON p.playlist_id = u.playlist_id GROUP BY ALL""",
    hold=True,
)
def feat_pair_song(v: Views) -> DataFrame:
    return rounded(stage2.pair_song(saved(uu(v), "candidates"), members(v), v.songs, v.playlist_factors(), v.song_factors()), "playlist_id", "song_id")


@query(
    "feat_pair_playlist",
    f"""{UU}, {SAMPLE} SELECT q.playlist_id, q.song_id, round(avg(CASE WHEN a.name = b.name THEN 1.0 ELSE 0.0 END), 6) AS same_name, round(avg(a.n_tracks - b.n_tracks), 6) AS d_tracks,
  round(avg(list_inner_product(x.u, y.u)), 6) AS uu, round(avg(list_inner_product(x.u[1:32], y.u[1:32])), 6) AS name_uu
  FROM uu q JOIN smp s ON s.song_id = q.song_id JOIN pl a ON a.playlist_id = q.playlist_id JOIN pl b ON b.playlist_id = s.playlist_id JOIN uf x ON x.playlist_id = q.playlist_id JOIN uf y ON y.playlist_id = s.playlist_id GROUP BY ALL""",
    hold=True,
)
def feat_pair_playlist(v: Views) -> DataFrame:
    return rounded(stage2.pair_playlist(uu(v), stage2.sampled(members(v), 20), v.playlists, v.playlist_factors()), "playlist_id", "song_id")


AUDIO_SQL = ", ".join(f"round(avg(coalesce(a.features[{k + 1}] - b.features[{k + 1}], 0)), 6) AS d_{c}" for k, c in enumerate(stage2.AUDIO_MEANS))


@query(
    "feat_pair_audio",
    f"""{PAIR}, au AS (SELECT f.id AS song_id, features, label FROM f JOIN embeddings ON vec_id = id JOIN songs ON song_id = id)
SELECT playlist_id, u.song_id, {AUDIO_SQL}, round(avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END), 6) AS same_key
  FROM uu u JOIN m2 USING (playlist_id) LEFT JOIN au a ON a.song_id = u.song_id LEFT JOIN au b ON b.song_id = member GROUP BY ALL""",
    hold=True,
)
def feat_pair_audio(v: Views) -> DataFrame:
    return rounded(stage2.pair_audio(uu(v), members(v), audio_table(v).drop("uri")), "playlist_id", "song_id")


LAB = f"{BLEND}, {HID}, lb AS (SELECT bl.*, CASE WHEN tr.song_id IS NULL THEN 0 ELSE 1 END AS label FROM bl LEFT JOIN tr ON tr.playlist_id = bl.playlist_id AND tr.song_id = bl.song_id)"
SAMPLED = f"{LAB}, sm AS (SELECT * FROM lb QUALIFY row_number() OVER (PARTITION BY playlist_id, label ORDER BY md5(concat_ws('#', 's2', playlist_id, song_id)), song_id) <= 20)"


def labelled(v: Views) -> DataFrame:
    return stage2.labelled(blended(v), hidden(v))


@query("label_candidates", f"{LAB} SELECT playlist_id, song_id, rank, CAST(label AS BIGINT) AS label FROM lb", hold=True)
def label_candidates(v: Views) -> DataFrame:
    return labelled(v).select("playlist_id", "song_id", "rank", "label")


@query("sample_pos_neg", f"{SAMPLED} SELECT playlist_id, song_id, CAST(label AS BIGINT) AS label FROM sm", hold=True)
def sample_pos_neg(v: Views) -> DataFrame:
    return stage2.samples(labelled(v)).select("playlist_id", "song_id", "label")


#: Playlists of the validation file: a fifth.
VALID = "floor(playlist_id / 50) % 5 = 0"


def parted(rows: DataFrame) -> DataFrame:
    """rows with part: valid, or train if their playlist has a positive one."""
    rows = saved(rows.withColumn("part", F.when(F.expr(VALID), "valid").otherwise("train")), "samples")
    return stage2.with_positives(rows.filter("part = 'train'")).unionByName(rows.filter("part = 'valid'"))


PART = f"st AS (SELECT *, CASE WHEN {VALID} THEN 'valid' ELSE 'train' END AS part FROM sm), sv AS (SELECT * FROM st WHERE part = 'valid' OR playlist_id IN (SELECT playlist_id FROM st WHERE label = 1))"


@query("stage2_samples", f"{SAMPLED}, {PART} SELECT part, playlist_id, song_id, CAST(label AS BIGINT) AS label, uu, latent, ii, score FROM sv", hold=True)
def stage2_samples(v: Views) -> DataFrame:
    """Samples with the scores of the first stage; training playlists without a positive are left out."""
    return parted(stage2.samples(labelled(v))).select("part", "playlist_id", "song_id", "label", "uu", "latent", "ii", "score")


@query("stage2_files", f"{SAMPLED}, {PART}, {PC} SELECT part, CAST(label AS BIGINT) AS label, CAST(duration AS DOUBLE) AS duration, CAST(song_pop AS DOUBLE) AS song_pop, CAST(artist_pop AS DOUBLE) AS artist_pop, CAST(album_pop AS DOUBLE) AS album_pop FROM sv JOIN sp USING (song_id)", hold=True)
def stage2_files(v: Views) -> DataFrame:
    """Samples written as "label idx:val ..." to a folder for training and one for validation, and read again."""
    columns = ["duration", "song_pop", "artist_pop", "album_pop"]
    rows = parted(stage2.samples(labelled(v))).join(stage2.with_popularity(v.songs, saved(counted(v), "counts")), "song_id")
    path = folder(v.spark, "samples")
    rows.select("part", src.format_labelled(rows, columns).alias("value")).write.partitionBy("part").text(path)
    return src.parse_labelled(v.spark.read.schema("value string, part string").text(path), columns).select("part", "label", *columns)


SCORES = ["uu", "latent", "ii", "score"]


def with_features(v: Views, rows: DataFrame, u: DataFrame, w: DataFrame) -> tuple[DataFrame, list[str], int]:
    """rows (playlist_id, song_id and SCORES) with all features of the second stage, their names, and the length of the last, which is a vector."""
    rows = saved(rows, "rows")
    pairs = rows.select("playlist_id", "song_id")
    named = lambda df, mark: df.withColumnsRenamed({c: f"{mark}_{c}" for c in df.columns if c not in ("playlist_id", "song_id")})
    vectors, size = stage2.album_bags(v.playlists, *bags(v))
    parts = [
        (named(song_features(v, u, w), "song"), ["song_id"]),
        (named(playlist_features(v, u, w), "list"), ["playlist_id"]),
        (named(stage2.pair_song(pairs, members(v), v.songs, u, w), "ps"), ["playlist_id", "song_id"]),
        (named(stage2.pair_playlist(pairs, stage2.sampled(members(v), 20), v.playlists, u), "pp"), ["playlist_id", "song_id"]),
        (named(stage2.pair_audio(pairs, members(v), audio_table(v).drop("uri")), "pa"), ["playlist_id", "song_id"]),
    ]
    columns = list(SCORES)
    for part, on in parts:
        own = [c for c in part.columns if c not in on]
        rows, columns = rows.join(part, on, "left").na.fill(0, own), [*columns, *own]
    return saved(rows.join(vectors, "playlist_id"), "vectors"), [*columns, "album_bag"], size


def _model(v: Views, candidates: DataFrame, u: DataFrame, w: DataFrame, rounds: int = 10, depth: int = 5):
    """Trees of the second stage over sampled candidates, the names of their features, and the sampled validation rows."""
    rows, columns, size = with_features(v, parted(stage2.samples(stage2.labelled(candidates, hidden(v)))), u, w)
    model = stage2.train_trees(rows.filter("part = 'train'"), columns, rounds, depth, vectors={"album_bag": size})
    return model, columns, rows.filter("part = 'valid'")


@query("gbdt_fit", hold=True)
def gbdt_fit(v: Views) -> DataFrame:
    u, w = v.playlist_factors(), v.song_factors()
    model, columns, _ = _model(v, saved(blended(v), "blended"), u, w)
    return model.importance(v.spark)


def _reranked(v: Views, u: DataFrame, w: DataFrame, candidates: int, n: int) -> tuple[DataFrame, DataFrame, float]:
    """(playlist_id, song_id, rank) of the first stage and of the second, whose model is saved and loaded again, and its AUC on validation rows."""
    found = saved(blended(v, u, w, candidates, n), "blended")
    model, _, valid = _model(v, found, u, w)
    path = folder(v.spark, "model")
    model.save(v.spark, path)
    model = boosting.PairwiseTrees.load(v.spark, path)
    rows = with_features(v, found, u, w)[0]
    return found, saved(stage2.reranked(model, rows, n), "reranked"), stage2.auc(model, valid)


@query("rerank", hold=True)
def rerank(v: Views) -> DataFrame:
    return _reranked(v, v.playlist_factors(), v.song_factors(), CANDIDATES, STORED)[1]


@query("stage_metrics", hold=True)
def stage_metrics(v: Views) -> DataFrame:
    """(stage, metric, threshold, value, n_eval): the measures of the blend and of the trees on validation playlists, and the trees' AUC."""
    first, second, area = _reranked(v, v.playlist_factors(), v.song_factors(), CANDIDATES, STORED)
    wanted = saved(hidden(v).filter(VALID), "wanted")
    both = [metrics(df.filter(VALID), wanted, v.songs, [10, 50, 100], STORED).select(F.lit(name).alias("stage"), "metric", "threshold", "value", "n_eval") for name, df in (("blend", first), ("trees", second))]
    n = second.filter(VALID).agg(F.countDistinct("playlist_id").alias("n_eval"))
    return both[0].unionByName(both[1]).unionByName(n.select(F.lit("trees").alias("stage"), F.lit("auc").alias("metric"), F.lit(None).cast("long").alias("threshold"), F.lit(area).alias("value"), "n_eval"))


@query("challenge_submission", hold=True)
def challenge_submission(v: Views) -> DataFrame:
    """The whole course: fitted factors, candidates, blend, trained re-ranking, cold start by names, and one line for each challenge playlist of up to 500 songs."""
    u, w = fitted(v)
    ranked = _reranked(v, u, w, 1000, 500)[1].select("playlist_id", "song_id", "rank").unionByName(cold_lists(v, u, w, 500))
    return submission_lines(ranked.select(F.col("playlist_id").alias("pid"), "rank", F.concat(F.lit("x:track:"), "song_id").alias("uri")))
