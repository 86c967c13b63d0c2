"""Queries of splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import hashed_order
from weftline.operators import rank, split
from weftline.plans.registry import query
from weftline.plans.views import Views
from weftline.sources.scratch import saved

CUT = 1706000000
BY_DATE = f"sd AS (SELECT row_id, col_id, date, CASE WHEN date > {CUT} THEN 'valid' ELSE 'train' END AS part FROM e QUALIFY min(date) OVER (PARTITION BY row_id) <= {CUT})"


@query("split_by_date", f"{BY_DATE} SELECT * FROM sd")
def split_by_date(v: Views) -> DataFrame:
    return split.by_date(v.events.select("row_id", "col_id", "date"), CUT)


ROWS = "vr AS (SELECT row_id FROM (SELECT DISTINCT row_id FROM sd WHERE part = 'valid') ORDER BY md5(concat_ws('#', 'rows', row_id)), row_id LIMIT 50)"
COLS = "vc AS (SELECT col_id FROM (SELECT DISTINCT col_id FROM sd WHERE part = 'valid') ORDER BY md5(concat_ws('#', 'cols', col_id)), col_id LIMIT 40)"


def _parts(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = split_by_date(v)
    valid = s.filter("part = 'valid'")
    return s, split.sample_ids(valid, "row_id", 50, "rows"), split.sample_ids(valid, "col_id", 40, "cols")


@query("valid_rows", f"{BY_DATE}, {ROWS} SELECT row_id FROM vr")
def valid_rows(v: Views) -> DataFrame:
    """A sample of fifty validation rows."""
    return _parts(v)[1]


@query("valid_cols", f"{BY_DATE}, {COLS} SELECT col_id FROM vc")
def valid_cols(v: Views) -> DataFrame:
    """A sample of forty validation columns."""
    return _parts(v)[2]


@query(
    "valid_cols_filled",
    f"""{BY_DATE}, {ROWS}, few AS (SELECT DISTINCT col_id FROM sd WHERE part = 'valid' AND row_id IN (SELECT row_id FROM vr) AND col_id % 3 = 0),
other AS (SELECT DISTINCT col_id FROM e WHERE col_id NOT IN (SELECT col_id FROM few))
SELECT col_id FROM (SELECT col_id, 0 AS src FROM few UNION ALL SELECT col_id, 1 FROM other) ORDER BY src, md5(concat_ws('#', 'fill', col_id)), col_id LIMIT 60""",
)
def valid_cols_filled(v: Views) -> DataFrame:
    """Sixty columns: validation columns of one type of column, and random others where these are fewer."""
    s, rows, _ = _parts(v)
    few = s.filter("part = 'valid' and col_id % 3 = 0").join(rows, "row_id", "left_semi")
    return split.filled_ids(few, v.events, "col_id", 60, "fill")


@query(
    "split_cold",
    f"""{BY_DATE}, {ROWS}, {COLS}, va AS (SELECT * FROM sd WHERE part = 'valid' AND row_id IN (SELECT row_id FROM vr) AND col_id IN (SELECT col_id FROM vc))
SELECT * FROM va UNION ALL SELECT * FROM sd WHERE part = 'train' AND row_id NOT IN (SELECT row_id FROM va)""",
)
def split_cold(v: Views) -> DataFrame:
    s, rows, cols = _parts(v)
    return split.restrict(s, rows, cols, cold=True)


FRACTION = "k AS (SELECT row_id, col_id, row_number() OVER (PARTITION BY row_id ORDER BY {}) AS k, count(*) OVER (PARTITION BY row_id) AS n FROM r) SELECT row_id, col_id, CASE WHEN n >= 3 AND k <= ceil(0.2 * n) THEN 'valid' ELSE 'train' END AS part FROM k"


@query("split_frac", FRACTION.format("md5(concat_ws('#', 'frac', row_id, col_id)), col_id"))
def split_frac(v: Views) -> DataFrame:
    return split.by_fraction(v.interactions.select("row_id", "col_id"), 0.2, [hashed_order("frac", "row_id", "col_id"), F.col("col_id")], 3)


@query("split_frac_date", FRACTION.format("date DESC, col_id"))
def split_frac_date(v: Views) -> DataFrame:
    return split.by_fraction(v.interactions.select("row_id", "col_id", "date"), 0.2, [F.desc("date"), F.col("col_id")], 3).drop("date")


@query("split_position", "SELECT row_id, col_id, CASE WHEN row_number() OVER (PARTITION BY row_id ORDER BY date DESC, col_id) <= 5 THEN 'train' ELSE 'valid' END AS part FROM r")
def split_position(v: Views) -> DataFrame:
    return split.by_position(v.interactions, F.lit(5)).select("row_id", "col_id", "part")


SIZES = "ts AS (SELECT playlist_id AS test_id, CAST(sum(value) AS BIGINT) AS size FROM pl JOIN train ON row_id = playlist_id WHERE is_test GROUP BY 1), ps AS (SELECT playlist_id, count(*) AS size FROM pl JOIN train ON row_id = playlist_id WHERE NOT is_test GROUP BY 1)"


def _sizes(v: Views) -> tuple[DataFrame, DataFrame]:
    """Tests count every occurrence, the pool distinct songs."""
    rows = v.train.join(v.playlists.select(F.col("playlist_id").alias("row_id"), "is_test"), "row_id")
    tests = rows.filter("is_test").groupBy(F.col("row_id").alias("test_id")).agg(F.sum("value").cast("long").alias("size"))
    return tests, rows.filter("not is_test").groupBy(F.col("row_id").alias("playlist_id")).agg(F.count("*").alias("size"))


@query("size_match", f"{SIZES} SELECT size, count(*) AS wanted, (SELECT count(*) FROM ps WHERE ps.size = ts.size) AS equal, (SELECT count(*) FROM ps WHERE ps.size > ts.size) AS larger FROM ts GROUP BY size", hold=True)
def size_match(v: Views) -> DataFrame:
    return split.sizes_met(*_sizes(v))


MATCH = f"""{SIZES}, slot AS (SELECT test_id, size, rep AS repeat, md5(concat_ws('#', 'slot', test_id, rep)) AS h FROM ts, range(3) t(rep)),
s1 AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY h) AS k FROM slot), p0 AS (SELECT *, md5(concat_ws('#', 'pool', playlist_id)) AS h FROM ps), p1 AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY h) AS k FROM p0),
ex AS (SELECT test_id, repeat, playlist_id FROM s1 JOIN p1 USING (size, k)),
s2 AS (SELECT * FROM s1 WHERE (test_id, repeat) NOT IN (SELECT (test_id, repeat) FROM ex)),
p2 AS (SELECT *, row_number() OVER (ORDER BY size DESC, h) AS rk FROM p1 WHERE playlist_id NOT IN (SELECT playlist_id FROM ex)),
q AS (SELECT size, sum(count(*)) OVER (ORDER BY size DESC) AS s, (SELECT count(*) FROM p2 WHERE p2.size > s2.size) AS o FROM s2 GROUP BY size),
c AS (SELECT size, s + least(0, min(o - s) OVER (ORDER BY size DESC)) AS c FROM q),
b AS (SELECT size, c, coalesce(lag(c) OVER (ORDER BY size DESC), 0) AS before FROM c),
s3 AS (SELECT test_id, repeat, before + row_number() OVER (PARTITION BY size ORDER BY h) AS rk FROM s2 JOIN b USING (size) QUALIFY rk <= c),
mt AS (SELECT test_id, repeat, playlist_id, true AS exact FROM ex UNION ALL SELECT test_id, repeat, playlist_id, false FROM s3 JOIN p2 USING (rk))"""


@query("split_matching", f"{MATCH} SELECT * FROM mt", hold=True)
def split_matching(v: Views) -> DataFrame:
    tests, pool = _sizes(v)
    return split.matching(saved(tests, "tests"), saved(pool, "pool"))


@query("split_summary", f"{MATCH} SELECT exact, repeat, count(*) AS n, count(DISTINCT test_id) AS tests FROM mt GROUP BY ALL", hold=True)
def split_summary(v: Views) -> DataFrame:
    return split_matching(v).groupBy("exact", "repeat").agg(F.count("*").alias("n"), F.countDistinct("test_id").alias("tests"))


@query("random_order_pred", "SELECT playlist_id, playlist_id BETWEEN 50 AND 79 OR playlist_id BETWEEN 110 AND 149 AS random_order FROM pl")
def random_order_pred(v: Views) -> DataFrame:
    return v.playlists.select("playlist_id", split.in_ranges(F.col("playlist_id"), (50, 79), (110, 149)).alias("random_order"))


@query(
    "remove_names",
    """b AS (SELECT playlist_id, seeds, row_number() OVER (PARTITION BY seeds ORDER BY md5(concat_ws('#', 'names', playlist_id)), playlist_id) AS k, count(*) OVER (PARTITION BY seeds) AS n FROM pl WHERE is_test AND seeds IN (5, 10))
SELECT playlist_id, CASE WHEN playlist_id IN (SELECT playlist_id FROM b WHERE k <= n // 2) THEN NULL ELSE name END AS name FROM pl""",
)
def remove_names(v: Views) -> DataFrame:
    """Half of the challenge playlists with 5 and with 10 seeds lose their name."""
    bucket = v.playlists.filter("is_test and seeds in (5, 10)").select("playlist_id", "seeds")
    lost = bucket.join(split.drop_half(bucket, "seeds", "names").select("playlist_id"), "playlist_id", "left_anti").select("playlist_id", F.lit(True).alias("lost"))
    return v.playlists.join(lost, "playlist_id", "left").select("playlist_id", F.when(F.col("lost").isNull(), F.col("name")).alias("name"))


@query("sample_playlists", "SELECT col_id AS song_id, row_id AS playlist_id FROM r QUALIFY row_number() OVER (PARTITION BY col_id ORDER BY md5(concat_ws('#', 'song', col_id, row_id)), row_id) <= 20")
def sample_playlists(v: Views) -> DataFrame:
    """At most twenty playlists of each song."""
    rows = v.interactions.select(F.col("col_id").alias("song_id"), F.col("row_id").alias("playlist_id"))
    return rank.hash_sample(rows, ["song_id"], 20, F.struct(hashed_order("song", "song_id", "playlist_id"), "playlist_id"))
