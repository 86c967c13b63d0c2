"""Queries of the sparse and dense algebra."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import blocks, coo, dense, transforms
from weftline.plans.registry import query, r6
from weftline.plans.views import Views
from weftline.sources.scratch import folder

CELLS = "SELECT row_id, col_id, round(value, 6) AS value"


def cells(m: DataFrame) -> DataFrame:
    return m.select("row_id", "col_id", r6("value", "value"))


def dated(m: DataFrame) -> DataFrame:
    return m.select("row_id", "col_id", r6("value", "value"), "date")


@query("interactions", "SELECT row_id AS playlist_id, col_id AS song_id, value, date AS pos FROM r")
def interactions(v: Views) -> DataFrame:
    return v.interactions.select(F.col("row_id").alias("playlist_id"), F.col("col_id").alias("song_id"), "value", F.col("date").alias("pos"))


@query("coo_from_rows", f"{CELLS}, date FROM e")
def coo_from_rows(v: Views) -> DataFrame:
    return dated(v.events)


@query("row_sum", "SELECT row_id, round(sum(value), 6) AS total FROM e GROUP BY 1")
def row_sum(v: Views) -> DataFrame:
    return coo.sums(v.events, "row_id").select("row_id", r6("total", "total"))


@query("col_sum", "SELECT col_id, round(sum(value), 6) AS total FROM e GROUP BY 1")
def col_sum(v: Views) -> DataFrame:
    return coo.sums(v.events, "col_id").select("col_id", r6("total", "total"))


@query("nnz", "SELECT 'row' AS side, row_id AS id, count(*) AS nnz FROM r GROUP BY ALL UNION ALL SELECT 'col', col_id, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'all', -1, count(*) FROM r")
def nnz(v: Views) -> DataFrame:
    r = v.interactions
    side = lambda by, name: coo.counts(r, by).select(F.lit(name).alias("side"), F.col(by).alias("id"), "nnz")
    return side("row_id", "row").union(side("col_id", "col")).union(r.agg(F.count("*").alias("nnz")).select(F.lit("all"), F.lit(-1).cast("long"), "nnz"))


@query("row_norm", "SELECT row_id, round(sqrt(sum(value * value)), 6) AS l2, round(sum(abs(value)), 6) AS l1 FROM e GROUP BY 1")
def row_norm(v: Views) -> DataFrame:
    l1 = coo.norms(v.events, "row_id", 1).withColumnRenamed("norm", "l1")
    return coo.norms(v.events, "row_id", 2).join(l1, "row_id").select("row_id", r6("norm", "l2"), r6("l1", "l1"))


@query("col_norm", "SELECT col_id, round(sqrt(sum(value * value)), 6) AS l2 FROM e GROUP BY 1")
def col_norm(v: Views) -> DataFrame:
    return coo.norms(v.events, "col_id", 2).select("col_id", r6("norm", "l2"))


@query("row_normalize", "n AS (SELECT row_id, sqrt(sum(value * value)) AS norm FROM r GROUP BY 1) SELECT row_id, col_id, round(CASE WHEN norm > 1e-5 THEN value / norm ELSE value END, 6) AS value FROM r JOIN n USING (row_id)")
def row_normalize(v: Views) -> DataFrame:
    return cells(coo.normalize(v.interactions, "row_id"))


@query("col_normalize", "n AS (SELECT col_id, sqrt(sum(value * value)) AS norm FROM r GROUP BY 1) SELECT row_id, col_id, round(CASE WHEN norm > 1e-10 THEN value / norm ELSE value END, 6) AS value FROM r JOIN n USING (col_id)")
def col_normalize(v: Views) -> DataFrame:
    return cells(coo.normalize(v.interactions, "col_id", least=1e-10))


@query("transpose", "SELECT col_id AS row_id, row_id AS col_id, value, date FROM r")
def transpose(v: Views) -> DataFrame:
    return coo.transpose(v.interactions)


@query("infer_ncols", "SELECT max(row_id) + 1 AS n_rows, max(col_id) + 1 AS n_cols, count(*) AS nnz FROM r")
def infer_ncols(v: Views) -> DataFrame:
    return coo.shape(v.interactions)


@query("binarize", "SELECT row_id, col_id, CAST(1 AS DOUBLE) AS value FROM r")
def binarize(v: Views) -> DataFrame:
    return coo.binarize(v.interactions).select("row_id", "col_id", "value")


@query("date_thresh", "SELECT 'later' AS part, row_id, col_id FROM e WHERE date > 1706000000 UNION ALL SELECT 'until', row_id, col_id FROM e WHERE date <= 1706000000")
def date_thresh(v: Views) -> DataFrame:
    part = lambda later, name: coo.by_date(v.events, 1706000000, later).select(F.lit(name).alias("part"), "row_id", "col_id")
    return part(True, "later").union(part(False, "until"))


@query(
    "col_selector",
    "k AS (SELECT col_id, row_number() OVER (ORDER BY col_id) - 1 AS idx FROM r GROUP BY col_id HAVING count(*) > 20) SELECT row_id, idx AS col_id, value, date FROM r JOIN k USING (col_id)",
)
def col_selector(v: Views) -> DataFrame:
    return coo.select_columns(v.interactions, 20)


@query("row_slice", "SELECT * FROM r WHERE row_id IN (SELECT playlist_id FROM pl WHERE is_test)")
def row_slice(v: Views) -> DataFrame:
    return coo.rows_in(v.interactions, v.playlists.filter("is_test").select(F.col("playlist_id").alias("row_id")))


ROW_AVG = """g AS (SELECT name AS group_name, playlist_id AS row_id FROM pl), p AS (SELECT * FROM g JOIN r USING (row_id)),
n AS (SELECT group_name, count(DISTINCT row_id) AS n FROM p GROUP BY 1), t AS (SELECT group_name, col_id, sum(value) AS s FROM p GROUP BY ALL)
SELECT group_name, col_id, round(s / n, 6) AS value FROM t JOIN n USING (group_name)"""


@query("row_avg", ROW_AVG)
def row_avg(v: Views) -> DataFrame:
    groups = v.playlists.select(F.col("name").alias("group_id"), F.col("playlist_id").alias("row_id"))
    return coo.row_average(v.interactions, groups).select(F.col("group_id").alias("group_name"), "col_id", r6("value", "value"))


@query("spmm", "t AS (SELECT a.col_id AS row_id, b.col_id, sum(a.value * b.value) AS value FROM e a JOIN e b ON a.row_id = b.row_id GROUP BY ALL) SELECT row_id, col_id, round(value, 4) AS value FROM t WHERE value <> 0")
def spmm(v: Views) -> DataFrame:
    """Columns by columns: the transposed event matrix times itself."""
    return coo.multiply(coo.transpose(v.events), v.events).select("row_id", "col_id", F.round("value", 4).alias("value"))


@query("vec_mat", "SELECT r.col_id, round(sum(r.value * n_tracks), 6) AS value FROM r JOIN pl ON row_id = playlist_id GROUP BY 1")
def vec_mat(v: Views) -> DataFrame:
    vector = v.playlists.select(F.col("playlist_id").alias("id"), F.col("n_tracks").alias("value"))
    return coo.vector_times(vector, v.interactions).select("col_id", r6("value", "value"))


@query("mat_vec", "SELECT row_id, round(sum(value * duration), 6) AS value FROM r JOIN songs ON col_id = song_id GROUP BY 1")
def mat_vec(v: Views) -> DataFrame:
    vector = v.songs.select(F.col("song_id").alias("id"), F.col("duration").alias("value"))
    return coo.times_vector(v.interactions, vector).select("row_id", r6("value", "value"))


@query("concat_h", "SELECT row_id, col_id, value FROM r UNION ALL SELECT row_id, col_id + (SELECT max(col_id) + 1 FROM r), round(value, 6) FROM e")
def concat_h(v: Views) -> DataFrame:
    return cells(coo.beside(v.interactions, v.events, coo.shape(v.interactions).first()["n_cols"]))


@query("concat_v", "SELECT row_id, col_id, value FROM r UNION ALL SELECT row_id + (SELECT max(row_id) + 1 FROM r), col_id, round(value, 6) FROM e")
def concat_v(v: Views) -> DataFrame:
    return cells(coo.below(v.interactions, v.events, coo.shape(v.interactions).first()["n_rows"]))


@query("coo_merge", "SELECT row_id, col_id, round(sum(value), 6) AS value, max(date) AS date FROM (FROM r UNION ALL FROM e) GROUP BY ALL")
def coo_merge(v: Views) -> DataFrame:
    return dated(coo.merge(v.interactions, v.events))


@query("coo_subtract", "t AS (SELECT row_id, col_id, sum(value) AS value FROM (SELECT row_id, col_id, value FROM r UNION ALL SELECT row_id, col_id, -value FROM train) GROUP BY ALL) SELECT * FROM t WHERE value <> 0")
def coo_subtract(v: Views) -> DataFrame:
    return coo.subtract(v.interactions, v.train)


#: Each playlist with the next one.
PAIRS = "p AS (SELECT playlist_id AS a, playlist_id + 1 AS b FROM pl), m AS (SELECT a, b, sum(x.value * y.value) AS dot, count(*) AS shared FROM p JOIN r x ON x.row_id = a JOIN r y ON y.row_id = b AND y.col_id = x.col_id GROUP BY ALL)"


def _pairs(v: Views) -> DataFrame:
    pairs = v.playlists.select(F.col("playlist_id").alias("left"), (F.col("playlist_id") + 1).alias("right"))
    return coo.pair_dots(pairs, v.interactions, v.interactions)


@query("sparse_dot", f'{PAIRS} SELECT p.a AS "left", p.b AS "right", round(coalesce(dot, 0), 6) AS dot FROM p LEFT JOIN m USING (a, b)')
def sparse_dot(v: Views) -> DataFrame:
    return _pairs(v).select("left", "right", r6("dot", "dot"))


@query("sparse_intersect", f'{PAIRS} SELECT p.a AS "left", p.b AS "right", coalesce(shared, 0) AS shared FROM p LEFT JOIN m USING (a, b)')
def sparse_intersect(v: Views) -> DataFrame:
    return _pairs(v).select("left", "right", "shared")


@query("vec_stats", "SELECT row_id, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean FROM e GROUP BY 1")
def vec_stats(v: Views) -> DataFrame:
    return coo.row_stats(v.events).select("row_id", r6("least", "least"), r6("most", "most"), r6("mean", "mean"))


@query("tfidf", "d AS (SELECT col_id, count(*) AS df FROM r GROUP BY 1) SELECT row_id, col_id, round(ln(1 + value) * ln((SELECT count(*) FROM pl) / df), 6) AS value FROM r JOIN d USING (col_id)")
def tfidf(v: Views) -> DataFrame:
    return cells(coo.tfidf(v.interactions, v.playlists.count()))


SPARSE_Z = """s AS (SELECT col_id, avg(value) AS m, stddev_pop(value) AS s FROM e GROUP BY 1)
SELECT row_id, col_id, round(greatest(-2.0, least(2.0, CASE WHEN s > 1e-5 THEN (value - m) / s ELSE value - m END)), 5) AS value FROM e JOIN s USING (col_id) WHERE abs(value - m) > 1e-5"""


@query("sparse_standardize", SPARSE_Z)
def sparse_standardize(v: Views) -> DataFrame:
    return coo.standardize_columns(v.events, 2.0).select("row_id", "col_id", F.round("value", 5).alias("value"))


FITTED = """t AS (SELECT * FROM e WHERE row_id % 2 = 0), k AS (SELECT col_id, row_number() OVER (ORDER BY col_id) - 1 AS idx FROM t GROUP BY col_id HAVING count(*) > 5),
tk AS (SELECT row_id, idx AS col_id, value FROM t JOIN k USING (col_id)), n AS (SELECT col_id, sqrt(sum(value * value)) AS norm FROM tk GROUP BY 1),
tn AS (SELECT row_id, col_id, CASE WHEN norm > 1e-10 THEN value / norm ELSE value END AS value FROM tk JOIN n USING (col_id)),
s AS (SELECT col_id, avg(value) AS m, stddev_pop(value) AS s FROM tn GROUP BY 1),
o AS (SELECT row_id, col_id, (CASE WHEN norm > 1e-10 THEN value / norm ELSE value END) - m AS c, s FROM (SELECT row_id, idx AS col_id, value FROM e JOIN k USING (col_id) WHERE row_id % 2 = 1) JOIN n USING (col_id) JOIN s USING (col_id))
SELECT row_id, col_id, round(greatest(-2.0, least(2.0, CASE WHEN s > 1e-5 THEN c / s ELSE c END)), 5) AS value FROM o WHERE abs(c) > 1e-5"""


@query("fitted_transforms", FITTED)
def fitted_transforms(v: Views) -> DataFrame:
    """Column selection, column norms and z-scores learned on even rows, saved, loaded and applied to odd ones."""
    chain = Pipeline(stages=[transforms.ColumnSelector(cutoff=5), transforms.ColumnNorm(), transforms.Standardizer(cutoff=2.0)])
    path = folder(v.spark, "pipeline")
    chain.fit(v.events.filter("row_id % 2 = 0")).write().save(path)
    return PipelineModel.load(path).transform(v.events.filter("row_id % 2 = 1")).select("row_id", "col_id", F.round("value", 5).alias("value"))


DENSE_Z = """x AS (SELECT id, unnest(features) AS value, generate_subscripts(features, 1) - 1 AS pos FROM f), s AS (SELECT pos, avg(value) AS m, stddev_pop(value) AS s FROM x GROUP BY 1)
SELECT id, CAST(pos AS BIGINT) AS pos, round(greatest(-5.0, least(5.0, CASE WHEN s > 0 THEN (value - m) / s ELSE value - m END)), 5) AS value FROM x JOIN s USING (pos)"""


@query("dense_standardize", DENSE_Z)
def dense_standardize(v: Views) -> DataFrame:
    return dense.standardize(v.factors).select("id", F.col("pos").cast("long").alias("pos"), F.round("value", 5).alias("value"))


@query("dense_dot", "SELECT playlist_id, song_id, round(list_inner_product(u, v), 6) AS score FROM train JOIN uf ON row_id = playlist_id JOIN vf ON col_id = song_id", hold=True)
def dense_dot(v: Views) -> DataFrame:
    t = v.train.select(F.col("row_id").alias("playlist_id"), F.col("col_id").alias("song_id"))
    return blocks.dots(t, v.playlist_factors(), v.song_factors(), {"score": ("u", "v")}).select("playlist_id", "song_id", r6("score", "score"))


@query("gram", "x AS (SELECT id, unnest(features) AS value, generate_subscripts(features, 1) - 1 AS i FROM f) SELECT CAST(a.i AS BIGINT) AS i, CAST(b.i AS BIGINT) AS j, round(sum(a.value * b.value), 6) AS value FROM x a JOIN x b USING (id) GROUP BY ALL")
def gram(v: Views) -> DataFrame:
    return dense.gram(v.factors, 64).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r6("value", "value"))
