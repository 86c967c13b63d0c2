"""Playlists and audio features from JSON, and the text formats of matrices and submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators import coo
from weftline.sources.dense_binary import DenseBinary

TRACK = "struct<pos int, track_uri string, track_name string, artist_uri string, artist_name string, album_uri string, album_name string, duration_ms int>"
PLAYLIST = (
    "struct<pid string, name string, collaborative string, modified_at bigint, num_albums int, num_tracks int, num_followers int, num_edits int,"
    f" duration_ms int, num_artists int, tracks array<{TRACK}>>"
)
AUDIO = ("acousticness", "danceability", "energy", "instrumentalness", "liveness", "loudness", "mode", "speechiness", "tempo", "time_signature", "valence")


def read_playlists(spark: SparkSession, path: str, is_test: bool = False) -> DataFrame:
    """One row a playlist of a folder of JSON slices, with file and place to order by; absent fields are null."""
    schema = T.StructType([T.StructField("playlists", T._parse_datatype_string(f"array<{PLAYLIST}>"))])
    files = spark.read.schema(schema).option("multiLine", True).json(path)
    return files.select(F.col("_metadata.file_name").alias("file"), F.posexplode("playlists").alias("place", "p")).select("file", "place", "p.*", F.lit(is_test).alias("is_test"))


def tracks_of(playlists: DataFrame) -> DataFrame:
    """One row a track occurrence; playlists without tracks have none."""
    return playlists.select("file", "place", "pid", "is_test", F.posexplode("tracks").alias("track_place", "t")).select("file", "place", "pid", "is_test", "track_place", "t.*")


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """(uri, feature, value, category) from a JSON array; elements that are null or have no uri are skipped, and so are absent fields. key is a category."""
    fields = ", ".join(["uri: string", "key: int", *[f"{a}: double" for a in AUDIO]])
    rows = spark.read.text(path, wholetext=True).select(F.inline(F.filter(F.from_json("value", f"array<struct<{fields}>>"), lambda x: x["uri"].isNotNull())))
    return long_audio(rows)


def long_audio(rows: DataFrame) -> DataFrame:
    cells = [F.struct(F.lit(a).alias("feature"), F.col(a).cast("double").alias("value"), F.lit(None).cast("string").alias("category")) for a in AUDIO]
    key = F.struct(F.lit("key").alias("feature"), F.lit(None).cast("double").alias("value"), F.col("key").cast("string").alias("category"))
    return rows.select("uri", F.inline(F.array(*cells, key))).filter("value is not null or category is not null")


def parse_libsvm(lines: DataFrame) -> DataFrame:
    """(row_id, col_id, value) of lines "row idx:val ..." with ids from 0."""
    parts = F.split("value", " ")
    cells = lines.select(F.get(parts, F.lit(0)).cast("long").alias("row_id"), F.explode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("cell"))
    pair = F.split("cell", ":")
    return cells.filter("cell <> ''").select("row_id", F.get(pair, F.lit(0)).cast("long").alias("col_id"), F.get(pair, F.lit(1)).cast("double").alias("value"))


def number(x: Column) -> Column:
    """Whole numbers bare, others with five decimals."""
    return F.when(x == F.floor(x), F.floor(x).cast("long").cast("string")).otherwise(F.format_string("%.5f", x))


def format_libsvm(m: DataFrame) -> DataFrame:
    """(row_id, line): "idx:val ..." of each row in the order of its columns."""
    cell = F.concat(F.col("col_id").cast("string"), F.lit(":"), number(F.col("value")))
    cells = m.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("col_id", cell.alias("c")))).alias("cells"))
    return cells.select("row_id", F.array_join("cells.c", " ").alias("line"))


def format_labelled(rows: DataFrame, columns: list[str]) -> Column:
    """The line "label idx:val ..." of a row with the columns as features from 0; zeros are left out."""
    cells = [F.when(F.col(c) != 0, F.concat(F.lit(f"{k}:"), number(F.col(c)))) for k, c in enumerate(columns)]
    return F.concat_ws(" ", F.col("label").cast("string"), *cells)


def parse_labelled(lines: DataFrame, columns: list[str]) -> DataFrame:
    """label and the columns of lines "label idx:val ..."; what a line leaves out is 0. Other columns of lines stay."""
    cells = F.map_from_entries(F.transform(F.filter(F.slice(F.split("value", " "), 2, 1 << 30), lambda x: x != ""), lambda x: F.struct(F.substring_index(x, ":", 1).cast("int"), F.substring_index(x, ":", -1).cast("double"))))
    own = lines.select(*[c for c in lines.columns if c != "value"], F.substring_index("value", " ", 1).cast("long").alias("label"), cells.alias("_cells"))
    return own.withColumns({c: F.coalesce(F.try_element_at("_cells", F.lit(k)), F.lit(0.0)) for k, c in enumerate(columns)}).drop("_cells")


def read_triples(spark: SparkSession, path: str, row: int, col: int, value: int | None = None, date: int | None = None, sep: str = ",", header: bool = False) -> DataFrame:
    """(row_id, col_id, value, date) of delimited files, by the numbers of their columns from 0; duplicates are summed and keep the latest date."""
    lines = spark.read.option("sep", sep).option("header", header).csv(path)
    if not lines.columns:
        lines = spark.createDataFrame([], ", ".join(f"c{k} string" for k in range(1 + max(x or 0 for x in (row, col, value, date)))))
    named = lambda k: None if k is None else lines.columns[k]
    return coo.from_rows(lines, named(row), named(col), named(value), named(date))


def parse_dense_csv(lines: DataFrame) -> DataFrame:
    """Arrays of doubles from lines of comma-separated numbers."""
    return lines.filter("trim(value) <> ''").select(F.transform(F.split("value", ","), lambda x: x.cast("double")).alias("features"))


def read_dense_binary(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """(path, row, features) of files of big-endian 32-bit floats, ``columns`` a row; trailing bytes are an error."""
    spark.dataSource.register(DenseBinary)
    return spark.read.format("dense_binary").option("columns", columns).load(path)


def submission_lines(ranked: DataFrame) -> DataFrame:
    """(pid, line) of ranked rows (pid, rank, uri)."""
    songs = ranked.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("rank", "uri"))).alias("songs"))
    return songs.select("pid", F.concat_ws(", ", F.col("pid").cast("string"), F.array_join("songs.uri", ", ")).alias("line"))


def write_submission(ranked: DataFrame, path: str, header: str) -> None:
    """A folder of text files, the header in a file of its own that comes first."""
    ranked.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/part=0")
    submission_lines(ranked).orderBy("pid").select("line").write.mode("overwrite").text(f"{path}/part=1")
