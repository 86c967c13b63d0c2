from datetime import datetime

from pyspark.sql import functions as F

from weftline.streaming import occurrences


def test_files_add_up_and_late_ones_are_dropped(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1, h)
    batches = [[(1, 7, 0, at(0)), (1, 7, 3, at(0)), (2, 7, 0, at(1))], [(1, 8, 1, at(9))], [(3, 7, 0, at(0)), (3, 8, 0, at(12))]]
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, occurrences.SCHEMA).coalesce(1).write.mode("append").parquet(path)
        occurrences.write(occurrences.hourly_popularity(occurrences.read(spark, path)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r["hour"].hour, r["song_id"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, 7): 2, (1, 7): 1, (9, 8): 1}  # the late event of hour 0 is gone, hour 12 is open
    batch = occurrences.interactions(spark.read.parquet(path)).filter("row_id = 1 and col_id = 7").select(F.col("value"), F.col("date")).first()
    assert tuple(batch) == (2.0, 0)
