"""Written tables that cut lineage, in the folder the cluster names in ``spark.checkpoint.dir``.

Such a table survives the loss of executors, and it is read as often as needed without being computed again. Only
a local session may do without the setting: it then takes a temporary folder of this machine and
sets it. On a cluster that folder would be another one on every machine, so a missing setting is an error there.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def folder(spark: SparkSession, kind: str) -> str:
    """A new path below ``spark.checkpoint.dir``."""
    return f"{root(spark)}/{kind}-{uuid.uuid4().hex}"


def saved(df: DataFrame, kind: str) -> DataFrame:
    """df written and read back; the shuffles of this step give back their disk at once."""
    path = folder(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()  # the driver then lets executors delete the shuffle files
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Free the disk of tables of ``saved`` that nothing reads any more."""
    for df in tables:
        for at in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """A folder of tables; ``drop`` and ``clear`` give its space back."""

    def __init__(self, spark: SparkSession, kind: str):
        self.spark, self.path = spark, folder(spark, kind)
        self.sorted: dict[str, str] = {}

    def save(self, df: DataFrame, name: str, free: bool = True) -> DataFrame:
        """Write once, read back; zstd, as these tables are large and short-lived. free: give back the disk of the step's shuffles at once."""
        path = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        if free:
            self.spark.sparkContext._jvm.System.gc()  # the driver then lets executors delete the shuffle files of the step
        return self.spark.read.schema(df.schema).parquet(path)

    def save_sorted(self, df: DataFrame, by: tuple[str, ...], name: str) -> DataFrame:
        """Write bucketed and sorted by columns, which df has been grouped by; tables of equal buckets are merge-joined without a shuffle."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        own = self.sorted[name] = f"sorted_{uuid.uuid4().hex}"
        out = df.write.format("parquet").option("compression", "zstd").option("path", f"{self.path}/{name}")
        out.bucketBy(buckets, *by).sortBy(*by).saveAsTable(own)
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.table(own)

    def drop(self, *names: str) -> None:
        """Free the disk of tables that no later step reads."""
        for name in names:
            if name in self.sorted:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.sorted.pop(name)}")
            self._delete(f"{self.path}/{name}")

    def clear(self) -> None:
        """Free all of it, when no DataFrame that reads these tables is needed any more."""
        self.drop(*self.sorted)
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
