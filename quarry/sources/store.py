"""Keyed tables kept as Parquet folders: the last write of a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with new's rows in place of those with their key. Rows of new that share
    a key are reduced to one, the greatest by its other columns."""
    rest = [c for c in new.columns if c not in key]
    both = old.withColumn("__age", F.lit(1)).unionByName(new.withColumn("__age", F.lit(0)))
    order = Window.partitionBy(*key).orderBy("__age", *(F.desc(c) for c in rest))
    return both.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__age", "__n")


class Store:
    """Tables under a folder. A write goes to a new version of the table's folder and
    is then named current, so a reader never sees half of one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file_system(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _versions(self, name: str) -> list[int]:
        fs, path = self._file_system(), self.spark._jvm.org.apache.hadoop.fs.Path
        at = path(f"{self.path}/{name}")
        if not fs.exists(at):
            return []
        done = [s.getPath().getName() for s in fs.listStatus(at) if fs.exists(path(s.getPath(), "_SUCCESS"))]
        return sorted(int(v[1:]) for v in done if v.startswith("v"))

    def read(self, name: str) -> DataFrame | None:
        found = self._versions(name)
        return self.spark.read.parquet(f"{self.path}/{name}/v{found[-1]}") if found else None

    def write(self, name: str, new: DataFrame, key: list[str]) -> DataFrame:
        found = self._versions(name)
        old = self.read(name)
        rows = upserted(old if old is not None else new.limit(0), new, key)
        rows.write.parquet(f"{self.path}/{name}/v{(found[-1] if found else 0) + 1}")
        return self.read(name)
