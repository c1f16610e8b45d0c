"""Sinks with the semantics of a keyed store, over plain Parquet folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


class Store:
    """A table in a folder. Each write makes a new version beside the old one; the newest that is complete is the current one.

    One writer at a time. A reader keeps the version that it opened; ``prune`` removes old versions.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._fs_path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self._fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        root = self._fs_path(self.path)
        names = [s.getPath().getName() for s in self.fs.listStatus(root)] if self.fs.exists(root) else []
        return sorted(n for n in names if n.startswith("v") and self.fs.exists(self._fs_path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.path}/{versions[-1]}") if versions else None

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> None:
        number = int(self._versions()[-1][1:9]) + 1 if self._versions() else 0
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.path}/v{number:08d}-{uuid.uuid4().hex[:8]}")

    def prune(self, keep: int = 1) -> None:
        for name in self._versions()[:-keep]:
            self.fs.delete(self._fs_path(f"{self.path}/{name}"), True)


def newest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last by order."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order]))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def upserted(old: DataFrame | None, new: DataFrame, key: list[str], update: list[str] | None = None, keep_old: bool = False) -> DataFrame:
    """old with new merged in by key.

    update: the columns that new rows replace in old ones (all when None); keep_old: new rows never replace.
    """
    if old is None:
        return new
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in key]
    if keep_old:
        return old.unionByName(new.join(old.select(key), key, "left_anti"))
    if update is None:
        return old.join(new.select(key), key, "left_anti").unionByName(new)
    there = F.col("n._new").isNotNull()
    joined = o.join(new.withColumn("_new", F.lit(True)).alias("n"), on, "full_outer")
    had = F.col(f"o.{key[0]}").isNotNull()
    columns = [F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) if c in key else F.when(there & (~had | F.lit(c in update)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns]
    return joined.select(columns)


def revisions(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """Known keys whose value changes: key, old_value, new_value."""
    joined = old.select(*key, F.col(value).alias("old_value")).join(new.select(*key, F.col(value).alias("new_value")), key)
    return joined.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def claimed(batch: DataFrame, taken: DataFrame | None, key: list[str]) -> DataFrame:
    """Rows of the batch whose key nobody has, one for each key."""
    first = batch.dropDuplicates(key)
    return first if taken is None else first.join(taken.select(key).distinct(), key, "left_anti")


def merged_graph(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Edges (a, b, n, total, label, at) with a batch added: counts and sums add up, the latest label wins; the mean is total / n."""
    rows = new if old is None else old.unionByName(new)
    return rows.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max_by("label", "at").alias("label"), F.max("at").alias("at"))
