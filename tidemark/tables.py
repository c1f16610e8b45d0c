"""Parquet tables of one data folder."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table, read lazily through Spark's own reader so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register tables as temporary views under their own names."""
    for name in names or TABLE_NAMES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables in between: under spark.checkpoint.dir, on a local session without that setting a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own in a scratch folder, read again: what follows may use it often, and a lost executor costs one reading of it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unneeded(spark: SparkSession) -> None:
    """Lets executors delete the shuffle files of what is written already: they keep them until the driver collects its garbage, of which plans are found only the second time."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: str = "8m") -> Iterator[None]:
    """While rows of hundreds of kilobytes go to Python: batches of so many bytes, not of 64 MB, which both sides hold."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)
