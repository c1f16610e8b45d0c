"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Word separators: blank and the control characters 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a file of a compact table, at most about.
FILE_ROWS = 200_000
#: A key that holds more than this share of all rows is joined by broadcast; so there are at most that many such keys.
HOT_KEYS = 1_000
#: Copies of one row that a task makes at once.
PART = 1_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and continue from there.

    rows: about how many short rows there are at most; they are dealt into a few files for that many, as
    many tiny files would slow every later read. The folder is the one the cluster names in
    spark.checkpoint.dir. Only a local session without that setting gets a folder of its own. Like
    checkpoints, the tables stay until the folder is cleaned; ``drop_table`` takes one away before.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    path = f"{context.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    (df if rows is None else df.repartition(rows // FILE_ROWS + 1)).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Take away the files of a table that ``cut`` wrote, once another table holds all that is needed of it."""
    context = df.sparkSession.sparkContext
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if not folder.rsplit("/", 1)[1].startswith("table-"):
            raise ValueError(f"{folder} is no table of cut()")
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def join_one(rows: DataFrame, side: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows left joined with side, which has one row for each key and, as column n, how many of the rows have it.

    Keys that hold more than one in HOT_KEYS of all ``total`` rows meet by broadcast, so that none of them
    gathers in a task; at most HOT_KEYS of them can exist. The others meet by a shuffle.
    """
    limit = total // HOT_KEYS
    more = [c for c in side.columns if c not in (key, n)]
    hot = F.broadcast(side.where(F.col(n) > limit).select(F.col(key).alias("__hot"), *[F.col(c).alias(f"__hot_{c}") for c in more]))
    cold = side.where(F.col(n) <= limit).select(F.col(key).alias("__cold"), *[F.col(c).alias(f"__cold_{c}") for c in more])
    with_hot = rows.join(hot, F.col(key) == F.col("__hot"), "left")
    # Rows of hot keys have met theirs, and those without a key meet nothing: other hashes spread them.
    done = F.col("__hot").isNotNull() | F.col(key).isNull()
    dealt = with_hot.withColumn("__dealt", F.when(done, F.xxhash64(*rows.columns)).otherwise(F.xxhash64(key)))
    met = dealt.join(cold.withColumn("__cold_dealt", F.xxhash64("__cold")), (F.col("__dealt") == F.col("__cold_dealt")) & (F.col(key) == F.col("__cold")), "left")
    return met.select(*rows.columns, *[F.coalesce(F.col(f"__hot_{c}"), F.col(f"__cold_{c}")).alias(c) for c in more])


def narrow_batches(df: DataFrame, rows: int = 1000) -> None:
    """Hand rows to Python in batches of whole texts that stay small: tasks hold a batch, often twice.

    Sets the session's batch size if that is larger; only memory depends on it, no result.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= rows:
        df.sparkSession.conf.set(name, str(rows))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def doc_order(*more: str) -> Column:
    """Sort key of documents: by doc_id, rows without one last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), *[F.col(c) for c in more])


def row_print() -> Column:
    """With ``row_key``, what names a row by its doc_id and text; without doc_id it differs from that of any doc_id."""
    return F.xxhash64(F.col("text"), F.col("text").isNull(), F.col("doc_id").isNull())


def row_key(name: str = "doc_id") -> Column:
    """The doc_id as a join key without nulls."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def repeated(df: DataFrame, n: str) -> DataFrame:
    """Each row as often as its column n says, with its place among its copies, from 0, as __tidemark_nth.

    Rows with many copies are dealt out in parts first, so that no task makes all copies of one row.
    """
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / PART)))
    many = df.where(F.col(n) > PART).withColumn("__tidemark_part", part).hint("rebalance")
    first = F.col("__tidemark_part") * PART
    many = many.withColumn("__tidemark_nth", F.explode(F.sequence(first, F.least(first + PART, F.col(n).cast("long")) - 1))).drop("__tidemark_part")
    few = df.where((F.col(n) > 0) & (F.col(n) <= PART)).withColumn("__tidemark_nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)))
    return few.unionByName(many)


def copies_of(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of docs, each as often as decided(doc_id, print, copies) says; all columns of docs stay, names that begin with __tidemark don't occur among them.

    decided has a row for each row of docs. Rows alike in doc_id and text share their copies evenly; what
    is left over goes to the first in the order of all their columns as JSON.
    """
    asked = decided.groupBy(row_key().alias("__tidemark_k"), F.col("print").alias("__tidemark_p")).agg(F.sum("copies").alias("__tidemark_copies"), F.count("*").alias("__tidemark_rows"))
    asked = cut(asked.where("__tidemark_copies > 0"))
    keyed = docs.select("*", row_key().alias("__tidemark_key"), row_print().alias("__tidemark_print"))
    met = keyed.join(asked, (F.col("__tidemark_key") == F.col("__tidemark_k")) & (F.col("__tidemark_print") == F.col("__tidemark_p")))
    own = [F.col(f"`{c}`") for c in docs.columns]
    most = asked.agg(F.max("__tidemark_rows").alias("rows"), F.max("__tidemark_copies").alias("copies")).first()
    plain = met.where("__tidemark_rows = 1 AND __tidemark_copies = 1").select(*own)
    if most["rows"] is None or (most["rows"] == 1 and most["copies"] == 1):
        return plain
    # Rows alike in all columns become one with their number, in the tasks that read them; then each kind gets its share.
    key = ("__tidemark_key", "__tidemark_print")
    once = met.where("__tidemark_rows = 1 AND __tidemark_copies > 1").withColumn("__tidemark_n", F.lit(1).cast("long"))
    alike = met.where("__tidemark_rows > 1").groupBy(*key, "__tidemark_copies", "__tidemark_rows", *own).agg(F.count("*").alias("__tidemark_n"))
    in_order = Window.partitionBy(*key).orderBy(F.to_json(F.struct(*own))).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__tidemark_n").over(in_order), F.lit(0))
    extra = F.col("__tidemark_copies") % F.col("__tidemark_rows")
    whole = F.floor(F.col("__tidemark_copies") / F.col("__tidemark_rows"))
    shared = alike.withColumn("__tidemark_copies", F.col("__tidemark_n") * whole + F.greatest(F.lit(0), F.least(F.col("__tidemark_n"), extra - before)))
    many = shared.select(*own, "__tidemark_copies").unionByName(once.select(*own, "__tidemark_copies"))
    return plain.unionByName(repeated(many, "__tidemark_copies").select(*own))
