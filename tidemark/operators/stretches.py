"""Long series in stretches of time: each is a task of its own, with as many rows before it as a kernel reaches back.

Rows are counted by buckets of time; buckets are put together to stretches of about ROWS rows by their running counts, so any
two neighbours hold more than ROWS rows. A bucket also goes to a following stretch if that reaches back into it.
Only counts of buckets pass through a task that sees a whole series.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Rows of a stretch, about, and seconds of a bucket: a sixteenth of a stretch of bars of a quarter of an hour.
ROWS, BUCKET = 4096, 256 * 900


def stretched(df: DataFrame, reach: int, t: str = "t", by: str = "symbol") -> DataFrame:
    """df with _stretch and _own: each row in its own stretch, and again, not as its own, in following ones that reach back to it.

    A stretch gets the last ``reach`` rows before it, or all there are, and at most a bucket more. reach: up to ROWS.
    """
    if reach > ROWS:
        raise ValueError(f"a stretch reaches back {ROWS} rows at most")
    bucket = F.floor(F.col(t) / BUCKET)
    counts = df.groupBy(F.col(by).alias("_by"), bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_by").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = counts.withColumn("_start", before).withColumn("_stretch", F.floor(F.col("_start") / ROWS))
    # Where the next stretch and the one after it begin; two neighbours have more rows than any reach, so no third one is reached.
    in_order = Window.partitionBy("_by").orderBy("_stretch")
    starts = dealt.groupBy("_by", "_stretch").agg(F.min("_start").alias("_first")).withColumn("_at", F.struct("_first", "_stretch"))
    following = starts.select(F.col("_by").alias("_b"), F.col("_stretch").alias("_s"), F.array(F.lead("_at", 1).over(in_order), F.lead("_at", 2).over(in_order)).alias("_later"))
    marks = dealt.join(following, F.col("_by").eqNullSafe(F.col("_b")) & (F.col("_stretch") == F.col("_s")))
    reached = F.filter("_later", lambda s: F.coalesce(F.col("_start") + F.col("_n") > s["_first"] - reach, F.lit(False)))
    targets = F.concat(F.array(F.struct(F.col("_stretch").alias("s"), F.lit(True).alias("own"))), F.transform(reached, lambda s: F.struct(s["_stretch"].alias("s"), F.lit(False).alias("own"))))
    places = marks.select("_by", "_bucket", targets.alias("_to"))
    met = df.withColumn("_at", bucket).join(places, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_at") == F.col("_bucket")))
    return met.select(*df.columns, F.explode("_to").alias("_t")).select(*df.columns, F.col("_t.s").alias("_stretch"), F.col("_t.own").alias("_own"))


def over_stretches(df: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str, reach: int, t: str = "t", by: str = "symbol") -> DataFrame:
    """kernel over every stretch's rows in order of t, with ``reach`` rows before them; it gives a row for each row, of which the stretch's own stay."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t, ignore_index=True)
        return kernel(pdf.drop(columns=["_stretch", "_own"]))[pdf["_own"].to_numpy()][names]

    return stretched(df, reach, t, by).groupBy(by, "_stretch").applyInPandas(run, schema)
