"""Places in an order and exact percentiles of a whole table, without one task that holds all its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.tables import written

#: Percentiles are first bracketed to this share of the rows, by sketches.
ACCURACY = 10_000
#: Groups whose brackets go to every task, at most.
FEW_GROUPS = 50_000


def placed(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values of df (by groups): by, value, ties (rows with it), before (rows of the group with a smaller value).

    Equal values are counted where they are read. The distinct ones are sorted by ranges, and written once with the number of their
    range; a task adds up one range of one group, and the ranges' totals (a few for each group) give where it starts. Nulls have no place.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    counts = written(counts.orderBy(*by, value).withColumn("_range", F.spark_partition_id()), "values")
    in_group = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.groupBy(*by, "_range").agg(F.sum("ties").alias("_rows")).withColumn("_start", F.coalesce(F.sum("_rows").over(in_group), F.lit(0))).drop("_rows")
    in_range = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("_inside", F.coalesce(F.sum("ties").over(in_range), F.lit(0)))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_range"]]
    return inside.alias("a").join(starts.alias("b"), on).select(*[F.col(f"a.{c}").alias(c) for c in by], F.col(f"a.{value}").alias(value), "ties", (F.col("_start") + F.col("_inside")).alias("before"))


def with_place(df: DataFrame, value: str, ties_by: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """df with place, from 0: the row's number in the order of value, then of ties_by. Rows without a value are left out.

    Rows are sorted by ranges and written once with their numbers in the range; what lies before a range is a sum over the ranges' counts.
    """
    by = list(by)
    order = dict.fromkeys([*by, value, *ties_by])
    rows = written(df.where(F.col(value).isNotNull()).orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "places")
    # The upper bits of such a number are the range's.
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    in_group = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")).withColumn("_start", F.coalesce(F.sum("_rows").over(in_group), F.lit(0)))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_range"]]
    place = (F.col("b._start") + F.col("a._at") - F.col("b._first")).alias("place")
    return rows.alias("a").join(starts.alias("b") if by else F.broadcast(starts.alias("b")), on).select(*[F.col(f"a.{c}") for c in df.columns], place)


def mean_rank(before: Column, ties: Column) -> Column:
    """Rank from 1, the mean of the places of equal values."""
    return before + (ties + 1) / 2


def exact_percentiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), often: str | None = None) -> DataFrame:
    """Linearly interpolated percentiles of value (by groups): by, then p0, p1, ... as doubles; null without values.

    Sketches give marks close to each percentile on both sides, and wider ones around. Rows up to each mark are counted, so the two marks
    a percentile lies between are certain however far off the sketches are; only distinct values between these, in general about a
    two-thousandth of the rows, are sorted. often: how many rows a row of df stands for, one if not given; sketches take it once all the same.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_v"), (F.col(often) if often else F.lit(1)).cast("long").alias("_often"))
    if not by:
        rows, by = rows.withColumn("_all", F.lit(0)), ["_all"]
    marks = sorted({min(1.0, max(0.0, p + s / ACCURACY)) for p in shares for s in (-40, -2, 2, 40)})
    sketched = written(rows.groupBy(*by).agg(F.sum(F.when(F.col("_v").isNotNull(), F.col("_often")).otherwise(0)).alias("_n"), F.percentile_approx("_v", marks, ACCURACY).alias("_marks")), "marks")
    # Few groups go to every task: a shuffle would give all rows of one group to one.
    few = (lambda t: F.broadcast(t)) if sketched.count() <= FEW_GROUPS else (lambda t: t)
    known, v, j = rows.where("_v IS NOT NULL").alias("r"), F.col("_v"), range(len(marks))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in by]
    own = [F.col(f"r.{c}") for c in by]
    upto = known.join(few(sketched.alias("k")), on).groupBy(*own).agg(*[F.sum(F.when(v <= F.element_at("_marks", i + 1), F.col("_often")).otherwise(0)).alias(f"_m{i}") for i in j])
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"u.{c}")) for c in by]
    counted = sketched.alias("s").join(upto.alias("u"), same, "left").select(*[F.col(f"s.{c}").alias(c) for c in by], "_n", "_marks", F.coalesce(F.array(*[F.col(f"_m{i}") for i in j]), F.array()).alias("_upto"))
    # Of each share: the last mark with too few rows up to it, and the first with enough.
    each = counted.select(*by, "_n", "_marks", "_upto", F.posexplode(F.array(*[F.lit(float(p)) for p in shares])).alias("i", "_p"))
    at = F.col("_p") * (F.col("_n") - 1)
    too_few = F.size(F.filter("_upto", lambda c: c <= F.floor(F.col("_at"))))
    too_few_above = F.size(F.filter("_upto", lambda c: c <= F.ceil(F.col("_at"))))
    between = each.withColumn("_at", at).withColumns({"_a": too_few, "_b": too_few_above}).select(
        *by, "i", "_at", F.try_element_at("_marks", F.nullif("_a", F.lit(0))).alias("_low"), F.try_element_at("_marks", F.col("_b") + 1).alias("_high"), F.coalesce(F.try_element_at("_upto", F.nullif("_a", F.lit(0))), F.lit(0)).alias("_below")
    )
    brackets = written(between.groupBy(*by).agg(F.collect_list(F.struct("i", "_at", "_low", "_high", "_below")).alias("_k")), "brackets")
    inside = known.join(few(brackets.alias("k")), on).select(*own, "_v", "_often", F.explode(F.filter("_k", lambda k: (k["_low"].isNull() | (v > k["_low"])) & (k["_high"].isNull() | (v <= k["_high"])))).alias("_b"))
    inside = inside.select(*by, "_v", "_often", F.col("_b.i").alias("i"), F.col("_b._at").alias("_at"), F.col("_b._below").alias("_below"))
    values = inside.groupBy(*by, "i", "_at", "_below", "_v").agg(F.sum("_often").alias("_c"))
    running = values.withColumn("_upto", F.col("_below") + F.sum("_c").over(Window.partitionBy(*by, "i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    ends = running.groupBy(*by, "i", "_at").agg(*[F.min(F.when(F.col("_upto") > r("_at"), v)).alias(name) for name, r in (("_a", F.floor), ("_b", F.ceil))])
    found = ends.select(*by, "i", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))).alias("_p"))
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("i") == i, F.col("_p"))).alias(f"p{i}") for i in range(len(shares))])
    # Groups without values have a row too.
    out = sketched.select(*by).alias("s").join(wide.alias("u"), same, "left").select(*[F.col(f"s.{c}").alias(c) for c in by], *[f"p{i}" for i in range(len(shares))])
    return out.drop("_all") if by == ["_all"] else out
