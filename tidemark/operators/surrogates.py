"""The null distribution of a cross-sectional link: the signal dealt out anew among the keys of each time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators.ranking import with_place
from tidemark.operators.resampling import drawn, tested


def _rank(c: str, at: str) -> Column:
    return F.rank().over(Window.partitionBy(at).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(at, c)) - 1) / 2.0


def ranked_panel(values: DataFrame, at: str, key: str, signal: str, outcome: str, least: int, block: int) -> DataFrame:
    """A row for each time that has at least ``least`` keys with both values: at, stretch, and in the order of the keys these (as text), and ranks x and y.

    stretch: the number of the run of ``block`` times that the time lies in. A time holds one row of each key.
    """
    known = values.where(F.col(signal).isNotNull() & F.col(outcome).isNotNull() & ~F.isnan(signal) & ~F.isnan(outcome))
    named = known.select(at, F.col(key).cast("string").alias("_key"), F.col(signal).alias("_s"), F.col(outcome).alias("_o"))
    ranks = named.select(at, "_key", _rank("_s", at).alias("x"), _rank("_o", at).alias("y"))
    rows = ranks.groupBy(at).agg(F.sort_array(F.collect_list(F.struct("_key", "x", "y"))).alias("_r")).where(F.size("_r") >= least)
    times = with_place(rows.select(at), at, [at]).select(at, F.floor(F.col("place") / block).alias("stretch"))
    return rows.join(times, at).select(at, "stretch", F.col("_r._key").alias("keys"), F.col("_r.x").alias("x"), F.col("_r.y").alias("y"))


def _correlation(x: Column, y: Column) -> Column:
    """Of two arrays of one length; null if one doesn't vary."""
    n = F.size(y).cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    dot = lambda a, b: total(F.zip_with(a, b, lambda p, q: p * q))
    vx, vy = dot(x, x) - total(x) * total(x) / n, dot(y, y) - total(y) * total(y) / n
    return F.when((vx > 1e-9) & (vy > 1e-9), (dot(x, y) - total(x) * total(y) / n) / F.sqrt(vx * vy))


def coefficients(panel: DataFrame, at: str) -> DataFrame:
    """at, ic: the rank correlation of each time."""
    return panel.select(at, _correlation(F.col("x"), F.col("y")).alias("ic")).where("ic IS NOT NULL")


def surrogate_null(values: DataFrame, at: str, key: str, signal: str, outcome: str, least: int = 3, draws: int = 200, block: int = 1, seed: int = 0) -> DataFrame:
    """One row: times, ic (mean over times), p, null_mean, null_sd, draws.

    Each draw deals the ranks of the signal out anew among the keys of a time. The deal is kept for ``block`` times in a row, so that a
    surrogate remembers as much as the series; deals of one time each make p too small where coefficients persist. Ranks are
    dealt, with their ties. p: the share of draws whose mean coefficient is at least as large in size, counting the series as one.
    """
    panel = ranked_panel(values, at, key, signal, outcome, least, block)
    each = panel.select("stretch", "keys", "x", "y", F.explode(F.sequence(F.lit(-1), F.lit(draws - 1))).alias("sample"))
    lots = F.zip_with("keys", "x", lambda k, v: F.struct(drawn(0, F.lit(seed), F.col("sample"), F.col("stretch"), k).alias("lot"), k.alias("k"), v.alias("v")))
    dealt = F.when(F.col("sample") < 0, F.col("x")).otherwise(F.transform(F.array_sort(lots), lambda r: r["v"]))
    means = each.withColumn("_x", dealt).groupBy("sample").agg(F.avg(_correlation(F.col("_x"), F.col("y"))).alias("stat"), F.count(_correlation(F.col("_x"), F.col("y"))).alias("times"))
    null = means.where("sample >= 0").agg(F.avg("stat").alias("null_mean"), F.stddev_samp("stat").alias("null_sd"))
    times = means.where("sample = -1").select("times")
    found = tested(means.select("sample", "stat"), []).select(F.col("stat").alias("ic"), "p", F.col("usable").alias("draws"))
    return found.crossJoin(F.broadcast(times)).crossJoin(F.broadcast(null)).select("times", "ic", "p", "null_mean", "null_sd", "draws")
