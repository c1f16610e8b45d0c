"""Thinned z, partial gains and surrogate orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def thinned_z(rows: DataFrame, t: str, order: str, atoms: str, hit: str, horizon: int, phases: int = 24) -> DataFrame:
    """z of each atom's share of hits against other rows', on windows that don't overlap: atom, z (median over phases), phases (usable ones).

    Of each window of ``horizon`` the first row is taken; windows begin at the first row's time, moved by a phase. Windows of all phases
    begin and end at steps of horizon / phases, so they choose from the first row of each step. A phase without rows on both sides is left out. hit: a boolean column.
    """
    origin = rows.agg(F.min(t).alias("_origin"))
    step = F.floor((F.col(t) - F.col("_origin")) * phases / horizon).alias("_s")
    first = F.min(F.struct(F.col(t).alias("_t"), F.col(order).alias("_o"), F.col(hit).cast("double").alias("hit"), F.col(atoms).alias("atoms"))).alias("_r")
    firsts = rows.crossJoin(F.broadcast(origin)).groupBy(step).agg(first)
    spread = firsts.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(phases - 1))))
    picked = spread.groupBy("_p", F.floor((F.col("_s") + F.col("_p")) / phases).alias("_w")).agg(F.min("_r").alias("_r"))
    each = picked.select("_p", "_r.hit", "_r.atoms")
    whole = each.groupBy("_p").agg(F.count("hit").alias("_n"), F.sum("hit").alias("_k"))
    marked = each.select("_p", "hit", F.explode("atoms").alias("atom")).groupBy("_p", "atom").agg(F.count("hit").alias("n1"), F.sum("hit").alias("k1"))
    both = marked.join(F.broadcast(whole), "_p").select("atom", "n1", "k1", (F.col("_n") - F.col("n1")).alias("n2"), (F.col("_k") - F.col("k1")).alias("k2")).where("n1 > 0 AND n2 > 0")
    spread_of = F.expr("sqrt((k1 + k2) / (n1 + n2) * (1 - (k1 + k2) / (n1 + n2)) * (1 / n1 + 1 / n2))")
    z = F.when(spread_of > 0, F.expr("k1 / n1 - k2 / n2") / spread_of).otherwise(0.0)
    return both.select("atom", z.alias("z")).groupBy("atom").agg(F.percentile("z", F.lit(0.5)).alias("z"), F.count(F.lit(1)).alias("phases"))


def partial_gains(df: DataFrame, y: str, base: str, extra: str, by: str) -> DataFrame:
    """r2 of y on the base column in each group, and the gain of the extra column, from correlations."""
    r = df.groupBy(by).agg(F.corr(y, base).alias("a"), F.corr(y, extra).alias("b"), F.corr(base, extra).alias("c"))
    return r.select(by, F.expr("a * a").alias("r2"), F.expr("(a * a + b * b - 2 * a * b * c) / (1 - c * c) - a * a").alias("gain"))


def surrogate_order(rows: DataFrame, by: str, key: str, block: int, seed: int) -> DataFrame:
    """Adds surrogate: a permutation of keys within each block of times, the same for all its times."""
    group = F.floor(F.col(by) / block)
    return rows.withColumn("surrogate", F.row_number().over(_window(group, seed, key)))


def _window(group, seed: int, key: str):
    from pyspark.sql import Window

    return Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), group, key))
