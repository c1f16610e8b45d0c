"""Measures of forecasts, groups and signals, as aggregates over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators.ranking import exact_percentiles, mean_rank, placed, with_place


def _one(holds: Column) -> Column:
    return F.when(holds, 1.0).otherwise(0.0)


def two_proportions(df: DataFrame, group: str, hit: Column) -> DataFrame:
    """z of each group's share of hits against all other rows'."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(_one(hit)).alias("k"))
    t = g.agg(F.sum("n").alias("tn"), F.sum("k").alias("tk"))
    x = g.crossJoin(F.broadcast(t)).select(group, "n", "k", (F.col("tn") - F.col("n")).alias("m"), (F.col("tk") - F.col("k")).alias("l"), (F.col("tk") / F.col("tn")).alias("p"))
    return x.select(group, F.expr("(k / n - l / m) / sqrt(p * (1 - p) * (1 / n + 1 / m))").alias("z"))


def discoveries(df: DataFrame, key: str, p: str, level: float) -> DataFrame:
    """Adds kept (Benjamini-Hochberg) and bonferroni. Places come from ranges of p, not from one sort of all rows."""
    ranked = with_place(df, p, [key]).withColumn("_k", F.col("place") + 1)
    m = df.agg(F.count(p).alias("_m"))
    ranked = ranked.crossJoin(F.broadcast(m))
    top = ranked.where(F.col(p) <= F.col("_k") * level / F.col("_m")).agg(F.coalesce(F.max("_k"), F.lit(0)).alias("_top"))
    return ranked.crossJoin(F.broadcast(top)).select(*df.columns, (F.col("_k") <= F.col("_top")).alias("kept"), (F.col(p) <= level / F.col("_m")).alias("bonferroni"))


def walk_forward(df: DataFrame, order: str, ties: str, folds: int) -> DataFrame:
    """Adds place (in time) and fold: 0 is only trained on, then ``folds`` equal stretches."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    return with_place(df, order, [ties]).crossJoin(F.broadcast(total)).withColumn("fold", F.floor(F.col("place") * float(folds + 1) / F.col("_n")).cast("int")).drop("_n")


def trend(df: DataFrame, step: Column, hit: Column) -> DataFrame:
    """Cochran-Armitage z of the share of hits over ordered steps."""
    g = df.groupBy(step.alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(_one(hit)).alias("k"))
    t = g.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.expr("sum(n * x)").alias("nx"), F.expr("sum(n * x * x)").alias("nxx"), F.expr("sum(k * x)").alias("kx"))
    return t.select(F.expr("(kx - k / n * nx) / sqrt(k / n * (1 - k / n) * (nxx - nx * nx / n))").alias("z"))


def calibration(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Brier score, skill over the base rate, and expected calibration error, from sums by bin."""
    at = F.floor(F.col(p) * bins).cast("int")
    c = df.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum((F.col(p) - F.col(y)) ** 2).alias("loss"))
    t = c.agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum("loss").alias("loss"), F.sum(F.abs(F.col("sp") - F.col("sy"))).alias("gap"))
    # Of 0/1 outcomes, the base rate's own score is base * (1 - base).
    return t.select((F.col("loss") / F.col("n")).alias("brier"), F.expr("1 - (loss / n) / (sy / n * (1 - sy / n))").alias("skill"), (F.col("gap") / F.col("n")).alias("ece"))


def auc(df: DataFrame, score: str, hit: Column) -> DataFrame:
    """Area under the curve from mean ranks; scores are ranked by ranges."""
    hits = df.where(hit).groupBy(score).agg(F.count(F.lit(1)).alias("_pos"))
    met = placed(df, score).join(hits, score, "left").withColumn("_pos", F.coalesce("_pos", F.lit(0)).cast("double"))
    t = met.agg(F.sum(F.col("_pos") * mean_rank(F.col("before"), F.col("ties"))).alias("ranks"), F.sum("_pos").alias("pos"), (F.sum("ties") - F.sum("_pos")).alias("neg"))
    return t.select(F.expr("(ranks - pos * (pos + 1) / 2) / (pos * neg)").alias("auc"))


def line_fit(train: DataFrame, test: DataFrame, y: str, x: str) -> DataFrame:
    """slope of a line fitted on train, and r2 on test against the mean of train."""
    m = train.agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.avg(y).alias("_base"))
    miss, base = F.col(y) - F.col("_a") - F.col("_b") * F.col(x), F.col(y) - F.col("_base")
    return test.crossJoin(F.broadcast(m)).agg(F.max("_b").alias("slope"), (1 - F.sum(miss * miss) / F.sum(base * base)).alias("r2"))


def spearman(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Rank correlation in each group, from mean ranks by ranges of values. Ranks meet the counts of pairs of values, not the rows."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = known.groupBy(by, x, y).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    for c, name in ((x, "_x"), (y, "_y")):
        spots = placed(known, c, [by]).select(by, c, mean_rank(F.col("before"), F.col("ties")).alias(name))
        ranked = ranked.join(spots, [by, c])
    n, u, v = F.sum("_n"), F.col("_x"), F.col("_y")
    sums = ranked.groupBy(by).agg(n.alias("n"), *[F.sum(F.col("_n") * e).alias(k) for k, e in {"sx": u, "sy": v, "sxx": u * u, "syy": v * v, "sxy": u * v}.items()])
    return sums.select(by, F.expr("(sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n))").alias("rho"))


def constant_heads(train: DataFrame, test: DataFrame, y: str, shares: Sequence[float]) -> DataFrame:
    """Pinball loss and coverage, on test, of the constant quantiles of train: loss0, covered0, ..."""
    heads = exact_percentiles(train, y, shares)
    out = []
    for i, t in enumerate(shares):
        miss = F.col(y) - F.col(f"p{i}")
        out += [F.avg(F.when(miss >= 0, t * miss).otherwise((t - 1) * miss)).alias(f"loss{i}"), F.avg(_one(miss <= 0)).alias(f"covered{i}")]
    return test.crossJoin(F.broadcast(heads)).agg(*out)


def seasonal(ts: str) -> dict[str, Column]:
    """Two harmonics of the day, and the weekend."""
    a = 2 * pi * (F.hour(ts) * 60 + F.minute(ts)) / 1440.0
    return {"s1": F.sin(a), "c1": F.cos(a), "s2": F.sin(2 * a), "c2": F.cos(2 * a), "weekend": F.weekday(ts) >= 5}


def demeaned(values: DataFrame, at: str, x: str) -> DataFrame:
    """Adds away (x less its mean at that time), share of the sum, and spread."""
    w = Window.partitionBy(at)
    return values.withColumns({"away": F.col(x) - F.avg(x).over(w), "share": F.col(x) / F.sum(x).over(w), "spread": F.stddev_samp(x).over(w)})


def information(values: DataFrame, at: str, signal: str, outcome: str, least: int) -> DataFrame:
    """Rank correlation of signal and outcome across the rows of each time: at, ic."""

    def ranks(c: str) -> Column:
        return F.rank().over(Window.partitionBy(at).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(at, c)) - 1) / 2.0

    r = values.select(at, ranks(signal).alias("_a"), ranks(outcome).alias("_b"))
    found = r.groupBy(at).agg(F.corr("_a", "_b").alias("ic"), F.count(F.lit(1)).alias("_k"), F.stddev_samp("_a").alias("_sa"), F.stddev_samp("_b").alias("_sb"))
    return found.where((F.col("_k") >= least) & (F.col("_sa") > 0) & (F.col("_sb") > 0)).select(at, "ic")


def demeaned_correlation(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Correlation after each group's mean is taken out, and the least correlation that many rows detect."""
    means = df.groupBy(by).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    r = df.join(F.broadcast(means), by).select((F.col(x) - F.col("_mx")).alias("_x"), (F.col(y) - F.col("_my")).alias("_y"))
    return r.agg(F.corr("_x", "_y").alias("r"), (1.96 / F.sqrt(F.count(F.lit(1)))).alias("detectable"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labellings beyond chance."""
    pairs = lambda n: n * (n - 1) / 2
    c = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = lambda g, name: (c.groupBy(g).agg(F.sum("n").alias("n")) if g else c).agg(F.sum(pairs(F.col("n"))).alias(name))
    whole = c.agg(pairs(F.sum("n")).alias("m"))
    x = total(None, "i").crossJoin(total(a, "p")).crossJoin(total(b, "q")).crossJoin(whole)
    return x.select(F.expr("(i - p * q / m) / ((p + q) / 2 - p * q / m)").alias("ari"))
