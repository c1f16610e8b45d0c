"""Rolling, forward and cross-sectional windows over rows (symbol, t)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window, WindowSpec

from tidemark.operators.stretches import over_stretches


def ordered() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("t")


def trailing(n: int) -> WindowSpec:
    """The last n rows, this one included."""
    return ordered().rowsBetween(-(n - 1), 0)


def ahead(n: int) -> WindowSpec:
    """The next n rows, this one excluded."""
    return ordered().rowsBetween(1, n)


def rolling(aggregate, x: Column, n: int, least: int) -> Column:
    """Aggregate over the last n rows; null when fewer than ``least`` values are known."""
    w = trailing(n)
    return F.when(F.count(x).over(w) >= least, aggregate(x).over(w))


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b) of doubles as IEEE arithmetic has it: infinite where one side is 0, not a number where both are or the ratio is negative."""
    infinite, unknown = F.lit(float("inf")), F.lit(float("nan"))
    of_zero = F.when(b != 0, -infinite).otherwise(unknown)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(a == 0, of_zero).when(b == 0, F.when(a > 0, infinite).otherwise(unknown)).when((a < 0) != (b < 0), unknown).otherwise(F.ln(F.try_divide(a, b)))


def zscore(x: Column, n: int) -> Column:
    """Distance from the rolling mean in sample deviations; null on a flat window."""
    half = n // 2
    return (x - rolling(F.avg, x, n, half)) / F.nullif(rolling(F.stddev_samp, x, n, half), F.lit(0.0))


def unit(x: Column) -> Column:
    """x cut to 0 and 1; null stays null, which least and greatest alone would not keep."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def position_in_range(n: int) -> Column:
    """Close between the window's low (0) and high (1)."""
    top, bottom = rolling(F.max, F.col("high"), n, n // 2), rolling(F.min, F.col("low"), n, n // 2)
    return unit((F.col("close") - bottom) / F.nullif(top - bottom, F.lit(0.0)))


def skew(x: Column, n: int, least: int) -> Column:
    """Bias-adjusted sample skewness; null for fewer than three values or no spread."""
    w = trailing(n)
    k, s = F.count(x).over(w), F.skewness(x).over(w)
    return F.when((k >= least) & (k > 2) & ~F.isnan(s), s * F.sqrt(k * (k - 1)) / F.nullif(k - 2, F.lit(0)))


def rank_in_window(df: DataFrame, x: str, n: int, least: int, name: str = "rank") -> DataFrame:
    """Adds the share of the window's values up to this one, ties at their mean rank.

    An order-statistic window (a skip list that rows enter and leave) over stretches of time with n - 1 rows before them.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return over_stretches(df, lambda pdf: pdf.assign(**{name: pdf[x].rolling(n, least).rank(pct=True)}), f"{schema}, {name} double", n - 1)


def last_known(x: Column) -> Column:
    """The last value that isn't null, this row included."""
    return F.last(x, ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, 0))


def rank_across(x: Column, by: str = "t", least: int = 4) -> Column:
    """Rank of a row's value among all symbols at one time, from 0 to 1, ties at their mean rank."""
    w = Window.partitionBy(by).orderBy(x)
    same = Window.partitionBy(F.col(by), x)
    known = F.count(x).over(Window.partitionBy(by))
    nulls = F.sum(x.isNull().cast("int")).over(Window.partitionBy(by))
    # Nulls sort first and take the lowest ranks.
    return F.when(x.isNotNull() & (known >= least), (F.rank().over(w) - nulls + (F.count(F.lit(1)).over(same) - 1) / 2) / known)


def islands(df: DataFrame, label: str) -> DataFrame:
    """Adds changed, seq (changes so far) and pos (place inside the run of equal labels, from 0)."""
    w = ordered()
    before = F.lag(label).over(w)
    changed = before.isNotNull() & (before != F.col(label))
    seq = F.sum(F.col("changed").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("changed", changed).withColumn("seq", seq)
    return marked.withColumn("pos", (F.row_number().over(Window.partitionBy("symbol", "seq").orderBy("t")) - 1).cast("long"))


def smooth_labels(df: DataFrame, label: str, least: int) -> DataFrame:
    """Adds smoothed: runs shorter than ``least`` take the label before them; the first run always counts."""
    runs = islands(df, label)
    # A row's run is long enough if the row lies in so many rows of one run: told by rows around it, without a sort by runs.
    alike = lambda o: (F.lead("seq", o) if o > 0 else F.lag("seq", -o)).over(ordered()) == F.col("seq") if o else F.lit(True)
    enough = reduce(or_, [F.coalesce(alike(-back) & alike(least - 1 - back), F.lit(False)) for back in range(least)], F.lit(least <= 1))
    kept = F.when(F.col("enough") | (F.col("seq") == 0), F.col(label))
    return runs.withColumn("enough", enough).withColumn("smoothed", last_known(kept)).drop("enough", "changed", "seq", "pos")


def entropy_of_labels(label: str, n: int, kinds: Column) -> Column:
    """Shannon entropy of the last n labels over ln(min(n, kinds)); a short start is padded with the first label."""
    seen = F.collect_list(label).over(trailing(n))
    first = F.first(label).over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    padded = F.concat(seen, F.array_repeat(first, F.lit(n) - F.size(seen)))
    share = lambda v: F.size(F.filter(padded, lambda u: u == v)) / F.lit(float(n))
    bits = F.aggregate(F.array_distinct(padded), F.lit(0.0), lambda acc, v: acc - share(v) * F.ln(share(v)))
    top = F.least(F.lit(n), kinds)
    return F.when(top > 1, bits / F.ln(F.greatest(top, F.lit(2)).cast("double"))).otherwise(bits)
