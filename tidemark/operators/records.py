"""Filters, joins, keyed merges, groupings and sequences of records, as functions on DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators.ranking import exact_percentiles, placed

# Time


def micros(ts: str = "ts") -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def seconds(ts: str = "ts") -> Column:
    """Whole seconds since 1970."""
    return F.floor(micros(ts) / 1_000_000).cast("long")


def bucket(t: Column, width: int | Column) -> Column:
    """Number of the tumbling window of ``width`` that t falls into."""
    return F.floor(t / width).cast("long")


def day_number(ts: str) -> Column:
    """yyyymmdd as a number."""
    return F.date_format(ts, "yyyyMMdd").cast("int")


def epoch_seconds(stamp: Column) -> Column:
    """Seconds of a stamp in micro- or milliseconds, told by its size."""
    return F.floor(F.when(stamp > 100_000_000_000_000, stamp / 1_000_000).otherwise(stamp / 1000)).cast("long")


# Predicates and projections


def filtered(df: DataFrame, equal: Mapping[str, object] = {}, least: Mapping[str, object] = {}, among: Mapping[str, Sequence] = {}) -> DataFrame:
    """Rows that meet all conditions that are given; a condition of None is none."""
    for name, value in equal.items():
        df = df if value is None else df.where(F.col(name) == F.lit(value))
    for name, value in least.items():
        df = df if value is None else df.where(F.col(name) >= F.lit(value))
    for name, values in among.items():
        df = df if values is None else df.where(F.col(name).isin(*values))
    return df


def stepped(x: Column, steps: Sequence[tuple[Callable[[Column], Column], object]], otherwise: object) -> Column:
    """The value of the first step whose test holds."""
    out = None
    for test, value in steps:
        out = F.when(test(x), F.lit(value)) if out is None else out.when(test(x), F.lit(value))
    return out.otherwise(F.lit(otherwise))


def above(limit: float) -> Callable[[Column], Column]:
    return lambda x: x > limit


def below(limit: float) -> Callable[[Column], Column]:
    return lambda x: x < limit


def up_to(limit: float) -> Callable[[Column], Column]:
    return lambda x: x <= limit


def rule_matches(rules: DataFrame, rows: DataFrame, tests: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Pairs of a rule and a row that meets all the rule's fields; a null field is no condition. Rules are few: they are broadcast."""
    holds = F.lit(True)
    for name, test in tests.items():
        holds &= F.col(name).isNull() | F.coalesce(test(F.col(name)), F.lit(False))
    return rows.join(F.broadcast(rules), holds)


def hashed_id(*parts: Column, length: int = 20) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, length)


def robust_scaled(df: DataFrame, value: str, clip: float) -> DataFrame:
    """Adds x: (value - median) / interquartile range, clipped; a range of 0 counts as 1."""
    scale = exact_percentiles(df, value, (0.25, 0.5, 0.75)).select(F.col("p1").alias("_mid"), F.col("p2").alias("_top"), F.col("p0").alias("_low"))
    spread = F.col("_top") - F.col("_low")
    x = (F.col(value) - F.col("_mid")) / F.when(spread == 0, 1.0).otherwise(spread)
    return df.crossJoin(F.broadcast(scale)).withColumn("x", F.greatest(F.lit(-clip), F.least(F.lit(clip), x))).drop("_mid", "_top", "_low")


def with_greatest(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the greatest value of all rows."""
    return df.crossJoin(F.broadcast(df.select(value.alias("_v")).agg(F.max("_v").alias(name))))


# Keys and merges


def last_by(df: DataFrame, key: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """For each key the columns of its last row by order, by aggregation: no key is sorted."""
    last = F.max(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in columns if c not in key])).alias("_last")
    return df.groupBy(*key).agg(last).select(*[F.col(c) if c in key else F.col(f"_last.{c}").alias(c) for c in dict.fromkeys([*key, *columns])])


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """For each key the columns of its first row by order, by aggregation."""
    first = F.min(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in columns if c not in key])).alias("_first")
    return df.groupBy(*key).agg(first).select(*[F.col(c) if c in key else F.col(f"_first.{c}").alias(c) for c in dict.fromkeys([*key, *columns])])


def latest_joined(left: DataFrame, right: DataFrame, on: tuple[str, str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Every left row with the columns of the last right row of its key, null without one."""
    last = last_by(right, [on[1]], order, columns)
    return left.join(last, F.col(on[0]) == F.col(on[1]), "left")


def coverage(df: DataFrame, symbol: str, t: Column, value: str, tie: str) -> DataFrame:
    """Of each symbol: rows, first and last time, last value."""
    return df.groupBy(symbol).agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("first_t"), F.max(t).alias("last_t"), F.max_by(value, F.struct(t, tie)).alias("last_value"))


def share_of_total(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of each group, n, and its share of all rows; the total is that of the groups."""
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return groups.crossJoin(F.broadcast(groups.agg(F.sum("n").alias("_total")))).withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def panel(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Every pair of a row and a column value that occur, with the mean of value, null where a pair has no rows."""
    means = df.groupBy(row, column).agg(F.avg(value).alias("x"))
    grid = means.select(row).distinct().crossJoin(F.broadcast(means.select(column).distinct()))
    return grid.join(means, [row, column], "left")


# Transitions


def transitions(df: DataFrame, by: str, order: Sequence[str], label: str, *columns: Column) -> DataFrame:
    """Changes of label along each sequence: a (before), b (after) and more columns of the later row."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.select(F.lag(label).over(w).alias("a"), F.col(label).alias("b"), *columns).where("a <> b")


def edges(moves: DataFrame) -> DataFrame:
    return moves.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def rare_edges(moves: DataFrame, share: float) -> DataFrame:
    """Edges whose count is at or below that percentile of counts."""
    counted = edges(moves)
    return counted.crossJoin(F.broadcast(exact_percentiles(counted, "n", (share,)))).where("n <= p0").drop("p0")


def neighbourhood(counted: DataFrame, node: str, top: int) -> DataFrame:
    """The most frequent edges into and out of a node: way, other, n, place."""
    ways = [counted.where(F.col(end) == node).select(F.lit(way).alias("way"), F.col(other).alias("other"), "n") for way, end, other in (("in", "b", "a"), ("out", "a", "b"))]
    placed_ = [w.orderBy(F.desc("n"), "other").limit(top).withColumn("place", F.row_number().over(Window.partitionBy("way").orderBy(F.desc("n"), "other"))) for w in ways]
    return placed_[0].unionByName(placed_[1])


def graph_parts(moves: DataFrame, batch: Column) -> DataFrame:
    """Edges of each batch: count n, total of value, and the label of the latest move with its id ``at``."""
    return moves.groupBy("a", "b", batch.alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max_by("label", "event_id").alias("label"), F.max("event_id").alias("at"))


def islands(df: DataFrame, by: str, order: Sequence[str], label: str) -> DataFrame:
    """Adds seq, the number of label changes so far along each sequence, and age, the row's place since the last one."""
    w = Window.partitionBy(by).orderBy(*order)
    marked = df.withColumn("_c", F.coalesce((F.lag(label).over(w) != F.col(label)).cast("long"), F.lit(0)))
    numbered = marked.withColumn("seq", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("age", F.row_number().over(Window.partitionBy(by, "seq").orderBy(*order)) - 1).drop("_c")


# Groupings


def downsampled(df: DataFrame, t: Column, value: str, most: int = 720, least_width: int = 60) -> DataFrame:
    """At most about ``most`` tumbling windows over the whole series, whole minutes wide: bucket, mean, peak."""
    timed = df.select(t.alias("_t"), value)
    span = timed.agg(F.greatest(F.lit(least_width), F.ceil((F.max("_t") - F.min("_t")) / float(most) / 60).cast("long") * 60).alias("_width"))
    at = (bucket(F.col("_t"), F.col("_width")) * F.col("_width")).alias("bucket")
    return timed.crossJoin(F.broadcast(span)).groupBy(at).agg(F.avg(value).alias("mean"), F.max(value).alias("peak"))


def binned(df: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """Adds bin: the number of exact percentiles below value; bins are closed on the right."""
    cuts = exact_percentiles(df, value, shares)
    number = sum((F.when(F.col(value) > F.col(f"p{i}"), 1).otherwise(0) for i in range(len(shares))), F.lit(0))
    return df.crossJoin(F.broadcast(cuts)).withColumn("bin", number).drop(*cuts.columns)


def target_encoded(train: DataFrame, rows: DataFrame, key: str, value: str, weight: float) -> DataFrame:
    """rows with encoded: the mean of value by key over train, drawn to the overall mean by ``weight`` rows; the mean itself for unknown keys."""
    prior = train.agg(F.avg(value).alias("_prior"))
    sums = train.groupBy(key).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    met = rows.join(sums, key, "left").crossJoin(F.broadcast(prior))
    code = (F.col("_sum") + weight * F.col("_prior")) / (F.col("_n") + weight)
    return met.withColumn("encoded", F.coalesce(code, "_prior")).drop("_sum", "_n", "_prior")


def backed_off_percentile(df: DataFrame, fine: str, coarse: str, value: str, share: float, least: int) -> DataFrame:
    """v for each (fine, coarse): the percentile of its rows if there are at least ``least``, else that of the coarse key's."""
    sizes = df.groupBy(fine, coarse).agg(F.count(F.lit(1)).alias("_n"))
    own = exact_percentiles(df, value, (share,), [fine, coarse]).withColumnRenamed("p0", "_own")
    wide = exact_percentiles(df, value, (share,), [coarse]).withColumnRenamed("p0", "_wide")
    met = sizes.join(own, [fine, coarse], "left").join(wide, coarse, "left")
    return met.select(fine, coarse, F.coalesce(F.when(F.col("_n") >= least, F.col("_own")), "_wide").alias("v"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair of columns, from one pass over the rows: a, b, r."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]).alias("_c")).select(F.inline("_c"))


def lagged_correlations(df: DataFrame, by: str, order: str, ties: str, value: str, lags: Sequence[int]) -> DataFrame:
    """Correlation of value with itself so many rows before, over all sequences: k, r.

    Rows are numbered without sorting a sequence in one task; a lag is an equi-join on the number.
    """
    spots = placed(df, order, [by]).drop("ties")
    numbered = df.select(by, order, ties, value).join(spots, [by, order])
    numbered = numbered.select(by, (F.col("before") + F.row_number().over(Window.partitionBy(by, order).orderBy(ties))).alias("_i"), value)
    ahead = numbered.select(by, F.explode(F.array(*[F.lit(k) for k in lags])).alias("k"), "_i", F.col(value).alias("y")).withColumn("_i", F.col("_i") + F.col("k"))
    return numbered.join(ahead, [by, "_i"]).groupBy("k").agg(F.corr(value, "y").alias("r"))


def rows_ahead(df: DataFrame, by: str, t: Column, width: int) -> DataFrame:
    """n for each row whose window fits: how many rows of its sequence have a time from its own up to ``width`` later, the end left out.

    Times are counted once each. The rows up to a window's end less those before its start are running sums over stretches of ``width``
    and the stretches' totals, so the work doesn't grow with the rows of a window.
    """
    timed = df.select(by, t.alias("_t")).where("_t IS NOT NULL").groupBy(by, "_t").agg(F.count(F.lit(1)).alias("_k"))
    end = F.lit(width - 1)
    marks = timed.select(by, "_t", "_k", F.explode(F.array(F.lit(0), F.lit(1))).alias("_end")).withColumn("_at", F.col("_t") + F.col("_end") * end).withColumn("_b", bucket(F.col("_at"), width))
    own = F.when(F.col("_end") == 0, F.col("_k")).otherwise(0)
    in_order = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = marks.groupBy(by, "_b").agg(F.sum(own).alias("_rows")).withColumn("_start", F.coalesce(F.sum("_rows").over(in_order), F.lit(0))).select(F.col(by).alias("_by"), F.col("_b").alias("_stretch"), "_start")
    running = F.sum(own).over(Window.partitionBy(by, "_b").orderBy("_at", "_end").rowsBetween(Window.unboundedPreceding, 0))
    met = marks.withColumn("_upto", running).join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_b") == F.col("_stretch")))
    # Rows up to the end, less those before the start.
    signed = F.when(F.col("_end") == 1, F.col("_start") + F.col("_upto")).otherwise(F.col("_k") - F.col("_start") - F.col("_upto"))
    counted = met.groupBy(by, "_t").agg(F.sum(signed).alias("n"), F.max("_k").alias("_k"))
    last = timed.groupBy(F.col(by).alias("_by")).agg(F.max("_t").alias("_last"))
    fits = counted.join(F.broadcast(last), F.col(by).eqNullSafe(F.col("_by"))).where(F.col("_t") + end <= F.col("_last"))
    return fits.select(by, F.explode(F.array_repeat("n", F.col("_k").cast("int"))).alias("n"))


def thinned(df: DataFrame, t: Column, value: str, order: Sequence[str], width: int, phases: int) -> DataFrame:
    """One value a window, the first, for each phase of windows that don't overlap: i, x.

    Windows of all phases begin and end at multiples of one step, so the first row of each step is all they choose from.
    """
    moved = width // phases
    step = gcd(width, moved)
    firsts = df.groupBy((bucket(t, step) * step).alias("_t")).agg(F.min(F.struct(*order, F.col(value).alias("_x"))).alias("_r"))
    at = firsts.select("_t", "_r", F.explode(F.sequence(F.lit(0), F.lit(phases - 1))).alias("i"))
    window = bucket(F.col("_t") - F.col("i") * moved, width).alias("_w")
    return at.groupBy("i", window).agg(F.min("_r").alias("_r")).select("i", F.col("_r._x").alias("x"))


# Frames


def limited(df: DataFrame, order: Sequence[Column], limit: int) -> tuple[DataFrame, bool]:
    """The first rows in order, and whether there are more; one row too many is asked for, nothing is counted."""
    asked = df.orderBy(*order).limit(limit + 1)
    return asked.orderBy(*order).limit(limit), asked.count() > limit


def side_by_side(frames: Mapping[str, DataFrame], key: Sequence[str]) -> DataFrame:
    """Frames of one index next to each other: the key, then name_column for each; keys that a frame lacks give nulls."""
    out = None
    for name, df in frames.items():
        named = df.select(*key, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in key])
        out = named if out is None else out.join(named, list(key), "full_outer")
    return out


def refreshed(old: DataFrame | None, rows: DataFrame, t: str, width: int, by: Sequence[str], aggregates: Sequence[Column], since: int) -> DataFrame:
    """Tumbling aggregates (bucket, by, ...) with the windows from the one that holds ``since`` on made anew from rows."""
    first = since // width * width
    fresh = rows.where(F.col(t) >= first).groupBy((bucket(F.col(t), width) * width).alias("bucket"), *by).agg(*aggregates)
    return fresh if old is None else old.where(F.col("bucket") < first).unionByName(fresh)


def fold_predictions(df: DataFrame, fold: str, predict: Callable[[DataFrame, DataFrame], DataFrame], folds: Sequence[int]) -> DataFrame:
    """predict(train, test) for each fold, train being all folds before it; what it returns, with the fold's number."""
    out = None
    for k in folds:
        found = predict(df.where(F.col(fold) < k), df.where(F.col(fold) == k)).withColumn("fold", F.lit(k))
        out = found if out is None else out.unionByName(found)
    return out
