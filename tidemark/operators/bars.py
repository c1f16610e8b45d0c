"""Ticks to bars and bars to coarser bars. Times are whole seconds since 1970."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators.windows import last_known, ordered


def seconds_of(raw: Column) -> Column:
    """Seconds of a number that may be in seconds, milli-, micro- or nanoseconds, by its size."""
    return F.when(raw > 1e17, raw / 1e9).when(raw > 1e14, raw / 1e6).when(raw > 1e11, raw / 1e3).otherwise(raw.cast("double"))


def event_ticks(events: DataFrame) -> DataFrame:
    """Ticks (symbol, us, price, volume, side, id) of the events table."""
    return events.select(
        F.col("event_type").alias("symbol"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("us"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
        F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.col("event_id").alias("id"),
    )


def tick_bars(ticks: DataFrame, seconds: int) -> DataFrame:
    """One bar for each symbol and bucket with ticks: high, low, close, volume, quote_volume, trades, taker_buy_base.

    The close is the last tick in order of execution: by time, then along the book, which a buy climbs and a sale
    descends; ticks that still tie have one price. That order is one decimal, microseconds since the bucket's start before the
    signed price, so the close is a maximum in a hash aggregate with map-side combining, and ticks are never sorted.
    Buckets of up to a day; a price of 9e9 or more, of either sign, is an error, and steps below 1e-16 are not told apart.
    """
    buy = F.lower("side") == "buy"
    good = ticks.where("price is not null and volume is not null")
    start = F.floor(F.col("us") / (seconds * 1_000_000)) * seconds
    signed = F.when(buy, F.col("price")).otherwise(-F.col("price"))
    # 11 digits of microseconds, 11 of the price's whole part, moved above zero, and 16 behind the point.
    large = F.raise_error(F.lit("tick_bars: a price of 9e9 or more")).cast("double")
    along = F.when(F.abs(F.col("price")) < 9e9, signed).otherwise(large).cast("decimal(27,16)")
    place = ((F.col("us") - start * 1_000_000).cast("decimal(11,0)") * F.lit(100_000_000_000).cast("decimal(12,0)")).cast("decimal(38,16)") + along
    return good.groupBy("symbol", start.alias("t")).agg(
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", place).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum(F.col("price") * F.col("volume")).alias("quote_volume"),
        F.count(F.lit(1)).alias("trades"),
        F.sum(F.when(buy, F.col("volume")).otherwise(0.0)).alias("taker_buy_base"),
    )


def fill_empty(bars: DataFrame, seconds: int) -> DataFrame:
    """A bar for every bucket from a symbol's first to its last: empty ones are flat at the close before, without volume.

    Opens are the close before (the first: its own close) and count for high and low.
    """
    grid = bars.groupBy("symbol").agg(F.min("t").alias("a"), F.max("t").alias("b")).select("symbol", F.explode(F.sequence("a", "b", F.lit(seconds).cast("long"))).alias("t"))
    full = grid.join(bars, ["symbol", "t"], "left").withColumn("close", last_known(F.col("close")))
    opened = full.withColumn("open", F.coalesce(F.lag("close").over(ordered()), F.col("close")))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("volume", "quote_volume", "trades", "taker_buy_base")}
    # An empty bar has no high of its own; greatest skips nulls, and a flat bar's close counts.
    flat = F.col("trades").isNull()
    high = F.greatest("high", "open", F.when(flat, F.col("close")))
    low = F.least("low", "open", F.when(flat, F.col("close")))
    return opened.withColumns({"high": high, "low": low}).withColumns(zero).select("symbol", "t", "open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_base")


def bars_of_events(events: DataFrame, seconds: int = 3600) -> DataFrame:
    return fill_empty(tick_bars(event_ticks(events), seconds), seconds)


def resample(bars: DataFrame, seconds: int) -> DataFrame:
    """Coarser bars, labelled by their left end; buckets without bars don't appear."""
    return bars.groupBy("symbol", (F.floor(F.col("t") / seconds) * seconds).alias("t")).agg(
        F.min_by("open", F.col("t")).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.col("t")).alias("close"),
        *[F.sum(c).alias(c) for c in ("volume", "quote_volume", "trades", "taker_buy_base")],
    )


def rebuild(base: DataFrame, stored: DataFrame, seconds: int) -> DataFrame:
    """Coarser bars when some are stored: those from each symbol's last stored bar on are made anew, as it may have been open."""
    last = stored.groupBy("symbol").agg(F.max("t").alias("since"))
    fresh = resample(base.join(F.broadcast(last), "symbol", "left").where("since is null or t >= since").drop("since"), seconds)
    kept = stored.join(F.broadcast(last), "symbol").where("t < since").drop("since")
    return kept.unionByName(fresh)


def as_of_closed(base: DataFrame, coarse: DataFrame, seconds: int, columns: list[str]) -> DataFrame:
    """Columns of the last coarse bar that is closed at each base bar; an equi-join, since the coarse grid is regular.

    A missing coarse bar leaves the one before it in force.
    """
    w = Window.partitionBy("symbol").orderBy("t")
    spans = coarse.select("symbol", "t", F.lead("t").over(w).alias("next"), *columns)
    # The bar of [t, next) is in force for base bars of the buckets after it, up to that of the next bar.
    until = F.coalesce(F.col("next"), F.col("t") + seconds)
    forced = spans.select("symbol", F.explode(F.sequence(F.col("t") + seconds, until, F.lit(seconds).cast("long"))).alias("bucket"), *[F.col(c).alias(f"tf_{c}") for c in columns])
    return base.withColumn("bucket", F.floor(F.col("t") / seconds) * seconds).join(forced, ["symbol", "bucket"], "left").drop("bucket")


def aggregate_levels(rows: DataFrame, seconds: int, levels: list[str], flows: list[str], order: str = "t") -> DataFrame:
    """Fine rows to buckets of t: the last known level in order, the mean flow, and how many rows came in; all null stays null."""
    last = {c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in levels}
    return rows.groupBy("symbol", (F.floor(F.col("t") / seconds) * seconds).alias("t")).agg(*last.values(), *[F.avg(c).alias(c) for c in flows], F.count(F.lit(1)).alias("src_rows"))
