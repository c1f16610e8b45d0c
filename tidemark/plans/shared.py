"""Projections of the generic tables that queries and their oracles start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators import bars as B
from tidemark.operators.recursive import with_indicators
from tidemark.tables import table

HOUR = 3600


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions doesn't show."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields])


def bars(spark: SparkSession, sf_dir: str, seconds: int = HOUR) -> DataFrame:
    return B.bars_of_events(table(spark, sf_dir, "events"), seconds)


def indicator_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_indicators(bars(spark, sf_dir))


def user_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user in order: symbol (the user), t (place), label (event type), value and time."""
    # Named before they are numbered: windows by symbol then need no other shuffle.
    named = table(spark, sf_dir, "events").withColumnRenamed("user_id", "symbol")
    w = Window.partitionBy("symbol").orderBy("ts", "event_id")
    return named.select(
        "symbol", F.row_number().over(w).cast("long").alias("t"), F.col("event_type").alias("label"), "value",
        F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("sec"),
    )


TICKS = """ticks AS (
  SELECT event_type AS symbol, epoch_us(ts) AS us, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume,
    CASE WHEN user_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, event_id AS id FROM events)"""


def bars_sql(seconds: int = HOUR) -> str:
    """CTEs ticks, raw (bars with ticks) and bars (without holes)."""
    return f"""{TICKS},
placed AS (
  SELECT *, (us // {seconds * 1_000_000}) * {seconds} AS t,
    row_number() OVER (PARTITION BY symbol, us // {seconds * 1_000_000} ORDER BY us DESC, CASE WHEN side = 'buy' THEN price ELSE -price END DESC, id DESC) AS from_end FROM ticks),
raw AS (
  SELECT symbol, t, max(price) AS high, min(price) AS low, max(CASE WHEN from_end = 1 THEN price END) AS close, sum(volume) AS volume,
    sum(price * volume) AS quote_volume, count(*) AS trades, sum(CASE WHEN side = 'buy' THEN volume ELSE 0.0 END) AS taker_buy_base FROM placed GROUP BY symbol, t),
grid AS (SELECT symbol, unnest(range(a, b + 1, {seconds})) AS t FROM (SELECT symbol, min(t) AS a, max(t) AS b FROM raw GROUP BY symbol)),
held AS (
  SELECT g.symbol, g.t, high, low, last_value(close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close,
    volume, quote_volume, trades, taker_buy_base FROM grid g LEFT JOIN raw r ON g.symbol = r.symbol AND g.t = r.t),
opened AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY t), close) AS open FROM held),
bars AS (
  SELECT symbol, t, open, greatest(coalesce(high, close), open) AS high, least(coalesce(low, close), open) AS low, close, coalesce(volume, 0) AS volume,
    coalesce(quote_volume, 0) AS quote_volume, coalesce(trades, 0) AS trades, coalesce(taker_buy_base, 0) AS taker_buy_base FROM opened)"""


def indicators_sql() -> str:
    """CTEs up to ind: bars with ema_day, ema_week, ema_20, atr and rsi. To follow WITH RECURSIVE."""
    keep = lambda n: f"(1 - 2.0 / {n + 1})"
    step = lambda old, new, n: f"2.0 / {n + 1} * {new} + {keep(n)} * {old}"
    wild = lambda old, new: f"{new} / 14.0 + {old} * 13.0 / 14.0"
    return f"""{bars_sql()},
num AS (
  SELECT *, row_number() OVER w AS n, lag(close) OVER w AS before FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)),
moves AS (
  SELECT *, greatest(high - low, abs(high - before), abs(low - before)) AS tr, greatest(close - before, 0) AS gain, greatest(before - close, 0) AS loss FROM num),
fold AS (
  SELECT symbol, n, close AS ed, close AS ew, close AS e20, tr AS a, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS l FROM moves WHERE n = 1
  UNION ALL
  SELECT m.symbol, m.n, {step('ed', 'm.close', 24)}, {step('ew', 'm.close', 168)}, {step('e20', 'm.close', 20)}, {wild('a', 'm.tr')},
    CASE WHEN g IS NULL THEN m.gain ELSE {wild('g', 'm.gain')} END, CASE WHEN l IS NULL THEN m.loss ELSE {wild('l', 'm.loss')} END
  FROM fold f JOIN moves m ON m.symbol = f.symbol AND m.n = f.n + 1),
ind AS (
  SELECT m.symbol, m.t, m.n, m.open, m.high, m.low, m.close, m.volume, m.quote_volume, m.trades, m.taker_buy_base,
    CASE WHEN m.n >= 12 THEN ed END AS ema_day, CASE WHEN m.n >= 84 THEN ew END AS ema_week, CASE WHEN m.n >= 10 THEN e20 END AS ema_20,
    CASE WHEN m.n >= 14 THEN a END AS atr,
    CASE WHEN m.n >= 15 THEN CASE WHEN l = 0 THEN CASE WHEN g = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + g / l) END END AS rsi
  FROM moves m JOIN fold f ON m.symbol = f.symbol AND m.n = f.n)"""


#: CTE states: events of each user in order.
STATES = """states AS (
  SELECT user_id AS symbol, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, event_type AS label, value,
    CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events)"""
