"""Queries of bars, windows, features, events and price structure."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators import bars as B
from tidemark.operators import features as X
from tidemark.operators import structure as S
from tidemark.operators import windows as W
from tidemark.plans.shared import bars, bars_sql, indicator_bars, indicators_sql, rounded
from tidemark.registry import Registry
from tidemark.tables import table

REGISTRY = Registry()
query = REGISTRY.query

BAR_COLUMNS = ("open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_base")


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


PLAIN_BARS = "symbol, t, " + r6("open", "high", "low", "close", "volume", "quote_volume") + ", trades, " + r6("taker_buy_base")


@query("a04_timestamp_units", """
WITH raw AS (SELECT event_id, CAST(epoch_us(ts) AS DOUBLE) AS us FROM events),
stamped AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN us / 1e6 WHEN 1 THEN us / 1e3 WHEN 2 THEN us ELSE us * 1e3 END AS stamp FROM raw)
SELECT event_id, round(CASE WHEN stamp > 1e17 THEN stamp / 1e9 WHEN stamp > 1e14 THEN stamp / 1e6 WHEN stamp > 1e11 THEN stamp / 1e3 ELSE stamp END, 3) AS seconds FROM stamped
""")  # fmt: skip
def timestamp_units(spark, sf_dir):
    """Seconds from stamps whose unit shows in their size."""
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").cast("double")
    kind = F.col("event_id") % 4
    stamp = F.when(kind == 0, us / 1e6).when(kind == 1, us / 1e3).when(kind == 2, us).otherwise(us * 1e3)
    return table(spark, sf_dir, "events").select("event_id", F.round(B.seconds_of(stamp), 3).alias("seconds"))


@query("d01_tick_bars", f"WITH {bars_sql()} SELECT symbol, t, {r6('high', 'low', 'close', 'volume', 'quote_volume')}, trades, {r6('taker_buy_base')} FROM raw")
def tick_bars(spark, sf_dir):
    return rounded(B.tick_bars(B.event_ticks(table(spark, sf_dir, "events")), 3600))


@query("d02_bars_without_holes", f"WITH {bars_sql(900)} SELECT {PLAIN_BARS} FROM bars")
def filled_bars(spark, sf_dir):
    return rounded(bars(spark, sf_dir, 900))


RESAMPLED = """
coarse AS (
  SELECT symbol, (t // 86400) * 86400 AS t, arg_min(open, b.t) AS open, max(high) AS high, min(low) AS low, arg_max(close, b.t) AS close, sum(volume) AS volume,
    sum(quote_volume) AS quote_volume, CAST(sum(trades) AS BIGINT) AS trades, sum(taker_buy_base) AS taker_buy_base FROM bars b GROUP BY symbol, (b.t // 86400) * 86400)"""


@query("d03_resample", f"WITH {bars_sql()}, {RESAMPLED} SELECT {PLAIN_BARS} FROM coarse")
def resampled(spark, sf_dir):
    return rounded(B.resample(bars(spark, sf_dir), 86400)).select("symbol", "t", *BAR_COLUMNS)


@query("d04_incremental_resample", f"WITH {bars_sql()}, {RESAMPLED} SELECT {PLAIN_BARS} FROM coarse")
def rebuilt(spark, sf_dir):
    """Stored days up to the 20th, the last of them half done: the rebuild equals a full one."""
    base = bars(spark, sf_dir)
    half = base.where(F.col("t") < F.lit(1_704_067_200 + 20 * 86400 + 43200))
    return rounded(B.rebuild(base, B.resample(half, 86400), 86400)).select("symbol", "t", *BAR_COLUMNS)


@query("d05_metrics_to_buckets", """
WITH fine AS (
  SELECT event_type AS symbol, epoch_us(ts) // 1000000 AS t, event_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE value END AS level, value / 2 AS flow FROM events),
b AS (SELECT *, (t // 900) * 900 AS bucket FROM fine)
SELECT symbol, bucket AS t, round(arg_max(level, (t * 100000 + event_id)) FILTER (WHERE level IS NOT NULL), 6) AS level, round(avg(flow), 6) AS flow, count(*) AS src_rows FROM b GROUP BY symbol, bucket
""")  # fmt: skip
def metrics(spark, sf_dir):
    """Last known level and mean flow of each quarter hour; time and event in one key, so that ties have an order."""
    at = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    fine = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), at.alias("t"), (at * 100000 + F.col("event_id")).alias("seq"), F.when(F.col("user_id") % 7 != 0, F.col("value")).alias("level"), (F.col("value") / 2).alias("flow")
    )
    return rounded(B.aggregate_levels(fine, 900, ["level"], ["flow"], "seq"))


@query("c03_as_of_closed_bar", f"""WITH {bars_sql()}, {RESAMPLED},
closed AS (SELECT symbol, t + 86400 AS since, close AS tf_close, high AS tf_high FROM coarse)
SELECT b.symbol, b.t, round(b.close, 6) AS close, round(c.tf_close, 6) AS tf_close, round(c.tf_high, 6) AS tf_high FROM bars b ASOF LEFT JOIN closed c ON b.symbol = c.symbol AND b.t >= c.since""")
def as_of(spark, sf_dir):
    base = bars(spark, sf_dir)
    return rounded(B.as_of_closed(base, B.resample(base, 86400), 86400, ["close", "high"]).select("symbol", "t", "close", "tf_close", "tf_high"))


@query("e01_recursive_indicators", f"WITH RECURSIVE {indicators_sql()} SELECT symbol, t, {r6('ema_day', 'ema_week', 'ema_20', 'atr', 'rsi')} FROM ind")
def recursive_indicators(spark, sf_dir):
    return rounded(indicator_bars(spark, sf_dir).select("symbol", "t", "ema_day", "ema_week", "ema_20", "atr", "rsi"))


def roll(fn: str, x: str, n: int, least: int) -> str:
    """A rolling aggregate with a least count, over windows named by their length."""
    return f"CASE WHEN count({x}) OVER w{n} >= {least} THEN {fn}({x}) OVER w{n} END"


def frames(*lengths: int) -> str:
    return "WINDOW w AS (PARTITION BY symbol ORDER BY t), " + ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in lengths)


def position(n: int) -> str:
    top, low = roll("max", "high", n, n // 2), roll("min", "low", n, n // 2)
    x = f"(close - ({low})) / nullif(({top}) - ({low}), 0)"
    return f"CASE WHEN {x} IS NOT NULL THEN least(1.0, greatest(0.0, {x})) END"


def clamp(x: str) -> str:
    """Null stays null."""
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE least(1.0, greatest(0.0, {x})) END"


RETURNS = f"""
steps AS (SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY t) AS ret FROM ind),
ret AS (SELECT *, {roll('stddev_samp', 'ret', 24, 12)} AS rv_day, {roll('stddev_samp', 'ret', 168, 84)} AS rv_week, round(atr / close, 12) AS atr_share,
  {clamp('taker_buy_base / nullif(volume, 0)')} AS share, ln(1 + volume) AS log_volume, CAST(volume AS DOUBLE) AS vol,
  round({roll('stddev_samp', 'ret', 24, 12)}, 12) AS rv_level FROM steps {frames(24, 168)})"""


def rank_sql(x: str) -> str:
    l = f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER w672"
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER w672 >= 168 THEN (len(list_filter({l}, lambda v: v < {x})) + (len(list_filter({l}, lambda v: v = {x})) + 1) / 2.0) / len({l}) END"


FEATURES = {
    **{f"ret_{n}": f"(ln(close) - lag(ln(close), {k}) OVER w) / (nullif(rv_day, 0) * sqrt({k}.0))" for n, k in (("1h", 1), ("4h", 4), ("1d", 24), ("1w", 168))},
    "rv_ratio": "ln(nullif(rv_day, 0) / nullif(rv_week, 0))",
    "rv_rank": rank_sql("rv_level"),
    "atr_rank": rank_sql("atr_share"),
    "range_exp": f"ln(CASE WHEN {roll('avg', '(high - low)', 24, 12)} > 0 THEN greatest(0.001, (high - low) / nullif({roll('avg', '(high - low)', 24, 12)}, 0)) END)",
    "pos_1d": position(24),
    "pos_1w": position(168),
    "pos_1m": position(672),
    "dd_from_high": f"(close - ({roll('max', 'high', 672, 336)})) / nullif(atr, 0)",
    "dist_ema_1d": "(close - ema_day) / nullif(atr, 0)",
    "dist_ema_1w": "(close - ema_week) / nullif(atr, 0)",
    "slope_ema_1d": "(ema_day - lag(ema_day, 24) OVER w) / nullif(atr, 0)",
    "slope_ema_1w": "(ema_week - lag(ema_week, 168) OVER w) / nullif(atr, 0)",
    "trend_align": "(ema_day - ema_week) / nullif(atr, 0)",
    "vol_z": f"(log_volume - ({roll('avg', 'log_volume', 24, 12)})) / nullif({roll('stddev_samp', 'log_volume', 24, 12)}, 0)",
    "vol_ratio": f"ln(nullif({roll('avg', 'vol', 24, 12)}, 0) / nullif({roll('avg', 'vol', 168, 84)}, 0))",
    "taker_bias": f"({roll('avg', 'share', 24, 12)}) - 0.5",
    "rsi": "rsi / 100",
    "up_bar_share": roll("avg", "CASE WHEN close > open THEN 1.0 ELSE 0.0 END", 24, 12),
    "ret_skew": "CASE WHEN count(ret) OVER w24 >= 12 THEN skewness(ret) OVER w24 END",
}
@query("k00_base_features", f"WITH RECURSIVE {indicators_sql()}, {RETURNS} SELECT symbol, t, {', '.join(f'round({x}, 6) AS {n}' for n, x in FEATURES.items())} FROM ret {frames(24, 168, 672)}")
def base_features(spark, sf_dir):
    return rounded(X.base_features(indicator_bars(spark, sf_dir)))


STEP = "pow(10.0, floor(log10(close)) - 1)"
ATOMS = {
    "breakout_1d_high": "close > lag(top_day) OVER w",
    "breakdown_1d_low": "close < lag(low_day) OVER w",
    "breakout_1w_high": "close > lag(top_week) OVER w",
    "breakdown_1w_low": "close < lag(low_week) OVER w",
    "wide_range_bar": "high - low > 2.0 * mean_range",
    "inside_bar": "high <= lag(high) OVER w AND low >= lag(low) OVER w",
    "vol_expansion": "rv_day > 1.5 * rv_week",
    "vol_contraction": "rv_day < 0.6 * rv_week",
    "atr_spike": "high - low > 3.0 * atr",
    "volume_spike": "volume > 3.0 * mean_volume",
    "volume_dry": "volume < 0.3 * mean_volume",
    "ema_cross_up": "close - ema_day > 0 AND lag(close - ema_day) OVER w <= 0",
    "ema_cross_down": "close - ema_day < 0 AND lag(close - ema_day) OVER w >= 0",
    "rsi_overbought": "rsi > 70",
    "rsi_oversold": "rsi < 30",
    "momentum_reversal_up": "rsi > 30 AND lag(rsi) OVER w <= 30",
    "momentum_reversal_down": "rsi < 70 AND lag(rsi) OVER w >= 70",
    "at_range_high": "pos > 0.85",
    "at_range_low": "pos < 0.15",
    "round_level_touch": f"close > 0 AND least(close - floor(close / {STEP}) * {STEP}, {STEP} - (close - floor(close / {STEP}) * {STEP})) < {STEP} * 0.05",
    "taker_buy_dominance": "share > 0.60",
    "taker_sell_dominance": "share < 0.40",
    "trend_up_align": "close > ema_day AND ema_day > ema_week",
    "trend_down_align": "close < ema_day AND ema_day < ema_week",
    "mid_range": "pos BETWEEN 0.40 AND 0.60",
    "asia_session": "(t // 3600) % 24 < 8",
    "europe_session": "(t // 3600) % 24 >= 8 AND (t // 3600) % 24 < 14",
    "us_session": "(t // 3600) % 24 >= 14 AND (t // 3600) % 24 < 22",
    "weekend": "((t // 86400) + 3) % 7 >= 5",
}
ATOM_SQL = f"""{RETURNS},
wide AS (SELECT *, {roll('max', 'high', 24, 1)} AS top_day, {roll('min', 'low', 24, 1)} AS low_day, {roll('max', 'high', 168, 24)} AS top_week, {roll('min', 'low', 168, 24)} AS low_week,
  {roll('avg', '(high - low)', 24, 1)} AS mean_range, {roll('avg', 'vol', 24, 1)} AS mean_volume, {FEATURES['pos_1w']} AS pos FROM ret {frames(24, 168)}),
atoms AS (SELECT symbol, t, {', '.join(f'coalesce({x}, false) AS {n}' for n, x in ATOMS.items())} FROM wide WINDOW w AS (PARTITION BY symbol ORDER BY t))"""


@query("b05_atoms", f"WITH RECURSIVE {indicators_sql()}, {ATOM_SQL} SELECT * FROM atoms")
def atoms(spark, sf_dir):
    return X.atoms(indicator_bars(spark, sf_dir))


def _mask(names) -> str:
    return " + ".join(f"CASE WHEN {n} THEN {1 << i} ELSE 0 END" for i, n in enumerate(names))


def _names(names, column) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN ({column} >> {i}) & 1 = 1 THEN '{n}' END" for i, n in enumerate(names)) + "], lambda x: x IS NOT NULL), ',')"


_FAMILIES = "list_filter([" + ", ".join(f"CASE WHEN (mask >> {i}) & 1 = 1 THEN '{f}' END" for i, f in enumerate(X.SIGNATURE.values())) + "], lambda x: x IS NOT NULL)"
BLOCKS = f"""{ATOM_SQL},
masks AS (SELECT symbol, t, CAST({_mask(X.SIGNATURE)} AS BIGINT) AS mask, CAST({_mask(X.CONTEXT)} AS BIGINT) AS context_mask FROM atoms),
blocks AS (SELECT symbol, t, mask, context_mask, 'event_block_' || lpad(CAST(CAST('0x' || substr(sha1(CAST(mask AS VARCHAR)), 1, 8) AS BIGINT) % 1000000 AS VARCHAR), 6, '0') AS event_block_id,
  {_names(X.SIGNATURE, 'mask')} AS atoms, {_names(X.CONTEXT, 'context_mask')} AS context_atoms, bit_count(mask) AS atom_count, len(list_distinct({_FAMILIES})) AS family_count,
  array_to_string(list_sort(list_distinct({_FAMILIES})), ',') AS families FROM masks)"""


def _blocks(spark, sf_dir):
    return X.event_blocks(X.atoms(indicator_bars(spark, sf_dir)))


@query("k10_event_blocks", f"""WITH RECURSIVE {indicators_sql()}, {BLOCKS}
SELECT symbol, t, mask, context_mask, event_block_id, atoms, context_atoms, CAST(atom_count AS INT) AS atom_count, CAST(family_count AS INT) AS family_count, families,
  CASE WHEN atom_count <= 2 THEN 'sparse' WHEN atom_count <= 5 THEN 'moderate' ELSE 'dense' END AS intensity FROM blocks""")
def event_blocks(spark, sf_dir):
    text = lambda c: F.array_join(c, ",").alias(c)
    return _blocks(spark, sf_dir).select("symbol", "t", "mask", "context_mask", "event_block_id", text("atoms"), text("context_atoms"), "atom_count", "family_count", text("families"), "intensity")


@query("d11_block_statistics", f"""WITH RECURSIVE {indicators_sql()}, {BLOCKS},
s AS (SELECT symbol, event_block_id, count(*) AS total_rows, CAST(median(atom_count) AS INT) AS atom_count, arg_max(families, t) AS families FROM blocks GROUP BY symbol, event_block_id),
q AS (SELECT *, total_rows * 1.0 / sum(total_rows) OVER (PARTITION BY symbol) AS row_share FROM s)
SELECT symbol, event_block_id, total_rows, atom_count, families, round(row_share, 6) AS row_share,
  CASE WHEN row_share < 0.002 THEN 'rare' WHEN row_share < 0.01 THEN 'uncommon' ELSE 'common' END AS rarity FROM q""")
def block_statistics(spark, sf_dir):
    stats = X.block_statistics(_blocks(spark, sf_dir))
    return rounded(stats.select("symbol", "event_block_id", "total_rows", "atom_count", F.array_join("families", ",").alias("families"), "row_share", "rarity"))


SWINGS = """
around AS (SELECT *, count(*) OVER a = 7 AS whole, max(high) OVER a AS top, min(low) OVER a AS bottom FROM ind WINDOW a AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
late AS (SELECT *, lag(CASE WHEN whole AND high = top THEN high END, 3) OVER w AS sh, lag(CASE WHEN whole AND low = bottom THEN low END, 3) OVER w AS sl FROM around WINDOW w AS (PARTITION BY symbol ORDER BY t)),
swings AS (SELECT * EXCLUDE (whole, top, bottom, sh, sl), last_value(sh IGNORE NULLS) OVER u AS swing_high, last_value(sl IGNORE NULLS) OVER u AS swing_low FROM late
  WINDOW u AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("e13_confirmed_swings", f"WITH RECURSIVE {indicators_sql()}, {SWINGS} SELECT symbol, t, {r6('swing_high', 'swing_low')} FROM swings")
def swings(spark, sf_dir):
    return rounded(S.swings(indicator_bars(spark, sf_dir)).select("symbol", "t", "swing_high", "swing_low"))


@query("k01_gaps", f"""WITH RECURSIVE {indicators_sql()}, g AS (SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2 FROM ind WINDOW w AS (PARTITION BY symbol ORDER BY t))
SELECT symbol, t, round(CASE WHEN low > h2 THEN h2 END, 6) AS bull_lo, round(CASE WHEN low > h2 THEN low END, 6) AS bull_hi, round(CASE WHEN low > h2 THEN (low - h2) / nullif(atr, 0) END, 6) AS bull_atr,
  round(CASE WHEN high < l2 THEN high END, 6) AS bear_lo, round(CASE WHEN high < l2 THEN l2 END, 6) AS bear_hi, round(CASE WHEN high < l2 THEN (l2 - high) / nullif(atr, 0) END, 6) AS bear_atr
FROM g WHERE low > h2 OR high < l2""")
def gaps(spark, sf_dir):
    found = S.gaps(indicator_bars(spark, sf_dir)).where("bull_lo is not null or bear_lo is not null")
    return rounded(found.select("symbol", "t", "bull_lo", "bull_hi", "bull_atr", "bear_lo", "bear_hi", "bear_atr"))


@query("k03_structure_breaks", f"""WITH RECURSIVE {indicators_sql()}, {SWINGS},
runs AS (SELECT *, sum(hc) OVER u AS hr, sum(lc) OVER u AS lr FROM (
  SELECT *, CASE WHEN swing_high IS NOT NULL AND (lag(swing_high) OVER w IS NULL OR lag(swing_high) OVER w <> swing_high) THEN 1 ELSE 0 END AS hc,
    CASE WHEN swing_low IS NOT NULL AND (lag(swing_low) OVER w IS NULL OR lag(swing_low) OVER w <> swing_low) THEN 1 ELSE 0 END AS lc FROM swings WINDOW w AS (PARTITION BY symbol ORDER BY t))
  WINDOW u AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
hits AS (SELECT *, coalesce(close > swing_high, false) AS o, coalesce(close < swing_low, false) AS v FROM runs),
firsts AS (SELECT *, o AND sum(CAST(o AS INT)) OVER (PARTITION BY symbol, hr ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS up,
  v AND sum(CAST(v AS INT)) OVER (PARTITION BY symbol, lr ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS down FROM hits),
sides AS (SELECT *, CASE WHEN down THEN -1 WHEN up THEN 1 END AS side, CASE WHEN up OR down THEN n END AS broke FROM firsts),
known AS (SELECT *, coalesce(last_value(side IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  coalesce(last_value(side IGNORE NULLS) OVER u, 0) AS bias, last_value(broke IGNORE NULLS) OVER u AS last FROM sides WINDOW u AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT symbol, t, up AND before >= 0 AS bos_up, up AND before < 0 AS choch_up, down AND CASE WHEN up THEN 1 ELSE before END <= 0 AS bos_down, down AND CASE WHEN up THEN 1 ELSE before END > 0 AS choch_down,
  bias > 0 AS structure_bullish, round(CASE WHEN last IS NULL THEN 1.0 ELSE least(1.0, ln(1 + n - last) / ln(2689.0)) END, 6) AS bars_since_structure_break FROM known""")
def breaks(spark, sf_dir):
    found = S.breaks(S.swings(indicator_bars(spark, sf_dir)))
    return rounded(found.select("symbol", "t", "bos_up", "choch_up", "bos_down", "choch_down", "structure_bullish", "bars_since_structure_break"))


@query("k06_premium_discount", f"""WITH RECURSIVE {indicators_sql()}, {SWINGS}, p AS (SELECT symbol, t,
  CASE WHEN swing_high IS NULL OR swing_low IS NULL OR swing_high <= swing_low THEN 0.5 ELSE least(1.0, greatest(0.0, (close - swing_low) / (swing_high - swing_low))) END AS place,
  swing_high > swing_low AS known FROM swings)
SELECT symbol, t, round(place, 6) AS place, coalesce(known AND place < 0.382, false) AS in_discount, coalesce(known AND place > 0.618, false) AS in_premium FROM p""")
def premium(spark, sf_dir):
    s = S.swings(indicator_bars(spark, sf_dir)).withColumn("place", S.premium_discount(F.col("close"), F.col("swing_high"), F.col("swing_low")))
    known = F.coalesce(F.col("swing_high") > F.col("swing_low"), F.lit(False))
    return s.select("symbol", "t", F.round("place", 6).alias("place"), (known & (F.col("place") < S.DISCOUNT)).alias("in_discount"), (known & (F.col("place") > S.PREMIUM)).alias("in_premium"))


@query("k02_k04_k05_zones")
def zones(spark, sf_dir):
    """Registries of gaps, order blocks and liquidity levels: order-dependent, so tested against a plain version."""
    return rounded(S.zones(indicator_bars(spark, sf_dir)))


@query("e07_rolling_rank", f"""WITH {bars_sql()} SELECT symbol, t, round(CASE WHEN count(close) OVER w >= 12 THEN (len(list_filter(list(close) OVER w, lambda v: v < close)) + (len(list_filter(list(close) OVER w, lambda v: v = close)) + 1) / 2.0) / count(close) OVER w END, 6) AS rank
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)""")
def rolling_rank(spark, sf_dir):
    return rounded(W.rank_in_window(bars(spark, sf_dir).select("symbol", "t", "close"), "close", 48, 12).drop("close"))


@query("e08_rolling_moments", f"""WITH {bars_sql()} SELECT symbol, t, round(avg(close) OVER w, 6) AS mean, round(stddev_samp(close) OVER w, 6) AS std, round(CASE WHEN count(*) OVER w >= 12 THEN (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) END, 6) AS z,
  max(close) OVER w AS top, min(close) OVER w AS bottom, bool_or(close > open) OVER w AS rose FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def moments(spark, sf_dir):
    w, c = W.trailing(24), F.col("close")
    return bars(spark, sf_dir).select(
        "symbol", "t", F.round(F.avg(c).over(w), 6).alias("mean"), F.round(F.stddev_samp(c).over(w), 6).alias("std"), F.round(W.zscore(c, 24), 6).alias("z"),
        F.max(c).over(w).alias("top"), F.min(c).over(w).alias("bottom"), F.bool_or(c > F.col("open")).over(w).alias("rose"),
    )


@query("e11_rolling_beta", f"""WITH {bars_sql()}, r AS (SELECT symbol, t, close / lag(close) OVER (PARTITION BY symbol ORDER BY t) - 1 AS ret FROM bars), m AS (SELECT *, avg(ret) OVER (PARTITION BY t) AS market FROM r)
SELECT symbol, t, round(covar_samp(ret, market) OVER w / nullif(var_samp(market) OVER w, 0), 6) AS beta FROM m WHERE ret IS NOT NULL
WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 71 PRECEDING AND CURRENT ROW)""")
def beta(spark, sf_dir):
    r = bars(spark, sf_dir).withColumn("ret", F.col("close") / F.lag("close").over(W.ordered()) - 1)
    m = r.withColumn("market", F.avg("ret").over(Window.partitionBy("t"))).where("ret is not null")
    w = W.trailing(72)
    return m.select("symbol", "t", F.round(F.covar_samp("ret", "market").over(w) / F.nullif(F.var_samp("market").over(w), F.lit(0.0)), 6).alias("beta"))


@query("e22_rank_across_symbols", f"""WITH {bars_sql()}, r AS (SELECT symbol, t, close / lag(close, 4) OVER (PARTITION BY symbol ORDER BY t) - 1 AS ret FROM bars), k AS (SELECT * FROM r WHERE ret IS NOT NULL),
c AS (SELECT *, rank() OVER (PARTITION BY t ORDER BY ret) AS place, count(*) OVER (PARTITION BY t, ret) AS ties, count(*) OVER (PARTITION BY t) AS n FROM k)
SELECT symbol, t, round(CASE WHEN n >= 4 THEN (place + (ties - 1) / 2.0) / n END, 6) AS rank FROM c""")
def rank_across(spark, sf_dir):
    r = bars(spark, sf_dir).withColumn("ret", F.col("close") / F.lag("close", 4).over(W.ordered()) - 1)
    return r.withColumn("rank", F.round(W.rank_across(F.col("ret")), 6)).where("ret is not null").select("symbol", "t", "rank")


@query("e27_range_estimators", f"""WITH {bars_sql()}, e AS (SELECT symbol, t, pow(ln(high / low), 2) / (4 * ln(2)) AS pk, 0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2) AS gk,
  ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs FROM bars)
SELECT symbol, t, {', '.join(f"round(CASE WHEN count(*) OVER w >= 12 AND avg({x}) OVER w > 1e-12 THEN 0.5 * ln(avg({x}) OVER w) END, 6) AS {n}" for n, x in (('parkinson', 'pk'), ('garman_klass', 'gk'), ('rogers_satchell', 'rs')))}
FROM e WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def range_estimators(spark, sf_dir):
    """Variance estimators from bar ranges; half the log of their mean over a day."""
    b, ln = bars(spark, sf_dir), lambda a, b: W.log_ratio(F.col(a), F.col(b))
    hl, co = ln("high", "low"), ln("close", "open")
    two = F.ln(F.lit(2.0))
    b = b.withColumns({
        "pk": hl * hl / (4 * two), "gk": 0.5 * hl * hl - (2 * two - 1) * co * co,
        "rs": ln("high", "close") * ln("high", "open") + ln("low", "close") * ln("low", "open"),
    })
    w = W.trailing(24)
    log = lambda x: F.round(F.when((F.count(F.lit(1)).over(w) >= 12) & (F.avg(x).over(w) > 1e-12), 0.5 * F.ln(F.avg(x).over(w))), 6)
    return b.select("symbol", "t", log("pk").alias("parkinson"), log("gk").alias("garman_klass"), log("rs").alias("rogers_satchell"))


@query("e26_har_columns", f"""WITH {bars_sql()}, s AS (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY t)) AS ret FROM bars)
SELECT symbol, t, {', '.join(f"round(ln(nullif({roll('stddev_samp', 'ret', n, n // 2)}, 0)), 6) AS har_{k}" for k, n in (('day', 24), ('week', 168), ('month', 720)))} FROM s {frames(24, 168, 720)}""")
def har(spark, sf_dir):
    """Log volatility over a day, a week and thirty days."""
    b = bars(spark, sf_dir).withColumn("ret", F.ln("close") - F.ln(F.lag("close").over(W.ordered())))
    log = lambda n: F.round(F.ln(F.nullif(W.rolling(F.stddev_samp, F.col("ret"), n, n // 2), F.lit(0.0))), 6)
    return b.select("symbol", "t", log(24).alias("har_day"), log(168).alias("har_week"), log(720).alias("har_month"))


@query("l11_range_fields", f"""WITH {bars_sql()}, view AS (SELECT symbol, t, (high - low) / close AS p50, 1.5 * ((high - low) / close) AS p90 FROM bars WHERE t % 7200 = 0)
SELECT b.symbol, b.t, round(p50, 6) AS expected_range_ratio_p50, round(p90, 6) AS expected_range_ratio_p90, CASE WHEN p50 < 0.85 THEN 'compressed' WHEN p50 > 1.15 THEN 'expanded' WHEN p50 IS NOT NULL THEN 'normal' END AS range_regime
FROM bars b LEFT JOIN view v ON v.symbol = b.symbol AND v.t = b.t""")
def range_fields(spark, sf_dir):
    """Forecast fields of a bar where a forecast is known, null elsewhere."""
    b = bars(spark, sf_dir)
    span = (F.col("high") - F.col("low")) / F.col("close")
    view = b.where("t % 7200 = 0").select("symbol", "t", span.alias("p50"), (1.5 * span).alias("p90"))
    regime = F.when(F.col("p50") < 0.85, "compressed").when(F.col("p50") > 1.15, "expanded").when(F.col("p50").isNotNull(), "normal")
    return b.join(view, ["symbol", "t"], "left").select("symbol", "t", F.round("p50", 6).alias("expected_range_ratio_p50"), F.round("p90", 6).alias("expected_range_ratio_p90"), regime.alias("range_regime"))
