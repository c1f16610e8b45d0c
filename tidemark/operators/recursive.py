"""Indicators that fold over a symbol's history in order, by a scan over stretches of time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.stretches import stretched

DAY, WEEK, MONTH = 24, 168, 672

SCHEMA_MORE = "ema_day double, ema_week double, ema_20 double, atr double, rsi double"


def smoothed(x: pd.Series, alpha: float, least: int) -> pd.Series:
    """y = alpha x + (1 - alpha) y before, from the first known value on; null until ``least`` values are known."""
    return x.ewm(alpha=alpha, adjust=False, min_periods=least).mean()


def span(n: int) -> float:
    return 2.0 / (n + 1)


def true_range(bars: pd.DataFrame) -> pd.Series:
    before = bars["close"].shift(1)
    return np.fmax(np.fmax(bars["high"] - bars["low"], (bars["high"] - before).abs()), (bars["low"] - before).abs())


def rsi(close: pd.Series, period: int = 14) -> pd.Series:
    """Relative strength: 50 on a flat window, 100 without losses."""
    move = close.diff()
    gain, loss = (smoothed(s, 1 / period, period) for s in (move.clip(lower=0), (-move).clip(lower=0)))
    return pd.Series(strength(gain.to_numpy(), loss.to_numpy()), index=close.index)


def strength(gain: np.ndarray, loss: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(loss == 0, np.where(gain == 0, 50.0, 100.0), 100 - 100 / (1 + gain / loss))
    return np.where(np.isnan(gain), np.nan, value)


def add_indicators(bars: pd.DataFrame) -> pd.DataFrame:
    bars = bars.sort_values("t", ignore_index=True)
    bars["ema_day"] = smoothed(bars["close"], span(DAY), DAY // 2)
    bars["ema_week"] = smoothed(bars["close"], span(WEEK), WEEK // 2)
    bars["ema_20"] = smoothed(bars["close"], span(20), 10)
    bars["atr"] = smoothed(true_range(bars), 1 / 14, 14)
    bars["rsi"] = rsi(bars["close"])
    return bars


#: The smoothed series: name, weight of a new value.
SERIES = (("ema_day", span(DAY)), ("ema_week", span(WEEK)), ("ema_20", span(20)), ("atr", 1 / 14), ("gain", 1 / 14), ("loss", 1 / 14))
LEAST = {"ema_day": DAY // 2, "ema_week": WEEK // 2, "ema_20": 10, "atr": 14, "gain": 14, "loss": 14}
CARRIED = ", ".join(f"{n}_y double, {n}_n long" for n, _ in SERIES)
MAPS = "symbol {0}, _stretch long, " + ", ".join(f"{n}_a double, {n}_b double, {n}_f double, {n}_c long" for n, _ in SERIES)


def inputs_of(bars: pd.DataFrame) -> dict[str, np.ndarray]:
    """The values that each series smooths."""
    move = bars["close"].diff()
    close = bars["close"].to_numpy(float)
    return {"ema_day": close, "ema_week": close, "ema_20": close, "atr": true_range(bars).to_numpy(float), "gain": move.clip(lower=0).to_numpy(float), "loss": (-move).clip(lower=0).to_numpy(float)}


def folded(x: np.ndarray, alpha: float, y: float = np.nan) -> np.ndarray:
    """y after each value of x; an unknown value leaves y as it was and weighs less what came before, as in ``smoothed``."""
    start = np.concatenate([[y], x])
    return pd.Series(start).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]


def as_map(x: np.ndarray, alpha: float) -> tuple[float, float, float, int]:
    """A stretch without unknown values as an affine map of y before it: slope, intercept; its last y if there was none before; known values."""
    ends = folded(x, alpha)
    count = int(np.isfinite(x).sum())
    slope = (1 - alpha) ** len(x)
    return slope, (folded(x, alpha, 0.0)[-1] if len(x) else 0.0), (ends[-1] if len(x) else np.nan), count


def _maps(pdf: pd.DataFrame) -> pd.DataFrame:
    """One stretch -> its maps."""
    pdf = pdf.sort_values("t", ignore_index=True)
    own = pdf["_own"].to_numpy()
    row = {"symbol": pdf["symbol"].iloc[0], "_stretch": pdf["_stretch"].iloc[0]}
    alphas = dict(SERIES)
    for name, x in inputs_of(pdf).items():
        row |= dict(zip((f"{name}_{k}" for k in "abfc"), as_map(x[own], alphas[name]), strict=True))
    return pd.DataFrame([row])


def _carried(pdf: pd.DataFrame) -> pd.DataFrame:
    """Maps of a symbol's stretches -> what each of them gets from those before it: the series' last y, and how many values they had."""
    pdf = pdf.sort_values("_stretch", ignore_index=True)
    out = pdf[["symbol", "_stretch"]].copy()
    for name, _ in SERIES:
        y, n, ys, ns = np.nan, 0, [], []
        for a, b, f, c in zip(*(pdf[f"{name}_{k}"] for k in "abfc"), strict=True):
            ys.append(y)
            ns.append(n)
            y, n = (f if np.isnan(y) else a * y + b), n + c
        out[f"{name}_y"], out[f"{name}_n"] = ys, ns
    return out


def _indicated(names: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        own = pdf["_own"].to_numpy()
        inputs, first = inputs_of(pdf), pdf.iloc[0]
        out, found = pdf[own][names].reset_index(drop=True), {}
        for name, alpha in SERIES:
            x = inputs[name][own]
            known = np.cumsum(np.isfinite(x)) + int(first[f"{name}_n"])
            found[name] = np.where(known >= LEAST[name], folded(x, alpha, float(first[f"{name}_y"])), np.nan)
        for name in ("ema_day", "ema_week", "ema_20", "atr"):
            out[name] = found[name]
        out["rsi"] = strength(found["gain"], found["loss"])
        return out

    return run


def with_indicators(bars: DataFrame) -> DataFrame:
    """Bars with exponential means, average true range and relative strength. Closes are known.

    A parallel scan: every stretch of time is an affine map of each series' value before it. Stretches are mapped as tasks
    of their own, a symbol's maps (a row for some thousand bars) are put together in order, and each stretch is then folded from what it is handed.
    """
    kind = bars.schema["symbol"].dataType.simpleString()
    cut = stretched(bars, 1)
    maps = cut.select("symbol", "t", "high", "low", "close", "_stretch", "_own").groupBy("symbol", "_stretch").applyInPandas(_maps, MAPS.format(kind))
    carried = maps.groupBy("symbol").applyInPandas(_carried, f"symbol {kind}, _stretch long, {CARRIED}").withColumnsRenamed({"symbol": "_symbol", "_stretch": "_of"})
    handed = cut.join(carried, F.col("symbol").eqNullSafe(F.col("_symbol")) & (F.col("_stretch") == F.col("_of"))).drop("_symbol", "_of")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields)
    return handed.groupBy("symbol", "_stretch").applyInPandas(_indicated(bars.columns), f"{schema}, {SCHEMA_MORE}")
