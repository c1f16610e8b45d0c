"""Price structure: swings, gaps, breaks of structure natively; the registries of zones and levels as a stateful kernel.

The kernel steps through a symbol's bars in order and keeps zones and levels as objects, so the same
``StructureState`` serves the batch kernel and the stream (see ``tidemark.streaming.structure``).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log1p

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators.windows import last_known, ordered

LEFT = RIGHT = 3
#: Settings of the kernel. Ages and spans in bars, sizes in average true ranges. Fixed values.
ZONE_AGE, LEVEL_AGE, LOOKBACK, RECLAIM = 672, 2688, 20, 4
LARGE_GAP, TOLERANCE, DISCOUNT, PREMIUM, COUNT_SCALE = 0.7, 0.25, 0.382, 0.618, 10


def swings(bars: DataFrame) -> DataFrame:
    """Adds swing_high and swing_low: the last extremum of LEFT bars before to RIGHT bars after, known RIGHT bars late."""
    around = ordered().rowsBetween(-LEFT, RIGHT)
    whole = F.count(F.lit(1)).over(around) == LEFT + RIGHT + 1
    top = F.when(whole & (F.col("high") == F.max("high").over(around)), F.col("high"))
    bottom = F.when(whole & (F.col("low") == F.min("low").over(around)), F.col("low"))
    late = bars.withColumns({"top": top, "bottom": bottom}).withColumns({"top": F.lag("top", RIGHT).over(ordered()), "bottom": F.lag("bottom", RIGHT).over(ordered())})
    return late.withColumns({"swing_high": last_known(F.col("top")), "swing_low": last_known(F.col("bottom"))}).drop("top", "bottom")


def gaps(bars: DataFrame) -> DataFrame:
    """Adds the bounds of three-bar gaps, bull and bear, and their size in average true ranges."""
    high2, low2 = F.lag("high", 2).over(ordered()), F.lag("low", 2).over(ordered())
    marked = bars.withColumns({"high2": high2, "low2": low2})
    atr = F.nullif(F.col("atr"), F.lit(0.0))
    bull, bear = F.col("low") > F.col("high2"), F.col("high") < F.col("low2")
    return marked.withColumns(
        {
            "bull_lo": F.when(bull, F.col("high2")),
            "bull_hi": F.when(bull, F.col("low")),
            "bull_atr": F.when(bull, (F.col("low") - F.col("high2")) / atr),
            "bear_lo": F.when(bear, F.col("high")),
            "bear_hi": F.when(bear, F.col("low2")),
            "bear_atr": F.when(bear, (F.col("low2") - F.col("high")) / atr),
        }
    ).drop("high2", "low2")


def breaks(with_swings: DataFrame) -> DataFrame:
    """Breaks of structure, natively: the first close beyond each confirmed swing value.

    A swing value holds while it doesn't change; only its first crossing breaks. A break that turns the
    bias (the side of the last break) is a change of character, any other goes on. When one bar breaks both ways the
    break up comes first.
    """
    w = ordered()
    run = lambda c: F.sum((F.col(c).isNotNull() & (F.lag(c).over(w).isNull() | (F.lag(c).over(w) != F.col(c)))).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = with_swings.withColumns({"high_run": run("swing_high"), "low_run": run("swing_low")})
    crossed = numbered.withColumns({"over": F.coalesce(F.col("close") > F.col("swing_high"), F.lit(False)), "under": F.coalesce(F.col("close") < F.col("swing_low"), F.lit(False))})
    first = lambda hit, by: F.col(hit) & (F.sum(F.col(hit).cast("long")).over(Window.partitionBy("symbol", by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)) == 1)
    broken = crossed.withColumns({"up": first("over", "high_run"), "down": first("under", "low_run")})
    side = F.when(F.col("down"), -1).when(F.col("up"), 1)
    before = F.coalesce(F.last(side, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = broken.withColumns({"before": before, "bias": F.coalesce(F.last(side, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))})
    middle = F.when(F.col("up"), 1).otherwise(F.col("before"))
    place = F.row_number().over(w)
    out = told.withColumn("place", place).withColumns(
        {
            "bos_up": F.col("up") & (F.col("before") >= 0),
            "choch_up": F.col("up") & (F.col("before") < 0),
            "bos_down": F.col("down") & (middle <= 0),
            "choch_down": F.col("down") & (middle > 0),
            "structure_bullish": F.col("bias") > 0,
        }
    )
    last = F.last(F.when(F.col("up") | F.col("down"), F.col("place")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    age = F.when(last.isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.log1p(F.col("place") - last) / F.lit(log1p(LEVEL_AGE))))
    return out.withColumn("bars_since_structure_break", age).drop("high_run", "low_run", "over", "under", "up", "down", "before", "bias", "place")


def premium_discount(close: Column, high: Column, low: Column) -> Column:
    """Place of the close between the swings, 0.5 when they are unknown or crossed."""
    inside = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (close - low) / F.nullif(high - low, F.lit(0.0))))
    return F.when(high.isNull() | low.isNull() | (high <= low), F.lit(0.5)).otherwise(inside)


def proximity(atrs: float) -> float:
    """1 at the price, falling with the distance in average true ranges."""
    return 1.0 / (1.0 + abs(atrs))


def signed(atrs: float) -> float:
    return proximity(atrs) if atrs >= 0 else -proximity(atrs)


@dataclass
class Zone:
    """A gap or an order block."""

    side: int
    lo: float
    hi: float
    born: int
    filled: float = 0.0
    touches: int = 0
    inside: bool = False
    breaker: bool = False

    def away(self, price: float) -> float:
        return (self.lo + self.hi) / 2 - price


@dataclass
class Level:
    price: float
    seen: int
    strength: int = 1
    swept: bool = False


@dataclass
class StructureState:
    """What is known of one symbol after a bar; ``step`` takes the next bar and says what it shows."""

    t: int = -1
    gaps: list[Zone] = field(default_factory=list)
    blocks: list[Zone] = field(default_factory=list)
    levels: dict[int, list[Level]] = field(default_factory=lambda: {1: [], -1: []})
    waiting: list[tuple[int, float, int]] = field(default_factory=list)
    bias: int = 0
    swing: dict[int, float | None] = field(default_factory=lambda: {1: None, -1: None})
    used: dict[int, bool] = field(default_factory=lambda: {1: False, -1: False})
    recent: list[tuple[float, float, float, float]] = field(default_factory=list)

    def step(self, bar: dict) -> dict:
        """bar: open, high, low, close, atr (positive), swings and gap bounds, None where unknown."""
        self.t += 1
        self.recent = [*self.recent[-LOOKBACK:], (bar["open"], bar["high"], bar["low"], bar["close"])]
        self._age_zones(bar)
        out = self._sweeps(bar)
        self._note_swings(bar)
        self._break_structure(bar)
        large = False
        for side, name in ((1, "bull"), (-1, "bear")):
            if bar[f"{name}_lo"] is not None:
                self.gaps.append(Zone(side, bar[f"{name}_lo"], bar[f"{name}_hi"], self.t))
                large |= bar[f"{name}_hi"] - bar[f"{name}_lo"] > LARGE_GAP * bar["atr"]
        return out | {"fvg_formed_large": large} | self._near_gaps(bar) | self._near_blocks(bar) | self._near_levels(bar)

    def _age_zones(self, bar: dict) -> None:
        for z in self.gaps:
            reached = z.hi - bar["low"] if z.side > 0 else bar["high"] - z.lo
            z.filled = min(1.0, max(z.filled, reached / (z.hi - z.lo)))
        self.gaps = [z for z in self.gaps if z.filled < 1.0 and self.t - z.born <= ZONE_AGE]
        for z in self.blocks:
            touching = bar["low"] <= z.hi and bar["high"] >= z.lo
            z.touches += touching and not z.inside
            z.inside = touching
            if not z.breaker and (bar["close"] < z.lo if z.side > 0 else bar["close"] > z.hi):
                z.side, z.breaker = -z.side, True
        self.blocks = [z for z in self.blocks if self.t - z.born <= ZONE_AGE]

    def _sweeps(self, bar: dict) -> dict:
        out = dict.fromkeys(("sweep_high", "sweep_low", "sweep_high_reclaim", "sweep_low_reclaim"), False)
        for side, name in ((1, "high"), (-1, "low")):
            for level in self.levels[side]:
                if level.strength > 1 and not level.swept and (bar[name] - level.price) * side > 0:
                    level.swept = out[f"sweep_{name}"] = True
                    self.waiting.append((side, level.price, self.t))
        left = []
        for side, price, born in self.waiting:
            if (price - bar["close"]) * side > 0:
                out[f"sweep_{'high' if side > 0 else 'low'}_reclaim"] = True
            elif self.t - born < RECLAIM:
                left.append((side, price, born))
        self.waiting = left
        return out

    def _note_swings(self, bar: dict) -> None:
        for side, name in ((1, "swing_high"), (-1, "swing_low")):
            price = bar[name]
            if price is None or price == self.swing[side]:
                continue
            self.swing[side], self.used[side] = price, False
            near = next((x for x in self.levels[side] if abs(x.price - price) <= bar["atr"] * TOLERANCE), None)
            if near is None:
                self.levels[side].append(Level(price, self.t))
            else:
                near.price = (near.price * near.strength + price) / (near.strength + 1)
                near.strength, near.seen, near.swept = near.strength + 1, self.t, False
        if self.t % 64 == 0:
            for side in self.levels:
                self.levels[side] = [x for x in self.levels[side] if self.t - x.seen <= LEVEL_AGE]

    def _break_structure(self, bar: dict) -> None:
        for side, name in ((1, "swing_high"), (-1, "swing_low")):
            price = bar[name]
            if price is None or self.used[side] or (bar["close"] - price) * side <= 0:
                continue
            self.used[side], self.bias = True, side
            for o, h, lo, c in reversed(self.recent):
                if (c < o) == (side > 0):
                    self.blocks.append(Zone(side, lo, h, self.t))
                    break

    def _near_gaps(self, bar: dict) -> dict:
        out = {"in_unfilled_fvg": any(z.lo <= bar["close"] <= z.hi for z in self.gaps), "near_fvg_bull": 0.0, "near_fvg_bear": 0.0, "fvg_fill_pct": 0.0}
        by = lambda z: abs(z.away(bar["close"]))
        if self.gaps:
            out["fvg_fill_pct"] = min(self.gaps, key=by).filled
        for side, name in ((1, "bull"), (-1, "bear")):
            if some := [z for z in self.gaps if z.side == side]:
                out[f"near_fvg_{name}"] = signed(min(some, key=by).away(bar["close"]) / bar["atr"])
        return out

    def _near_blocks(self, bar: dict) -> dict:
        out = {"in_bullish_ob": False, "in_bearish_ob": False, "in_breaker": False, "near_ob": 0.0, "ob_age_norm": 0.0, "ob_touch_count_norm": 0.0}
        for z in self.blocks:
            if z.lo <= bar["close"] <= z.hi:
                out["in_breaker" if z.breaker else "in_bullish_ob" if z.side > 0 else "in_bearish_ob"] = True
        if self.blocks:
            z = min(self.blocks, key=lambda z: abs(z.away(bar["close"])))
            out["near_ob"] = signed(z.away(bar["close"]) / bar["atr"])
            out["ob_age_norm"] = min(1.0, log1p(self.t - z.born) / log1p(ZONE_AGE))
            out["ob_touch_count_norm"] = min(1.0, log1p(z.touches) / log1p(COUNT_SCALE))
        return out

    def _near_levels(self, bar: dict) -> dict:
        beyond = {side: [((x.price - bar["close"]) * side, x) for x in self.levels[side] if (x.price - bar["close"]) * side > 0] for side in self.levels}
        nearest = {side: min(some, key=lambda p: p[0], default=None) for side, some in beyond.items()}
        pools = [gap for some in beyond.values() for gap, x in some if x.strength > 1]
        near = lambda gap: 0.0 if gap is None else proximity(gap / bar["atr"])
        strength = max([0, *(x[1].strength for x in nearest.values() if x)])
        return {
            "near_resistance": near(nearest[1] and nearest[1][0]),
            "near_support": near(nearest[-1] and nearest[-1][0]),
            "near_liquidity": near(min(pools, default=None)),
            "level_strength_norm": min(1.0, log1p(strength) / log1p(COUNT_SCALE)),
            "eqh_above": any(x.strength > 1 for _, x in beyond[1]),
            "eql_below": any(x.strength > 1 for _, x in beyond[-1]),
        }


FLAGS = ("sweep_high", "sweep_low", "sweep_high_reclaim", "sweep_low_reclaim", "fvg_formed_large", "in_unfilled_fvg", "in_bullish_ob", "in_bearish_ob", "in_breaker", "eqh_above", "eql_below")
NUMBERS = ("near_fvg_bull", "near_fvg_bear", "fvg_fill_pct", "near_ob", "ob_age_norm", "ob_touch_count_norm", "near_resistance", "near_support", "near_liquidity", "level_strength_norm")
INPUT = ("open", "high", "low", "close", "atr", "swing_high", "swing_low", "bull_lo", "bull_hi", "bear_lo", "bear_hi")
ZONES_SQL = "symbol string, t long, " + ", ".join(f"{x} boolean" for x in FLAGS) + ", " + ", ".join(f"{x} double" for x in NUMBERS)


def known(x):
    return None if x is None or x != x else x


def _zones(bars: pd.DataFrame) -> pd.DataFrame:
    bars = bars.sort_values("t", ignore_index=True)
    # A usable range before the average is known, and where it is zero.
    atr = bars["atr"].where(bars["atr"] != 0).ffill().bfill()
    spread = float((bars["high"] - bars["low"]).mean())
    bars["atr"] = atr.fillna(spread if spread > 0 else 1.0)
    state = StructureState()
    rows = [state.step({k: known(v) for k, v in zip(INPUT, values, strict=True)}) for values in bars[list(INPUT)].itertuples(index=False)]
    return pd.concat([bars[["symbol", "t"]], pd.DataFrame(rows, columns=[*FLAGS, *NUMBERS])], axis=1)


def zones(bars: DataFrame) -> DataFrame:
    """Gap, order block and liquidity states of every bar (with indicators): FLAGS and NUMBERS."""
    return gaps(swings(bars)).select("symbol", "t", *INPUT).groupBy("symbol").applyInPandas(_zones, ZONES_SQL)
