"""Statistics of a growing past, one row at a time: running quantiles, and an accumulator of outcomes.

All state grows with a key's distinct values at most, each row costs the logarithm of that, and two
accumulators of disjoint rows can be merged.
"""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass, field
from math import floor

DAY, MONTH = 86_400, 30 * 86_400


@dataclass
class RunningQuantile:
    """Linearly interpolated quantile of all values added so far, from two heaps that meet at its place."""

    p: float
    low: list[float] = field(default_factory=list)  # negated: the largest on top
    high: list[float] = field(default_factory=list)

    def add(self, x: float) -> None:
        if self.low and x < -self.low[0]:
            heapq.heappush(self.low, -x)
        else:
            heapq.heappush(self.high, x)
        wanted = floor(self.p * (len(self.low) + len(self.high) - 1)) + 1
        while len(self.low) < wanted:
            heapq.heappush(self.low, -heapq.heappop(self.high))
        while len(self.low) > wanted:
            heapq.heappush(self.high, -heapq.heappop(self.low))

    def value(self) -> float | None:
        if not self.low:
            return None
        at = self.p * (len(self.low) + len(self.high) - 1)
        a = -self.low[0]
        return a if at == floor(at) or not self.high else a + (self.high[0] - a) * (at - floor(at))

    def merge(self, other: RunningQuantile) -> None:
        for x in [-v for v in other.low] + other.high:
            self.add(x)


@dataclass
class Accumulator:
    """What the outcomes of a sample say; rows are added in any order."""

    rows: int = 0
    valid: int = 0
    ups: int = 0
    falls: int = 0
    ret_sum: float = 0.0
    sequences: set[int] = field(default_factory=set)
    days: set[int] = field(default_factory=set)
    months: Counter = field(default_factory=Counter)
    favorable: RunningQuantile = field(default_factory=lambda: RunningQuantile(0.70))
    adverse: RunningQuantile = field(default_factory=lambda: RunningQuantile(0.80))
    favorable_short: RunningQuantile = field(default_factory=lambda: RunningQuantile(0.70))
    adverse_short: RunningQuantile = field(default_factory=lambda: RunningQuantile(0.80))

    #: Spark type of ``stats``.
    SCHEMA = (
        "sample_size long, effective_sample_size long, valid_label_count long, long_outcome_count long, ret_sum double, repeatability_days long, repeatability_months long, "
        "top_month long, favorable double, adverse double, falls long, favorable_short double, adverse_short double"
    )

    def add(self, t: int, ret: float | None, mfe: float | None, mae: float | None, valid: bool, sequence: int) -> None:
        self.rows += 1
        self.sequences.add(sequence)
        self.days.add(t // DAY)
        self.months[t // MONTH] += 1
        if not valid:
            return
        self.valid += 1
        self.ret_sum += ret or 0.0
        drop, rise = max(0.0, -(mae or 0.0)), max(0.0, mfe or 0.0)
        if ret is not None and ret > 0:
            self.ups += 1
            self.favorable.add(mfe or 0.0)
            self.adverse.add(drop)
        elif ret is not None and ret < 0:
            self.falls += 1
            self.favorable_short.add(drop)
            self.adverse_short.add(rise)

    def merge(self, other: Accumulator) -> None:
        for name in ("rows", "valid", "ups", "falls", "ret_sum"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.sequences |= other.sequences
        self.days |= other.days
        self.months += other.months
        for name in ("favorable", "adverse", "favorable_short", "adverse_short"):
            getattr(self, name).merge(getattr(other, name))

    def stats(self) -> tuple:
        """Values of ``SCHEMA``; quantiles of nothing are 0."""
        quantiles = [q.value() or 0.0 for q in (self.favorable, self.adverse, self.favorable_short, self.adverse_short)]
        return (
            self.rows, len(self.sequences), self.valid, self.ups, self.ret_sum, len(self.days), len(self.months), max(self.months.values(), default=0),
            quantiles[0], quantiles[1], self.falls, quantiles[2], quantiles[3],
        )
