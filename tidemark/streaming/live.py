"""Streams: windowed aggregates, time-limited de-duplication, keyed alerts, and sinks for micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.sources.stores import Store, claimed, upserted


def window_aggregates(events: DataFrame, width: str, late: str) -> DataFrame:
    """Count, mean, least, greatest and strong values of each symbol and window; windows close ``late`` after their end.

    events: ts, event_type, value. Works on streams and on tables alike.
    """
    agg = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    out = agg.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.when(F.col("value") > 100, 1)).alias("strong"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "mean", "low", "high", "strong")


def first_in(events: DataFrame, key: list[str], ttl: str) -> DataFrame:
    """The first event of each key within a time to live."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(key)


def cutoff(now: int, asked: int | None, last: int | None, most: int = 30 * 86400, default: int = 240 * 60) -> int:
    """Where a run resumes: an explicit time, else after the last emitted one, at most 30 days back, else four hours back."""
    if asked is not None:
        return asked
    return max(last, now - most) if last is not None else now - default


def emit(store: Store, key: list[str], log: Store | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: upserts a batch, once however often it is replayed, and logs the keys that are new."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        if log is not None:
            log.write(upserted(log.read(), claimed(batch.select(key), log.read(), key), key, keep_old=True))
        store.write(upserted(store.read(), batch.dropDuplicates(key), key))
        batch.unpersist()

    return write


@dataclass
class Rule:
    """An alert: over ``limit`` for ``sustain`` samples, quiet ``cooldown`` seconds after it fires, over at ``recover``."""

    name: str
    limit: float
    recover: float
    sustain: int = 3
    cooldown: int = 900


@dataclass
class AlertState:
    over: int = 0
    firing: bool = False
    fired_at: int = -(1 << 60)

    def step(self, rule: Rule, t: int, value: float) -> str | None:
        """What a sample causes: 'fired', 'recovered' or nothing."""
        if value > rule.limit:
            self.over += 1
            if not self.firing and self.over >= rule.sustain and t - self.fired_at >= rule.cooldown:
                self.firing, self.fired_at = True, t
                return "fired"
            return None
        self.over = 0
        if self.firing and value <= rule.recover:
            self.firing = False
            return "recovered"
        return None


ALERTS = "key string, t long, value double, what string"


def _follow(rule: Rule, state: AlertState, key: str, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for t, value in sorted(zip(rows["t"].tolist(), rows["value"].tolist(), strict=True)):
        if what := state.step(rule, int(t), float(value)):
            out.append((key, int(t), float(value), what))
    return pd.DataFrame(out, columns=["key", "t", "value", "what"])


def alerts(samples: DataFrame, rule: Rule) -> DataFrame:
    """Alerts of samples (key, t, value) in a table; one task for a key."""
    return samples.groupBy("key").applyInPandas(lambda pdf: _follow(rule, AlertState(), pdf["key"].iloc[0], pdf), ALERTS)


class AlertProcessor(StatefulProcessor):
    """The same over a stream: a key's state lives in the state store."""

    def __init__(self, rule: Rule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alert", "over int, firing boolean, fired_at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        state = AlertState(*known) if known is not None else AlertState()
        for pdf in rows:
            yield _follow(self.rule, state, key[0], pdf)
        self.state.update(tuple(asdict(state).values()))

    def close(self) -> None:
        """Nothing is held."""


def alert_stream(samples: DataFrame, rule: Rule) -> DataFrame:
    """Alerts of a stream of samples; needs the RocksDB state store."""
    return samples.groupBy("key").transformWithStateInPandas(AlertProcessor(rule), ALERTS, "update", "none")


def strong_only(scored: DataFrame, newest_seconds: int, now: int) -> DataFrame:
    """Candidates worth publishing: rated STRONG and no older than a limit."""
    return scored.where((F.col("rating") == "STRONG") & (F.col("t") >= now - newest_seconds))
