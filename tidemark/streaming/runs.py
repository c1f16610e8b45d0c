"""Live runs: fresh bars are added, labelled with a stored model, and only what is new is written."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.model import ModelError, Settings, StateModel, history, observed
from tidemark.sources.stores import Store, upserted
from tidemark.streaming.live import cutoff

#: Days before the last stored bar that are asked for again, as late revisions change them.
REFETCH_DAYS = 3


@dataclass
class Stores:
    """Where a symbol's live run reads and writes."""

    bars: Store
    features: Store
    states: Store
    candidates: Store


@dataclass
class LiveRun:
    """One run over what has come in since the last one.

    bars(since) gives the bars from a time on, as a source would; the last of them may still be open. Limits are those of
    ``candidates``. All writes are upserts by key, so a run that is repeated changes nothing.
    """

    model: StateModel
    stores: Stores
    settings: Settings = Settings()
    limits: dict = field(default_factory=dict)

    def fetch(self, source, now: int) -> int:
        """Add closed bars, from REFETCH_DAYS before the last stored one on; the number of rows that are asked for."""
        old = self.stores.bars.read()
        last = None if old is None else old.agg(F.max("t")).first()[0]
        fresh = source(0 if last is None else last - REFETCH_DAYS * 86_400).where((F.col("symbol") == self.model.symbol) & (F.col("t") + self.settings.seconds <= now))
        self.stores.bars.write(upserted(old, fresh, ["symbol", "t"]))
        return fresh.count()

    def run(self, source, now: int, run_id: int, lookback: int | None = None) -> dict:
        """Fetch, label all bars, and write features and states of the tail and candidates from the cut on."""
        fetched = self.fetch(source, now)
        bars = self.stores.bars.read()
        if bars is None or bars.isEmpty():
            raise ModelError(f"{self.model.symbol}: no bars")
        shown, features = observed(bars)
        found = history(shown, features, self.model, self.settings)
        stored = self.stores.candidates.read()
        last_bar = bars.agg(F.max("t")).first()[0]
        emitted = None if stored is None else stored.agg(F.max("t")).first()[0]
        cut = cutoff(last_bar, None if lookback is None else last_bar - lookback, emitted)
        written = {
            "features": self._write(self.stores.features, self.feature_tail(features, cut), ["symbol", "t"]),
            "states": self._write(self.stores.states, self.state_tail(found.states, cut).withColumn("run_id", F.lit(run_id)), ["symbol", "t", "run_id"]),
            # Taken in from the cut on: an overlap is safer than a hole, and ids don't change.
            "candidates": self._write(self.stores.candidates, found.candidates(**self.limits).where(F.col("t") >= cut), ["candidate_id"]),
        }
        return {"run_id": run_id, "cut": cut, "bars": fetched, **written}

    def feature_tail(self, features: DataFrame, cut: int) -> DataFrame:
        """Rows after the last stored one, or from the cut on if none is stored."""
        old = self.stores.features.read()
        last = None if old is None else old.agg(F.max("t")).first()[0]
        known = features.dropna(subset=list(self.model.columns)).select("symbol", "t", *self.model.columns)
        return known.where(F.col("t") > last) if last is not None else known.where(F.col("t") >= cut)

    def state_tail(self, states: DataFrame, cut: int) -> DataFrame:
        """Rows from the cut on, and the margin before it that smoothing, trajectories and snapshots reach back to."""
        return states.where(F.col("t") >= cut - self.settings.margin * self.settings.seconds)

    @staticmethod
    def _write(store: Store, rows: DataFrame, key: list[str]) -> int:
        """Upsert the rows; how many of them are new. Of what is stored only the keys are looked at for that."""
        old = store.read()
        new = rows.select(*key).distinct()
        added = (new if old is None else new.join(old.select(*key), key, "left_anti")).count()
        store.write(upserted(old, rows, key))
        return added
