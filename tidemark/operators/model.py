"""State models that are kept: features scaled and laid to the nearest centroid, and what follows from the labels.

``train`` learns a model and derives everything from one table of bars; ``label_history`` derives the same with a
stored model. A model belongs to one symbol and to the columns it was trained on.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import candidates as C
from tidemark.operators import features as X
from tidemark.operators import states as S
from tidemark.operators.recursive import with_indicators
from tidemark.operators.vectors import fit_states_of, nearest_centroid
from tidemark.tables import written

STORED = "symbol string, run_id long, version string, trained_to long, body string"


class ModelError(ValueError):
    """A model that doesn't fit what it is asked to label."""


@dataclass(frozen=True)
class StateModel:
    """Centroids in the space of scaled columns. mid and spread: median and interquartile range of each column."""

    symbol: str
    columns: tuple[str, ...]
    mid: tuple[float, ...]
    spread: tuple[float, ...]
    centroids: tuple[tuple[float, ...], ...]
    clip: float = 5.0
    version: str = "v1"
    trained_to: int = 0

    def to_frame(self, spark: SparkSession, run_id: int) -> DataFrame:
        """The row a store keeps, keyed by (symbol, run_id)."""
        return spark.createDataFrame([(self.symbol, run_id, self.version, self.trained_to, json.dumps(asdict(self)))], STORED)

    @classmethod
    def load(cls, stored: DataFrame | None, symbol: str, run_id: int | None = None) -> StateModel:
        """The model of a run, or the symbol's last one. A run of another symbol is refused: its space is another."""
        rows = [] if stored is None else (stored.where(F.col("symbol") == symbol) if run_id is None else stored.where(F.col("run_id") == run_id)).orderBy(F.desc("run_id")).limit(1).collect()
        if not rows:
            raise ModelError(f"no model of {symbol}" if run_id is None else f"no run {run_id}")
        if rows[0]["symbol"] != symbol:
            raise ModelError(f"run {run_id} was trained on {rows[0]['symbol']}, not on {symbol}")
        body = json.loads(rows[0]["body"])
        return cls(**{k: tuple(map(tuple, v)) if k == "centroids" else tuple(v) if isinstance(v, list) else v for k, v in body.items()})

    def scaled(self) -> list:
        limit = F.lit(float(self.clip))
        return [F.greatest(-limit, F.least(limit, (F.col(c) - m) / (s or 1.0))) for c, m, s in zip(self.columns, self.mid, self.spread, strict=True)]

    def labels(self, features: DataFrame) -> DataFrame:
        """Rows that have all columns: symbol, t and label (g1, g2, ... by the order of centroids)."""
        missing = [c for c in self.columns if c not in features.columns]
        if missing:
            raise ModelError(f"the features lack {missing}; train anew")
        known = features.dropna(subset=list(self.columns)).select("symbol", "t", F.array(*self.scaled()).alias("_v"))
        return nearest_centroid(known, np.array(self.centroids), "_v").select("symbol", "t", F.concat(F.lit("g"), F.col("group").cast("string")).alias("label"))


def fit_model(features: DataFrame, columns: Sequence[str], version: str = "v1", least: int | None = None) -> StateModel:
    """Scale and centroids from all rows of one symbol that have all columns; medians and quartiles within 1e-4 of the rows."""
    known = features.dropna(subset=list(columns))
    head = known.agg(F.count_distinct("symbol").alias("symbols"), F.first("symbol").alias("symbol"), F.max("t").alias("t")).first()
    if head["symbols"] != 1:
        raise ModelError(f"a model is of one symbol, not of {head['symbols']}")
    cuts = known.approxQuantile(list(columns), [0.25, 0.5, 0.75], 1e-4)
    model = StateModel(head["symbol"], tuple(columns), tuple(c[1] for c in cuts), tuple(c[2] - c[0] for c in cuts), (), version=version, trained_to=int(head["t"]))
    flat = known.select("t", *[x.alias(f"x{i}") for i, x in enumerate(model.scaled())])
    centroids = fit_states_of(flat, [f"x{i}" for i in range(len(columns))], "t", least=least)
    return StateModel(**{**asdict(model), "centroids": tuple(map(tuple, centroids.tolist()))})


@dataclass
class History:
    """A labelled history, and what candidates are made of."""

    features: DataFrame
    states: DataFrame
    blocks: DataFrame
    outcomes: DataFrame
    snapshots: DataFrame
    horizon: int

    def candidates(self, **limits) -> DataFrame:
        return C.candidates(self.snapshots, self.horizon, **limits)


@dataclass(frozen=True)
class Settings:
    """Seconds of a bar, bars of an outcome, and bars after a transition that snapshots are taken at."""

    seconds: int = 3600
    horizon: int = 24
    offsets: tuple[int, ...] = (0, 1, 3)
    smoothing: int = 2
    trajectory: int = 24

    @property
    def margin(self) -> int:
        """Bars before a cut that its rows may still depend on."""
        return self.smoothing + self.trajectory + max(self.offsets)


def observed(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars with indicators, and their base features."""
    shown = written(with_indicators(bars), "shown")
    return shown, written(X.base_features(shown), "features")


def history(shown: DataFrame, features: DataFrame, model: StateModel, settings: Settings = Settings()) -> History:
    """Labels, states, blocks, outcomes and snapshots of bars with indicators, under a model."""
    states = S.assign(model.labels(features), "label", settings.seconds // 60, settings.smoothing, settings.trajectory)
    blocks = X.event_blocks(X.atoms(shown))
    outcomes = C.outcomes(shown, settings.horizon, settings.seconds)
    with_outcomes = states.join(outcomes, ["symbol", "t"], "left")
    edges = S.transition_stats(with_outcomes).select("transition_id", F.col("rarity").alias("transition_rarity"))
    kinds = X.block_statistics(blocks).select("symbol", "event_block_id", F.col("rarity").alias("event_rarity"))
    found = C.snapshots(with_outcomes, list(settings.offsets)).join(blocks.select("symbol", "t", "event_block_id"), ["symbol", "t"])
    found = found.withColumn("valid", F.coalesce("valid", F.lit(False)))
    snapshots = found.join(F.broadcast(edges), "transition_id", "left").join(kinds, ["symbol", "event_block_id"], "left")
    return History(features, states, blocks, outcomes, snapshots, settings.horizon * settings.seconds)


def train(bars: DataFrame, columns: Sequence[str], settings: Settings = Settings(), version: str = "v1", least: int | None = None) -> tuple[StateModel, History]:
    """A model of one symbol's bars and the history under it, as one call."""
    shown, features = observed(bars)
    model = fit_model(features, columns, version, least)
    return model, history(shown, features, model, settings)


def label_history(bars: DataFrame, model: StateModel, start: int | None = None, end: int | None = None, settings: Settings = Settings()) -> History:
    """The history of the model's symbol from start to end under a stored model; writes nothing."""
    own = bars.where(F.col("symbol") == model.symbol)
    own = own if start is None else own.where(F.col("t") >= start)
    own = own if end is None else own.where(F.col("t") <= end)
    if own.isEmpty():
        raise ModelError(f"{model.symbol}: no bars from {start} to {end}")
    return history(*observed(own), model, settings)
