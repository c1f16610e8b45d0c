"""Feature sources that can be added and switched; the version string names the active set."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class FeatureSource:
    """compute(bars) returns (symbol, t, *columns); enabled says whether it takes part."""

    name: str
    columns: tuple[str, ...]
    compute: Callable[[DataFrame], DataFrame]
    enabled: bool = True


@dataclass
class FeatureSources:
    sources: dict[str, FeatureSource] = field(default_factory=dict)

    def add(self, source: FeatureSource) -> None:
        taken = {c for s in self.sources.values() for c in s.columns}
        if source.name in self.sources or taken & set(source.columns):
            raise ValueError(f"{source.name}: its name or a column is taken")
        self.sources[source.name] = source

    def active(self) -> list[FeatureSource]:
        return [s for _, s in sorted(self.sources.items()) if s.enabled]

    def version(self, base: str) -> str:
        return "+".join([base, *(s.name for s in self.active())])

    def require(self, trained: str, base: str) -> None:
        """Refuse a model that was trained on another set."""
        if trained != self.version(base):
            raise ValueError(f"the model knows {trained}, the features are {self.version(base)}")

    def apply(self, bars: DataFrame) -> DataFrame:
        for s in self.active():
            bars = bars.join(s.compute(bars).select("symbol", "t", *s.columns), ["symbol", "t"], "left")
        return bars

    def guarded(self, bars: DataFrame, most: float = 0.02) -> DataFrame:
        """Rows that all active sources know; an error if that loses more than ``most`` of them."""
        full = self.apply(bars)
        names = [c for s in self.active() for c in s.columns]
        row = full.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in names) or "true"), 1)).alias("kept")).first()
        if row["n"] and 1 - row["kept"] / row["n"] > most:
            raise ValueError(f"optional sources lose {1 - row['kept'] / row['n']:.1%} of the rows")
        return full.dropna(subset=names)
