"""Price structure over a stream of bars: the batch kernel's state kept for each symbol."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.structure import FLAGS, INPUT, NUMBERS, ZONES_SQL, StructureState, known


class StructureProcessor(StatefulProcessor):
    """Zones and levels of a symbol after each bar. Bars of a symbol come in order of t; ages bound the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("structure", "body binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else StructureState()
        bars = pd.concat(list(rows)).sort_values("t", ignore_index=True)
        out = [state.step({k: known(v) for k, v in zip(INPUT, values, strict=True)}) for values in bars[list(INPUT)].itertuples(index=False)]
        self.state.update((pickle.dumps(state),))
        yield pd.concat([bars[["symbol", "t"]], pd.DataFrame(out, columns=[*FLAGS, *NUMBERS])], axis=1)

    def close(self) -> None:
        """Nothing is held."""


def zone_stream(bars: DataFrame) -> DataFrame:
    """bars: symbol, t and the kernel's INPUT, with a positive atr; needs the RocksDB state store."""
    return bars.groupBy("symbol").transformWithStateInPandas(StructureProcessor(), ZONES_SQL, "update", "none")
