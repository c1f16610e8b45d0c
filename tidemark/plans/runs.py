"""Queries of live runs and replays, with a model that SQL can say: two centroids over two columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.model import StateModel, label_history
from tidemark.operators.records import last_by
from tidemark.plans.market import FEATURES, RETURNS, frames
from tidemark.plans.sequence import SMOOTH
from tidemark.plans.shared import STATES, bars, indicators_sql, rounded
from tidemark.registry import Registry
from tidemark.sources.stores import Store
from tidemark.streaming.runs import LiveRun, Stores
from tidemark.tables import scratch

REGISTRY = Registry()
query = REGISTRY.query

SYMBOL = "click"
MODEL = StateModel(SYMBOL, ("rsi", "pos_1d"), (0.5, 0.5), (1.0, 1.0), ((-0.2, -0.2), (0.2, 0.2)))
#: Two days apart, then after all bars; the first run's cut is three days before its last closed bar.
TIMES, LOOKBACK = (1_706_313_600, 1_706_486_400, 4_000_000_000), 3 * 86_400
FIRST_CUT = TIMES[0] - 3600 - LOOKBACK

_LABELLED = f"""states AS (SELECT symbol, t, CASE WHEN x + y <= 1 THEN 'g1' ELSE 'g2' END AS label, x AS value, y AS sec
  FROM (SELECT symbol, t, {FEATURES['rsi']} AS x, {FEATURES['pos_1d']} AS y FROM ret {frames(24, 168, 672)}) WHERE symbol = '{SYMBOL}' AND x IS NOT NULL AND y IS NOT NULL)"""
_STATES_SQL = f"WITH RECURSIVE {indicators_sql()}, {RETURNS}, {SMOOTH.replace(STATES, _LABELLED)}"


@query("i01_i03_i04_i06_live_run", f"{_STATES_SQL} SELECT symbol, t, round(value, 6) AS rsi, round(sec, 6) AS pos_1d, g AS group_id, state_seq, transition_id FROM aged WHERE t >= {FIRST_CUT}")
def live_run(spark, sf_dir):
    """What three runs over growing input leave in the stores: features of the tail and the last state of each bar, as one full run gives."""
    root = scratch(spark, "live")
    stores = Stores(*[Store(spark, f"{root}/{name}") for name in ("bars", "features", "states", "candidates")])
    run = LiveRun(MODEL, stores, limits={"least": 10, "least_effective": 5})
    all_bars = bars(spark, sf_dir)
    for k, now in enumerate(TIMES):
        run.run(lambda since: all_bars.where(F.col("t") >= since), now, k, LOOKBACK)
    last = last_by(stores.states.read(), ["symbol", "t"], [F.col("run_id")], ["group_id", "state_seq", "transition_id"])
    return rounded(stores.features.read().join(last, ["symbol", "t"]))


@query("l19_replay", f"{_STATES_SQL} SELECT symbol, t, g AS group_id, state_seq, transition_id FROM aged")
def replay(spark, sf_dir):
    """A history labelled with the symbol's last stored model."""
    store = Store(spark, scratch(spark, "models"))
    store.write(MODEL.to_frame(spark, 1))
    found = label_history(bars(spark, sf_dir), StateModel.load(store.read(), SYMBOL))
    return found.states.select("symbol", "t", "group_id", "state_seq", "transition_id")
