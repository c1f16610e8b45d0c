"""Stateful and drawn operators against plain versions and properties."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import profiles
from tidemark.operators import recursive, structure
from tidemark.operators import vectors as V


def walk(n: int, seed: int = 3) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    open_ = np.concatenate([[close[0]], close[:-1]])
    top, low = np.maximum(open_, close) * (1 + rng.random(n) * 0.004), np.minimum(open_, close) * (1 - rng.random(n) * 0.004)
    return pd.DataFrame({"symbol": "A", "t": np.arange(n) * 3600, "open": open_, "high": top, "low": low, "close": close, "volume": rng.random(n), "quote_volume": 1.0, "trades": 1, "taker_buy_base": 0.0})


def test_indicators_do_not_look_ahead():
    bars = walk(300)
    whole, part = recursive.add_indicators(bars.copy()), recursive.add_indicators(bars.iloc[:200].copy())
    pd.testing.assert_frame_equal(whole.iloc[:200].reset_index(drop=True), part)


def test_rsi_of_flat_and_rising_prices():
    assert (recursive.rsi(pd.Series([5.0] * 40)).dropna() == 50).all()
    assert (recursive.rsi(pd.Series(np.arange(1.0, 41.0))).dropna() == 100).all()


def kernel_input(n: int) -> list[dict]:
    bars = recursive.add_indicators(walk(n))
    bars["atr"] = bars["atr"].bfill()
    high, low = bars["high"], bars["low"]
    is_top, is_low = high == high.rolling(7, center=True).max(), low == low.rolling(7, center=True).min()
    bars["swing_high"], bars["swing_low"] = high.where(is_top).shift(3).ffill(), low.where(is_low).shift(3).ffill()
    bull, bear = low > high.shift(2), high < low.shift(2)
    bars["bull_lo"], bars["bull_hi"] = high.shift(2).where(bull), low.where(bull)
    bars["bear_lo"], bars["bear_hi"] = high.where(bear), low.shift(2).where(bear)
    return [{k: structure.known(v) for k, v in r.items()} for r in bars[list(structure.INPUT)].to_dict("records")]


def test_gap_registry_against_a_plain_scan():
    bars = kernel_input(400)
    state = structure.StructureState()
    for t, bar in enumerate(bars):
        out = state.step(bar)
        live = []
        for born in range(t + 1):
            for side, name in ((1, "bull"), (-1, "bear")):
                if bars[born][f"{name}_lo"] is None:
                    continue
                lo, hi = bars[born][f"{name}_lo"], bars[born][f"{name}_hi"]
                fill = max([0.0, *((hi - b["low"]) / (hi - lo) if side > 0 else (b["high"] - lo) / (hi - lo) for b in bars[born + 1 : t + 1])])
                if fill < 1:
                    live.append((lo, hi, side))
        assert out["in_unfilled_fvg"] == any(lo <= bar["close"] <= hi for lo, hi, _ in live)
        bull = [(lo + hi) / 2 - bar["close"] for lo, hi, side in live if side > 0]
        assert out["near_fvg_bull"] == pytest.approx(structure.signed(min(bull, key=abs) / bar["atr"]) if bull else 0.0)


def test_structure_state_is_scale_free():
    bars = kernel_input(300)
    scaled = [{k: v if v is None else v * 8 for k, v in b.items()} for b in bars]
    a, b = structure.StructureState(), structure.StructureState()
    for x, y in zip(bars, scaled, strict=True):
        p, q = a.step(x), b.step(y)
        assert {k: p[k] for k in structure.FLAGS} == {k: q[k] for k in structure.FLAGS}
        assert [p[k] for k in structure.NUMBERS] == pytest.approx([q[k] for k in structure.NUMBERS])


def test_sweep_and_reclaim_of_a_level_of_two_swings():
    state, flat = structure.StructureState(), dict.fromkeys(structure.INPUT) | {"atr": 1.0}
    bar = lambda o, h, lo, c, sh=None: flat | {"open": o, "high": h, "low": lo, "close": c, "swing_high": sh}
    state.step(bar(9, 9.5, 8, 9, 10.0))
    state.step(bar(9, 9.5, 8, 9, 10.2))
    out = state.step(bar(9, 11, 8, 9, 10.2))
    assert out["sweep_high"] and out["sweep_high_reclaim"] and not out["sweep_low"]


def test_native_zones_match_the_kernel(spark):
    bars = walk(250)
    got = structure.zones(recursive.with_indicators(spark.createDataFrame(bars))).orderBy("t").toPandas()
    state = structure.StructureState()
    for row, bar in zip(got.to_dict("records"), kernel_input(250), strict=True):
        out = state.step(bar)
        assert {k: out[k] for k in structure.FLAGS} == {k: row[k] for k in structure.FLAGS}


def test_quantile_heads_are_fitted_on_all_keys(spark, tmp_path):
    """Prices that drift with the key: heads of the lowest keys would cover almost none of the rest."""
    from tidemark.plans.catalog import REGISTRY

    rng = np.random.default_rng(1)
    key = np.arange(30_000)
    frame = pd.DataFrame({"l_orderkey": key, "l_quantity": rng.integers(1, 51, 30_000).astype(float), "l_tax": rng.integers(0, 9, 30_000) / 100, "l_extendedprice": key * 1.0 + rng.normal(size=30_000)})
    frame.to_parquet(tmp_path / "lineitem.parquet")
    r = REGISTRY.builders["m17_quantile_heads"](spark, str(tmp_path)).collect()[0]
    assert [r.covered0, r.covered1, r.covered2, r.covered3] == pytest.approx([0.25, 0.5, 0.75, 0.9], abs=0.03) and r.rising


def test_states_separate_blobs_and_keep_a_cloud_whole():
    rng = np.random.default_rng(6)
    blobs = np.vstack([rng.normal(c, 0.2, (400, 2)) for c in ((0, 0), (5, 5), (0, 6))])
    c = V.fit_states(blobs, seeds=3, least=50)
    assert len(c) == 3
    cloud = rng.uniform(0, 1, (1000, 2))
    assert len(V.fit_states(cloud, seeds=1, least=50)) == 1


def test_states_of_a_table_find_a_small_state(spark):
    """0.6% of 60,000 rows, next to one of eight large states: more than the floor of 300 rows."""
    rng = np.random.default_rng(8)
    small = np.arange(60_000) < 360
    group = np.arange(60_000) % 8
    x = np.stack([group % 4, group // 4], axis=1) * 20.0 + rng.normal(0, 0.2, (60_000, 2))
    x[small] = [0, 2] + rng.normal(0, 0.2, (360, 2))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(60_000), "x": x[:, 0], "y": x[:, 1]}))
    got = V.states_of(spark, df, ["x", "y"], "id").toPandas()
    own = got[got["id"] < 360]["group"]
    assert own.nunique() == 1 and (got["group"] == own.iloc[0]).sum() == 360
    sizes = got["group"].value_counts()
    assert list(sizes.sort_index()) == sorted(sizes, reverse=True) and len(sizes) >= 9


def test_states_of_a_table_are_those_of_its_matrix(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.2, (400, 2)) for c in ((0, 0), (5, 5), (0, 6))])
    df = spark.createDataFrame(pd.DataFrame({"id": range(1200), "x": x[:, 0], "y": x[:, 1]}))
    a, b = V.fit_states(x, seeds=3, least=50), V.fit_states_of(df, ["x", "y"], "id", seeds=3, least=50)
    assert sorted(map(tuple, a.round(6).tolist())) == sorted(map(tuple, b.round(6).tolist()))


def test_separation_and_silhouette():
    x = np.vstack([np.zeros((5, 2)), np.ones((5, 2)) * 10 + np.eye(5, 2)])
    assert V.separation(x, np.arange(10) < 5, np.arange(10) >= 5) > 5
    assert V.silhouette(x, (np.arange(10) >= 5).astype(int)) > 0.8


def test_profiles_inherit_merge_and_fail():
    registry = {"a": {"ladders": {"sample_size": {"floor": 0.2}}}, "b": {"extends": "a", "batch": {"fresh_bonus": 0.1}}}
    b = profiles.resolve("b", registry)
    assert b["ladders"]["sample_size"]["floor"] == 0.2 and b["batch"]["fresh_bonus"] == 0.1 and b["ladders"]["sample_size"]["steps"]
    assert profiles.fingerprint(b) != profiles.fingerprint(profiles.DEFAULT)
    assert profiles.fingerprint(profiles.merge(profiles.DEFAULT, {"name": "x"})) == profiles.fingerprint(profiles.DEFAULT)
    for bad in ({"weights": {"context": 0.9}}, {"rating": {"strong_min": 0.1}}, {"extends": "nowhere"}, {"extends": "bad"}):
        with pytest.raises(profiles.ProfileError):
            profiles.resolve("bad", {"bad": bad})


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 4))
def test_smoothing_against_a_plain_loop(spark, labels, least):
    from tidemark.operators.windows import smooth_labels

    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(labels)], "symbol string, t long, label int")
    got = [r.smoothed for r in smooth_labels(df, "label", least).orderBy("t").collect()]
    runs, want, current = [], [], labels[0]
    for x in labels:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    for i, (x, n) in enumerate(runs):
        current = x if n >= least or i == 0 else current
        want += [current] * n
    assert got == want


def test_candidates_against_a_plain_history(spark):
    """Point-in-time samples, sides and scores from a loop over all earlier matured rows."""
    from math import log10

    from tidemark.operators import candidates as C

    rng = np.random.default_rng(9)
    rows = [("S", t * 3600, 0, f"t{rng.integers(2)}", f"b{rng.integers(2)}", float(rng.normal(0.3, 1)), bool(rng.random() < 0.9), int(t)) for t in range(220)]
    cols = "symbol string, t long, offset int, transition_id string, event_block_id string, ret_pct double, valid boolean, state_seq long"
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, cols).withColumns({"mfe_pct": F.abs("ret_pct") + 0.5, "mae_pct": -F.abs("ret_pct") - 0.25, "transition_rarity": F.lit("rare"), "event_rarity": F.lit("uncommon")})
    got = {r.t: r for r in C.candidates(df, 24 * 3600, least=20, least_effective=20).collect()}
    want = {}
    for r in rows:
        past = [p for p in rows if p[3] == r[3] and p[1] <= r[1] - 24 * 3600]
        narrow = [p for p in past if p[4] == r[4]]
        chosen, scope = (narrow, "transition+event_block") if len(narrow) >= 20 else (past, "transition")
        valid = [p for p in chosen if p[6]]
        if len(chosen) < 20 or not valid:
            continue
        up = [p for p in valid if p[5] > 0]
        skew = 2 * len(up) / len(valid) - 1
        if abs(skew) < 0.06:
            continue
        months = [p[1] // (30 * 86400) for p in chosen]
        top = max(months.count(m) for m in set(months)) / len(chosen)
        rare = (1.0 + (0.66 if scope != "transition" else 0.33)) / 2
        score = 0.25 * min(1, abs(skew) / 0.5) + 0.20 * min(1, log10(len(chosen) + 1) / 3) + 0.15 * min(1, len(set(months)) / 18) + 0.15 * (1 - min(1, top / 0.5)) + 0.15 * len(valid) / len(chosen) + 0.10 * rare
        want[r[1]] = (scope, len(chosen), "long" if skew > 0 else "short", np.percentile([abs(p[5]) + 0.5 for p in up], 70), score)
    assert set(got) == set(want) and want
    for t, (scope, n, side, favorable, score) in want.items():
        r = got[t]
        assert (r.scope, r.sample_size, r.research_side) == (scope, n, side)
        assert r.p70_long_favorable_pct == pytest.approx(favorable) and r.research_score == pytest.approx(score)


def test_features_of_a_prefix_equal_those_of_the_whole(spark):
    from tidemark.operators import features

    bars = walk(260)
    whole = features.base_features(recursive.with_indicators(spark.createDataFrame(bars))).toPandas().sort_values("t").reset_index(drop=True)
    part = features.base_features(recursive.with_indicators(spark.createDataFrame(bars.iloc[:200]))).toPandas().sort_values("t").reset_index(drop=True)
    pd.testing.assert_frame_equal(whole.iloc[:200], part)


def test_feature_sources_switch_and_name_the_version(spark):
    from tidemark.functions.feature_sources import FeatureSource, FeatureSources

    sources = FeatureSources()
    sources.add(FeatureSource("deriv", ("x",), lambda df: df.selectExpr("symbol", "t", "close * 2 AS x")))
    sources.add(FeatureSource("smc", ("y",), lambda df: df.selectExpr("symbol", "t", "close + 1 AS y"), enabled=False))
    bars = spark.createDataFrame(walk(5))
    out = sources.apply(bars.select("symbol", "t", "close"))
    assert sources.version("v1") == "v1+deriv" and out.columns == ["symbol", "t", "close", "x"]
    with pytest.raises(ValueError):
        sources.require("v1+deriv+smc", "v1")


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_exact_percentiles_against_numpy(spark, n):
    from tidemark.operators import ranking

    rng = np.random.default_rng(n)
    rows = [("ab"[i % 2], float(rng.integers(0, max(2, n // 3)))) for i in range(n)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = (0.0, 0.1, 0.5, 0.9, 0.99, 1.0)
    got = {r["g"]: [r[f"p{i}"] for i in range(6)] for r in ranking.exact_percentiles(df, "x", shares, ["g"]).collect()}
    for g in got:
        assert got[g] == pytest.approx(np.percentile([x for k, x in rows if k == g and x is not None], [100 * p for p in shares]))
    whole = ranking.exact_percentiles(df, "x", shares).first()
    assert list(whole) == pytest.approx(np.percentile([x for _, x in rows if x is not None], [100 * p for p in shares]))


def test_places_against_sorting(spark):
    from tidemark.operators import ranking

    rng = np.random.default_rng(4)
    rows = [(i, "ab"[i % 2], int(rng.integers(0, 60))) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, x long")
    for r in ranking.placed(df, "x", ["g"]).collect():
        same = [x for _, g, x in rows if g == r.g]
        assert r.ties == same.count(r.x) and r.before == sum(x < r.x for x in same)
    want = {i: k for k, (i, _, _) in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    assert {r.id: r.place for r in ranking.with_place(df, "x", ["id"]).collect()} == want
