"""Stretches of time, and what is computed over them, against whole series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, recursive, stretches
from tidemark.operators import windows as W

NUMBERS = ["open", "high", "low", "close", "volume", "taker_buy_base"]


def walk(n: int, symbol: str = "a", seed: int = 0, step: int = 3600, holes: bool = False) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    close[n // 3 : n // 3 + 40] = close[n // 3]  # a flat stretch
    t = np.arange(n) * step
    if holes:
        t = t + np.cumsum(rng.random(n) < 0.02) * step * 400
    opened = np.concatenate([[close[0]], close[:-1]])
    return pd.DataFrame({"symbol": symbol, "t": t, "open": opened, "high": np.maximum(opened, close) * 1.002, "low": np.minimum(opened, close) * 0.998, "close": close, "volume": np.round(rng.random(n) * 9), "quote_volume": 1.0, "trades": 1, "taker_buy_base": rng.random(n)})


@pytest.fixture
def short(monkeypatch):
    """Stretches of a few hundred rows, at the least that the widest reach allows."""
    monkeypatch.setattr(stretches, "ROWS", 900)
    monkeypatch.setattr(stretches, "BUCKET", 50 * 3600)


@pytest.mark.parametrize("reach", [0, 1, 30, 100])
def test_each_stretch_gets_the_rows_before_it(spark, monkeypatch, reach):
    monkeypatch.setattr(stretches, "ROWS", 100)
    monkeypatch.setattr(stretches, "BUCKET", 50)
    rng = np.random.default_rng(1)
    rows = []
    for symbol, n in (("a", 1500), ("b", 40), (None, 333)):
        t = np.sort(rng.choice(9000, n, replace=False))
        if symbol == "a":
            t[700:1100] = t[700] + np.arange(400) // 10  # one bucket holds several stretches
        rows += [(symbol, int(x), i) for i, x in enumerate(t)]
    got = stretches.stretched(spark.createDataFrame(rows, "symbol string, t long, i long"), reach).toPandas()
    assert sorted(got[got["_own"]][["t", "i"]].itertuples(index=False, name=None)) == sorted((t, i) for _, t, i in rows)
    assert got[got["_own"]].groupby(["symbol", "_stretch"], dropna=False).size().max() < 500
    for _, part in got.groupby(["symbol", "_stretch"], dropna=False):
        first = part[part["_own"]]["i"].min()
        before = sorted(part[~part["_own"]]["i"])
        assert len(before) >= min(reach, first) and before == list(range(first - len(before), first))


def test_a_reach_beyond_a_stretch_is_an_error(spark):
    with pytest.raises(ValueError):
        stretches.stretched(spark.createDataFrame([], "symbol string, t long"), stretches.ROWS + 1)


@pytest.mark.parametrize("holes", [False, True])
def test_indicators_by_scan_equal_the_fold(spark, short, holes):
    bars = pd.concat([walk(3000, "a", 1, holes=holes), walk(1, "one", 2), walk(950, "b", 3)], ignore_index=True)
    got = recursive.with_indicators(spark.createDataFrame(bars).repartition(4)).toPandas().sort_values(["symbol", "t"], ignore_index=True)
    want = pd.concat([recursive.add_indicators(g.copy()) for _, g in bars.groupby("symbol")], ignore_index=True)
    want = want.sort_values(["symbol", "t"], ignore_index=True)
    names = ["ema_day", "ema_week", "ema_20", "atr", "rsi"]
    np.testing.assert_allclose(got[names].to_numpy(float), want[names].to_numpy(float), rtol=1e-9)


def test_features_and_atoms_do_not_depend_on_the_stretches(spark, monkeypatch):
    bars = pd.concat([walk(3000, "a", 5, holes=True), walk(400, "b", 6)], ignore_index=True)
    shown = spark.createDataFrame(pd.concat([recursive.add_indicators(g.copy()) for _, g in bars.groupby("symbol")]))
    results = []
    for rows, bucket in ((4096, 10**9), (900, 50 * 3600)):
        monkeypatch.setattr(stretches, "ROWS", rows)
        monkeypatch.setattr(stretches, "BUCKET", bucket)
        results.append([f(shown).toPandas().sort_values(["symbol", "t"], ignore_index=True) for f in (features.base_features, features.atoms)])
    (f1, a1), (f2, a2) = results
    np.testing.assert_allclose(f1[features.FEATURES].to_numpy(float), f2[features.FEATURES].to_numpy(float), atol=1e-7)
    same = (a1.drop(columns=["symbol", "t"]) == a2.drop(columns=["symbol", "t"])).to_numpy()
    assert len(a1) == 3400 and same.mean() > 0.9999


def test_rank_in_window_against_a_count(spark, short):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=2500), 1)
    x[rng.random(2500) < 0.05] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"symbol": "a", "t": np.arange(2500) * 3600, "x": x}))
    got = W.rank_in_window(df, "x", 672, 20).toPandas().sort_values("t")["rank"].to_numpy()
    for i in rng.choice(2500, 200, replace=False):
        seen = x[max(0, i - 671) : i + 1]
        seen = seen[~np.isnan(seen)]
        want = np.nan if np.isnan(x[i]) or len(seen) < 20 else ((seen < x[i]).sum() + ((seen == x[i]).sum() + 1) / 2) / len(seen)
        np.testing.assert_allclose(got[i], want)


@pytest.mark.parametrize("window", [1, 3])
def test_blocks_name_what_was_true_of_late(spark, window):
    rng = np.random.default_rng(7)
    names = [*features.SIGNATURE, *features.CONTEXT]
    frame = pd.DataFrame(rng.random((300, len(names))) < 0.1, columns=names).assign(symbol="a", t=np.arange(300))
    got = features.event_blocks(spark.createDataFrame(frame), window).toPandas().sort_values("t", ignore_index=True)
    late = frame[names].astype(int).rolling(window, 1).max().astype(bool)
    for i, r in got.iterrows():
        on = [a for a in features.SIGNATURE if late.loc[i, a]]
        families = [features.SIGNATURE[a] for a in on]
        assert r["atoms"].tolist() == on and r["families"].tolist() == sorted(set(families)) and r["atom_count"] == len(on)
        assert r["context_atoms"].tolist() == [a for a in features.CONTEXT if late.loc[i, a]]
        assert r["mask"] == sum(1 << k for k, a in enumerate(features.SIGNATURE) if a in on)
        if families:
            top = max(map(families.count, families))
            assert r["primary_family"] == next(f for f in families if families.count(f) == top)
        else:
            assert r["primary_family"] is None
    ids = got.groupby("mask")["event_block_id"].nunique()
    assert (ids == 1).all() and features.block_id is not None


def test_block_ids_agree_with_the_columns(spark):
    masks = [0, 1, 5, 1 << 19, 987_654]
    rows = spark.createDataFrame([(m,) for m in masks], "mask long").select("mask", features.block_id(F.col("mask")).alias("id")).collect()
    assert {r["mask"]: r["id"] for r in rows} == {m: features.kind_of(m)[0] for m in masks}


def test_empty_tables(spark):
    none = spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'symbol' else 'long' if c == 't' else 'double'}" for c in ["symbol", "t", *NUMBERS]))
    shown = recursive.with_indicators(none)
    assert shown.count() == 0 and features.base_features(shown).count() == 0 and features.event_blocks(features.atoms(shown)).count() == 0
