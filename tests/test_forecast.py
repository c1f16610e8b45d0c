"""Trees that executors grow against a plain version, folds, gate, importances and surrogate panels."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_resampling import drawn
from tidemark.operators import forecast as Q
from tidemark.operators import importance as I
from tidemark.operators import surrogates as S


def sample(n: int, seed: int = 1) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    return pd.DataFrame({"t": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": 0.5 * x[:, 0] + 0.6 * (x[:, 1] > 0) + 0.3 * rng.normal(size=n)})


def plain_trees(x: np.ndarray, y: np.ndarray, edges: list[np.ndarray], columns: list[int], level: float, start: float, spread: float, trees: int, depth: int, rate: float) -> np.ndarray:
    """Fitted values of one head, grown by looking at the rows themselves."""
    bins = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)
    f = np.full(len(y), start)

    def grow(rows: np.ndarray, left: int) -> None:
        slope = np.where(y[rows] > f[rows], level, level - 1)
        best = None
        for j in columns if left else []:
            for b in range(Q.BINS - 1):
                low = bins[rows, j] <= b
                n, m = low.sum(), (~low).sum()
                if min(n, m) < Q.LEAF_ROWS:
                    continue
                gain = slope[low].sum() ** 2 / n + slope[~low].sum() ** 2 / m - slope.sum() ** 2 / len(rows)
                if best is None or gain > best[0] + 1e-9:
                    best = gain, j, b
        if best is None or best[0] <= 1e-9 * len(rows):
            step[rows] = rate * spread * 2 * slope.mean()
            return
        low = bins[rows, best[1]] <= best[2]
        grow(rows[low], left - 1)
        grow(rows[~low], left - 1)

    for _ in range(trees):
        step = np.zeros(len(y))
        grow(np.arange(len(y)), depth)
        f = f + step
    return f


@pytest.mark.parametrize("keep", [3, 100])
def test_trees_against_plain_growth(spark, monkeypatch, keep):
    monkeypatch.setattr(Q, "KEEP", keep)
    frame = sample(800)
    df = spark.createDataFrame(frame).repartition(5)
    heads = [Q.Model(0.25, [0, 1, 2], F.lit(True)), Q.Model(0.9, [0], F.lit(True)), Q.Model(0.5, [0, 1, 2], F.col("t") < 500)]
    forest = Q.fit(df, ["a", "b", "c"], "y", heads, trees=7)
    values = forest.values(frame)
    spread = np.subtract(*df.agg(F.percentile_approx("y", [0.75, 0.25], 10_000)).first()[0])
    x, y = frame[["a", "b", "c"]].to_numpy(), frame["y"].to_numpy()
    for k, m in enumerate(forest.models):
        mine = np.arange(800) < (500 if k == 2 else 800)
        want = plain_trees(x[mine], y[mine], forest.edges, m.columns, m.level, m.start, spread, 7, 2, 0.3)
        np.testing.assert_allclose(values[mine, k], want, atol=1e-9)


def test_heads_cover_rise_and_beat_the_benchmark(spark):
    df = spark.createDataFrame(sample(3000)).repartition(4)
    forest, judged = Q.production(df, ["t"], ["a", "b", "c"], ["a"], "y", 10, 30, trees=16, samples=60)
    g = judged.first()
    assert g["passed"] and g["n"] == 900 and g["delta_r2"] > 0.1 and g["rho"] > g["rho_bench"] and g["coverage_error"] < 0.05
    found = Q.predicted(df, forest, logs=True).toPandas()
    assert (found["p25"] <= found["p50"]).all() and (found["p75"] <= found["p90"]).all() and (found["bench_p50"] <= found["bench_p75"]).all()
    lift = found["p50"] / found["bench_p50"]
    want = np.select([lift < 0.85, lift > 1.15], ["compressed", "expanded"], "normal")
    assert (found["range_regime"] == want).all() and set(want) == {"compressed", "normal", "expanded"}
    assert ((np.exp(found["y"]) <= found["p90"]).mean()) == pytest.approx(0.9, abs=0.04)


def test_gate_refuses_noise_and_names_no_gap(spark):
    frame = sample(1200, 2)
    frame["y"] = np.random.default_rng(5).normal(size=1200)
    df = spark.createDataFrame(frame)
    _, judged = Q.production(df, ["t"], ["a", "b", "c"], ["a"], "y", 10, 30, trees=6, samples=40)
    assert not judged.first()["passed"]
    with pytest.raises(ValueError):
        Q.production(df, ["t"], ["a"], ["a"], "y", 0, 30)
    with pytest.raises(ValueError):
        Q.folds_of(df, ["t"], 3, 0)


def test_folds_learn_from_what_ends_a_gap_before_them(spark):
    """Each fold grown by itself gives what the folds give that grow side by side."""
    frame = sample(900, 3)
    df = spark.createDataFrame(frame).repartition(3)
    got = Q.fold_forecasts(df, ["t"], ["a", "b"], ["a"], "y", 2, 20, trees=4).toPandas().sort_values("t")
    assert got["t"].tolist() == list(range(300, 900)) and (got["fold"] == np.where(got["t"] < 600, 1, 2)).all()
    for k, first in ((1, 300), (2, 600)):
        part = got[got["fold"] == k]
        assert part["train_mean"].iloc[0] == pytest.approx(frame["y"][: first - 20].mean())
        alone = Q.fit(df, ["a", "b"], "y", [Q.Model(0.5, [0, 1], F.col("t") < first - 20)], trees=4)
        # Edges and spread come from all rows in both.
        np.testing.assert_allclose(part["p50"], np.maximum.accumulate(np.stack([part["p25"], alone.values(part)[:, 0]]), axis=0)[1], atol=1e-9)


def test_permutation_importance_finds_what_the_model_uses(spark):
    rng = np.random.default_rng(3)
    n = 1500
    frame = pd.DataFrame({"t": np.arange(n), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    frame["label"] = (frame["a"] + 0.1 * rng.normal(size=n) > 0).astype(float)
    df = spark.createDataFrame(frame).repartition(4)
    got = I.permutation_importance(df, ["a", "b"], "label", lambda d: d.withColumn("score", F.when(F.col("a") > 0, 1.0).otherwise(0.0)), ["t"], 5).toPandas().set_index("feature")
    order = np.argsort([drawn(0, 5, i) for i in range(n)], kind="stable")
    spot = np.empty(n, int)
    spot[order] = np.arange(n)
    a, y = frame["a"].to_numpy(), frame["label"].to_numpy()
    base = ((a > 0) == (y > 0.5)).mean()
    assert got.loc["a", "base"] == pytest.approx(base) and got.loc["b", "drop"] == pytest.approx(0)
    assert got.loc["a", "drop"] == pytest.approx(base - ((a[spot] > 0) == (y > 0.5)).mean()) and got.loc["a", "drop"] > 0.4


def test_partners_are_a_permutation(spark):
    df = spark.range(500).select("id", (F.col("id") * 2).alias("x"))
    got = I.with_partner(df, ["x"], ["id"], 1).toPandas()
    assert sorted(got["x_partner"]) == sorted(got["x"]) and (got["x_partner"] != got["x"]).mean() > 0.9


def test_least_squares_and_the_gain_of_columns(spark):
    frame = sample(600, 4)
    frame[["a", "b", "c"]] += 1e6  # large means
    df = spark.createDataFrame(frame)
    fit = I.least_squares(df, ["a", "b", "c"], "y")
    want = np.linalg.lstsq(np.column_stack([np.ones(600), frame[["a", "b", "c"]] - 1e6]), frame["y"], rcond=None)[0]
    np.testing.assert_allclose(fit[1:], want[1:], rtol=1e-6)
    row = I.r2_gain(df.where("t < 400"), df.where("t >= 400"), ["a"], ["b", "c"], "y").first()
    assert row["gain"] == pytest.approx(row["r2_full"] - row["r2_base"]) and row["gain"] > 0.1


@pytest.mark.parametrize("planted", [True, False])
def test_surrogate_panels_against_a_plain_version(spark, planted):
    rng = np.random.default_rng(6)
    rows = [(t, k, float(x), float((0.8 * x if planted else 0) + e)) for t in range(40) for k, x, e in zip("abcdef", rng.normal(size=6).round(1), rng.normal(size=6), strict=True) if rng.random() < 0.9]
    got = S.surrogate_null(spark.createDataFrame(rows, "t long, k string, x double, y double").repartition(3), "t", "k", "x", "y", 4, 50, 5, 2).first()
    panel = pd.DataFrame(rows, columns=["t", "k", "x", "y"])
    times = [g.sort_values("k") for _, g in panel.groupby("t") if len(g) >= 4]

    def mean(sample_: int) -> float:
        each = []
        for i, g in enumerate(times):
            x, y = g["x"].rank().to_numpy(), g["y"].rank().to_numpy()
            if sample_ >= 0:
                x = x[np.argsort([drawn(0, 2, sample_, i // 5, k) for k in g["k"]], kind="stable")]
            if np.ptp(x) and np.ptp(y):
                each.append(np.corrcoef(x, y)[0, 1])
        return float(np.mean(each))

    null = np.array([mean(k) for k in range(50)])
    own = mean(-1)
    assert got["ic"] == pytest.approx(own) and got["null_mean"] == pytest.approx(null.mean()) and got["null_sd"] == pytest.approx(null.std(ddof=1))
    assert got["p"] == pytest.approx((1 + (np.abs(null) >= abs(own)).sum()) / 51)
    assert got["p"] < 0.05 if planted else got["p"] > 0.05
