"""Bootstraps, gradations and links against plain Python versions that draw the same blocks."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import gradation as G
from tidemark.operators import resampling as R


def drawn(part: int, *names: int) -> float:
    return int(hashlib.md5("|".join(map(str, names)).encode()).hexdigest()[8 * part : 8 * part + 8], 16) / 2**32


def plain_sources(units: int, length: float, unit: int, sample: int, seed: int = 0) -> list[int]:
    out, at, first = [], 0, 0
    for place in range(units):
        if place % R.STRETCH == 0 or drawn(0, seed, sample, place) < min(1.0, unit / length):
            at, first = place, math.floor(drawn(1, seed, sample, place) * units)
        out.append((first + place - at) % units)
    return out


def plain_pairs(n: int, length: float, unit: int, sample: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the predictor and of the target that meet in a sample."""
    units = -(-n // unit)
    a, b = [], []
    for place, source in enumerate(plain_sources(units, length, unit, sample, seed) if sample >= 0 else range(units)):
        k = min(unit, n - place * unit, n - source * unit)
        a += range(source * unit, source * unit + k)
        b += range(place * unit, place * unit + k)
    return np.array(a), np.array(b)


def plain_rows(n: int, length: float, unit: int, sample: int, seed: int = 0) -> np.ndarray:
    """Rows of a sample of whole rows."""
    units = -(-n // unit)
    sources = plain_sources(units, length, unit, sample, seed) if sample >= 0 else range(units)
    return np.concatenate([np.arange(s * unit, min(n, (s + 1) * unit)) for s in sources])


def plain_p(stats: list[float | None], own: float | None, one_sided: bool = False) -> float:
    size = (lambda v: v) if one_sided else abs
    good = [s for s in stats if s is not None and np.isfinite(s)]
    return 1.0 if own is None or not good else (1 + sum(size(s) >= size(own) - 1e-12 for s in good)) / (1 + len(good))


def corr(x, y) -> float | None:
    return float(np.corrcoef(x, y)[0, 1]) if np.ptp(x) > 0 and np.ptp(y) > 0 else None


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(9)
    n = 700
    noise = np.convolve(rng.normal(size=n + 20), np.ones(20) / 4, "valid")[:n]  # remembers itself
    x = np.convolve(rng.normal(size=n + 20), np.ones(20) / 4, "valid")[:n]
    y = 0.8 * x + rng.normal(size=n)
    frame = pd.DataFrame({"t": np.arange(n), "x": x, "noise": noise, "y": y, "flag": (x > 0.4).astype(float)})
    return frame.sort_values("t").reset_index(drop=True), spark.createDataFrame(frame).repartition(5)


@pytest.mark.parametrize("unit", [1, 7])
def test_samples_are_laid_alike(spark, unit, monkeypatch):
    monkeypatch.setattr(R, "STRETCH", 64)
    got = R.laid(spark.createDataFrame([(200,)], "units long"), [], 20, unit, 3, 5).toPandas()
    for k in range(3):
        assert got[got["sample"] == k].sort_values("place")["source"].tolist() == plain_sources(200, 20, unit, k, 5)
    own = got[got["sample"] == -1]
    assert (own["place"] == own["source"]).all() and len(own) == 200


def test_blocks_have_the_asked_length_and_cover_evenly():
    starts = covered = 0
    seen = np.zeros(300)
    for k in range(60):
        s = np.array(plain_sources(300, 24, 3, k))
        starts += 1 + int((np.diff(s) % 300 != 1).sum())
        np.add.at(seen, s, 1)
        covered += len(s)
    assert 5.5 < covered / starts < 11  # 24 rows are 8 units
    assert seen.min() > 20 and seen.max() < 120


@pytest.mark.parametrize("unit", [1, 8])
def test_predictors_are_moved_against_targets(series, unit):
    frame, df = series
    got = R.apart(df, ["t"], {"x": F.col("x"), "noise": F.col("noise")}, {"y": F.col("y")}, 30, 4, unit=unit).toPandas()
    for r in got.itertuples():
        a, b = plain_pairs(len(frame), 30, unit, r.sample)
        x, y = frame[r.feature].to_numpy()[a], frame["y"].to_numpy()[b]
        np.testing.assert_allclose([r.n, r.sx, r.sxx, r.s_y, r.ss_y, r.sx_y], [len(x), x.sum(), x @ x, y.sum(), y @ y, x @ y], rtol=1e-9)
    assert len(got) == 2 * 5


def test_intervals_by_group(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"g": ["a"] * 300 + [None] * 200, "t": np.arange(500), "v": rng.normal(size=500)})
    got = R.intervals(spark.createDataFrame(frame), ["t"], F.col("v"), ["g"], 20, 50).toPandas()
    for g, rows in ((("a"), frame[:300]), (None, frame[300:])):
        v = rows["v"].to_numpy()
        means = [v[plain_rows(len(v), 20, 2, k)].mean() for k in range(50)]
        r = got[got["g"].isna()] if g is None else got[got["g"] == g]
        np.testing.assert_allclose(r[["mean", "low", "high"]].to_numpy(float)[0], [v.mean(), *np.quantile(means, [0.025, 0.975])], rtol=1e-9)


def test_rank_links_find_the_planted_one(series):
    frame, df = series
    got = R.rank_links(df, ["t"], ["x", "noise"], "y", 30, 99).toPandas().set_index("feature")
    ranks = frame.rank()
    for name in ("x", "noise"):
        own = corr(ranks[name], ranks["y"])
        stats = []
        for k in range(99):
            a, b = plain_pairs(len(frame), 30, 3, k)
            stats.append(corr(ranks[name].to_numpy()[a], ranks["y"].to_numpy()[b]))
        assert got.loc[name, "rho"] == pytest.approx(own) and got.loc[name, "p"] == pytest.approx(plain_p(stats, own))
    assert got.loc["x", "p"] == 0.01 and got.loc["noise", "p"] > 0.05


def test_paired_difference_of_two_links(series):
    frame, df = series
    ranks = frame.rank()
    for a, b in (("x", "noise"), ("noise", "x")):
        got = R.stronger(df, ["t"], a, b, "y", 30, 60).first()
        worse = 0
        for k in range(60):
            i = plain_rows(len(frame), 30, 3, k)
            worse += abs(corr(ranks[a].to_numpy()[i], ranks["y"].to_numpy()[i])) <= abs(corr(ranks[b].to_numpy()[i], ranks["y"].to_numpy()[i]))
        assert got["p"] == pytest.approx((1 + worse) / 61)
    assert got["p"] > 0.9


def test_what_a_predictor_adds(series):
    frame, df = series
    got = R.added(df, ["t"], "x", "noise", "y", 30, 60).first()
    r = frame.rank()
    design = np.column_stack([np.ones(len(r)), r["noise"], r["x"]])
    rest = r["y"] - design @ np.linalg.lstsq(design, r["y"], rcond=None)[0]
    assert got["r2_full"] == pytest.approx(1 - (rest @ rest) / ((r["y"] - r["y"].mean()) ** 2).sum())
    assert got["r2_base"] == pytest.approx(corr(r["noise"], r["y"]) ** 2) and got["p"] == pytest.approx(1 / 61) and got["partial"] > 0.4
    assert R.added(df, ["t"], "noise", "x", "y", 30, 60).first()["p"] > 0.1


def test_lift_of_atoms(spark, series):
    frame, _ = series
    atoms = [[a for a, on in (("hot", f > 0), ("odd", t % 2), ("always", True)) if on] + (["hot"] if f else []) for f, t in zip(frame["flag"], frame["t"], strict=True)]
    df = spark.createDataFrame(frame[["t", "y"]].assign(atoms=atoms)).repartition(3)
    got = R.lift_by_atom(df, "atoms", "y", ["t"], 30, samples=80).toPandas().set_index("atom")
    n = int(len(frame) * 0.7)
    y = frame["y"].to_numpy()
    for name, flag in (("hot", frame["flag"].to_numpy()), ("odd", (frame["t"] % 2).to_numpy(float))):
        gap = lambda f, v: v[f > 0].mean() - v[f == 0].mean() if 0 < f.sum() < len(f) else None
        stats = []
        for k in range(80):
            a, b = plain_pairs(n, 30, 3, k)
            stats.append(gap(flag[:n][a], y[:n][b]))
        own = gap(flag[:n], y[:n])
        assert got.loc[name, "train_gap"] == pytest.approx(own) and got.loc[name, "test_gap"] == pytest.approx(gap(flag[n:], y[n:]))
        assert got.loc[name, "p"] == pytest.approx(plain_p(stats, own))
    assert got.loc["hot", "p"] < 0.05 and got.loc["hot", "confirmed"] and got.loc["odd", "p"] > 0.05
    assert got.loc["always", "p"] == 1.0 and got.loc["always", "usable"] == 0
    assert R.lift_by_atom(df.where("false"), "atoms", "y", ["t"], 30).count() == 0


def plain_gradation(frame: pd.DataFrame, feature: str, n: int, length: float, samples: int) -> dict:
    """One feature by pandas: profile of the training and the later rows, z and p."""

    def profile(part):
        part = part[part[feature].notna()]
        bins = pd.qcut(part[feature], 5, labels=False, duplicates="drop").to_numpy()
        y = part["y"].to_numpy()
        return bins, y, [y[bins == b].mean() for b in range(bins.max() + 1)]

    def z(b, y):
        s = y.var() * ((b * b).sum() - b.sum() ** 2 / len(b))
        return (b * (y - y.mean())).sum() / math.sqrt(s) if s > 0 else None

    bins, y, shares = profile(frame[:n])
    own, stats = z(bins, y), []
    for k in range(samples):
        a, b = plain_pairs(len(y), length, max(1, int(length) // 8), k)
        stats.append(z(bins[a], y[b]))
    return {"shares": shares, "z": own or 0.0, "p": plain_p(stats, own), "later": profile(frame[n:])[2]}


def test_gradation_of_every_feature(spark):
    rng = np.random.default_rng(8)
    n = 900
    up, noise = rng.normal(size=n), rng.normal(size=n)
    frame = pd.DataFrame({"t": np.arange(n), "up": up, "down": -up + rng.normal(size=n) / 4, "noise": noise, "hump": np.abs(rng.normal(size=n)), "zeros": np.where(rng.random(n) < 0.5, 0.0, up), "same": 1.0, "none": np.nan})
    frame["y"] = (rng.random(n) < 1 / (1 + np.exp(-up))).astype(float)
    frame.loc[::9, "noise"] = np.nan
    names = ["up", "down", "noise", "hump", "zeros", "same", "none"]
    got = G.gradation(spark.createDataFrame(frame).repartition(4), names, "y", ["t"], 20, samples=60, alpha=0.2).toPandas().set_index("feature")
    assert set(got.index) == set(names) - {"none"}
    for f in ("up", "down", "noise", "hump", "zeros"):
        want = plain_gradation(frame, f, 630, 20, 60)
        np.testing.assert_allclose(got.loc[f, "shares"], want["shares"])
        assert got.loc[f, "z"] == pytest.approx(want["z"]) and got.loc[f, "p"] == pytest.approx(want["p"])
        assert got.loc[f, "test_spread"] == pytest.approx(want["later"][-1] - want["later"][0])
        ratio = got.loc[f, "test_spread"] / got.loc[f, "spread"]
        steps = np.diff(want["shares"])
        monotone = len(want["shares"]) >= 3 and bool((steps >= 0).all() or (steps <= 0).all())
        assert got.loc[f, "confirmed"] == (want["p"] <= 0.2 / 5 and monotone and 0.5 <= ratio <= 2)
    assert got.loc["up", "confirmed"] and got.loc["down", "significant"] and got.loc["down", "spread"] < 0
    assert not got.loc["noise", "confirmed"] and not got.loc["hump", "significant"]
    assert got.loc["zeros", "bins"] < 5 and got.loc["same", "bins"] == 1 and math.isnan(got.loc["same", "p"])


def test_bins_match_quantile_cuts(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=400), 1)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    edges = G.edges_of(df.withColumn("g", F.lit(1)), 5, ["g"])
    got = df.crossJoin(edges).select("x", G.bin_of(F.col("x"), F.col("edges")).alias("b")).toPandas()
    assert got.sort_values("x")["b"].tolist() == sorted(pd.qcut(x, 5, labels=False, duplicates="drop").tolist())


def test_trend_is_cochran_armitage_for_shares(spark):
    rows = [(b, float(h)) for b, k, n in ((0, 10, 60), (1, 20, 50), (2, 40, 70)) for h in [1] * k + [0] * (n - k)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "t long, b int, y double")
    z = R.apart(df, ["t"], {"b": F.col("b")}, {"y": F.col("y")}, 10, 1).where("sample = -1").select(R.of_target(R.trend_z, "y")).first()[0]
    n, k, x = np.array([60, 50, 70]), np.array([10, 20, 40]), np.arange(3)
    p = k.sum() / n.sum()
    assert z == pytest.approx(((k - n * p) @ x) / math.sqrt(p * (1 - p) * ((n * x * x).sum() - (n @ x) ** 2 / n.sum())))


@pytest.mark.parametrize("how", ["none", "bonferroni", "bh"])
def test_corrections(spark, how):
    p = [0.001, 0.012, 0.02, 0.04, 0.3, 0.9]
    got = G.corrected(spark.createDataFrame([(f"f{i}", v) for i, v in enumerate(p)], "feature string, p double"), 0.05, how).orderBy("feature").toPandas()["significant"].tolist()
    want = {"none": 4, "bonferroni": 1, "bh": 3}[how]
    assert got == [i < want for i in range(6)]


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([], "t long, a double, b double, y double")
    assert R.rank_links(none, ["t"], ["a", "b"], "y", 10, 5).count() == 0
    assert G.gradation(none, ["a", "b"], "y", ["t"], 10, samples=5).count() == 0
    assert R.intervals(none, ["t"], F.col("y"), ["a"], 10, 5).count() == 0
