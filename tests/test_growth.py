"""Queries on tables larger or odder than the given ones: what the rows' number, ids beyond a range, zeros and bad sketches may not change."""

from __future__ import annotations

import tracemalloc
from hashlib import md5

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_forecast import plain_trees, sample
from tests.test_queries import rows
from tests.test_resampling import plain_pairs, plain_rows
from tidemark import tables
from tidemark.operators import forecast as Q
from tidemark.operators import gradation as G
from tidemark.operators import ranking
from tidemark.operators import records as R
from tidemark.operators import resampling as B
from tidemark.plans.catalog import REGISTRY


def against_sql(spark, folder, name: str, table: str, sql: str):
    """The query and its SQL on a table that the SQL text makes."""
    con = duckdb.connect()
    con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    assert rows(REGISTRY.builders[name](spark, str(folder)).toPandas()) == rows(con.execute(REGISTRY.oracles[name]).df())


def test_zero_prices_have_range_estimators(spark, small, tmp_path):
    zeros = f"SELECT * REPLACE (CASE WHEN event_id % 40 < 2 THEN 0.0 ELSE value END AS value) FROM '{small}/events.parquet'"
    against_sql(spark, tmp_path, "e27_range_estimators", "events", zeros)


def test_levels_of_buckets_with_large_event_ids(spark, small, tmp_path):
    against_sql(spark, tmp_path, "d05_metrics_to_buckets", "events", f"SELECT * REPLACE (event_id * 70001 AS event_id) FROM '{small}/events.parquet'")


def test_rows_ahead_cost_no_more_for_crowded_times(spark):
    """A window of 300,000 rows: counting each row's window anew takes 4.5e10 steps."""
    crowded = spark.range(300_000).select(F.lit("a").alias("g"), (F.col("id") % 100).alias("t")).unionByName(spark.createDataFrame([("a", 1000), ("b", 5)], "g string, t long"))
    got = R.rows_ahead(crowded, "g", F.col("t"), 200).groupBy("g", "n").count().collect()
    assert {(r["g"], r["n"]): r["count"] for r in got} == {("a", 3000 * (100 - t)): 3000 for t in range(100)}


def test_rows_ahead_against_a_plain_count(spark):
    t = np.sort(np.random.default_rng(3).integers(-50, 400, 300))
    got = sorted(r["n"] for r in R.rows_ahead(spark.createDataFrame(pd.DataFrame({"g": "a", "t": t})), "g", F.col("t"), 70).collect())
    assert got == sorted(int(((t >= x) & (t < x + 70)).sum()) for x in t if x + 69 <= t[-1])


@pytest.mark.parametrize("width, phases", [(24, 4), (50, 7)])
def test_thinned_rows_against_a_plain_scan(spark, width, phases):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"id": np.arange(400), "t": rng.integers(0, 1500, 400), "x": rng.normal(size=400)})
    got = {(r["i"], r["x"]) for r in R.thinned(spark.createDataFrame(frame), F.col("t"), "x", ["t", "id"], width, phases).collect()}
    want = set()
    for i in range(phases):
        first = frame.sort_values(["t", "id"]).groupby((frame["t"] - i * (width // phases)) // width).first()
        want |= {(i, x) for x in first["x"]}
    assert got == want


def test_percentiles_where_the_sketch_is_far_off(spark, monkeypatch):
    """Marks that lie beside the percentile on one side."""
    monkeypatch.setattr(ranking.F, "percentile_approx", lambda c, marks, accuracy: F.array(*[F.lit(float(i)) + F.max(c) * 0 for i in range(len(marks))]))
    x = np.random.default_rng(5).normal(100, 30, 2000)
    got = ranking.exact_percentiles(spark.createDataFrame(pd.DataFrame({"x": x})), "x", (0.1, 0.5, 0.9)).first()
    np.testing.assert_allclose([got[f"p{i}"] for i in range(3)], np.quantile(x, [0.1, 0.5, 0.9]), rtol=1e-12)


def test_ranks_read_the_rows_once_in_a_plan(spark):
    """Plans that read the rows again for each rank, and again for each place, filled the driver: 27 readings for three ranks."""
    df = spark.range(100).selectExpr("id % 3 AS g", "id % 7 AS a", "id % 11 AS b", "id AS c")
    plan = B.ranked(df, ["a", "b", "c"], ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 100") == 1


def plain_sums(frame: pd.DataFrame, unit: int, sample: int) -> list[float]:
    a, b = plain_pairs(len(frame), 30, unit, sample)
    x, y = frame["x"].to_numpy()[a], frame["y"].to_numpy()[b]
    return [len(x), x.sum(), x @ x, y.sum(), y @ y, x @ y]


@pytest.mark.parametrize("kind", ["few", "many"])
def test_samples_over_many_tiles(spark, monkeypatch, kind):
    """Series of many stretches and chunks, with predictors in several parts; a shorter last unit; predictors with few and many distinct values."""
    for name, v in (("STRETCH", 8), ("TARGET_ROWS", 60), ("PREDICTOR_ROWS", 100), ("PREDICTORS", 1)):
        monkeypatch.setattr(B, name, v)
    rng = np.random.default_rng(6)
    x = rng.integers(0, 5, 701).astype(float) if kind == "few" else rng.normal(size=701)
    frame = pd.DataFrame({"t": np.arange(701), "x": x, "y": rng.normal(size=701)})
    got = B.apart(spark.createDataFrame(frame), ["t"], {"x": F.col("x"), "more": -F.col("x")}, {"y": F.col("y")}, 30, 3, unit=3).collect()
    assert len(got) == 2 * 4
    for r in got:
        sign = 1 if r["feature"] == "x" else -1
        np.testing.assert_allclose([r["n"], sign * r["sx"], r["sxx"], r["s_y"], r["ss_y"], sign * r["sx_y"]], plain_sums(frame, 3, r["sample"]), rtol=1e-9)


@pytest.mark.parametrize("held", [1 << 21, 40])
def test_samples_draw_their_runs_where_targets_are(spark, monkeypatch, held):
    """Runs of all samples, sent and spread out to units, took gigabytes. Pieces that begin and end within units, tiles of both sides, groups with null and NaN, several targets."""

    def sent(*_, **__):
        raise AssertionError("runs are sent")

    for name, v in (("STRETCH", 8), ("TARGET_ROWS", 100), ("PREDICTOR_ROWS", 70), ("PREDICTORS", 1), ("PIECE", 7), ("RUNS", held), ("PRODUCTS", 16), ("runs", sent)):
        monkeypatch.setattr(B, name, v, raising=name not in ("PIECE", "RUNS", "PRODUCTS"))
    rng = np.random.default_rng(8)
    groups = {None: 311, float("nan"): 5, 1.5: 402}
    frames = {g: pd.DataFrame({"t": np.arange(n), "x": rng.integers(0, 2, n).astype(float), "y": rng.normal(size=n)}) for g, n in groups.items()}
    lines = [(g, int(t), x, y) for g, f in frames.items() for t, x, y in f.itertuples(index=False)]
    df = spark.createDataFrame([*lines, (1.5, 3, None, 1.0), (1.5, 4, 1.0, float("nan"))], "g double, t long, x double, y double").repartition(3)
    got = B.apart(df, ["t"], {"x": F.col("x"), "wide": F.col("x") * F.col("y")}, {"y": F.col("y"), "z": -F.col("y")}, 30, 3, ["g"], unit=3).collect()
    assert len(got) == 3 * 2 * 4
    for r in got:
        f = next(f for g, f in frames.items() if g == r["g"] or str(g) == str(r["g"]))
        f = f if r["feature"] == "x" else f.assign(x=f["x"] * f["y"])
        want = plain_sums(f, 3, r["sample"])
        np.testing.assert_allclose([r[c] for c in ("n", "sx", "sxx", "s_y", "ss_y", "sx_y")], want, rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose([-r["s_z"], r["ss_z"], -r["sx_z"]], want[3:], rtol=1e-9, atol=1e-12)


def test_a_task_of_samples_holds_few_runs():
    """40 samples of 120,000 units: spread out to units, their places and sources alone take 77 MB."""
    tile, x = B._Tile(1_440_000, 12, 4096, 0, 120_000, 0, 120_000, 1), (np.arange(1 << 16) % 7 < 2).astype(float)
    tile.stays(0, 0, np.ones(1_440_000))
    pieces = {(at, len(v)): [("x", *B._coded(v))] for at in range(0, 1_440_000, 1 << 16) for v in [x[: 1_440_000 - at]]}
    tracemalloc.start()
    sums = tile.sums(range(-1, 39), 0, 1 / 8, 4096, pieces)["x"]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6
    np.testing.assert_allclose(sums[[0, 3, 4]], 1_440_000)
    np.testing.assert_allclose(sums[1], sums[5])


@pytest.mark.parametrize("prefix, low, high", [(b"0|17|", 0, 1200), (b"12|3|", 99_990, 100_020), (b"7|1|", 8190, 16_400), (b"-" * 53, 0, 120)])
def test_hashes_taken_together_are_md5(prefix, low, high):
    want = [md5(prefix + b"%d" % p).hexdigest() for p in range(low, high)]
    assert B._hashed(prefix, low, high).tolist() == [[int(w[:8], 16), int(w[8:16], 16)] for w in want]


def graded(n: int) -> pd.DataFrame:
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"t": rng.permutation(n) // 2, "id": np.arange(n), "few": rng.integers(0, 50, n).astype(float), "many": rng.normal(size=n), "holes": rng.normal(size=n), "late": rng.normal(size=n)})
    frame["y"] = frame["few"] / 50 + rng.normal(size=n)
    frame.loc[::7, "holes"] = np.nan
    frame.loc[frame["t"] < n // 8, "late"] = np.nan
    return frame


def test_gradation_writes_rows_once_as_codes(spark, monkeypatch, tmp_path):
    """Rows with their places and their bins, of all features, were written as rows: 101 bytes a row here."""
    monkeypatch.setattr(tables, "scratch", lambda spark, name: f"{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}")
    n = 40_000
    df = spark.createDataFrame(graded(n)).select("t", "id", "few", F.floor("many").cast("double").alias("many"), (F.col("t") % 11).alias("eleven"), (F.col("t") % 7).alias("seven"), "y").repartition(3)
    got = G.gradation(df, ["few", "many", "eleven", "seven"], "y", ["t", "id"], 512, samples=3)
    assert got.count() == 4
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 20 * n


def test_gradation_in_parts_rounds_and_tiles(spark, monkeypatch):
    """Sorted in parts, tiles of one chunk of predictors at a time, pieces that begin within units: the same figures. Features with holes are series of their own."""
    monkeypatch.setattr(B, "STRETCH", 8)
    df = spark.createDataFrame(graded(800)).withColumn("y", F.when(F.col("id") % 50 != 3, F.when(F.col("id") % 50 == 4, float("nan")).otherwise(F.col("y")))).repartition(3)
    names = ["few", "many", "holes", "late"]
    columns = ["feature", "n", "bins", "shares", "spread", "inversions", "z", "p", "test_spread", "test_z"]

    def found(at_once):
        monkeypatch.setattr(G, "SORTED", at_once)
        return G.gradation(df, {f: F.col(f) for f in names}, F.when(F.isnan("y"), 0.0).otherwise(F.col("y")), ["t", "id"], 20, samples=30).orderBy("feature").select(columns).toPandas()

    want = found(1 << 25)
    for name, v in (("PIECE", 50), ("TARGET_ROWS", 200), ("PREDICTOR_ROWS", 200), ("PREDICTORS", 1), ("RUNS", 100), ("PRODUCTS", 64)):
        monkeypatch.setattr(B, name, v)
    assert len(B._in_parts(df, "t", 250)) == 4
    pd.testing.assert_frame_equal(found(250), want, rtol=1e-9)


def test_rows_without_a_number_for_a_metric_keep_their_place(spark):
    """The profile of a metric that is no number is none either; its test goes on with the rows that have one."""
    df = spark.createDataFrame(graded(600)).withColumn("y", F.when(F.col("id") == 17, float("nan")).otherwise(F.col("y")))
    got = G.gradation(df, ["few"], "y", ["t", "id"], 20, samples=9).first()
    assert got["n"] == 420 and 0 < got["p"] < 1


def test_percentiles_of_values_that_stand_for_rows(spark):
    rng = np.random.default_rng(10)
    x, often = np.round(rng.normal(size=500), 2), rng.integers(1, 40, 500)
    got = ranking.exact_percentiles(spark.createDataFrame(pd.DataFrame({"x": x, "k": often})), "x", (0, 0.2, 0.5, 0.99, 1), often="k").first()
    np.testing.assert_allclose([got[f"p{i}"] for i in range(5)], np.quantile(np.repeat(x, often), [0, 0.2, 0.5, 0.99, 1]), rtol=1e-12)


def test_whole_rows_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(B, "STRETCH", 8)
    monkeypatch.setattr(B, "CHUNK", 16)
    v = np.random.default_rng(7).normal(size=500)
    got = B.jointly(spark.createDataFrame(pd.DataFrame({"t": np.arange(500), "v": v})), ["t"], {"s": F.col("v"), "c": F.lit(1.0)}, 30, 3, unit=3).collect()
    assert len(got) == 4
    for r in got:
        picked = v[plain_rows(500, 30, 3, r["sample"])]
        np.testing.assert_allclose([r["s"], r["c"]], [picked.sum(), len(picked)], rtol=1e-9)


def test_sources_of_a_sample_come_as_runs(spark):
    """A row for each block, not for each unit of a sample."""
    got = B.runs(spark.createDataFrame([(20_000,)], "units long"), [], 64, 1, 2, 0).where("sample >= 0")
    assert got.agg(F.sum("n")).first()[0] == 40_000 and got.count() < 2000


@pytest.mark.parametrize("listed", [True, False])
def test_trees_by_cells_and_by_rows_are_alike(spark, monkeypatch, listed):
    """With few columns passes count rows by cell and hold no model's values beside the rows; with more they do. Both grow plain trees."""
    if not listed:
        monkeypatch.setattr(Q, "CELLS", 0)
    monkeypatch.setattr(Q, "KEEP", 2)
    written = []
    monkeypatch.setattr(Q, "written", lambda df, name: written.append(df.columns) or tables.written(df, name))
    frame = sample(600)
    df = spark.createDataFrame(frame).repartition(3)
    forest = Q.fit(df, ["a", "b"], "y", [Q.Model(0.25, [0, 1], F.lit(True)), Q.Model(0.9, [1], F.col("t") < 400)], trees=5)
    assert written == ([["y", "cell", "mask"]] if listed else [["y", "bins", "mask", "f"]] * 3)
    spread = np.subtract(*df.agg(F.percentile_approx("y", [0.75, 0.25], 10_000)).first()[0])
    x, y, got = frame[["a", "b"]].to_numpy(), frame["y"].to_numpy(), forest.values(frame)
    for k, m in enumerate(forest.models):
        mine = np.arange(600) < (600 if k == 0 else 400)
        np.testing.assert_allclose(got[mine, k], plain_trees(x[mine], y[mine], forest.edges, m.columns, m.level, m.start, spread, 5, 2, 0.3), atol=1e-9)
