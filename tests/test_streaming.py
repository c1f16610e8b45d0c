"""Streams against their batch twins."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from tests.test_operators import kernel_input
from tidemark.operators.structure import FLAGS, INPUT, StructureState
from tidemark.sources.stores import Store
from tidemark.streaming import live
from tidemark.streaming.structure import zone_stream


def run(df, tmp_path, mode="append"):
    name = f"q{uuid.uuid4().hex[:8]}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    return df.sparkSession.table(name)


def streamed(spark, df, tmp_path):
    path = str(tmp_path / f"in{uuid.uuid4().hex[:6]}")
    df.repartition(3).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_windows_match_batch_up_to_the_open_tail(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").orderBy("ts").coalesce(1)
    path = str(tmp_path / "e")
    events.write.parquet(path)
    got = run(live.window_aggregates(spark.readStream.schema(events.schema).parquet(path), "1 hour", "1 hour"), tmp_path).toPandas()
    want = live.window_aggregates(events, "1 hour", "1 hour").toPandas()
    both = want.merge(got, on=["start", "event_type"], how="left", suffixes=("", "_s"))
    closed = both[both["n_s"].notna()]
    assert len(got) == len(closed) and len(want) - len(got) <= 10
    assert (closed["n"] == closed["n_s"]).all() and closed["mean"].tolist() == pytest.approx(closed["mean_s"].tolist())


def test_first_in_ttl(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id")
    got = run(live.first_in(streamed(spark, events, tmp_path), ["user_id", "event_type"], "60 days"), tmp_path)
    assert got.count() == events.select("user_id", "event_type").distinct().count()


def test_cutoff():
    assert live.cutoff(10_000_000, 5, 7) == 5
    assert live.cutoff(10_000_000, None, 9_999_000) == 9_999_000
    assert live.cutoff(10_000_000, None, 1) == 10_000_000 - 30 * 86400
    assert live.cutoff(10_000_000, None, None) == 10_000_000 - 14400


SAMPLES = [("a", t, v) for t, v in enumerate([1, 9, 9, 9, 9, 6, 4, 9, 9, 9, 1])] + [("b", t, 1) for t in range(5)]


def test_alerts_in_batch(spark):
    rule = live.Rule("x", limit=8, recover=5, sustain=3, cooldown=5)
    df = spark.createDataFrame([(k, t, float(v)) for k, t, v in SAMPLES], "key string, t long, value double")
    assert sorted((r.t, r.what) for r in live.alerts(df, rule).collect()) == [(3, "fired"), (6, "recovered"), (9, "fired"), (10, "recovered")]


def test_alert_stream_equals_batch(spark, tmp_path):
    rule = live.Rule("x", limit=8, recover=5, sustain=3, cooldown=5)
    df = spark.createDataFrame([(k, t, float(v)) for k, t, v in SAMPLES], "key string, t long, value double")
    path = str(tmp_path / "s")
    df.orderBy("t").coalesce(1).write.parquet(path)
    got = run(live.alert_stream(spark.readStream.schema(df.schema).parquet(path), rule), tmp_path, "update")
    assert sorted((r.key, r.t, r.what) for r in got.collect()) == sorted((r.key, r.t, r.what) for r in live.alerts(df, rule).collect())


def test_structure_stream_equals_kernel(spark, tmp_path):
    bars = kernel_input(120)
    df = spark.createDataFrame([("A", i, *[b[k] for k in INPUT]) for i, b in enumerate(bars)], "symbol string, t long, " + ", ".join(f"{k} double" for k in INPUT))
    path = str(tmp_path / "b")
    df.coalesce(1).write.parquet(path)
    got = {r.t: r for r in run(zone_stream(spark.readStream.schema(df.schema).parquet(path)), tmp_path, "update").collect()}
    state = StructureState()
    for i, b in enumerate(bars):
        out = state.step(b)
        assert {k: out[k] for k in FLAGS} == {k: got[i][k] for k in FLAGS}


def test_emit_is_idempotent(spark, tmp_path):
    store, log = Store(spark, str(tmp_path / "store")), Store(spark, str(tmp_path / "log"))
    write = live.emit(store, ["id"], log)
    batch = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    for k in range(2):
        write(batch, k)
    assert store.read().count() == 2 and log.read().count() == 2


def test_strong_only(spark):
    df = spark.createDataFrame([("STRONG", 100), ("STRONG", 10), ("WEAK", 100)], "rating string, t long")
    assert live.strong_only(df, 50, 120).count() == 1
