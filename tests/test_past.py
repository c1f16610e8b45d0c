"""The matured past in stretches of time against the fold in one task, and its percentiles against plain ones."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import candidates as C
from tidemark.operators.accumulate import Accumulator
from tidemark.operators.growing import growing, kth
from tidemark.operators.past import Percentile, windows_of
from tidemark.plans.sequence import _candidate_rows

COLUMNS = "symbol string, tr string, block string, t long, id long, ret_pct double, mfe_pct double, mae_pct double, valid boolean, state_seq long"


def history(n: int, seed: int) -> list[tuple]:
    """One key with most rows, small ones, null keys, ties in time and in values, gaps of months, invalid and flat outcomes."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        t = int(rng.integers(0, 400)) * 7200 + (5_000_000 if i % 3 else 0) + (40_000_000 if i % 7 == 0 else 0)
        ret = None if rng.random() < 0.05 else float(rng.integers(-3, 4)) / 2
        tr = rng.choice(["hot", "hot", "hot", "small", None])
        mfe = None if rng.random() < 0.05 else float(rng.integers(0, 40)) / 8
        valid = None if rng.random() < 0.05 else bool(rng.random() < 0.9)
        rows.append(("A" if i % 50 else None, tr, f"b{rng.integers(2)}", t, i, ret, mfe, -float(rng.random()), valid, int(rng.integers(0, n // 4))))
    return rows


def flat(df) -> dict:
    return {r["id"]: tuple(tuple(r[c]) for c in ("past", "narrow") if c in df.columns) for r in df.collect()}


@pytest.mark.parametrize(("n", "stretch"), [(1500, 64), (700, 1), (300, 10_000)])
def test_stretches_give_what_one_task_gives(spark, n, stretch):
    df = spark.createDataFrame(history(n, n), COLUMNS)
    finer = ["block"] if stretch == 64 else None
    want = flat(C.folded(df, ["symbol", "tr"], 86_400, finer))
    got = flat(C.matured(df, ["symbol", "tr"], 86_400, finer, hot=60, stretch=stretch))
    assert len(got) == n and set(got) == set(want)
    for k, rows in want.items():
        for a, b in zip(got[k], rows, strict=True):
            assert a == pytest.approx(b), k


def test_columns_stay_and_empty_tables_pass(spark):
    df = spark.createDataFrame(history(200, 3), COLUMNS).withColumn("kind", F.lit("mine"))
    got = C.matured(df, ["symbol", "tr"], 86_400, hot=10, stretch=16)
    assert got.columns == [*df.columns, "past"] and got.where("kind = 'mine'").count() == 200
    assert C.matured(df.limit(0), ["symbol", "tr"], 86_400, ["block"]).count() == 0


def test_a_percentile_moves_within_its_window():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n, m, p = int(rng.integers(0, 60)), int(rng.integers(0, 20)), float(rng.choice([0.7, 0.8]))
        had, more = np.sort(rng.integers(0, 12, n).astype(float)), rng.integers(-3, 16, m).astype(float)
        here = Percentile(p, n)
        if n:
            low, high = windows_of(p, n, m)
            half = (low + high + 1) // 2
            for a, b in ((low, half), (half, high + 1)):
                if a < b:
                    here.hold(a, had[a:b])
        for k in range(m + 1):
            seen = np.concatenate([had, more[:k]])
            assert here.value() == pytest.approx(np.percentile(seen, 100 * p) if len(seen) else 0.0)
            if k < m:
                here.add(more[k])


def test_growing_arrays_say_what_accumulators_say():
    """Many keys at once: ties, untimed rows first, times before 1970, values that aren't numbers or are infinite, a lone row."""
    rng = np.random.default_rng(8)
    sizes = [1, 40, 300, 2, 7]
    key = np.repeat([9, -3, 5, 2, 11], sizes)
    n = len(key)
    timed = rng.random(n) < 0.95
    t = np.where(timed, rng.integers(-40, 60, n) * 43_200, 0)
    order = np.lexsort((t, timed, np.repeat(np.arange(len(sizes)), sizes)))
    timed, t = timed[order], t[order]
    ret = rng.choice([-2.0, -0.5, 0.0, 0.25, 1.0, np.nan, np.inf], n, p=[0.2, 0.2, 0.1, 0.2, 0.2, 0.05, 0.05])
    mfe, mae = rng.integers(-2, 9, n) / 4, -rng.integers(-2, 9, n) / 4
    valid, sequence = rng.random(n) < 0.9, rng.integers(0, 30, n)
    got = list(zip(*growing(key, t, timed, ret, mfe, mae, valid, sequence, 86_400), strict=True))
    for i in range(n):
        past = Accumulator()
        for j in range(n):
            if timed[i] and timed[j] and key[j] == key[i] and t[j] <= t[i] - 86_400:
                past.add(int(t[j]), float(ret[j]), float(mfe[j]), float(mae[j]), bool(valid[j]), int(sequence[j]))
        assert got[i] == pytest.approx(past.stats(), nan_ok=True), i


def test_kth_of_ranges_against_sorted_slices():
    values = np.random.default_rng(9).integers(0, 50, 400).astype(float)
    low, high = np.triu_indices(400, 1)
    for share in (0.0, 0.4, 1.0):
        k = np.floor(share * (high - low - 1)).astype(int)
        pick = np.arange(0, len(low), 97)
        assert kth(values, low[pick], high[pick], k[pick]).tolist() == [np.sort(values[a:b])[c] for a, b, c in zip(low[pick], high[pick], k[pick], strict=True)]


@pytest.mark.parametrize("at_once", [1, 50, 10_000])
def test_keys_cut_by_batches(spark, monkeypatch, at_once):
    """A key goes over several batches, a batch holds several keys; tasks take few rows or many at once."""
    monkeypatch.setattr(C, "AT_ONCE", at_once)
    records = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
        data = history(400, 4)
        got = flat(C.folded(spark.createDataFrame(data, COLUMNS).coalesce(1), ["symbol", "tr"], 86_400, ["block"]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    assert len(got) == 400
    for r in data:
        for same, stats in zip((2, 3), got[r[4]], strict=True):
            past = Accumulator()
            for q in sorted(data, key=lambda q: q[3]):
                if q[:same] == r[:same] and q[3] <= r[3] - 86_400:
                    past.add(q[3], *q[5:9], q[9])
            assert stats == pytest.approx(past.stats())


def test_keys_that_differ_by_where_a_null_is(spark):
    """A hash that skips nulls took the two keys for one."""
    data = [(*key, "b", t * 86_400, i * 5 + t, 1.0, 1.0, -1.0, True, t) for i, key in enumerate([(None, "A"), ("A", None)]) for t in range(5)]
    got = flat(C.folded(spark.createDataFrame(data, COLUMNS), ["symbol", "tr"], 86_400))
    assert {k: v[0][0] for k, v in got.items()} == {i * 5 + t: t for i in range(2) for t in range(5)}


def test_snapshots_are_read_and_shuffled_once(spark, small):
    """States were made twice and joined, with a shuffle for places and one for windows on each side."""
    plan = _candidate_rows(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 2


def test_snapshots_against_plain_offsets(spark):
    rng = np.random.default_rng(10)
    rows, seq = [], 0
    for t in range(200):
        moved = t > 0 and rng.random() < 0.3
        seq += moved
        rows.append(("S" if t < 150 else None, t, seq, f"tr{rng.integers(3)}" if moved else None, t * 10))
    got = sorted((r["transition_id"], r["offset"], r["t"], r["v"]) for r in C.snapshots(spark.createDataFrame(rows, "symbol string, t long, state_seq long, transition_id string, v long"), [0, 1, 3]).collect())
    known = [r for r in rows if r[0]]
    assert got == sorted((r[3], o, known[r[1] + o][1], known[r[1] + o][4]) for r in known if r[3] for o in (0, 1, 3) if r[1] + o < len(known) and known[r[1] + o][2] == r[2])
