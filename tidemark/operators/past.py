"""The matured past of keys with very many rows, in stretches of time that are tasks of their own.

Each row is an arrival when its horizon is over, and a question at its own time. A key's arrivals and questions are cut into
stretches of about ``STRETCH`` of them, and a stretch starts from what all earlier ones of its key add up to:

* counts, sums and the month with most rows are running sums and maxima over the totals of stretches;
* a sequence, day or month that is new is an arrival of its own, found by a minimum for each, so distinct counts are sums too;
* of the values behind a percentile a stretch needs only those that its own arrivals can move the percentile to: as many places to
  either side as it has arrivals. Values are counted by cells of their order; a sweep over the cells' totals says where each window
  lies, and tasks of one cell cut the windows out.

So the work is linear in the rows, and a task holds a stretch, a cell, or totals of a key's stretches, but for rows of one instant.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from math import floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tidemark.operators.accumulate import DAY, MONTH, Accumulator
from tidemark.operators.ranking import placed
from tidemark.tables import written

#: Arrivals and questions of a stretch, about; steps of a key's time at which stretches may end; stretches that share a task's cell.
STRETCH, STEPS, BLOCK = 16_384, 65_536, 64
#: The most tasks of the last step.
MOST_TASKS = 10_000
#: Percentiles: of rises two, then of falls two, as in the accumulator.
SHARES = (0.70, 0.80, 0.70, 0.80)


class Percentile:
    """A percentile that moves with what arrives, from the earlier values around it: n values, of which skip lie below those held."""

    def __init__(self, p: float, n: int = 0):
        self.p, self.n, self.skip, self.values = p, n, 0, []
        self.above = n

    def hold(self, skip: int, values: np.ndarray) -> None:
        """Take a piece of the window; pieces come in order."""
        if not self.values:
            self.skip = skip
        self.values += values.tolist()
        self.above = self.n - self.skip - len(self.values)

    def add(self, x: float) -> None:
        self.n += 1
        if self.skip and x < self.values[0]:
            self.skip += 1
        elif self.above and x > self.values[-1]:
            self.above += 1
        else:
            insort(self.values, x)

    def value(self) -> float:
        if not self.n:
            return 0.0
        at = self.p * (self.n - 1)
        k = floor(at)
        a = self.values[k - self.skip]
        return a if at == k or k + 1 >= self.n else a + (self.values[k + 1 - self.skip] - a) * (at - k)


def windows_of(p: float, n: int, m: int) -> tuple[int, int]:
    """Places, from 0, of the first and last of n values that a percentile can meet while m more arrive."""
    return max(0, floor(p * (n - 1)) - m), min(n - 1, floor(p * (n + m - 1)) + 1)


def _sweep(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the windows of one key's percentile lie: for each stretch, the cells and the places in them."""
    pdf = pdf.sort_values("stretch", kind="stable")
    cells = max(0, int(pdf["cell"].max())) + 1
    p, seen, found = SHARES[int(pdf["q"].iloc[0])], np.zeros(cells, np.int64), []
    for stretch, part in pdf.groupby("stretch", sort=True):
        real = part[part["cell"] >= 0]
        n, m = int(seen.sum()), int(real["c"].sum())
        if n:
            low, high = windows_of(p, n, m)
            upto = np.cumsum(seen)
            for cell in range(int(np.searchsorted(upto, low, "right")), int(np.searchsorted(upto, high, "right")) + 1):
                below = int(upto[cell] - seen[cell])
                start, end = max(0, low - below), min(int(seen[cell]), high + 1 - below)
                if start < end:
                    found.append((cell, stretch, stretch // BLOCK, start, end, below + start))
        seen[real["cell"].to_numpy(np.int64)] += real["c"].to_numpy(np.int64)
    out = pd.DataFrame(found, columns=["cell", "stretch", "block", "start", "end", "skip"]).astype("int64")
    return out.assign(**{"__key": pdf["__key"].iloc[0], "q": pdf["q"].iloc[0]})


_WANTED = "__key long, q int, cell long, stretch long, block long, start long, end long, skip long"


def _cut_out(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
    """The windows of a block of stretches from the values of one cell."""
    have, want = have.sort_values("stretch"), want.sort_values("stretch")
    values, which = np.unique(have["v"].to_numpy(float), return_inverse=True)
    when, times = have["stretch"].to_numpy(np.int64), have["c"].to_numpy(np.int64)
    counts, done, out = np.zeros(len(values), np.int64), 0, []
    for w in want.itertuples():
        upto = int(np.searchsorted(when, w.stretch, "left"))
        np.add.at(counts, which[done:upto], times[done:upto])
        done = upto
        out.append(values[np.searchsorted(np.cumsum(counts), np.arange(w.start, w.end), "right")])
    return want[["__key", "q", "cell", "stretch", "skip"]].assign(held=out)


_HELD = "__key long, q int, cell long, stretch long, skip long, held array<double>"
_TOTALS = ["rows", "valid", "ups", "falls", "ret_sum", "sequences", "days", "months"]


def _fold(batches: Iterator[pa.RecordBatch], out_type: pa.DataType, name: str) -> Iterator[pa.RecordBatch]:
    """Statistics at each question, from rows in order of (key, stretch, time, kind): what was before, arrivals, questions."""
    current, read = None, ("__key", "stretch", "kind", "q", "skip", "t", "ret", "mfe", "mae", "valid")
    total, top, month, in_month, percentiles = {}, 0, None, 0, []
    for batch in batches:
        out, asked, bases, values = [], [], batch.column("base"), batch.column("held")
        for i, (key, stretch, kind, q, skip, t, ret, mfe, mae, valid) in enumerate(zip(*(batch.column(c).to_pylist() for c in read), strict=True)):
            if (key, stretch) != current:
                current = (key, stretch)
                total, top, month, in_month = dict.fromkeys(_TOTALS, 0), 0, None, 0
                percentiles = [Percentile(p) for p in SHARES]
            if kind == 0:
                base = bases[i].as_py()
                total = {c: base[c] for c in _TOTALS}
                top, month, in_month = base["top"], base["month"], base["in_month"]
                percentiles = [Percentile(p, total["ups" if k < 2 else "falls"]) for k, p in enumerate(SHARES)]
            elif kind == 1:
                percentiles[q].hold(skip, values[i].values.to_numpy(zero_copy_only=False))
            elif kind == 2:
                total[_TOTALS[5 + q]] += 1
            elif kind == 3:
                total["rows"] += 1
                now = t // MONTH
                in_month = in_month + 1 if now == month else 1
                month, top = now, max(top, in_month)
                if valid:
                    total["valid"] += 1
                    total["ret_sum"] += ret or 0.0
                    drop, rise = max(0.0, -(mae or 0.0)), max(0.0, mfe or 0.0)
                    if ret is not None and ret > 0:
                        total["ups"] += 1
                        percentiles[0].add(mfe or 0.0)
                        percentiles[1].add(drop)
                    elif ret is not None and ret < 0:
                        total["falls"] += 1
                        percentiles[2].add(drop)
                        percentiles[3].add(rise)
            else:
                a, b, c, d = (x.value() for x in percentiles)
                n = total
                asked.append(i)
                out.append((n["rows"], n["sequences"], n["valid"], n["ups"], float(n["ret_sum"]), n["days"], n["months"], top, a, b, n["falls"], c, d))
        rows = batch.column("payload").take(pa.array(asked, pa.int64()))
        stats = [pa.array(v, f.type) for v, f in zip(zip(*out, strict=True) if out else [[]] * len(out_type), out_type, strict=True)]
        yield pa.RecordBatch.from_arrays([rows, pa.StructArray.from_arrays(stats, fields=list(out_type))], names=["payload", name])


def in_stretches(rows: DataFrame, keys: DataFrame, key: list[str], horizon: int, name: str = "past", stretch: int = STRETCH) -> DataFrame:
    """rows of the given keys with their matured past, as ``candidates.matured`` says. keys: the key's columns, _n rows, _first and _last time."""
    hashed = F.xxhash64(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}))
    known = keys.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], hashed.alias("__key"), F.col("_first").alias("_low"), (F.col("_last") - F.col("_first") + horizon + 1).alias("_span"))
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)]
    t = F.col("t").cast("long")
    mine = rows.select(F.struct(*rows.columns).alias("payload"), *key, t.alias("t"), F.col("ret_pct").alias("ret"), F.col("mfe_pct").alias("mfe"), F.col("mae_pct").alias("mae"), F.coalesce("valid", F.lit(False)).alias("valid"), F.col("state_seq").alias("seq"))
    mine = mine.join(known, on).select("__key", "_low", "_span", "payload", "t", "ret", "mfe", "mae", "valid", "seq")
    facts = ["t", "ret", "mfe", "mae", "valid"]
    none = lambda names: [F.lit(None).cast(mine.schema[c].dataType).alias(c) for c in names]
    arrive = (F.col("t") + horizon).alias("at")
    ids = ["__key", "_low", "_span"]
    parts = [
        mine.select(*ids, arrive, F.lit(3).alias("kind"), F.lit(None).cast("int").alias("q"), *facts, *none(["payload"])),
        mine.select(*ids, F.col("t").alias("at"), F.lit(4).alias("kind"), F.lit(None).cast("int").alias("q"), *none(facts), "payload"),
    ]
    for q, what in enumerate([F.col("seq"), F.floor(F.col("t") / DAY), F.floor(F.col("t") / MONTH)]):
        first = mine.groupBy(*ids, what.alias("_what")).agg((F.min("t") + horizon).alias("at"))
        parts.append(first.select(*ids, "at", F.lit(2).alias("kind"), F.lit(q).alias("q"), *none([*facts, "payload"])))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    both = both.withColumn("_step", F.floor((F.col("at") - F.col("_low")) / F.col("_span") * STEPS))
    counts = both.groupBy("__key", "_step").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("__key").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    dealt = counts.select("__key", "_step", F.floor(F.coalesce(F.sum("_n").over(upto), F.lit(0)) / stretch).alias("stretch"))
    events = written(both.join(dealt, ["__key", "_step"]).drop("_low", "_span", "_step"), "past")

    # What each stretch adds, and what was there before it.
    arrived, new = F.col("kind") == 3, lambda q: F.count(F.when((F.col("kind") == 2) & (F.col("q") == q), 1))
    good = arrived & F.col("valid")
    adds = [F.count(F.when(arrived, 1)), F.count(F.when(good, 1)), F.count(F.when(good & (F.col("ret") > 0), 1)), F.count(F.when(good & (F.col("ret") < 0), 1)), F.coalesce(F.sum(F.when(good, F.col("ret"))), F.lit(0.0)), new(0), new(1), new(2)]
    totals = events.groupBy("__key", "stretch").agg(*[a.alias(c) for a, c in zip(adds, _TOTALS, strict=True)])
    in_key = Window.partitionBy("__key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    months = events.where(arrived).groupBy("__key", "stretch", F.floor(F.col("t") / MONTH).alias("_m")).agg(F.count(F.lit(1)).alias("_c"))
    months = months.withColumn("_c", F.sum("_c").over(Window.partitionBy("__key", "_m").orderBy("stretch")))
    months = months.groupBy("__key", "stretch").agg(F.max("_c").alias("_top"), F.max(F.struct("_m", "_c")).alias("_latest"))
    before = totals.join(months, ["__key", "stretch"], "left").select(
        "__key", "stretch", *[F.coalesce(F.sum(c).over(in_key), F.lit(0)).alias(c) for c in _TOTALS], F.coalesce(F.max("_top").over(in_key), F.lit(0)).alias("top"), F.max("_latest").over(in_key).alias("_latest")
    )
    before = before.select("__key", "stretch", F.struct(*_TOTALS, "top", F.col("_latest._m").alias("month"), F.coalesce(F.col("_latest._c"), F.lit(0)).alias("in_month")).alias("base"))

    # The values around each percentile at the beginning of each stretch.
    zero = F.lit(0.0)
    mfe, mae = F.coalesce("mfe", zero), F.coalesce("mae", zero)
    drop, rise = F.greatest(zero, -mae), F.greatest(zero, mfe)
    pair = lambda q, a, b: F.array(F.struct(F.lit(q).alias("q"), a.alias("v")), F.struct(F.lit(q + 1).alias("q"), b.alias("v")))
    sides = events.where(good & (F.col("ret") != 0)).select("__key", "stretch", F.inline(F.when(F.col("ret") > 0, pair(0, mfe, drop)).otherwise(pair(2, drop, rise))))
    spots = placed(sides, "v", ["__key", "q"]).select("__key", "q", "v", F.floor(F.col("before") / stretch).alias("cell"))
    celled = written(sides.groupBy("__key", "q", "v", "stretch").agg(F.count(F.lit(1)).alias("c")).join(spots, ["__key", "q", "v"]), "cells")
    every = totals.select("__key", F.explode(F.array(*[F.lit(q) for q in range(len(SHARES))])).alias("q"), F.lit(-1).cast("long").alias("cell"), "stretch", F.lit(0).cast("long").alias("c"))
    cells = celled.groupBy("__key", "q", "cell", "stretch").agg(F.sum("c").alias("c")).unionByName(every)
    wanted = written(cells.groupBy("__key", "q").applyInPandas(_sweep, _WANTED), "windows")
    by = ["__key", "q", "cell", "block"]
    blocks = wanted.select(*[F.col(c).alias(c) for c in by]).distinct()
    given = celled.join(blocks, ["__key", "q", "cell"]).where(F.col("stretch") < (F.col("block") + 1) * BLOCK)
    # Of a block only what comes before a stretch differs by stretch; all that came before the block is one row a value.
    given = given.groupBy("__key", "q", "cell", "block", "v", F.greatest("stretch", F.col("block") * BLOCK - 1).alias("stretch")).agg(F.sum("c").alias("c"))
    pieces = given.groupBy(*by).cogroup(wanted.groupBy(*by)).applyInPandas(_cut_out, _HELD)

    lay = ["__key", "stretch", "at", "kind", "q", "cell", "skip", "held", *facts, "base", "payload"]
    types = {"cell": "long", "skip": "long", "held": "array<double>", "q": "int", "at": "long", "base": before.schema["base"].dataType, **{c: mine.schema[c].dataType for c in [*facts, "payload"]}}
    laid = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in lay])
    stream = laid(events).unionByName(laid(before.withColumn("kind", F.lit(0)))).unionByName(laid(pieces.withColumn("kind", F.lit(1))))
    # A task for about eight stretches, whatever their bytes: the fold is bound by rows.
    tasks = max(1, min(MOST_TASKS, keys.agg(F.sum("_n")).first()[0] // (4 * stretch)))
    stream = stream.repartition(tasks, "__key", "stretch").sortWithinPartitions("__key", "stretch", F.col("at").asc_nulls_first(), "kind", "q", "cell")
    stats = T.StructType.fromDDL(Accumulator.SCHEMA)
    arrow = pa.struct([pa.field(f.name, pa.float64() if f.dataType == T.DoubleType() else pa.int64()) for f in stats.fields])
    schema = T.StructType([T.StructField("payload", rows.schema), T.StructField(name, stats)])
    return stream.mapInArrow(lambda batches: _fold(batches, arrow, name), schema).select("payload.*", name)
