"""Graded effects of continuous features: quantile bins, a test of the trend over them, and its confirmation on later rows."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators.ranking import FEW_GROUPS, exact_percentiles
from tidemark.operators.resampling import _codes, _coded, _decoded, bits_of, in_pieces, moved, of_target, opened, packed_codes, tested, trend_z, with_first
from tidemark.tables import small_batches, written

BINS, MIN_BINS = 5, 3
#: Rows that are sorted at a time, about.
SORTED = 1 << 25


def edges_of(long: DataFrame, bins: int, by: Sequence[str], often: str | None = None) -> DataFrame:
    """long(by, x) -> by, edges: the distinct quantiles of x at 0, 1/bins, ..., 1. often: how many rows each one stands for."""
    at = exact_percentiles(long, "x", [k / bins for k in range(bins + 1)], by, often)
    return at.select(*by, F.array_distinct(F.filter(F.array(*[F.col(f"p{k}") for k in range(bins + 1)]), lambda v: v.isNotNull())).alias("edges"))


def bin_of(x: Column, edges: Column) -> Column:
    """Number of the bin of x, from 0: bins are open below and closed above, the first one closed on both sides; null outside."""
    below = F.size(F.filter(edges, lambda e: e < x))
    inside = (x >= F.array_min(edges)) & (x <= F.array_max(edges))
    return F.when(inside, F.greatest(below - 1, F.lit(0)))


def _bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """``bin_of`` for numbers: -1 outside, -2 where x is no number."""
    if not (edges == edges).any():
        return np.where(x == x, -1, -2)
    # As the engine orders numbers, NaN comes after all others.
    inside = (x >= np.nanmin(edges)) & ((edges != edges).any() | (x <= np.nanmax(edges)))
    return np.where(x != x, -2, np.where(inside, np.maximum((edges[:, None] < x).sum(axis=0) - 1, 0), -1))


def _parts(first: int, n: int, cut: int) -> list[tuple[str, slice]]:
    """The rows of a piece that are for training, and those for the test; only what there is."""
    middle = min(n, max(0, cut - first))
    return [(part, slice(low, high)) for part, low, high in (("train", 0, middle), ("test", middle, n)) if low < high]


def _pieces(batches) -> Iterator[tuple[int, int, dict, dict]]:
    """first, n, columns by name (bits, codes, values) and the other fields of each piece."""
    for batch in batches:
        others = batch.drop_columns(["__columns"]).to_pylist()
        for row, columns in zip(others, opened(batch), strict=True):
            yield row["__first"], row["__n"], {name: coded for name, *coded in columns}, row


def _binned(coded: tuple, n: int, some: slice, edges: np.ndarray) -> np.ndarray:
    """Bins of some rows of a piece."""
    bits, codes, values = coded
    return _bins(_decoded(bits, codes, values, n)[some], edges) if bits == 64 else _bins(values, edges)[_codes(bits, codes, n)[some]]


def counted(pieces: DataFrame, features: Sequence[str], cut: int) -> DataFrame:
    """(feature, part, x, often): the numbers of each piece, and how many of its rows have them. part is train for the first rows in time, test for the others."""

    def values_of(batches):
        for first, n, columns, _ in _pieces(batches):
            for f in features:
                bits, codes, values = columns[f"x{f}"]
                for part, some in _parts(first, n, cut):
                    if bits == 64:
                        v, often = np.unique(_decoded(bits, codes, values, n)[some], return_counts=True)
                    else:
                        v, often = values, np.bincount(_codes(bits, codes, n)[some], minlength=len(values))
                    met = (often > 0) & (v == v)
                    yield pa.RecordBatch.from_arrays([pa.repeat(f, k := int(met.sum())), pa.repeat(part, k), pa.array(v[met]), pa.array(often[met], pa.int64())], names=["feature", "part", "x", "often"])

    return pieces.mapInArrow(values_of, "feature string, part string, x double, often long")


def cells_of(pieces: DataFrame, features: Sequence[str], cut: int, cuts: dict, bins: int) -> DataFrame:
    """(feature, part, bin, c, s, ss): rows, and sums of y and of its squares, of each bin in a task; with part 'usable' and no bin, the training rows that have a bin and a y."""

    def sums_of(batches):
        sums, usable = defaultdict(lambda: np.zeros((3, bins + 3))), defaultdict(int)
        for first, n, columns, _ in _pieces(batches):
            y = _decoded(*columns["yy"], n)
            for f in features:
                for part, some in _parts(first, n, cut):
                    if (f, part) in cuts:
                        b, v = _binned(columns[f"x{f}"], n, some, cuts[f, part]), y[some]
                        sums[f, part] += [np.bincount(b + 2, w, bins + 3) for w in (None, v, v * v)]
                        usable[f] += int(((b >= 0) & (v == v)).sum()) if part == "train" else 0
        rows = [(f, part, b - 2 if b > 1 else None, *map(float, s[:, b])) for (f, part), s in sums.items() for b in range(1, bins + 3) if s[0, b]]
        rows += [(f, "usable", None, float(k), 0.0, 0.0) for f, k in usable.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["feature", "part", "bin", "c", "s", "ss"])

    return pieces.mapInArrow(sums_of, "feature string, part string, bin int, c double, s double, ss double")


def series_of(pieces: DataFrame, whole: Sequence[str], others: Sequence[str], cut: int, cuts: dict) -> DataFrame:
    """The training rows' bins and y as pieces for ``moved``, by __series: features that all rows have are one series, of the others each is its own.

    Bins are moved within the rows that have the feature, so its places are counted anew.
    """
    before = pieces.withColumn("__before", F.lit(None).cast("map<string,bigint>"))
    if others:

        def usable_of(batches):
            for first, n, columns, row in _pieces(batches):
                y = _decoded(*columns["yy"], n)
                for _, some in _parts(first, n, cut)[: first < cut]:
                    n_of = [int(((_binned(columns[f"x{f}"], n, some, cuts[f, "train"]) >= 0) & (y[some] == y[some])).sum()) for f in others]
                    yield pa.RecordBatch.from_arrays([pa.array(others), *(pa.array([row[c]] * len(n_of), pa.int64()) for c in ("__range", "__at")), pa.array(n_of, pa.int64())], names=["feature", "__range", "__at", "n"])

        upto = Window.partitionBy("feature").orderBy("__range", "__at").rowsBetween(Window.unboundedPreceding, -1)
        counts = written(pieces.mapInArrow(usable_of, "feature string, __range long, __at long, n long"), "usable").withColumn("_s", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        starts = counts.groupBy("__range", "__at").agg(F.map_from_entries(F.collect_list(F.struct("feature", "_s"))).alias("__before"))
        before = pieces.join(F.broadcast(starts) if starts.count() * len(others) <= FEW_GROUPS else starts, ["__range", "__at"], "left")
    names = ["__series", "__first", "__n", "__name", "__bits", "__codes", "__values"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.list_(pa.float64())]

    def bins_of(batches):
        for first, n, columns, row in _pieces(batches):
            for _, some in _parts(first, n, cut)[: first < cut]:
                binned = {f: _binned(columns[f"x{f}"], n, some, cuts[f, "train"]) for f in [*whole, *others]}
                values = lambda f: np.arange(max(1, len(cuts[f, "train"])), dtype=float)
                out = [("", first, some.stop, f"x{f}", *packed_codes(binned[f], values(f))) for f in whole]
                if whole or others:
                    y = _decoded(*columns["yy"], n)[some]
                if whole:
                    bits, codes, old = columns["yy"]
                    out.append(("", first, some.stop, "yy", *((bits, codes.to_pybytes(), old) if some.stop == n else _coded(y))))
                for f in others:
                    met = (binned[f] >= 0) & (y == y)
                    if met.any():
                        at = dict(row["__before"])[f]
                        out += [(f, at, int(met.sum()), name, *coded) for name, coded in ((f"x{f}", packed_codes(binned[f][met], values(f))), ("yy", _coded(y[met])))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return before.mapInArrow(bins_of, "__series string, __first long, __n int, __name string, __bits int, __codes binary, __values array<double>")


def profiles(cells: DataFrame) -> DataFrame:
    """Of each (feature, part): the bins' mean outcomes in order, what they say of a trend, and its z in closed form.

    Columns: feature, part, n, shares, spread (last bin less the first), inversions (steps against the direction), monotone, z, bins.
    """
    cells = cells.groupBy("feature", "part", "bin").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    b = F.col("bin").cast("double")
    sums = cells.groupBy("feature", "part").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * b).alias("sx"), F.sum(F.col("c") * b * b).alias("sxx"), F.sum("s").alias("s_y"), F.sum("ss").alias("ss_y"), F.sum(F.col("s") * b).alias("sx_y"),
        F.transform(F.sort_array(F.collect_list(F.struct("bin", (F.col("s") / F.col("c")).alias("share")))), lambda r: r["share"]).alias("shares"),
    )
    steps = F.zip_with(F.slice("shares", F.lit(2), F.greatest(F.size("shares") - 1, F.lit(0))), F.slice("shares", F.lit(1), F.greatest(F.size("shares") - 1, F.lit(0))), lambda b, a: b - a)
    spread = F.element_at("shares", -1) - F.element_at("shares", 1)
    against = F.size(F.filter("_steps", lambda d: d * F.when(F.col("spread") >= 0, 1).otherwise(-1) < 0))
    told = sums.withColumns({"_steps": steps, "spread": spread, "bins": F.size("shares")}).withColumn("inversions", against)
    return told.select("feature", "part", F.col("n").cast("long").alias("n"), "shares", "spread", "inversions", ((F.col("inversions") == 0) & (F.col("bins") >= MIN_BINS)).alias("monotone"), F.coalesce(of_target(trend_z, "y"), F.lit(0.0)).alias("z"), "bins")


def corrected(p: DataFrame, alpha: float, how: str) -> DataFrame:
    """Adds significant: by Bonferroni, Benjamini-Hochberg (bh) or none. A row for each feature, so few."""
    if how not in ("bonferroni", "bh", "none"):
        raise ValueError(f"unknown correction {how}")
    whole = Window.partitionBy()
    m = F.count("p").over(whole)
    if how == "none":
        return p.withColumn("significant", F.col("p") <= alpha)
    if how == "bonferroni":
        return p.withColumn("significant", F.col("p") <= alpha / m)
    k = F.row_number().over(Window.partitionBy().orderBy("p", "feature"))
    top = p.withColumns({"_k": k, "_m": m}).withColumn("_top", F.max(F.when(F.col("p") <= F.col("_k") * alpha / F.col("_m"), F.col("_k"))).over(whole))
    return top.withColumn("significant", F.coalesce(F.col("_k") <= F.col("_top"), F.lit(False))).drop("_k", "_m", "_top")


def gradation(rows: DataFrame, features: Sequence[str] | dict[str, Column], metric: str | Column, order: Sequence[str], length: float, bins: int = BINS, train: float = 0.7, samples: int = 300, alpha: float = 0.05, correction: str = "bonferroni", unit: int | None = None, seed: int = 0) -> DataFrame:
    """Trend of the metric over quantile bins of each feature, in training rows, and whether later rows confirm it.

    Columns: feature, n, bins, shares, spread, inversions, monotone, z, p (bins moved by blocks against the metric), significant (after the
    correction over all features that have MIN_BINS bins), test_spread, test_z, confirmed: significant, monotone, and of one direction and between
    half and twice the size in the later rows. Features with fewer bins keep their profile, with p null. length: rows of a block, on average.
    Rows without a metric are no part, rows without a feature are none of that feature. The rows are sorted once and kept as codes, nothing else of their size is written.
    """
    named = features if isinstance(features, dict) else {f: F.col(f) for f in features}
    y = F.col(metric) if isinstance(metric, str) else metric
    pieces = with_first(in_pieces(rows.where(y.isNotNull()), order, [], {f"x{f}": c for f, c in named.items()} | {"yy": y}, missing=True, at_once=SORTED), [])
    spark, cut = rows.sparkSession, math.floor((pieces.agg(F.max("__rows")).first()[0] or 0) * train)
    with small_batches(spark):
        # Two rows for each feature.
        edges = edges_of(counted(pieces, list(named), cut), bins, ["feature", "part"], "often").collect()
        cuts = {(r["feature"], r["part"]): np.array(r["edges"], float) for r in edges if r["edges"]}
        cells = written(cells_of(pieces, list(named), cut, cuts, bins), "cells")
    told = profiles(cells.where("part != 'usable'"))
    trained = told.where(F.col("part") == "train")
    usable = {r["feature"]: int(r["c"]) for r in cells.where("part = 'usable'").groupBy("feature").agg(F.sum("c").alias("c")).collect()}
    whole, others = [f for f in named if 0 < usable.get(f, 0) == cut], {f: usable[f] for f in named if 0 < usable.get(f, 0) < cut}
    with small_batches(spark):
        series = series_of(pieces, whole, list(others), cut, cuts)
        width = {f"x{f}": bits_of(max(1, len(cuts[f, "train"]))) for f in [*whole, *others]}
        sizes = spark.createDataFrame([*([("", cut)] if whole else []), *others.items()], "__series string, __rows long")
        sums = moved(series, sizes, ["__series"], [*whole, *others], ["y"], length, samples, unit, seed, width)
    p = tested(sums.select("feature", "sample", of_target(trend_z, "y").alias("stat")), ["feature"]).select("feature", "p")
    enough = trained.where(F.col("bins") >= MIN_BINS).select("feature").join(p, "feature")
    judged = corrected(enough, alpha, correction)
    later = told.where((F.col("part") == "test") & (F.col("bins") >= MIN_BINS)).select("feature", F.col("spread").alias("test_spread"), F.col("z").alias("test_z"))
    ratio = F.col("test_spread") / F.nullif("spread", F.lit(0.0))
    confirmed = F.coalesce(F.col("significant") & F.col("monotone") & ratio.between(0.5, 2.0), F.lit(False))
    return trained.drop("part").join(judged, "feature", "left").join(later, "feature", "left").withColumns({"significant": F.coalesce("significant", F.lit(False)), "confirmed": confirmed})
