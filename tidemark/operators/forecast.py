"""Quantile forecasts by boosted trees that executors grow, with benchmark heads, range lift, walk-forward folds and a gate.

Every model is a sum of trees on binned columns. All models of a call grow together: the heads of each quantile, those on the benchmark's columns
alone, those of each fold. A level of a tree is one pass: tasks sum (model, node, column, bin) histograms of the loss's slope over their
rows, and only these sums meet, so the driver holds models x nodes x columns x bins numbers, whatever the rows. Leaves step along the
slope, so they come to rest where the share of rows below equals the quantile.

A model's value depends on a row's bins alone. With few columns all cells of bins are listed: a row is its cell, its target and its mask, a
pass looks values up by cell and counts rows above and below them by cell. With more columns the models' values so far are kept beside
the rows and written anew every KEEP trees.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import resampling as R
from tidemark.operators.ranking import with_place
from tidemark.tables import written

QUANTILES = (0.25, 0.5, 0.75, 0.9)
#: Bins of a column; trees after which values are written; rows that a leaf needs.
BINS, KEEP, LEAF_ROWS = 32, 8, 20
#: Cells of bins that are listed, at most: those of three columns. Rows that a task looks up at once.
CELLS, ROWS = BINS**3, 1 << 18
#: Conditions of the gate: gain of R2, its p and that of the ranks, largest error of coverage. Fixed values.
LEAST_GAIN, MOST_P, MOST_COVERAGE_ERROR = 0.02, 0.05, 0.05
#: Lift of compressed and expanded ranges. Fixed values.
COMPRESSED, EXPANDED = 0.85, 1.15
#: Models that grow together, at most: each has a bit of the rows' mask.
MOST_MODELS = 63


@dataclass
class Model:
    """A quantile's head: which columns it may use, which rows it learns from, and its trees.

    A tree is arrays (column, bin, left, right, value) of nodes: rows whose bin is at most ``bin`` go left; column -1 is a leaf.
    """

    level: float
    columns: list[int]
    rows: Column
    start: float = 0.0
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)


@dataclass
class Forest:
    """Fitted models over columns with their bins' edges."""

    columns: list[str]
    edges: list[np.ndarray]
    models: list[Model]

    def values(self, pdf: pd.DataFrame) -> np.ndarray:
        """A column for each model; rows with unknown columns give unknown values."""
        x = pdf[self.columns].to_numpy(float)
        bins = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(self.edges)], axis=1) if self.columns else np.empty((len(x), 0), int)
        same = None
        if self.columns and BINS ** len(self.columns) <= CELLS:  # each cell is looked up once
            sizes = (BINS,) * len(self.columns)
            cells, same = np.unique(np.ravel_multi_index(bins.T, sizes), return_inverse=True)
            bins = np.stack(np.unravel_index(cells, sizes), axis=1)
        out = np.stack([m.start + sum((_leaf_values(t, bins) for t in m.trees), np.zeros(len(bins))) for m in self.models], axis=1)
        out = out if same is None else out[same]
        out[np.isnan(x).any(axis=1)] = np.nan
        return out


def _leaves(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The node in which each row ends."""
    column, cut, left, right, _ = tree
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    while True:
        inner = column[node] >= 0
        if not inner.any():
            return node
        below = bins[rows, np.maximum(column[node], 0)] <= cut[node]
        node = np.where(inner, np.where(below, left[node], right[node]), node)


def _leaf_values(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    return tree[4][_leaves(tree, bins)]


def _open_tree() -> list[list]:
    return [[-1], [0], [0], [0], [0.0]]


def _arrays(tree: list[list]) -> tuple[np.ndarray, ...]:
    return (*(np.array(x, np.int64) for x in tree[:4]), np.array(tree[4], float))


def _bins_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width).astype(np.int64)


def _values_of(batch: pa.RecordBatch, models: list[Model], since: int, bins: np.ndarray) -> np.ndarray:
    """Values of all models: the written ones, and the trees grown since."""
    f = np.frombuffer(b"".join(batch.column("f").to_pylist()), np.float64).reshape(-1, len(models)).copy()
    for k, m in enumerate(models):
        for t in m.trees[since:]:
            f[:, k] += _leaf_values(t, bins)
    return f


def _histograms(models: list[Model], growing: list[tuple[np.ndarray, ...]], since: int, width: int):
    """A task's rows -> sums over (model, node, column, bin) of rows and of the loss's slope."""

    def run(batches):
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = _bins_of(batch, width)
            y, mask = batch.column("y").to_numpy(), batch.column("mask").to_numpy()
            f = _values_of(batch, models, since, bins)
            for k, m in enumerate(models):
                mine = np.flatnonzero(mask >> k & 1)
                if not len(mine):
                    continue
                node = _leaves(growing[k], bins[mine])
                slope = np.where(y[mine] > f[mine, k], m.level, m.level - 1)
                for leaf in np.unique(node).tolist():
                    here = np.flatnonzero(node == leaf)
                    for j in m.columns:
                        b = bins[mine[here], j]
                        found = np.stack([np.bincount(b, minlength=BINS), np.bincount(b, slope[here], BINS)])
                        key = (k, leaf, j)
                        sums[key] = sums[key] + found if key in sums else found
        yield _batch_of_sums([r for key, v in sums.items() for r in _rows_by_model(v, *key)])

    return run


def _rows_by_model(histograms: np.ndarray, k: int, node: int, j: int) -> list[tuple]:
    return [(k, node, j, b, histograms[0, b], histograms[1, b]) for b in np.flatnonzero(histograms[0]).tolist()]


def _batch_of_sums(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = [pa.int32()] * 4 + [pa.float64()] * 2
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["model", "node", "col", "bin", "n", "g"])


def _cells(width: int) -> np.ndarray:
    """Bins of every cell: the first column's bin counts most."""
    return np.stack(np.unravel_index(np.arange(BINS**width), (BINS,) * width), axis=1) if width else np.zeros((1, 0), np.int64)


def _histograms_of_cells(models: list[Model], growing: list[tuple[np.ndarray, ...]], width: int):
    """As ``_histograms``, of rows given as cells."""

    def run(batches):
        bins = _cells(width)
        values = [m.start + sum((_leaf_values(t, bins) for t in m.trees), np.zeros(len(bins))) for m in models]
        count, above = np.zeros((len(models), len(bins)), np.int64), np.zeros((len(models), len(bins)), np.int64)

        def add(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held)
            y, cell, mask = (t.column(c).to_numpy() for c in ("y", "cell", "mask"))
            everywhere = np.bitwise_and.reduce(mask)
            of_mask: dict[bytes, tuple[np.ndarray, ...]] = {}
            for k in range(len(models)):
                one = everywhere >> k & 1
                mine = None if one else (mask >> k & 1).astype(bool)
                key = b"" if one else np.packbits(mine).tobytes()
                if key not in of_mask:
                    cells = cell if one else cell[mine]
                    of_mask[key] = (cells, y if one else y[mine], np.bincount(cells, minlength=len(bins)))
                cells, targets, rows = of_mask[key]
                count[k] += rows
                above[k] += np.bincount(cells[targets > values[k][cells]], minlength=len(bins))

        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size >= ROWS:
                add(held)
                held, size = [], 0
        if size:
            add(held)
        rows: list[tuple] = []
        for k, m in enumerate(models):
            slope = above[k] * m.level + (count[k] - above[k]) * (m.level - 1)
            node = _leaves(growing[k], bins)
            for leaf in np.unique(node[count[k] > 0]).tolist():
                here = np.flatnonzero((node == leaf) & (count[k] > 0))
                for j in m.columns:
                    b = bins[here, j]
                    rows += _rows_by_model(np.stack([np.bincount(b, count[k][here], BINS), np.bincount(b, slope[here], BINS)]), k, leaf, j)
        yield _batch_of_sums(rows)

    return run


def _split(found: np.ndarray) -> tuple[float, int, np.ndarray] | None:
    """found: (2, bins) rows and slopes of a column -> gain, bin, and both sides' (rows, slope) of the best cut."""
    n, g = np.cumsum(found, axis=1)
    left, right = np.stack([n, g])[:, :-1], np.stack([n[-1] - n, g[-1] - g])[:, :-1]
    fits = (left[0] >= LEAF_ROWS) & (right[0] >= LEAF_ROWS)
    if not fits.any():
        return None
    gain = np.where(fits, left[1] ** 2 / np.maximum(left[0], 1) + right[1] ** 2 / np.maximum(right[0], 1), -np.inf)
    b = int(gain.argmax())
    return float(gain[b] - g[-1] ** 2 / n[-1]), b, np.stack([left[:, b], right[:, b]])


def fit(rows: DataFrame, columns: Sequence[str], target: str, models: list[Model], trees: int = 60, depth: int = 2, rate: float = 0.3) -> Forest:
    """Fitted copies of the models. Rows with an unknown column or target teach nothing; a model without rows stays at 0."""
    if len(models) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models at once")
    known = rows.select(*[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(columns)], F.col(target).cast("double").alias("_y"), *[m.rows.cast("boolean").alias(f"_m{k}") for k, m in enumerate(models)]).dropna(subset=["_y", *[f"_x{j}" for j in range(len(columns))]])
    shares = np.linspace(0, 1, BINS + 1)[1:-1].tolist()
    cuts = known.approxQuantile([f"_x{j}" for j in range(len(columns))], shares, 1e-3) if columns else []
    edges = [np.unique(c) for c in cuts]
    head = known.agg(F.percentile_approx("_y", [0.25, 0.75], 10_000).alias("s"), *[F.percentile_approx(F.when(F.col(f"_m{k}"), F.col("_y")), m.level, 10_000).alias(f"q{k}") for k, m in enumerate(models)]).first()
    fitted = [Model(m.level, list(m.columns), m.rows, float(head[f"q{k}"] if head[f"q{k}"] is not None else 0.0)) for k, m in enumerate(models)]
    spread = max((head["s"][1] - head["s"][0]) if head["s"] else 0.0, 1e-12)
    starts, width = np.array([m.start for m in fitted]), len(columns)
    listed = BINS**width <= CELLS

    def binned(batches):
        for batch in batches:
            n = batch.num_rows
            x = np.stack([np.searchsorted(e, batch.column(f"_x{j}").to_numpy()) for j, e in enumerate(edges)], axis=1).astype(np.uint8) if edges else np.empty((n, 0), np.uint8)
            mask = np.zeros(n, np.int64)
            for k in range(len(starts)):
                mask |= batch.column(f"_m{k}").fill_null(False).to_numpy(zero_copy_only=False).astype(np.int64) << k
            if listed:
                cell = np.ravel_multi_index(x.T.astype(np.int64), (BINS,) * width) if width else np.zeros(n, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("_y"), pa.array(cell.astype(np.int32)), pa.array(mask)], names=["y", "cell", "mask"])
                continue
            f = starts.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("_y"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(mask), pa.array([f] * n, pa.binary())], names=["y", "bins", "mask", "f"])

    state_sql = "y double, cell int, mask long" if listed else "y double, bins binary, mask long, f binary"
    state, since = written(known.mapInArrow(binned, state_sql), "forest"), 0
    for grown in range(trees):
        growing = [_open_tree() for _ in fitted]
        ended: list[dict[int, float]] = [{} for _ in fitted]  # leaf -> its mean slope
        for _ in range(depth):
            plain, open_trees = [Model(m.level, m.columns, None, m.start, m.trees) for m in fitted], [_arrays(t) for t in growing]
            kernel = _histograms_of_cells(plain, open_trees, width) if listed else _histograms(plain, open_trees, since, width)
            found = state.mapInArrow(kernel, "model int, node int, col int, bin int, n double, g double")
            sums: dict[tuple[int, int], dict[int, np.ndarray]] = {}
            for r in found.groupBy("model", "node", "col", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).collect():  # models * nodes * columns * BINS rows at most
                sums.setdefault((r["model"], r["node"]), {}).setdefault(r["col"], np.zeros((2, BINS)))[:, r["bin"]] = r["n"], r["g"]
            for (k, node), each in sums.items():
                n, g = next(iter(each.values())).sum(axis=1)
                ended[k][node] = g / n
                best = max(((s[0], -j, j, s[1], s[2]) for j in sorted(each) if (s := _split(each[j]))), default=None)
                if best is None or best[0] <= 1e-9 * n:
                    continue
                tree, (_, _, j, b, sides) = growing[k], best
                tree[0][node], tree[1][node], tree[2][node], tree[3][node] = j, b, len(tree[0]), len(tree[0]) + 1
                for c, s in sides:
                    ended[k][len(tree[0])] = s / c
                    for part, v in zip(tree, (-1, 0, 0, 0, 0.0), strict=True):
                        part.append(v)
        for m, tree, slopes in zip(fitted, growing, ended, strict=True):
            for node, s in slopes.items():
                tree[4][node] = rate * spread * 2 * s
            m.trees.append(_arrays(tree))
        if not listed and (grown + 1) % KEEP == 0 and grown + 1 < trees:
            kept, at = [Model(m.level, m.columns, None, m.start, list(m.trees)) for m in fitted], since

            def moved(batches, kept=kept, at=at):
                for batch in batches:
                    if batch.num_rows:
                        f = _values_of(batch, kept, at, _bins_of(batch, width))
                        yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("bins"), batch.column("mask"), pa.array([r.tobytes() for r in f], pa.binary())], names=["y", "bins", "mask", "f"])

            state, since = written(state.mapInArrow(moved, state_sql), "forest"), grown + 1
    return Forest(list(columns), edges, [Model(m.level, m.columns, None, m.start, m.trees) for m in fitted])


def heads_of(columns: Sequence[str], benchmark: Sequence[str], rows: Column) -> list[Model]:
    """A full and a benchmark head for each quantile."""
    own = [list(columns).index(c) for c in benchmark]
    return [Model(q, list(range(len(columns))), rows) for q in QUANTILES] + [Model(q, own, rows) for q in QUANTILES]


def named(q: float) -> str:
    return f"p{round(q * 100)}"


def predicted(rows: DataFrame, forest: Forest, at: int = 0, logs: bool = False) -> DataFrame:
    """Adds p25, p50, p75, p90 and bench_ heads in rising order, range_lift (p50 over the benchmark's) and range_regime.

    at: the first of the forest's 2 * len(QUANTILES) models to use. logs: the target is a logarithm, and heads are given on its own scale.
    """
    heads = [named(q) for q in QUANTILES]
    some = Forest(forest.columns, forest.edges, forest.models[at : at + 2 * len(QUANTILES)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        for pdf in batches:
            v = some.values(pdf)
            v = np.exp(v) if logs else v
            for prefix, part in (("", v[:, : len(heads)]), ("bench_", v[:, len(heads) :])):
                for name, column in zip(heads, np.maximum.accumulate(part, axis=1).T, strict=True):
                    pdf[prefix + name] = column
            yield pdf

    found = rows.mapInPandas(run, f"{schema}, {', '.join(f'{p}{h} double' for p in ('', 'bench_') for h in heads)}")
    lift = F.col("p50") / F.nullif("bench_p50", F.lit(0.0))
    regime = F.when(F.col("range_lift") < COMPRESSED, "compressed").when(F.col("range_lift") > EXPANDED, "expanded").when(F.col("range_lift").isNotNull(), "normal")
    return found.withColumn("range_lift", lift).withColumn("range_regime", regime)


def folds_of(rows: DataFrame, order: Sequence[str], folds: int, gap: int) -> DataFrame:
    """Adds place and fold: 0 is only trained on, then ``folds`` equal stretches; fold k learns from the rows that end ``gap`` before it begins."""
    if gap <= 0:
        raise ValueError("a gap of at least one row, as long as the target looks ahead")
    head, *ties = order
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    return with_place(rows, head, ties or [head]).crossJoin(F.broadcast(n)).withColumn("fold", F.floor(F.col("place") * float(folds + 1) / F.col("_n")).cast("int"))


def _first_of(k: int, folds: int) -> Column:
    """Place of the first row of fold k."""
    return F.ceil(F.lit(float(k)) * F.col("_n") / (folds + 1))


def fold_forecasts(rows: DataFrame, order: Sequence[str], columns: Sequence[str], benchmark: Sequence[str], target: str, folds: int, gap: int, trees: int = 60, depth: int = 2) -> DataFrame:
    """Out-of-fold heads of every row of folds 1, 2, ...: rows with place, fold, train_mean and the columns of ``predicted``.

    All folds' models grow side by side, in the same passes.
    """
    placed = written(folds_of(rows, order, folds, gap), "folds")
    each = [m for k in range(1, folds + 1) for m in heads_of(columns, benchmark, F.col("place") < _first_of(k, folds) - gap)]
    forest = fit(placed, columns, target, each, trees, depth)
    means = placed.agg(*[F.avg(F.when(F.col("place") < _first_of(k, folds) - gap, F.col(target))).alias(f"m{k}") for k in range(1, folds + 1)]).first()
    out = None
    for k in range(1, folds + 1):
        part = predicted(placed.where(F.col("fold") == k).drop("_n"), forest, (k - 1) * 2 * len(QUANTILES)).withColumn("train_mean", F.lit(means[f"m{k}"]).cast("double"))
        out = part if out is None else out.unionByName(part)
    return out


def pinball(actual: Column, head: Column, q: float) -> Column:
    miss = actual - head
    return F.greatest(q * miss, (q - 1) * miss)


def quality(found: DataFrame, target: str) -> DataFrame:
    """Mean pinball loss and coverage of each head and of the benchmark's: head, level, n, loss, bench_loss, covered."""
    cells = [F.struct(F.lit(named(q)).alias("head"), F.lit(q).alias("level"), pinball(F.col(target), F.col(named(q)), q).alias("l"), pinball(F.col(target), F.col(f"bench_{named(q)}"), q).alias("b"), (F.col(target) <= F.col(named(q))).cast("double").alias("c")) for q in QUANTILES]
    return found.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*").groupBy("head", "level").agg(F.count("l").alias("n"), F.avg("l").alias("loss"), F.avg("b").alias("bench_loss"), F.avg("c").alias("covered"))


def gate(found: DataFrame, order: Sequence[str], target: str, train_mean: float, length: float, samples: int = 200, seed: int = 0) -> DataFrame:
    """Whether held-out forecasts pass: one row with delta_r2, p_delta, rho, rho_bench, p_better, coverage_error, n, and passed.

    Three conditions: the median head gains LEAST_GAIN of R2 over the benchmark's, against the training mean, and the gain is above 0 in all but MOST_P
    of the block samples; it ranks outcomes better, p at most MOST_P; no head's coverage is off by more than MOST_COVERAGE_ERROR.
    """
    y = F.col(target)
    errors = {"base": (y - F.col("bench_p50")) ** 2, "full": (y - F.col("p50")) ** 2, "total": (y - F.lit(train_mean)) ** 2}
    gains = R.jointly(found, order, errors, length, samples, seed=seed).select("sample", ((F.col("base") - F.col("full")) / F.col("total")).alias("d"))
    drawn = F.col("sample") >= 0
    gain = gains.agg(F.max(F.when(~drawn, F.col("d"))).alias("delta_r2"), ((1 + F.count(F.when(drawn & (F.col("d") <= 0), 1))) / (1 + F.count(F.when(drawn, 1)))).alias("p_delta"))
    ranks = R.stronger(found, order, "p50", "bench_p50", target, length, samples, seed=seed).select(F.col("rho_a").alias("rho"), F.col("rho_b").alias("rho_bench"), F.col("p").alias("p_better"))
    covered = quality(found, target).agg(F.max(F.abs(F.col("covered") - F.col("level"))).alias("coverage_error"), F.max("n").alias("n"))
    conditions = (F.col("delta_r2") >= LEAST_GAIN) & (F.col("p_delta") <= MOST_P) & (F.col("p_better") <= MOST_P) & (F.col("rho") > F.col("rho_bench")) & (F.col("coverage_error") <= MOST_COVERAGE_ERROR)
    return gain.crossJoin(F.broadcast(ranks)).crossJoin(F.broadcast(covered)).withColumn("passed", F.coalesce(conditions, F.lit(False)))


def production(rows: DataFrame, order: Sequence[str], columns: Sequence[str], benchmark: Sequence[str], target: str, gap: int, length: float, train: float = 0.7, trees: int = 60, depth: int = 2, samples: int = 200, seed: int = 0) -> tuple[Forest, DataFrame]:
    """The forest for use, fitted on all rows, and the gate's row, from heads that learned the first ``train`` of them less a gap.

    Both grow in the same passes. The forest's figures on rows it has learned are no forecasts: use it on later ones.
    """
    if gap <= 0:
        raise ValueError("a gap of at least one row, as long as the target looks ahead")
    head, *ties = order
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    placed = written(with_place(rows, head, ties or [head]).crossJoin(F.broadcast(n)).withColumn("_cut", F.floor(F.col("_n") * train)), "folds")
    early = F.col("place") < F.col("_cut") - gap
    forest = fit(placed, columns, target, heads_of(columns, benchmark, early) + heads_of(columns, benchmark, F.lit(True)), trees, depth)
    mean = placed.agg(F.avg(F.when(early, F.col(target)))).first()[0]
    held = written(predicted(placed.where(F.col("place") >= F.col("_cut")).drop("_n", "_cut"), forest), "held")
    judged = gate(held, order, target, mean or 0.0, length, samples, seed)
    last = 2 * len(QUANTILES)
    return Forest(forest.columns, forest.edges, forest.models[last:]), judged
