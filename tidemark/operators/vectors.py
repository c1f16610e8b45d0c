"""Vectors: similarity search, nearest centroids, separation of groups, and unsupervised states."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a group on which a split is tested and from whose centroids it starts; its sums and sizes are of all rows.
LOOK_ROWS = 4000
#: Groups to start from, and how often one is split in two.
SEEDS, DEPTH = 8, 4


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def nearest_vectors(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k vectors nearest to one by cosine distance: an exact scan with a bounded heap in each task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, cosine_distance(F.col(column), q).alias("distance")).orderBy("distance", key).limit(k)


def nearest_centroid(vectors: DataFrame, centroids: np.ndarray, column: str = "embedding") -> DataFrame:
    """Adds group (from 1) and distance: |x|^2 - 2 x.c + |c|^2 for all centroids in one matrix product for a batch."""
    out = T.StructType([T.StructField("group", T.IntegerType()), T.StructField("distance", T.DoubleType())])

    @F.pandas_udf(out)
    def assign(column):
        import pandas as pd

        x = np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, centroids.shape[1]))
        square = (x**2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1)
        best = square.argmin(1)
        return pd.DataFrame({"group": (best + 1).astype("int32"), "distance": np.sqrt(np.maximum(square[np.arange(len(x)), best], 0))})

    return vectors.withColumn("_near", assign(column)).select("*", "_near.group", "_near.distance").drop("_near")


def centroids_of(vectors: DataFrame, label: str, column: str = "embedding") -> tuple[list, np.ndarray]:
    """Mean vector of each label; labels are few."""
    parts = vectors.select(label, F.posexplode(column).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("x"))
    rows = parts.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).orderBy(label).collect()
    return [r[label] for r in rows], np.array([[p["x"] for p in r["c"]] for r in rows])


def separation(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """Distance of two groups' means (row masks of x) over the sum of their deviations along that axis."""
    p, q = x[a].mean(0), x[b].mean(0)
    gap = float(np.linalg.norm(p - q))
    if gap == 0:
        return 0.0
    axis = (p - q) / gap
    spread = float((x[a] @ axis).std() + (x[b] @ axis).std())
    return gap / spread if spread > 0 else float("inf")


def silhouette(x: np.ndarray, labels: np.ndarray, rows: int = 512) -> float:
    """Mean silhouette of two or more groups; distances are held for ``rows`` rows at a time."""
    square = (x**2).sum(1)
    kinds, own = np.unique(labels, return_inverse=True)
    member = np.eye(len(kinds))[own]
    sizes = member.sum(0)
    total = 0.0
    for at in range(0, len(x), rows):
        part, mine = x[at : at + rows], own[at : at + rows]
        here = np.arange(len(part))
        sums = np.sqrt(np.maximum(square[at : at + rows, None] - 2 * part @ x.T + square, 0)) @ member
        inner = sums[here, mine] / np.maximum(sizes[mine] - 1, 1)
        other = sums / sizes
        other[here, mine] = np.inf
        outer = other.min(1)
        s = (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-12)
        total += float(np.where(sizes[mine] > 1, s, 0).sum())
    return total / len(x)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's algorithm from spread seeds: centroids and labels."""
    c = x[[rng.integers(len(x))]]
    while len(c) < k:
        d = ((x[:, None] - c) ** 2).sum(2).min(1)
        c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))]])
    labels = np.full(len(x), -1)
    for _ in range(rounds):
        new = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(1)
        if (new == labels).all():
            break
        labels = new
        c = np.array([x[labels == j].mean(0) if (labels == j).any() else c[j] for j in range(k)])
    return c, labels


def best_k_means(x: np.ndarray, k: int, rng: np.random.Generator, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """The tightest of several runs."""
    runs = [k_means(x, k, rng) for _ in range(starts)]
    return min(runs, key=lambda r: float(((x - r[0][r[1]]) ** 2).sum()))


def split_gain(x: np.ndarray, rng: np.random.Generator, boxes: int = 10, spread: float = 2.0) -> tuple[float, np.ndarray]:
    """How much better two groups fit than they fit uniform boxes of the same sides, and the two centroids."""
    c, labels = best_k_means(x, 2, rng, 5)
    if len(x) < 50 or len(np.unique(labels)) < 2:
        return -1.0, c
    low, high = x.min(0), x.max(0)
    drawn = []
    for _ in range(boxes):
        u = rng.uniform(low, high, x.shape)
        _, l = k_means(u, 2, rng)
        drawn.append(silhouette(u, l) if len(np.unique(l)) > 1 else 0.0)
    return float(silhouette(x, labels) - np.mean(drawn) - spread * np.std(drawn, ddof=1) * np.sqrt(1 + 1 / boxes)), c


#: Splits of a tree of groups: node -> (first child, children's centroids). Children have higher numbers than their parent.
Splits = dict[int, tuple[int, np.ndarray]]


def leaves(x: np.ndarray, splits: Splits) -> np.ndarray:
    """The leaf of each row, down the nearest centroids from node 0."""
    node = np.zeros(len(x), np.int64)
    for i in sorted(splits):
        rows = np.flatnonzero(node == i)
        if len(rows):
            first, c = splits[i]
            node[rows] = first + ((c**2).sum(1) - 2 * x[rows] @ c.T).argmin(1)
    return node


def centroids_in(splits: Splits) -> dict[int, np.ndarray]:
    return {first + j: c[j] for first, c in splits.values() for j in range(len(c))}


def leaf_sums(x: np.ndarray, splits: Splits, second: bool) -> dict[int, np.ndarray]:
    """For each leaf its rows, their sum and, if asked, their products, all from the leaf's centroid on."""
    node, at = leaves(x, splits), centroids_in(splits)
    out = {}
    for k in np.unique(node).tolist():
        d = x[node == k] - at[k]
        out[k] = np.concatenate([[len(d)], d.sum(0), (d.T @ d).ravel() if second else []])
    return out


def look(x: np.ndarray, node: int, k: int, seed: int) -> tuple[float, np.ndarray]:
    """Gain of a split and the centroids to start from, on rows drawn from a node; the root is split in any case."""
    rng = np.random.default_rng([seed, node])
    return (np.inf, best_k_means(x, min(k, len(x)), rng, 5)[0]) if node == 0 else split_gain(x, rng)


class MatrixRows:
    """Rows in memory."""

    def __init__(self, x: np.ndarray):
        self.x = x

    def count(self) -> int:
        return len(self.x)

    def sums(self, splits: Splits, second: bool = False) -> dict[int, np.ndarray]:
        return leaf_sums(self.x, splits, second)

    def looks(self, splits: Splits, sizes: dict[int, int], k: int, seed: int) -> dict[int, tuple[float, np.ndarray]]:
        node, rng = leaves(self.x, splits), np.random.default_rng(seed)
        parts = {i: self.x[node == i] for i in sizes}
        return {i: look(p if len(p) <= LOOK_ROWS else p[rng.choice(len(p), LOOK_ROWS, replace=False)], i, k, seed) for i, p in parts.items()}


class TableRows:
    """Rows of a table: sums over all of them, looks in a task for each node."""

    def __init__(self, df: DataFrame, columns: list[str], key: str):
        names = [f"_x{i}" for i in range(len(columns))]
        hashed = F.pmod(F.xxhash64(F.lit("look"), key, *columns), F.lit(1 << 40)) / F.lit(float(1 << 40))
        self.columns, self.df = names, df.dropna(subset=columns).select(hashed.alias("_h"), *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)])
        self.df = self.df.persist()

    def count(self) -> int:
        return self.df.count()

    def sums(self, splits: Splits, second: bool = False) -> dict[int, np.ndarray]:
        columns = self.columns

        def add(batches):
            import pandas as pd

            total: dict[int, np.ndarray] = {}
            for pdf in batches:
                for k, v in leaf_sums(pdf[columns].to_numpy(float), splits, second).items():
                    total[k] = total[k] + v if k in total else v
            for k, v in total.items():
                yield pd.DataFrame({"leaf": k, "i": range(len(v)), "v": v})

        out: dict[int, dict[int, float]] = {}
        for r in self.df.select(columns).mapInPandas(add, "leaf long, i int, v double").groupBy("leaf", "i").agg(F.sum("v").alias("v")).collect():
            out.setdefault(r["leaf"], {})[r["i"]] = r["v"]
        return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}

    def looks(self, splits: Splits, sizes: dict[int, int], k: int, seed: int) -> dict[int, tuple[float, np.ndarray]]:
        columns = self.columns
        # A quarter more than needed, as hashes scatter; the rows of least hash are taken.
        rates = {i: 1.25 * LOOK_ROWS / max(1, n) for i, n in sizes.items()}

        def draw(batches):
            for pdf in batches:
                pdf = pdf[pdf["_h"] < max(rates.values())]
                pdf = pdf.assign(leaf=leaves(pdf[columns].to_numpy(float), splits))
                yield pdf[pdf["_h"] < pdf["leaf"].map(rates).fillna(-1.0)]

        def measure(pdf):
            import pandas as pd

            node = int(pdf["leaf"].iloc[0])
            gain, c = look(pdf.sort_values(["_h", *columns])[columns].to_numpy(float)[:LOOK_ROWS], node, k, seed)
            return pd.DataFrame({"leaf": [node], "gain": [gain], "c": [c.ravel().tolist()]})

        fields = ", ".join(f"{c} double" for c in ["_h", *columns])
        drawn = self.df.mapInPandas(draw, f"{fields}, leaf long")
        return {r["leaf"]: (r["gain"], np.array(r["c"]).reshape(-1, len(columns))) for r in drawn.groupBy("leaf").applyInPandas(measure, "leaf long, gain double, c array<double>").collect()}


def refined(rows: MatrixRows | TableRows, splits: Splits, fresh: list[int], rounds: int = 300) -> tuple[Splits, dict[int, int]]:
    """Lloyd's algorithm over all rows for the fresh splits at once, and the leaves' rows under the centroids returned.

    It ends when a split's centroids move by less than 1e-3 of their distances, all in all.
    """
    moving = set(fresh)
    for _ in range(rounds):
        sums = rows.sums(splits)
        nearer = dict(splits)
        for i in sorted(moving):
            first, c = splits[i]
            new = np.array([p + sums[first + j][1:] / sums[first + j][0] if first + j in sums else p for j, p in enumerate(c)])
            if np.linalg.norm(new - c) <= 1e-3 * np.linalg.norm(c - c.mean(0)):
                moving.discard(i)
            else:
                nearer[i] = first, new
        if not moving:
            break
        splits = nearer
    else:
        sums = rows.sums(splits)
    return splits, {k: round(v[0]) for k, v in sums.items()}


def merged(groups: list[tuple[float, np.ndarray, np.ndarray]], apart: float) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Groups (rows, mean, products of what lies off the mean), the nearest pair merged while it lies within ``apart``."""

    def distance(a, b) -> float:
        gap = float(np.linalg.norm(a[1] - b[1]))
        if gap < 1e-12:
            return 0.0
        axis = (a[1] - b[1]) / gap
        spread = sum(np.sqrt(max(0.0, axis @ g[2] @ axis) / g[0]) for g in (a, b))
        return gap / spread if spread > 0 else np.inf

    groups = list(groups)
    while len(groups) > 1:
        near, i, j = min((distance(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if near >= apart:
            break
        (n, p, u), (m, q, v) = groups[i], groups.pop(j)
        groups[i] = n + m, (n * p + m * q) / (n + m), u + v + np.outer(p - q, p - q) * n * m / (n + m)
    return groups


def fit_rows(rows: MatrixRows | TableRows, dimensions: int, seeds: int, least: int | None, depth: int, apart: float, seed: int) -> np.ndarray:
    n = rows.count()
    if not n:
        return np.zeros((0, dimensions))
    least = max(300, round(0.0025 * n)) if least is None else least
    splits: Splits = {0: (1, rows.looks({}, {0: n}, seeds, seed)[0][1])}
    free = 1 + len(splits[0][1])
    splits, sizes = refined(rows, splits, [0])
    level = list(sizes)
    for _ in range(depth):
        open_ = {k: sizes[k] for k in level if sizes[k] >= 2 * least}
        if not open_:
            break
        fresh = []
        for k, (gain, c) in sorted(rows.looks(splits, open_, 2, seed).items()):
            if gain > 0:
                splits = splits | {k: (free, c)}
                fresh.append(k)
                free += 2
        if not fresh:
            break
        splits, found = refined(rows, splits, fresh)
        level = []
        for k in fresh:
            two = [splits[k][0], splits[k][0] + 1]
            if min(found.get(i, 0) for i in two) >= least:
                level += two
                sizes |= {i: found[i] for i in two}
            else:
                splits = {i: s for i, s in splits.items() if i != k}
    at, groups = centroids_in(splits), []
    for k, v in sorted(rows.sums(splits, True).items()):
        off = v[1 : 1 + dimensions]
        groups.append((v[0], at[k] + off / v[0], v[1 + dimensions :].reshape(dimensions, dimensions) - np.outer(off, off) / v[0]))
    c = np.array([g[1] for g in merged(groups, apart)])
    # A state is what lies nearest to its centroid: that gives the sizes, and centroids without rows go.
    sizes = {k - 1: round(v[0]) for k, v in rows.sums({0: (1, c)}).items()}
    return c[sorted(sizes, key=lambda k: (-sizes[k], k))]


def fit_states(x: np.ndarray, seeds: int = SEEDS, least: int | None = None, depth: int = DEPTH, apart: float = 1.0, seed: int = 7) -> np.ndarray:
    """Centroids of states: seeds, split while a split gains, merged while two lie within ``apart``; largest first.

    x: scaled rows. Groups below ``least`` rows (300 or a 400th of the rows) are not split off.
    """
    return fit_rows(MatrixRows(x), x.shape[1], seeds, least, depth, apart, seed)


def fit_states_of(df: DataFrame, columns: list[str], key: str, seeds: int = SEEDS, least: int | None = None, depth: int = DEPTH, apart: float = 1.0, seed: int = 7) -> np.ndarray:
    """``fit_states`` over all rows of a table that have no null or NaN in the columns."""
    rows = TableRows(df, columns, key)
    try:
        return fit_rows(rows, len(columns), seeds, least, depth, apart, seed)
    finally:
        rows.df.unpersist()


def states_of(spark: SparkSession, df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Unsupervised states of every row: model and labels from all rows."""
    centroids = fit_states_of(df, columns, key)
    return nearest_centroid(df.withColumn("_v", F.array(*[F.col(c).cast("double") for c in columns])), centroids, "_v").drop("_v")
