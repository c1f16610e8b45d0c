"""What a fitted model owes to each feature: its accuracy with that feature's values dealt out anew among the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import with_place
from tidemark.operators.resampling import drawn


def with_partner(rows: DataFrame, columns: Sequence[str], order: Sequence[str], seed: int = 0) -> DataFrame:
    """rows with each column's value of a partner row as <column>_partner: a random permutation of all rows.

    Rows get a place in order and a place in the order of a hash of it, both by ranges of values; the partner of the row at hash
    place j is the row at place j. So a permutation is one join on places, and no task holds a column.
    """
    head, *ties = order
    placed = with_place(rows, head, ties or [head])
    dealt = with_place(placed.withColumn("_u", drawn(0, F.lit(seed), F.col("place"))).withColumnRenamed("place", "_own"), "_u", ["_own"])
    partners = placed.select(F.col("place").alias("_place"), *[F.col(c).alias(f"{c}_partner") for c in columns])
    return dealt.join(partners, F.col("place") == F.col("_place")).drop("_u", "_own", "_place", "place")


def permutation_importance(rows: DataFrame, features: Sequence[str], label: str, predict: Callable[[DataFrame], DataFrame], order: Sequence[str], seed: int = 0) -> DataFrame:
    """feature, drop (in accuracy when its values are dealt out anew), base (accuracy as it is).

    predict adds a column score in [0, 1] to rows that have the features; label is 0 or 1. One permutation of the rows serves
    all features, each changed by itself; the changed rows are scored together in one pass.
    """
    paired = with_partner(rows.select(*order, *[f for f in features if f not in order], *[c for c in [label] if c not in order]), features, order, seed)
    each = paired.withColumn("_variant", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    changed = each.withColumns({f: F.when(F.col("_variant") == i + 1, F.col(f"{f}_partner")).otherwise(F.col(f)) for i, f in enumerate(features)})
    right = ((F.col("score") > 0.5) == (F.col(label) > 0.5)).cast("double")
    scored = predict(changed).groupBy("_variant").agg(F.avg(right).alias("accuracy"))
    base = scored.where("_variant = 0").select(F.col("accuracy").alias("base"))
    names = F.array(*[F.lit(f) for f in features])
    return scored.where("_variant > 0").crossJoin(F.broadcast(base)).select(F.element_at(names, F.col("_variant")).alias("feature"), (F.col("base") - F.col("accuracy")).alias("drop"), "base")


def least_squares(train: DataFrame, columns: Sequence[str], target: str) -> list[float]:
    """Intercept and slopes of the least-squares fit, from sums of products: one aggregate, and one small system for the driver.

    Rows with a null are left out. Columns that others determine get what the pseudo-inverse gives.
    """
    known = train.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)], F.col(target).cast("double").alias("_y")).dropna()
    names = [*[f"_x{i}" for i in range(len(columns))], "_y"]
    # Moments about the first row's values keep large means from eating the digits.
    at = known.first()
    if at is None:
        raise ValueError("no rows to fit on")
    away = {n: F.col(n) - F.lit(float(at[n])) for n in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = known.agg(F.count(F.lit(1)).alias("n"), *[F.sum(away[n]).alias(f"s{n}") for n in names], *[F.sum(away[a] * away[b]).alias(f"p{a}{b}") for a, b in pairs]).first()
    mean = np.array([sums[f"s{n}"] for n in names]) / sums["n"]
    cross = np.zeros((len(names), len(names)))
    for a, b in pairs:
        i, j = names.index(a), names.index(b)
        cross[i, j] = cross[j, i] = sums[f"p{a}{b}"] - sums["n"] * mean[i] * mean[j]
    slopes = np.linalg.pinv(cross[:-1, :-1], hermitian=True) @ cross[:-1, -1]
    middle = mean + np.array([float(at[n]) for n in names])
    return [float(middle[-1] - slopes @ middle[:-1]), *map(float, slopes)]


def linear(fit: Sequence[float], columns: Sequence[str]) -> Column:
    """The fitted value of ``least_squares``."""
    return sum((F.col(c) * b for c, b in zip(columns, fit[1:], strict=True)), F.lit(fit[0]))


def r2_gain(train: DataFrame, test: DataFrame, base: Sequence[str], extra: Sequence[str], target: str) -> DataFrame:
    """R2 on test rows, against the mean of the training rows, of the base columns alone and with the extra ones: r2_base, r2_full, gain."""
    fits = {"base": (least_squares(train, base, target), base), "full": (least_squares(train, [*base, *extra], target), [*base, *extra])}
    mean = F.lit(float(train.agg(F.avg(target)).first()[0]))
    known = test.dropna(subset=[*base, *extra, target])
    loss = {n: F.sum((F.col(target) - linear(*f)) ** 2) / F.sum((F.col(target) - mean) ** 2) for n, f in fits.items()}
    return known.agg((1 - loss["base"]).alias("r2_base"), (1 - loss["full"]).alias("r2_full")).withColumn("gain", F.col("r2_full") - F.col("r2_base"))
