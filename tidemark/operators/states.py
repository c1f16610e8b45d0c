"""States of a sequence: transitions, ages, trajectories, and the graph they form."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators.windows import entropy_of_labels, islands, ordered, smooth_labels


def age_bucket(minutes: Column) -> Column:
    return F.when(minutes < 30, "age_lt_30").when(minutes < 60, "age_30_60").when(minutes < 120, "age_60_120").otherwise("age_gt_120")


def entropy_bucket(x: Column) -> Column:
    return F.when(x < 0.33, "low").when(x < 0.66, "medium").otherwise("high")


def bias(share: Column, threshold: float) -> Column:
    return F.when(share > 0.5 + threshold, "long_skew").when(share < 0.5 - threshold, "short_skew").otherwise("neutral")


def assign(rows: DataFrame, label: str, minutes: int, smoothing: int = 2, trajectory: int = 24) -> DataFrame:
    """States of rows (symbol, t, label): group_id, prev_group_id, state_seq, age_minutes, age_bucket, entropy and transition_id.

    prev_group_id: the state before the current one; transition_id: at the first row of a new state.
    """
    kinds = F.size(F.collect_set("smoothed").over(Window.partitionBy("symbol")))
    smooth = smooth_labels(rows, label, smoothing)
    seen = islands(smooth.withColumn("kinds", kinds), "smoothed")
    w = ordered()
    before = F.when(F.col("changed"), F.lag("smoothed").over(w))
    out = seen.withColumns({"prev_group_id": F.last(before, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "entropy_value": entropy_of_labels("smoothed", trajectory, F.col("kinds"))})
    age = (F.col("pos") * minutes).cast("int")
    return out.select(
        *[c for c in rows.columns if c != label],
        F.col("smoothed").alias("group_id"),
        "prev_group_id",
        F.col("seq").alias("state_seq"),
        F.col("changed").alias("is_transition"),
        age.alias("age_minutes"),
        age_bucket(age).alias("age_bucket"),
        "entropy_value",
        entropy_bucket(F.col("entropy_value")).alias("entropy"),
        F.when(F.col("changed"), F.concat_ws("->", "prev_group_id", "smoothed")).alias("transition_id"),
    )


def rarity_by_quantiles(counts: DataFrame, count: str = "n") -> DataFrame:
    """Adds rarity: rare up to the lower third of counts, uncommon up to the upper."""
    cuts = counts.agg(F.percentile(count, F.array(F.lit(0.33), F.lit(0.66))).alias("cuts"))
    n = F.col(count)
    return counts.crossJoin(F.broadcast(cuts)).withColumn("rarity", F.when(n <= F.col("cuts")[0], "rare").when(n <= F.col("cuts")[1], "uncommon").otherwise("common")).drop("cuts")


def transition_stats(states: DataFrame) -> DataFrame:
    """Edges: how often, what share, how rare, and the mean outcome and share of rises of valid rows (ret_pct, valid)."""
    moved = states.where("transition_id is not null")
    ret = F.when(F.col("valid"), F.col("ret_pct"))
    stats = moved.groupBy("transition_id").agg(F.count(F.lit(1)).alias("n"), F.avg(ret).alias("avg_ret"), F.avg((ret > 0).cast("double")).alias("up_share"))
    total = moved.agg(F.count(F.lit(1)).alias("total"))
    return rarity_by_quantiles(stats.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).drop("total"))


def group_stats(states: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Nodes: size, share, up_share, mean and sample deviation of outcomes of valid rows, and bias."""
    ret = F.when(F.col("valid"), F.col("ret_pct"))
    stats = states.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("size"), F.avg((ret > 0).cast("double")).alias("up_share"), F.avg(ret).alias("avg_ret"), F.stddev_samp(ret).alias("std_ret")
    )
    total = states.agg(F.count(F.lit(1)).alias("total"))
    return stats.crossJoin(F.broadcast(total)).withColumn("share", F.col("size") / F.col("total")).withColumn("dominant_bias", bias(F.coalesce("up_share", F.lit(0.5)), threshold)).drop("total")


def describe_groups(rows: DataFrame, group: str, features: list[str], top: int = 5) -> DataFrame:
    """The features of each group that lie farthest from the whole, in deviations: (group, place, feature, deviation)."""
    pairs = rows.select(group, F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*[F.col(f).cast("double") for f in features]))).alias("feature", "x"))
    whole = pairs.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    each = pairs.groupBy(group, "feature").agg(F.avg("x").alias("x")).join(F.broadcast(whole), "feature")
    away = each.withColumn("deviation", (F.col("x") - F.col("mean")) / F.nullif("std", F.lit(0.0))).where("deviation is not null")
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.abs("deviation").desc(), "feature"))
    return away.withColumn("place", place).where(F.col("place") <= top).select(group, "place", "feature", "deviation")


def state_names(rows: DataFrame, axes: Mapping[str, Mapping[str, tuple[str, str]]], fallback: Column, salience: float = 0.5, most: int = 3, name: str = "name") -> DataFrame:
    """Adds a name made of phrases: of each axis the strongest feature, of the axes the ``most`` strongest, in the axes' order.

    axes: for each axis its features (columns of deviations) with the phrases of a positive and a negative one. A feature counts
    from ``salience`` on, up or down; null and NaN don't. The first of equals wins, feature or axis. Without any phrase: fallback.
    """

    def best(order: int, vocabulary: Mapping[str, tuple[str, str]]) -> Column:
        x = lambda f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))
        choices = [F.when(F.abs(x(f)) >= salience, F.struct(F.abs(x(f)).alias("size"), F.lit(-i).alias("less"), F.when(x(f) > 0, up).otherwise(down).alias("phrase"))) for i, (f, (up, down)) in enumerate(vocabulary.items())]
        found = F.array_max(F.array(*choices))
        return F.when(found.isNotNull(), F.struct((-found["size"]).alias("weak"), F.lit(order).alias("axis"), found["phrase"].alias("phrase")))

    strongest = F.slice(F.array_sort(F.array_compact(F.array(*[best(k, v) for k, v in enumerate(axes.values())]))), 1, most)
    in_order = F.array_sort(F.transform(strongest, lambda s: F.struct(s["axis"].alias("axis"), s["phrase"].alias("phrase"))))
    phrases = F.array_join(F.transform(in_order, lambda s: s["phrase"]), " · ")
    return rows.withColumn(name, F.when(phrases != "", phrases).otherwise(fallback))


def centroid_features(rows: DataFrame, group: str, features: list[str], top: int = 3) -> DataFrame:
    """The features of each group's centroid that are largest, up or down: (group, place, feature, value); equals by the order of features.

    rows hold scaled features, so that a centroid's value is a deviation from the whole. Means are taken before anything is ranked.
    """
    means = rows.groupBy(group).agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features])
    each = [F.when(F.col(f).isNotNull(), F.struct((-F.abs(f)).alias("weak"), F.lit(i).alias("order"), F.lit(f).alias("feature"), F.col(f).alias("value"))) for i, f in enumerate(features)]
    ranked = means.select(group, F.posexplode(F.slice(F.array_sort(F.array_compact(F.array(*each))), 1, top)).alias("place", "s"))
    return ranked.select(group, (F.col("place") + 1).alias("place"), "s.feature", "s.value")


def named_share(tops: DataFrame, group: str, named: list[str]) -> DataFrame:
    """One row: groups, and the share of them that have one of the named features among their largest."""
    hit = tops.groupBy(group).agg(F.max(F.col("feature").isin(named).cast("int")).alias("hit"))
    return hit.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.avg("hit"), F.lit(0.0)).alias("share"))


def context_lift(states: DataFrame, group: str, atoms: str) -> DataFrame:
    """How much likelier an atom is in a group than at all: (group, atom, n, lift)."""
    total = states.agg(F.count(F.lit(1)).alias("total"))
    sizes = states.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    seen = states.select(group, F.explode(atoms).alias("atom"))
    here = seen.groupBy(group, "atom").agg(F.count(F.lit(1)).alias("n"))
    all_ = seen.groupBy("atom").agg(F.count(F.lit(1)).alias("n_all"))
    joined = here.join(sizes, group).join(F.broadcast(all_), "atom").crossJoin(F.broadcast(total))
    return joined.select(group, "atom", "n", ((F.col("n") / F.col("size")) / (F.col("n_all") / F.col("total"))).alias("lift"))


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with the graph as JSON, nodes and edges in order; sizes are those of the state model, not of the data."""
    ns = nodes.agg(F.to_json(F.array_sort(F.collect_list(F.struct("group_id", "size", "dominant_bias")))).alias("nodes"))
    es = edges.agg(F.to_json(F.array_sort(F.collect_list(F.struct("transition_id", "n", "rarity")))).alias("edges"))
    return ns.crossJoin(es)
