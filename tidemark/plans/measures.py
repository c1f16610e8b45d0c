"""Queries of vectors and of resampling measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import forecast as Q
from tidemark.operators import statistics as M
from tidemark.operators import vectors as V
from tidemark.plans.shared import rounded
from tidemark.plans.validation import LINE, tagged
from tidemark.registry import Registry
from tidemark.tables import table

REGISTRY = Registry()
query = REGISTRY.query


@query("f08_cosine_top_k", """WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 5) AS distance FROM embeddings, q ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), vec_id LIMIT 20""")
def top_k(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    first = e.orderBy("vec_id").limit(1).collect()[0]["embedding"]
    return V.nearest_vectors(e, first, 20).select("vec_id", F.round("distance", 5).alias("distance"))


@query("l05_nearest_centroid", """WITH p AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY label, i), k AS (SELECT DISTINCT label FROM embeddings),
c AS (SELECT label, row_number() OVER (ORDER BY label) AS g, (SELECT list(x ORDER BY i) FROM p WHERE p.label = k.label) AS v FROM k),
d AS (SELECT vec_id, g, list_distance(embedding::DOUBLE[], v) AS distance FROM embeddings, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, g) AS place FROM d)
SELECT vec_id, CAST(g AS INT) AS "group", round(distance, 5) AS distance FROM r WHERE place = 1""")
def centroid(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    _, c = V.centroids_of(e, "label")
    return V.nearest_centroid(e, c).select("vec_id", "group", F.round("distance", 5).alias("distance"))


@query("l01_l02_l04_states")
def states(spark, sf_dir):
    """States of vectors by their first four coordinates: sizes of the groups, found and labelled over all rows."""
    e = table(spark, sf_dir, "embeddings")
    flat = e.select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(f"x{i}") for i in range(4)])
    return V.states_of(spark, flat, ["x0", "x1", "x2", "x3"], "vec_id").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("distance"), 6).alias("distance"))


@query("e30_thinned_z", """WITH e AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, value > 50 AS hit, [x FOR x IN [event_type, CASE WHEN user_id % 3 = 0 THEN 'third' END, CASE WHEN hour(ts) < 8 THEN 'night' END] IF x IS NOT NULL] AS atoms FROM events),
p AS (SELECT p.range AS p, e.*, floor((t - (SELECT min(t) FROM e) + p.range * 900.0) / 21600.0) AS w FROM e, range(24) p), f AS (SELECT p, CAST(hit AS INT) AS hit, atoms FROM (SELECT *, row_number() OVER (PARTITION BY p, w ORDER BY t, event_id) AS place FROM p) WHERE place = 1),
whole AS (SELECT p, count(hit) AS n, sum(hit) AS k FROM f GROUP BY p), m AS (SELECT p, atom, count(hit) AS n1, sum(hit) AS k1 FROM (SELECT p, hit, unnest(atoms) AS atom FROM f) GROUP BY p, atom),
b AS (SELECT atom, n1, k1, n - n1 AS n2, k - k1 AS k2, k * 1.0 / n AS q FROM m JOIN whole USING (p) WHERE n1 > 0 AND n - n1 > 0),
z AS (SELECT atom, CASE WHEN q * (1 - q) > 0 THEN (k1 * 1.0 / n1 - k2 * 1.0 / n2) / sqrt(q * (1 - q) * (1.0 / n1 + 1.0 / n2)) ELSE 0 END AS z FROM b)
SELECT atom, round(quantile_cont(CAST(z AS DOUBLE), 0.5), 6) AS z, count(*) AS phases FROM z GROUP BY atom""")
def thinned(spark, sf_dir):
    """Median over 24 phases of each atom's z on rows six hours apart."""
    return rounded(M.thinned_z(tagged(spark, sf_dir).withColumn("hit", F.col("value") > 50), "t", "event_id", "atoms", "hit", 21_600))


@query("m12_classifier")
def classifier(spark, sf_dir):
    """Boosted trees and isotonic calibration on the tail of the training rows: Brier score on the rest."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_tax", "l_extendedprice", (F.col("l_extendedprice") > 30000).cast("double").alias("label"))
    data = VectorAssembler(inputCols=["l_quantity", "l_tax"], outputCol="features").transform(rows)
    part = F.pmod("l_orderkey", F.lit(10))
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=7).fit(data.where(part < 6))
    scored = model.transform(data).withColumn("raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
    calibrated = IsotonicRegression(featuresCol="raw", labelCol="label").fit(scored.where((part >= 6) & (part < 8)))
    p = calibrated.transform(scored.where(part >= 8))
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("prediction") - F.col("label")) ** 2), 4).alias("brier"))


@query("m16_partial_gain", """WITH r AS (SELECT l_returnflag, corr(l_extendedprice, l_quantity) AS a, corr(l_extendedprice, l_tax) AS b, corr(l_quantity, l_tax) AS c FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, round(a * a, 6) AS r2, round((a * a + b * b - 2 * a * b * c) / (1 - c * c) - a * a, 6) AS gain FROM r""")
def gain(spark, sf_dir):
    """R2 of price on quantity, and what tax adds."""
    return rounded(M.partial_gains(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", "l_tax", "l_returnflag"))


#: Columns of the range forecasts' stand-in rows; the benchmark is the first of them.
RANGE_COLUMNS = ["l_tax", "l_quantity", "l_discount"]


def _ranges(spark, sf_dir):
    """Lines in order of their keys, with the logarithm of the price as the target."""
    rows = table(spark, sf_dir, "lineitem").select(*LINE, "l_tax", "l_quantity", "l_discount")
    return rows.withColumn("target", F.ln("l_extendedprice"))


@query("m17_quantile_heads")
def heads(spark, sf_dir):
    """Quantile heads and their benchmarks, grown on half of the orders: coverage on the others, that heads rise, and regimes of the range lift."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_tax", "l_quantity").withColumn("target", F.ln("l_extendedprice"))
    columns = RANGE_COLUMNS[:2]
    forest = Q.fit(rows, columns, "target", Q.heads_of(columns, columns[:1], F.pmod(F.xxhash64("l_orderkey"), F.lit(2)) == 0), trees=12)
    found = Q.predicted(rows.where(F.pmod(F.xxhash64("l_orderkey"), F.lit(2)) == 1), forest, logs=True)
    names = [Q.named(q) for q in Q.QUANTILES]
    covered = [F.round(F.avg((F.col("l_extendedprice") <= F.col(n)).cast("double")), 3).alias(f"covered{i}") for i, n in enumerate(names)]
    rising = F.bool_and((F.col("p25") <= F.col("p50")) & (F.col("p50") <= F.col("p75")) & (F.col("p75") <= F.col("p90")))
    regimes = [F.count(F.when(F.col("range_regime") == r, 1)).alias(r) for r in ("compressed", "normal", "expanded")]
    return found.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("range_lift"), 3).alias("range_lift"), *regimes, *covered, rising.alias("rising"))


@query("m18_gate")
def gated(spark, sf_dir):
    """The gate's three conditions on the last three tenths of the lines, for heads that learned the first seven less a gap; the forest for use grows beside them."""
    _, judged = Q.production(_ranges(spark, sf_dir), LINE, RANGE_COLUMNS, RANGE_COLUMNS[:1], "target", 96, 512, trees=8, samples=99)
    return judged.select(*[F.round(c, 3).alias(c) for c in ("delta_r2", "p_delta", "rho", "rho_bench", "p_better", "coverage_error")], "n", "passed")


@query("j03_fold_forecasts")
def fold_forecasts(spark, sf_dir):
    """Out-of-fold heads of three walk-forward folds that grow side by side: R2 of the median against the training mean, and coverage."""
    found = Q.fold_forecasts(_ranges(spark, sf_dir), LINE, RANGE_COLUMNS, RANGE_COLUMNS[:1], "target", 3, 96, trees=8)
    r2 = 1 - F.sum((F.col("target") - F.col("p50")) ** 2) / F.sum((F.col("target") - F.col("train_mean")) ** 2)
    return found.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(r2, 3).alias("r2"), *[F.round(F.avg((F.col("target") <= F.col(Q.named(q))).cast("double")), 3).alias(f"covered_{Q.named(q)}") for q in Q.QUANTILES])


@query("m22_surrogates", """WITH w AS (SELECT DISTINCT CAST(floor(epoch(ts) / 604800) AS BIGINT) AS week, event_type FROM events), n AS (SELECT week, count(*) AS n FROM w GROUP BY week)
SELECT week, n AS symbols, list_sum(range(1, n + 1))::BIGINT AS places, n AS distinct_places FROM n""")
def surrogates(spark, sf_dir):
    """A permutation of symbols within blocks of seven days: the places of each block are 1 to n, each once; drawn anew by block."""
    week = F.floor(F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 604_800)
    panel = table(spark, sf_dir, "events").select(week.alias("week"), "event_type").distinct()
    placed = M.surrogate_order(panel, "week", "event_type", 1, 11)
    return placed.groupBy("week").agg(F.count("*").alias("symbols"), F.sum("surrogate").alias("places"), F.count_distinct("surrogate").alias("distinct_places"))
