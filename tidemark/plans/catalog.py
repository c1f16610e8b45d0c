"""All queries of the engine in one registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.plans import market, measures, relational, runs, sequence, validation
from tidemark.registry import Registry
from tidemark.tables import table

REGISTRY = Registry()
for part in (market.REGISTRY, sequence.REGISTRY, relational.REGISTRY, measures.REGISTRY, validation.REGISTRY, runs.REGISTRY):
    REGISTRY.builders |= part.builders
    REGISTRY.oracles |= part.oracles


@REGISTRY.query(
    "d07_transition_stats",
    """
    WITH s AS (
      SELECT event_type, lag(event_type) OVER w AS prev, lead(value) OVER w AS nxt, value
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    t AS (SELECT prev || '->' || event_type AS transition_id, nxt, value FROM s WHERE prev <> event_type)
    SELECT transition_id, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM t), 9) AS share,
      round(avg(nxt / nullif(value, 0) - 1), 6) AS avg_ret, round(avg(CASE WHEN nxt IS NULL THEN NULL WHEN nxt > value THEN 1.0 ELSE 0.0 END), 6) AS up_share
    FROM t GROUP BY transition_id
    """,
)
def transition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    moved = (
        table(spark, sf_dir, "events")
        .select("event_type", F.lag("event_type").over(w).alias("prev"), F.lead("value").over(w).alias("nxt"), "value")
        .where("prev <> event_type")
        .select(F.concat_ws("->", "prev", "event_type").alias("transition_id"), "nxt", "value")
    )
    stats = moved.groupBy("transition_id").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("nxt") / F.nullif("value", F.lit(0.0)) - 1), 6).alias("avg_ret"),
        F.round(F.avg((F.col("nxt") > F.col("value")).cast("double")), 6).alias("up_share"),
    )
    return stats.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))
