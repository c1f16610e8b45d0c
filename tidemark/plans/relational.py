"""Queries of filters, joins, keyed merges, aggregates, sorts, sets and measures; their DuckDB texts are in ``oracles``."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators import measures as M
from tidemark.operators import records as R
from tidemark.operators import states as S
from tidemark.operators.ranking import exact_percentiles
from tidemark.plans.oracles import ORACLES
from tidemark.plans.shared import rounded
from tidemark.registry import Registry
from tidemark.sources import stores
from tidemark.tables import table

REGISTRY = Registry()
DAY = 86_400
#: 2024-01-15, where a first part of history ends in some queries.
PART_END = 1_705_276_800


def q(name: str) -> Callable:
    """Decorator: the query gets its tables by name."""

    def add(fn: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda t: table(spark, sf_dir, t))

        del run.__wrapped__
        REGISTRY.query(name, ORACLES[name])(run)
        return fn

    return add


def key_of(df: DataFrame) -> DataFrame:
    """events with k, the number in their JSON."""
    return df.withColumn("k", F.get_json_object("props", "$.k"))


# Projections and predicates


@q("a02_klines_normalised")
def klines(t):
    """Opening times in milli- or microseconds by size; rows whose numbers don't parse are dropped."""
    e = t("events").withColumn("us", R.micros())
    raw = e.select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("us")).otherwise(F.floor(F.col("us") / 1000)).alias("stamp"), F.when(F.col("event_id") % 17 == 0, "n/a").otherwise(F.col("user_id").cast("string")).alias("price"))
    return raw.select("event_id", R.epoch_seconds(F.col("stamp")).alias("t"), F.expr("try_cast(price AS DOUBLE)").alias("price")).where("price IS NOT NULL")


@q("a09_range_scan")
def range_scan(t):
    at = F.col("ts").between(F.expr("TIMESTAMP_NTZ '2024-01-05 00:00:00'"), F.expr("TIMESTAMP_NTZ '2024-01-12 00:00:00'"))
    return R.filtered(t("events"), equal={"event_type": "click"}).where(at).select("event_id", "event_type", "value")


@q("a10_array_columns")
def array_columns(t):
    return rounded(t("embeddings").select("vec_id", *[F.element_at("embedding", i).cast("double").alias(f"f{i}") for i in (1, 2, 64)]), 5)


@q("a28_coverage")
def coverage(t):
    return R.coverage(t("events"), "event_type", R.seconds(), "value", "event_id").withColumnRenamed("event_type", "symbol")


@q("b01_filtered_page")
def page(t):
    found = R.filtered(t("orders"), equal={"o_orderstatus": "O", "o_custkey": None}, least={"o_totalprice": 1000}, among={"o_orderpriority": ["1-URGENT", "2-HIGH"]})
    return found.select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").offset(100).limit(50)


@q("b02_membership")
def membership(t):
    return R.filtered(t("orders"), among={"o_orderpriority": ["1-URGENT", "5-LOW"]}).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@q("b03_half_open_range")
def half_open(t):
    """Three months: from their first day on, up to the next month's first day, which is left out."""
    at = (F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ '1996-02-01 00:00:00'")) & (F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1996-05-01 00:00:00'"))
    return t("orders").where(at).groupBy(R.day_number("o_orderdate").alias("day")).agg(F.count("*").alias("n"))


@q("b04_json_predicate")
def json_predicate(t):
    k = F.col("k").cast("int")
    return key_of(t("events")).where((F.coalesce(k, F.lit(-1)) == 7) | (F.col("event_id") % 500 == 0)).select("event_id", k.alias("k"))


@q("b06_b07_b08_buckets")
def buckets(t):
    quantity = F.col("l_quantity")
    return t("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        R.stepped(quantity, [(R.up_to(2), "sparse"), (R.up_to(5), "moderate")], "dense").alias("intensity"),
        R.stepped(F.col("l_discount"), [(R.below(0.002), "rare"), (R.below(0.01), "uncommon")], "common").alias("rarity"),
        R.stepped(quantity, [(R.below(30), "age_lt_30"), (R.below(60), "age_30_60"), (R.below(120), "age_60_120")], "age_gt_120").alias("age"),
        R.stepped(F.col("l_tax"), [(R.above(0.5 + 0.05), "long_skew"), (R.below(0.5 - 0.05), "short_skew")], "neutral").alias("bias"),
    )


@q("b09_b10_ladder_and_map")
def ladder(t):
    status = {"F": 1.0, "O": 0.5}
    mapped = [(lambda x, k=k: x == k, v) for k, v in status.items()]
    steps = [(R.above(300000), 1.0), (R.above(200000), 0.7), (R.above(100000), 0.4)]
    return t("orders").select("o_orderkey", R.stepped(F.col("o_totalprice"), steps, 0.1).alias("score"), R.stepped(F.col("o_orderstatus"), mapped, 0.0).alias("mapped"))


@q("b14_c13_rule_matches")
def rules(t):
    """Rules with nullable fields, null meaning any, against every order: a nested-loop join with the small side."""
    orders = t("orders")
    rows = [(1, "O", None, None), (2, None, 250000.0, None), (3, "F", 150000.0, "1-URGENT"), (4, None, None, "5-LOW")]
    given = orders.sparkSession.createDataFrame(rows, "rule_id int, status string, least double, priority string")
    tests = {"status": lambda x: x == F.col("o_orderstatus"), "least": lambda x: F.col("o_totalprice") >= x, "priority": lambda x: x == F.col("o_orderpriority")}
    return R.rule_matches(given, orders, tests).groupBy("rule_id").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@q("b15_b16_payload")
def payload(t):
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("o_orderstatus").alias("status"))).alias("payload"))


@q("b17_row_loss_guard")
def guard(t):
    good = F.count(F.when(F.col("k").cast("int") > 1, 1))
    return rounded(key_of(t("events")).agg(F.count("*").alias("n"), good.alias("kept"), (1 - good / F.count("*")).alias("lost")), 9)


@q("b18_finite_rows")
def finite(t):
    """Infinite quotients become null and their rows go."""
    x = F.col("l_extendedprice") / F.nullif("l_discount", F.lit(0.0))
    return rounded(t("lineitem").select(x.alias("x")).where("x IS NOT NULL").agg(F.count("*").alias("n"), F.sum("x").alias("total")), 4)


@q("b19_robust_scale")
def robust(t):
    return rounded(R.robust_scaled(t("lineitem"), "l_extendedprice", 5.0).select("l_orderkey", "l_linenumber", "x"))


@q("b20_closed_bars")
def closed(t):
    return R.with_greatest(t("events"), R.seconds(), "now").where(R.seconds() + 3600 <= F.col("now")).select("event_id")


@q("b21_hash_ids")
def hashes(t):
    return t("customer").select("c_custkey", R.hashed_id(F.col("c_mktsegment"), F.col("c_custkey").cast("string"), F.col("c_name")).alias("id"))


# Joins


@q("c01_left_join")
def left_join(t):
    """Orders are summed by customer before they meet the customers."""
    spent = t("orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.sum("o_totalprice").alias("spent"))
    return rounded(t("customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("spent", F.lit(0.0)).alias("spent")), 2)


@q("c02_inner_join")
def inner_join(t):
    joined = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rounded(joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")), 2)


@q("c04_k08_day_lag_join")
def day_lag(t):
    """A daily series known one day late: the value of day D serves day D + 1; the seven-day change needs the full calendar."""
    events = t("events").withColumn("day", R.bucket(R.seconds(), DAY))
    daily = events.groupBy("day").agg(F.avg("value").alias("v"))
    before = daily.select((F.col("day") + 7).alias("day"), F.col("v").alias("old"))
    known = daily.join(before, "day", "left").select((F.col("day") + 1).alias("day"), "v", (F.col("v") - F.col("old")).alias("change"))
    v = F.col("v")
    return rounded(events.join(F.broadcast(known), "day", "left").select("event_id", ((v - 50) / 50).alias("level"), (F.col("change") / 50).alias("change_7d"), F.coalesce(v < 25, F.lit(False)).alias("fear"), F.coalesce(v > 75, F.lit(False)).alias("greed")))


@q("c05_last_before")
def last_before(t):
    return t("events").where(R.seconds() < PART_END).groupBy("event_type").agg(F.max_by("value", F.struct(R.seconds(), "event_id")).alias("last"))


@q("c06_latest_per_key")
def latest(t):
    return R.latest_joined(t("customer"), t("orders"), ("c_custkey", "o_custkey"), [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_totalprice"]).select("c_custkey", "o_orderkey", "o_totalprice")


@q("c07_c08_labelled_set")
def labelled(t):
    """The small tables meet first, so that lineitem is shuffled once at most."""
    places = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    joined = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    return rounded(joined.groupBy("n_name", "p_brand").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")), 2)


@q("c09_share_of_total")
def share(t):
    return rounded(R.share_of_total(t("lineitem"), ["l_returnflag", "l_linestatus"]), 9)


@q("c10_deliveries_and_rules")
def deliveries(t):
    regions = t("region").where("r_name <> 'ASIA'")
    joined = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select("s_suppkey", "n_name", "r_name")


@q("c11_anti_join")
def anti(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@q("c12_semi_join")
def semi(t):
    return t("part").join(t("lineitem").where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_brand")


def moves_of(t):
    return R.transitions(t("events"), "user_id", ["ts", "event_id"], "event_type", F.col("event_id"), F.col("value"), R.seconds().alias("sec"))


@q("c16_one_hop")
def one_hop(t):
    """Edges of the transition graph with both nodes' sizes, rare ones only."""
    sizes = t("events").groupBy("event_type").agg(F.count("*").alias("size"))
    ends = [sizes.select(F.col("event_type").alias(end), F.col("size").alias(f"size_{end}")) for end in ("a", "b")]
    return R.rare_edges(moves_of(t), 0.33).join(F.broadcast(ends[0]), "a").join(F.broadcast(ends[1]), "b")


@q("c17_neighbourhood")
def neighbours(t):
    return R.neighbourhood(R.edges(moves_of(t)), "click", 20)


@q("c18_dense_panel")
def panel(t):
    """Every hour of every symbol; hours without events are null."""
    return rounded(R.panel(t("events").select(R.bucket(R.seconds(), 3600).alias("h"), F.col("event_type").alias("s"), "value"), "h", "s", "value"))


@q("c20_merge_with_suffixes")
def suffixes(t):
    a, b = t("documents").alias("a"), t("labels").alias("b")
    return a.join(b, F.col("a.doc_id") == F.col("b.doc_id")).select("a.doc_id", F.col("a.n_chars").alias("n_chars_left"), F.col("b.quality").alias("quality_right"))


# Upserts and sinks, as the rows they leave


@q("a12_upsert")
def upsert(t):
    """Newest row of each key after two batches."""
    orders = t("orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("id"))
    batches = orders.withColumn("batch", F.lit(0)).unionByName(orders.where("id % 5 = 0").withColumns({"v": F.col("v") * 2, "batch": F.lit(1)}))
    return rounded(R.last_by(batches, ["k"], [F.col("batch"), F.col("id")], ["v", "batch"]), 2)


@q("a13_subset_upsert")
def subset_upsert(t):
    """A new payload keeps the evaluation that the old row has."""
    o = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("payload"), F.col("o_orderpriority").alias("rating"))
    new = o.where("k % 2 = 0").withColumns({"payload": F.col("payload") + 1, "rating": F.lit(None).cast("string")})
    return rounded(stores.upserted(o.where("k % 3 <> 0"), new, ["k"], update=["payload"]), 2)


@q("a14_revisions")
def revisions(t):
    best = lambda df: df.groupBy(R.day_number("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("v"))
    found = stores.revisions(best(t("orders").where("o_orderkey % 2 = 0")), best(t("orders")), ["day"], "v")
    return found.select("day", F.col("old_value").alias("old_v"), F.col("new_value").alias("new_v"))


@q("a15_bulk_update")
def bulk_update(t):
    old = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    given = old.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("seen").alias("status"))
    return stores.upserted(old, given, ["o_orderkey"], update=["status"])


@q("a16_claim")
def claim(t):
    """Keys of a batch that nobody claimed before, one row each."""
    batch = R.first_by(t("events").where("event_id >= 300"), ["user_id"], [F.col("event_id")], ["event_id"])
    return stores.claimed(batch, t("events").where("event_id < 300"), ["user_id"]).select("user_id", "event_id")


@q("a20_d21_d22_graph_merge")
def graph_merge(t):
    """Edges merged from two batches: counts and sums add up, means follow, the latest label wins."""
    moves = moves_of(t).withColumn("label", (F.col("value") > 50).cast("int"))
    parts = R.graph_parts(moves, F.col("event_id") % 2)
    merged = stores.merged_graph(parts.where("batch = 0").drop("batch"), parts.where("batch = 1").drop("batch"))
    return rounded(merged.select("a", "b", "n", (F.col("total") / F.col("n")).alias("avg_value"), "label"))


@q("a21_delete_symbol")
def delete_symbol(t):
    return t("events").where("event_type <> 'click'").groupBy("event_type").agg(F.count("*").alias("n"))


@q("a27_retention")
def retention(t):
    return R.with_greatest(t("events"), R.seconds(), "now").where(R.seconds() >= F.col("now") - 10 * DAY).select("event_id")


# Aggregates


@q("d06_first_of_duplicates")
def firsts(t):
    return R.first_by(t("events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], ["event_id"])


@q("d13_d14_filtered_counts")
def filtered(t):
    when = lambda test, x: F.when(F.expr(test), x)
    agg = t("lineitem").groupBy("l_returnflag").agg(
        F.count(when("l_quantity > 25", F.lit(1))).alias("large"), F.avg(when("l_discount = 0", F.col("l_tax"))).alias("tax"), F.count_distinct(when("l_quantity > 40", F.col("l_suppkey"))).alias("suppliers")
    )
    return rounded(agg)


@q("d15_counts_by_two")
def counts(t):
    return t("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))


@q("d16_i07_hourly_and_daily")
def continuous(t):
    """Days are rolled up from hours."""
    e = t("events").select("event_type", "value", (R.bucket(R.seconds(), 3600) * 3600).alias("bucket"))
    part = [F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("strong").alias("strong")]
    hours = e.groupBy("bucket", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.when(F.col("value") > 100, 1)).alias("strong"))
    days = hours.withColumn("bucket", R.bucket(F.col("bucket"), DAY) * DAY).groupBy("bucket", "event_type").agg(*part)
    both = hours.withColumn("width", F.lit(3600)).unionByName(days.withColumn("width", F.lit(DAY)))
    return rounded(both.select("width", "bucket", "event_type", "n", (F.col("total") / F.col("n")).alias("mean"), "low", "high", "strong"))


@q("d17_percent_of_total")
def percent(t):
    return rounded(R.share_of_total(t("orders"), ["o_orderpriority"]).select("o_orderpriority", "n", (100 * F.col("share")).alias("percent")))


@q("d19_percentiles")
def percentiles(t):
    shares = (0.1, 0.25, 0.5, 0.7, 0.8, 0.9)
    found = exact_percentiles(t("lineitem"), "l_extendedprice", shares, ["l_returnflag"])
    return rounded(found.select("l_returnflag", *[F.col(f"p{i}").alias(f"p{int(s * 100)}") for i, s in enumerate(shares)]))


@q("d20_monthly_concentration")
def concentration(t):
    months = t("orders").groupBy("o_custkey", F.year("o_orderdate"), F.month("o_orderdate")).agg(F.count("*").alias("m"))
    return rounded(months.groupBy("o_custkey").agg(F.sum("m").alias("n"), (F.max("m") / F.sum("m")).alias("concentration")), 9)


@q("d23_downsample")
def downsample(t):
    """At most 720 buckets over the series; mean and peak of each."""
    return rounded(R.downsampled(t("events"), R.seconds(), "value"))


@q("d24_quantile_bins")
def bins(t):
    """Right-closed bins at exact quintiles."""
    return rounded(R.binned(t("lineitem"), "l_extendedprice", (0.2, 0.4, 0.6, 0.8)).groupBy("bin").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean")))


@q("d25_target_encoding")
def target_encoding(t):
    """Means by part on the training half, drawn to the prior; unknown parts get the prior."""
    rows = t("lineitem")
    return rounded(R.target_encoded(rows.where("l_orderkey % 2 = 0"), rows.where("l_orderkey % 2 = 1"), "l_partkey", "l_quantity", 20).select("l_orderkey", "l_linenumber", "encoded"))


@q("d26_configuration_percentiles")
def configuration(t):
    """Percentiles by the fine key where it has enough rows, else by the coarse one."""
    return rounded(R.backed_off_percentile(t("lineitem"), "l_suppkey", "l_returnflag", "l_extendedprice", 0.7, 150))


@q("d27_d28_frequencies")
def frequencies(t):
    done, large = F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0), F.when(F.col("o_totalprice") > 100000, 1.0).otherwise(0.0)
    return rounded(t("orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.avg(done).alias("share"), F.avg(F.when(F.col("o_orderstatus") == "F", large)).alias("given")))


@q("d29_correlations")
def correlations(t):
    return rounded(R.correlations(t("lineitem"), ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))


@q("d31_run_list")
def runs(t):
    return t("orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("symbols"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("latest_done"))


# Windows

def in_time():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@q("e12_i15_rates")
def rates(t):
    """Change of a counter each second; a fall counts as a restart, without change."""
    change, passed = F.col("value") - F.lag("value").over(in_time()), R.seconds() - F.lag(R.seconds()).over(in_time())
    return rounded(t("events").select("event_id", (F.when(change > 0, change).when(change.isNotNull(), 0.0) / F.nullif(passed, F.lit(0))).alias("rate")))


@q("e16_e17_e18_islands")
def island(t):
    return R.islands(t("events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "seq", "age")


@q("e21_calendar")
def calendar(t):
    return t("events").select("event_id", F.hour("ts").alias("h"), F.weekday("ts").alias("wd"), (F.weekday("ts") >= 5).alias("weekend"))


@q("e23_e24_demeaned")
def demeaned(t):
    v = t("events").groupBy(R.bucket(R.seconds(), DAY).alias("day"), F.col("event_type").alias("s")).agg(F.sum("value").alias("x"))
    p = M.demeaned(v, "day", "x")
    change = F.col("share") - F.lag("share").over(Window.partitionBy("s").orderBy("day"))
    return p.select("day", "s", F.round("away", 6).alias("away"), F.round("share", 9).alias("share"), F.round("spread", 6).alias("spread"), F.round(change, 9).alias("change"))


@q("e25_ranked_dedup")
def ranked(t):
    return R.last_by(t("orders"), ["o_custkey", "o_orderpriority"], [(F.col("o_orderstatus") == "F").cast("int"), F.col("o_orderkey")], ["o_orderkey"]).select("o_orderkey")


@q("e28_autocorrelation")
def autocorrelation(t):
    return rounded(R.lagged_correlations(t("events").withColumn("us", R.micros()), "event_type", "us", "event_id", "value", (1, 2, 3, 5, 8)))


@q("e29_block_length")
def block_length(t):
    """Mean number of rows in a day ahead, over complete windows."""
    return rounded(R.rows_ahead(t("events"), "event_type", R.seconds(), DAY).groupBy("event_type").agg(F.avg("n").alias("rows_per_day")))


@q("e30_thinned_phases")
def thinned(t):
    """One row of each day for each of 24 phases: windows that don't overlap."""
    return rounded(R.thinned(t("events"), R.seconds(), "value", ["ts", "event_id"], DAY, 24).groupBy("i").agg(F.count("*").alias("n"), F.avg("x").alias("mean")))


# Sorts, sets


@q("f02_f03_window_end")
def window_end(t):
    return t("events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "value")


@q("f05_top_transitions")
def top_transitions(t):
    return R.edges(moves_of(t)).orderBy(F.desc("n"), "a", "b").limit(10)


@q("f07_strong_newest")
def newest(t):
    return t("orders").where("o_totalprice > 200000").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", R.day_number("o_orderdate").alias("day"))


@q("f09_lookup")
def lookup(t):
    return R.filtered(t("orders"), equal={"o_custkey": 77}).orderBy("o_orderkey").limit(1).select("o_orderkey", "o_custkey")


def _customers(t, status):
    return t("orders").where(F.col("o_orderstatus") == status).select("o_custkey")


@q("g01_g02_g07_unions")
def unions(t):
    return _customers(t, "F").union(_customers(t, "O")).distinct()


@q("g03_intersection")
def intersection(t):
    return _customers(t, "F").intersect(_customers(t, "O"))


@q("g04_difference")
def difference(t):
    return t("customer").select("c_custkey").subtract(t("orders").where("o_totalprice > 100000").select("o_custkey"))


@q("g05_g06_array_sets")
def array_sets(t):
    return t("events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


#: Sixteen axes of four coordinates each, for vectors of length one: an eighth is one deviation.
AXES = {f"axis{a}": {f"x{i}": (f"x{i} high", f"x{i} low") for i in range(4 * a, 4 * a + 4)} for a in range(16)}


def coordinates(t):
    return t("embeddings").select("vec_id", "label", *[(F.element_at("embedding", i + 1).cast("double") * 8).alias(f"x{i}") for i in range(64)])


@q("h_naming_phrases")
def naming(t):
    """Names of vectors: the three most pronounced of sixteen axes."""
    return S.state_names(coordinates(t), AXES, F.lit("neutral"), salience=1.5).select("vec_id", "name")


@q("f10_centroid_features")
def centroid_features(t):
    """The three largest features of each label's centroid."""
    return rounded(S.centroid_features(coordinates(t), "label", [f"x{i}" for i in range(64)]))


@q("f10_named_share")
def named_share(t):
    """The share of labels whose largest features hold one of the first sixteen."""
    return rounded(S.named_share(S.centroid_features(coordinates(t), "label", [f"x{i}" for i in range(64)]), "label", [f"x{i}" for i in range(16)]))


@q("k09_derivative_quadrants")
def quadrants(t):
    """Signs of the change of an open-interest stand-in and of price, hour on hour; zeros count as missing."""
    v = key_of(t("events")).groupBy(F.col("event_type").alias("s"), R.bucket(R.seconds(), 3600).alias("h")).agg(F.nullif(F.sum(F.col("k").cast("double")), F.lit(0.0)).alias("oi"), F.avg("value").alias("p"))
    w = Window.partitionBy("s").orderBy("h")
    c = v.select("s", "h", F.ln(F.col("oi") / F.lag("oi").over(w)).alias("oi_change"), F.ln(F.col("p") / F.lag("p").over(w)).alias("dp"))
    sides = {"up": lambda c: F.col(c) > 0, "down": lambda c: F.col(c) < 0}
    return rounded(c.select("s", "h", "oi_change", *[F.coalesce(a("oi_change") & b("dp"), F.lit(False)).alias(f"{x}_{y}") for x, a in sides.items() for y, b in sides.items()]))


@q("l18_prefix_rarity")
def prefix_rarity(t):
    """Rarity of transitions from the first part of history only."""
    e = R.edges(moves_of(t).where(F.col("sec") < PART_END))
    cuts = exact_percentiles(e, "n", (0.33, 0.66))
    return e.crossJoin(F.broadcast(cuts)).select("a", "b", "n", F.when(F.col("n") <= F.col("p0"), "rare").when(F.col("n") <= F.col("p1"), "uncommon").otherwise("common").alias("rarity"))


# Measures


@q("m01_two_proportions")
def proportions(t):
    return rounded(M.two_proportions(t("lineitem").withColumnRenamed("l_returnflag", "f"), "f", F.expr("l_discount > 0.05D")), 5)


@q("m02_benjamini_hochberg")
def hochberg(t):
    """Stand-in p-values; those at or below the largest that passes its step are kept."""
    p = t("part").select(F.col("p_partkey").alias("id"), F.expr("(p_partkey * 37 % 1009) / 1009.0D * ((p_partkey * 13 % 101) / 101.0D)").alias("p"))
    return M.discoveries(p, "id", "p", 0.05).select("id", "kept", "bonferroni")


@q("m03_m11_splits")
def splits(t):
    """Five walk-forward folds in time order, each trained on what ends a gap of 50 rows before it."""
    f = M.walk_forward(t("events").select("event_id", R.micros().alias("us")), "us", "event_id", 5).where("fold > 0")
    return f.groupBy("fold").agg(F.count("*").alias("test_rows"), F.min("place").alias("first_row"), F.greatest(F.lit(0), F.min("place") - 50).alias("train_rows"))


@q("m07_m08_trend")
def trend(t):
    """Cochran-Armitage trend of a share over ordered groups, in closed form."""
    return rounded(M.trend(t("lineitem"), F.floor((F.col("l_quantity") - 1) / 10).cast("int"), F.expr("l_discount > 0.05D")), 5)


@q("m10_calibration")
def calibration(t):
    """Brier score, skill over the base rate, and expected calibration error over ten bins of a stand-in forecast."""
    f = t("lineitem").select((F.col("l_quantity") / 51.0).alias("p"), F.when(F.col("l_extendedprice") > 30000, 1.0).otherwise(0.0).alias("y"))
    return rounded(M.calibration(f, "p", "y"))


@q("m13_auc")
def auc(t):
    """Area under the curve from mean ranks."""
    return rounded(M.auc(t("lineitem"), "l_quantity", F.col("l_extendedprice") > 30000))


@q("m14_m15_least_squares")
def least_squares(t):
    """A line fitted on the even orders; R2 out of sample against the mean of the training rows."""
    rows = t("lineitem")
    found = M.line_fit(rows.where("l_orderkey % 2 = 0"), rows.where("l_orderkey % 2 = 1"), "l_extendedprice", "l_quantity")
    return found.select(F.round("slope", 4).alias("slope"), F.round("r2", 6).alias("r2"))


@q("m16_spearman")
def spearman(t):
    return rounded(M.spearman(t("lineitem"), "l_quantity", "l_extendedprice", "l_returnflag"))


@q("m18_pinball_and_coverage")
def pinball(t):
    rows = t("lineitem")
    found = M.constant_heads(rows.where("l_orderkey % 2 = 0"), rows.where("l_orderkey % 2 = 1"), "l_extendedprice", (0.25, 0.9))
    return found.select(F.round("loss0", 4).alias("loss25"), F.round("loss1", 4).alias("loss90"), F.round("covered1", 6).alias("covered90"))


@q("m19_seasonality")
def seasonality(t):
    return rounded(t("events").select("event_id", *[c.alias(n) for n, c in M.seasonal("ts").items()]))


def daily(t):
    return t("events").groupBy(R.bucket(R.seconds(), DAY).alias("day"), F.col("event_type").alias("s")).agg(F.avg("value").alias("x"), F.count("*").alias("n"))


@q("m20_dispersion")
def dispersion(t):
    r = daily(t).withColumn("ret", F.ln(F.col("x") / F.lag("x").over(Window.partitionBy("s").orderBy("day")))).where("ret IS NOT NULL")
    return rounded(M.demeaned(r, "day", "ret").select("day", "s", F.col("away").alias("own"), F.col("spread").alias("dispersion")))


@q("m21_information_coefficient")
def information(t):
    """Rank correlation, day by day across symbols, of a signal and of what follows."""
    v = daily(t).withColumn("y", F.lead("x").over(Window.partitionBy("s").orderBy("day")) / F.col("x") - 1).where("y IS NOT NULL")
    return rounded(M.information(v, "day", "n", "y", 4))


@q("m23_demeaned_correlation")
def demeaned_correlation(t):
    return rounded(M.demeaned_correlation(t("events"), "value", "user_id", "event_type"))


@q("m24_adjusted_rand")
def rand(t):
    return rounded(M.adjusted_rand(t("lineitem"), "l_returnflag", "l_linestatus"))


@q("m25_lag_convention")
def lag_convention(t):
    """Correlation of a series with another at the same hour and the hour before; hours are few, so one task orders them."""
    v = t("events").groupBy(R.bucket(R.seconds(), 3600).alias("h")).agg(F.avg("value").alias("x"), F.count("*").alias("y"))
    before = v.withColumn("before", F.lag("y").over(Window.orderBy("h"))).where("before IS NOT NULL")
    return rounded(before.agg(F.corr("x", "y").alias("same"), F.corr("x", "before").alias("lagged")))


@q("l03_group_floor")
def group_floor(t):
    groups = R.share_of_total(t("embeddings"), ["label"])
    return groups.select("label", "n", (F.col("n") >= F.greatest(F.lit(30.0), 0.0025 * F.round(F.col("n") / F.col("share")))).alias("large_enough"))


@q("i11_first_in_ttl")
def ttl(t):
    """A key is taken again when its last sighting is half an hour old."""
    before = F.lag(R.seconds()).over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return t("events").select("event_id", (R.seconds() - before).alias("passed")).where("passed IS NULL OR passed > 1800").select("event_id")


@q("i17_age_cut")
def age_cut(t):
    return R.with_greatest(t("events"), R.seconds(), "now").where((R.seconds() >= F.col("now") - 180 * 60) & (F.col("value") > 20)).select("event_id")
