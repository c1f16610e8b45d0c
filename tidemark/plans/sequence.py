"""Queries of state sequences, outcomes, candidates and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions.profiles import DEFAULT, resolve
from tidemark.operators import candidates as C
from tidemark.operators import features as X
from tidemark.operators import scoring as R
from tidemark.operators import states as S
from tidemark.operators import windows as W
from tidemark.plans.market import BLOCKS, r6
from tidemark.plans.shared import HOUR, STATES, bars, indicator_bars, indicators_sql, rounded, user_states
from tidemark.registry import Registry
from tidemark.tables import table

REGISTRY = Registry()
query = REGISTRY.query

#: States smoothed by hand in SQL: runs of one row take the label before them.
SMOOTH = f"""{STATES},
marks AS (SELECT *, CASE WHEN lag(label) OVER w <> label THEN 1 ELSE 0 END AS c FROM states WINDOW w AS (PARTITION BY symbol ORDER BY t)),
runs AS (SELECT *, sum(c) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM marks),
sized AS (SELECT *, count(*) OVER (PARTITION BY symbol, run) AS n FROM runs),
smooth AS (SELECT symbol, t, sec, value, last_value(CASE WHEN n >= 2 OR run = 0 THEN label END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM sized),
turns AS (SELECT *, coalesce(lag(g) OVER w <> g, false) AS is_transition, lag(g) OVER w AS was FROM smooth WINDOW w AS (PARTITION BY symbol ORDER BY t)),
seqs AS (SELECT *, CAST(sum(CAST(is_transition AS INT)) OVER u AS BIGINT) AS state_seq, last_value(CASE WHEN is_transition THEN was END IGNORE NULLS) OVER u AS prev FROM turns
  WINDOW u AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
aged AS (SELECT *, CAST((row_number() OVER (PARTITION BY symbol, state_seq ORDER BY t) - 1) * 15 AS INT) AS age_minutes,
  CASE WHEN is_transition THEN prev || '->' || g END AS transition_id FROM seqs)"""


def assigned(spark, sf_dir):
    return S.assign(user_states(spark, sf_dir), "label", 15)


@query("e19_smoothed_labels", f"WITH {SMOOTH} SELECT symbol, t, g AS smoothed FROM smooth")
def smoothed(spark, sf_dir):
    return W.smooth_labels(user_states(spark, sf_dir), "label", 2).select("symbol", "t", "smoothed")


@query("l06_assign_states", f"""WITH {SMOOTH} SELECT symbol, t, g AS group_id, prev AS prev_group_id, state_seq, is_transition, age_minutes,
  CASE WHEN age_minutes < 30 THEN 'age_lt_30' WHEN age_minutes < 60 THEN 'age_30_60' WHEN age_minutes < 120 THEN 'age_60_120' ELSE 'age_gt_120' END AS age_bucket, transition_id FROM aged""")
def assign(spark, sf_dir):
    return assigned(spark, sf_dir).select("symbol", "t", "group_id", "prev_group_id", "state_seq", "is_transition", "age_minutes", "age_bucket", "transition_id")


@query("e20_trajectory_entropy", f"""WITH {SMOOTH},
kinds AS (SELECT symbol, count(DISTINCT g) AS k FROM smooth GROUP BY symbol),
firsts AS (SELECT symbol, arg_min(g, t) AS f FROM smooth GROUP BY symbol),
padded AS (SELECT s.symbol, s.t, s.t - o.range AS place FROM smooth s, range(24) o),
labels AS (SELECT p.symbol, p.t, coalesce(x.g, f.f) AS g FROM padded p JOIN firsts f USING (symbol) LEFT JOIN smooth x ON x.symbol = p.symbol AND x.t = p.place),
shares AS (SELECT symbol, t, g, count(*) / 24.0 AS p FROM labels GROUP BY symbol, t, g),
e AS (SELECT symbol, t, sum(-p * ln(p)) AS h FROM shares GROUP BY symbol, t)
SELECT symbol, t, round(h / CASE WHEN k > 1 THEN ln(least(24, k)) ELSE 1 END, 6) + 0.0 AS entropy FROM e JOIN kinds USING (symbol)""")
def entropy(spark, sf_dir):
    return assigned(spark, sf_dir).select("symbol", "t", (F.round("entropy_value", 6) + 0.0).alias("entropy"))


def _with_outcome(spark, sf_dir):
    """States with the relative change to the user's next event as outcome."""
    nxt = F.lead("value").over(W.ordered())
    ret = (nxt / F.nullif("value", F.lit(0.0)) - 1) * 100
    return assigned(spark, sf_dir).withColumns({"ret_pct": ret, "valid": ret.isNotNull()})


OUTCOME = f"{SMOOTH}, outcome AS (SELECT *, (lead(value) OVER (PARTITION BY symbol ORDER BY t) / nullif(value, 0) - 1) * 100 AS ret FROM aged)"


@query("d07_d08_transition_graph", f"""WITH {OUTCOME}, e AS (SELECT transition_id, count(*) AS n, avg(ret) AS avg_ret, avg(CAST(ret > 0 AS DOUBLE)) AS up_share, count(*) / (SELECT count(*) FROM outcome WHERE transition_id IS NOT NULL) AS share
  FROM outcome WHERE transition_id IS NOT NULL GROUP BY transition_id), q AS (SELECT quantile_cont(n, 0.33) AS a, quantile_cont(n, 0.66) AS b FROM e)
SELECT transition_id, n, round(avg_ret, 6) AS avg_ret, round(up_share, 6) AS up_share, round(share, 6) AS share, CASE WHEN n <= a THEN 'rare' WHEN n <= b THEN 'uncommon' ELSE 'common' END AS rarity FROM e, q""")
def edges(spark, sf_dir):
    return rounded(S.transition_stats(_with_outcome(spark, sf_dir)))


@query("d09_group_stats", f"""WITH {OUTCOME}, g AS (SELECT g AS group_id, count(*) AS size, avg(CAST(ret > 0 AS DOUBLE)) AS up_share, avg(ret) AS avg_ret, stddev_samp(ret) AS std_ret, count(*) / (SELECT count(*) FROM outcome) AS share FROM outcome GROUP BY g)
SELECT group_id, size, round(up_share, 6) AS up_share, round(avg_ret, 6) AS avg_ret, round(std_ret, 6) AS std_ret, round(share, 6) AS share,
  CASE WHEN up_share > 0.55 THEN 'long_skew' WHEN up_share < 0.45 THEN 'short_skew' ELSE 'neutral' END AS dominant_bias FROM g""")
def nodes(spark, sf_dir):
    return rounded(S.group_stats(_with_outcome(spark, sf_dir)))


@query("l17_graph_export", f"""WITH {OUTCOME}, e AS (SELECT transition_id, count(*) AS n FROM outcome WHERE transition_id IS NOT NULL GROUP BY transition_id), q AS (SELECT quantile_cont(n, 0.33) AS a, quantile_cont(n, 0.66) AS b FROM e),
g AS (SELECT g AS id, count(*) AS n, avg(CAST(ret > 0 AS DOUBLE)) AS up_share FROM outcome GROUP BY g)
SELECT 'node' AS kind, id, n, CASE WHEN up_share > 0.55 THEN 'long_skew' WHEN up_share < 0.45 THEN 'short_skew' ELSE 'neutral' END AS what, row_number() OVER (ORDER BY id) AS place FROM g
UNION ALL SELECT 'edge', transition_id, n, CASE WHEN n <= a THEN 'rare' WHEN n <= b THEN 'uncommon' ELSE 'common' END, row_number() OVER (ORDER BY transition_id) FROM e, q""")
def graph_export(spark, sf_dir):
    """The exported JSON documents, parsed back: every node and edge with its place in its document."""
    states = _with_outcome(spark, sf_dir)
    doc = S.graph_json(S.group_stats(states), S.transition_stats(states))
    nodes_ = doc.select(F.posexplode(F.from_json("nodes", "array<struct<group_id:string,size:bigint,dominant_bias:string>>")).alias("i", "x")).select(F.lit("node").alias("kind"), F.col("x.group_id").alias("id"), F.col("x.size").alias("n"), F.col("x.dominant_bias").alias("what"), (F.col("i") + 1).alias("place"))
    edges_ = doc.select(F.posexplode(F.from_json("edges", "array<struct<transition_id:string,n:bigint,rarity:string>>")).alias("i", "x")).select(F.lit("edge").alias("kind"), F.col("x.transition_id").alias("id"), F.col("x.n").alias("n"), F.col("x.rarity").alias("what"), (F.col("i") + 1).alias("place"))
    return nodes_.unionByName(edges_)


@query("d10_group_descriptions", """
WITH pairs AS (SELECT l_returnflag AS g, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM lineitem),
w AS (SELECT feature, avg(x) AS m, stddev_samp(x) AS s FROM pairs GROUP BY feature),
e AS (SELECT g, feature, avg(x) AS x FROM pairs GROUP BY g, feature),
d AS (SELECT g, feature, (x - m) / nullif(s, 0) AS deviation FROM e JOIN w USING (feature)),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY abs(deviation) DESC, feature) AS place FROM d)
SELECT g AS l_returnflag, CAST(place AS INT) AS place, feature, round(deviation, 6) AS deviation FROM r WHERE place <= 3""")
def descriptions(spark, sf_dir):
    return rounded(S.describe_groups(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 3))


@query("d12_context_lift", f"""WITH RECURSIVE {indicators_sql()}, {BLOCKS}, s AS (SELECT intensity, context_atoms FROM (SELECT *, CASE WHEN atom_count <= 2 THEN 'sparse' WHEN atom_count <= 5 THEN 'moderate' ELSE 'dense' END AS intensity FROM blocks)),
u AS (SELECT intensity, unnest(string_split(context_atoms, ',')) AS atom FROM s WHERE context_atoms <> ''),
h AS (SELECT intensity, atom, count(*) AS n FROM u GROUP BY intensity, atom), z AS (SELECT intensity, count(*) AS size FROM s GROUP BY intensity), a AS (SELECT atom, count(*) AS n_all FROM u GROUP BY atom)
SELECT intensity, atom, n, round((n / size) / (n_all / (SELECT count(*) FROM s)), 6) AS lift FROM h JOIN z USING (intensity) JOIN a USING (atom)""")
def lift(spark, sf_dir):
    blocks = X.event_blocks(X.atoms(indicator_bars(spark, sf_dir)))
    return rounded(S.context_lift(blocks, "intensity", "context_atoms"))


HORIZON = 24
FORWARD = f"""fwd AS (SELECT *, count(*) OVER f = {HORIZON} AS whole, max(high) OVER f AS top, min(low) OVER f AS bottom, lead(close, {HORIZON}) OVER w AS e, lead(t, {HORIZON}) OVER w AS et, stddev_samp(step) OVER f AS rv
  FROM (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY t)) AS step FROM ind)
  WINDOW w AS (PARTITION BY symbol ORDER BY t), f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {HORIZON} FOLLOWING)),
outcomes AS (SELECT symbol, t, (e / close - 1) * 100 AS ret_pct, CASE WHEN whole THEN (top / close - 1) * 100 END AS mfe_pct, CASE WHEN whole THEN (bottom / close - 1) * 100 END AS mae_pct,
  e > close AS is_up, CASE WHEN whole THEN (top - bottom) / close * 100 END AS range_pct, CASE WHEN whole THEN rv END AS rv_fwd,
  CASE WHEN whole THEN (top - bottom) / close * 100 / nullif(atr / close * 100 * sqrt({HORIZON}.0), 0) END AS range_ratio, e IS NOT NULL AND coalesce(et - t = {HORIZON * HOUR}, false) AS valid FROM fwd)"""


@query("e14_e15_outcomes", f"WITH RECURSIVE {indicators_sql()}, {FORWARD} SELECT symbol, t, {r6('ret_pct', 'mfe_pct', 'mae_pct')}, is_up, {r6('range_pct', 'rv_fwd', 'range_ratio')}, valid FROM outcomes")
def outcomes(spark, sf_dir):
    return rounded(C.outcomes(indicator_bars(spark, sf_dir), HORIZON, HOUR))


OFFSETS = [0, 1, 3]
SNAPSHOTS = f"""{SMOOTH}, numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS place FROM aged),
snaps AS (SELECT n.symbol, n.t, n.sec, n.value, n.state_seq, n.g, n.age_minutes, s.transition_id, o.o AS "offset" FROM numbered s, (SELECT unnest({OFFSETS}) AS o) o, numbered n
  WHERE s.transition_id IS NOT NULL AND n.symbol = s.symbol AND n.place = s.place + o.o AND n.state_seq = s.state_seq)"""


@query("l07_c14_snapshots", f"""WITH {SNAPSHOTS} SELECT symbol, t, "offset", transition_id, state_seq, g AS group_id, age_minutes FROM snaps""")
def snapshots(spark, sf_dir):
    return C.snapshots(assigned(spark, sf_dir), OFFSETS).select("symbol", "t", "offset", "transition_id", "state_seq", "group_id", "age_minutes")


def _candidate_rows(spark, sf_dir):
    """Snapshots of all users as one market: outcome is the change to the user's next event, the block its weekday."""
    nxt = F.lead("value").over(W.ordered())
    states = assigned(spark, sf_dir).withColumn("ret_pct", (nxt / F.nullif("value", F.lit(0.0)) - 1) * 100)
    rows = C.snapshots(states, OFFSETS)
    return rows.select(
        F.lit("ALL").alias("symbol"), F.col("sec").alias("t"), "offset", "transition_id", F.concat(F.lit("day"), (F.floor(F.col("sec") / 86400) % 3).cast("string")).alias("event_block_id"),
        F.coalesce("ret_pct", F.lit(0.0)).alias("ret_pct"), F.greatest(F.coalesce("ret_pct", F.lit(0.0)), F.lit(0.5)).alias("mfe_pct"), F.least(F.coalesce("ret_pct", F.lit(0.0)), F.lit(-0.5)).alias("mae_pct"),
        F.col("ret_pct").isNotNull().alias("valid"), (F.col("symbol") * 100_000 + F.col("state_seq")).alias("state_seq"), F.lit("common").alias("transition_rarity"), F.lit("rare").alias("event_rarity"),
    )


MATURED = f"""{SNAPSHOTS},
next AS (SELECT symbol, t, lead(value) OVER (PARTITION BY symbol ORDER BY t) AS nxt, value AS v FROM states),
rows AS (SELECT s.sec AS t, "offset", transition_id, 'day' || CAST((s.sec // 86400) % 3 AS VARCHAR) AS block, coalesce((nxt / nullif(v, 0) - 1) * 100, 0) AS ret, nxt / nullif(v, 0) IS NOT NULL AS valid, s.symbol * 100000 + state_seq AS seq
  FROM snaps s JOIN next n ON n.symbol = s.symbol AND n.t = s.t)"""


def _past(key: str) -> str:
    return f"""SELECT c.*, p.n, p.eff, p.valid AS nv, p.ups, p.fav, p.adv, p.days, p.months, p.top, p.falls, p.fav_short, p.adv_short FROM (SELECT *, row_number() OVER () AS id FROM rows) c LEFT JOIN LATERAL (
  SELECT count(*) AS n, count(DISTINCT seq) AS eff, count(*) FILTER (WHERE r.valid) AS valid, count(*) FILTER (WHERE r.valid AND ret > 0) AS ups, count(DISTINCT r.t // 86400) AS days,
    count(DISTINCT r.t // 2592000) AS months, coalesce(list_max(map_values(histogram(r.t // 2592000))), 0) AS top, count(*) FILTER (WHERE r.valid AND ret < 0) AS falls,
    quantile_cont(greatest(ret, 0.5), 0.7) FILTER (WHERE r.valid AND ret > 0) AS fav, quantile_cont(greatest(0, -least(ret, -0.5)), 0.8) FILTER (WHERE r.valid AND ret > 0) AS adv,
    quantile_cont(greatest(0, -least(ret, -0.5)), 0.7) FILTER (WHERE r.valid AND ret < 0) AS fav_short, quantile_cont(greatest(0, greatest(ret, 0.5)), 0.8) FILTER (WHERE r.valid AND ret < 0) AS adv_short
  FROM rows r WHERE {key} AND r.t <= c.t - 86400) p ON true"""


@query("l08_c15_matured_past", f"""WITH {MATURED}, past AS ({_past('r.transition_id = c.transition_id')})
SELECT t, "offset", transition_id, seq AS state_seq, n AS sample_size, eff AS effective_sample_size, nv AS valid_label_count, ups AS long_outcome_count, falls, days AS repeatability_days, months AS repeatability_months, top AS top_month,
  round(coalesce(fav, 0), 6) AS favorable, round(coalesce(adv, 0), 6) AS adverse, round(coalesce(fav_short, 0), 6) AS favorable_short, round(coalesce(adv_short, 0), 6) AS adverse_short FROM past""")
def matured(spark, sf_dir):
    """What was known of the same transition a day before each snapshot."""
    rows = C.matured(_candidate_rows(spark, sf_dir), ["symbol", "transition_id"], 86400)
    return rounded(rows.select("t", "offset", "transition_id", "state_seq", "past.*").drop("ret_sum"))


def _ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 1e-9 THEN {a} / {b} ELSE {a} END"


#: Of the finer sample if it has enough rows of enough states, else of the wider one.
_CHOSEN = "n eff nv ups days months top fav adv falls fav_short adv_short".split()


@query("l08_l10_candidates", f"""WITH {MATURED}, ids AS (SELECT *, row_number() OVER (ORDER BY t, "offset", seq, transition_id) AS rid FROM rows),
wide AS ({_past('r.transition_id = c.transition_id').replace('row_number() OVER () AS id FROM rows', 'rid AS id FROM ids')}),
narrow AS ({_past('r.transition_id = c.transition_id AND r.block = c.block').replace('row_number() OVER () AS id FROM rows', 'rid AS id FROM ids')}),
chosen AS (SELECT w.t, w."offset", w.transition_id, w.block, CASE WHEN a.n >= 30 AND a.eff >= 30 THEN 'transition+event_block' WHEN w.n >= 30 AND w.eff >= 30 THEN 'transition' END AS scope,
  {', '.join(f"CASE WHEN a.n >= 30 AND a.eff >= 30 THEN a.{c} ELSE w.{c} END AS {c}" for c in _CHOSEN)} FROM wide w JOIN narrow a USING (id)),
shares AS (SELECT *, ups * 1.0 / nv AS share, 2.0 * ups / nv - 1 AS skew, nv * 1.0 / n AS valid, top * 1.0 / n AS concentration FROM chosen WHERE scope IS NOT NULL AND nv > 0)
SELECT 'ALL' AS symbol, t, "offset", transition_id, block AS event_block_id, scope, substr(sha1(concat_ws('|', 'ALL', CAST(t AS VARCHAR), transition_id, block, CAST("offset" AS VARCHAR))), 1, 20) AS candidate_id,
  n AS sample_size, eff AS effective_sample_size, nv AS valid_label_count, round(valid, 6) AS valid_label_pct, days AS repeatability_days, months AS repeatability_months, round(concentration, 6) AS monthly_concentration,
  round(share, 6) AS long_outcome_share, round(skew, 6) AS historical_outcome_skew, CASE WHEN skew > 0 THEN 'long' ELSE 'short' END AS research_side,
  CASE WHEN share > 0.55 THEN 'long_skew' WHEN share < 0.45 THEN 'short_skew' ELSE 'neutral' END AS historical_bias_context,
  round(coalesce(fav, 0), 6) AS p70_long_favorable_pct, round(coalesce(adv, 0), 6) AS p80_long_adverse_pct, round({_ratio_sql('coalesce(fav, 0)', 'coalesce(adv, 0)')}, 6) AS long_favorable_adverse_ratio_p70_p80,
  CASE WHEN falls > 0 THEN round({_ratio_sql('fav_short', 'adv_short')}, 6) END AS short_favorable_adverse_ratio_p70_p80,
  round(least(1.0, greatest(0.0, 0.25 * least(1.0, abs(skew) / 0.5) + 0.20 * least(1.0, log10(eff + 1) / 3) + 0.15 * least(1.0, months / 18.0) + 0.15 * (1 - least(1.0, concentration / 0.5)) + 0.15 * valid
    + 0.10 * (0.33 + CASE WHEN scope = 'transition' THEN 0.33 ELSE 1.0 END) / 2)), 6) AS research_score
FROM shares WHERE abs(skew) >= 0.06""")
def candidates(spark, sf_dir):
    """Candidates with research scores."""
    return rounded(C.candidates(_candidate_rows(spark, sf_dir), 86400, least=30, least_effective=30))


#: Candidate records made of orders: every criterion gets a value that spreads over its ladder.
RECORDS = """records AS (
  SELECT 'c' || CAST(o_orderkey AS VARCHAR) AS candidate_id, c_mktsegment AS symbol, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'f' || CAST(o_orderkey % 200 AS VARCHAR) END AS candidate_family_key,
    't' || CAST(o_custkey % 40 AS VARCHAR) AS transition_id, CASE WHEN o_orderkey % 3 = 0 THEN 'short' ELSE 'long' END AS research_side,
    (o_orderkey % 97) / 96.0 AS valid_label_pct, CAST(o_orderkey % 1300 AS BIGINT) AS sample_size, CAST(NULL AS BIGINT) AS effective_sample_size, (o_orderkey % 41) / 100.0 AS monthly_concentration,
    CAST(o_orderkey % 19 AS BIGINT) AS repeatability_months, CAST(o_orderkey % 300 AS BIGINT) AS repeatability_days, (o_orderkey % 89) / 88.0 AS long_outcome_share, 2 * (o_orderkey % 89) / 88.0 - 1 AS historical_outcome_skew,
    (o_orderkey % 53) / 10.0 AS long_favorable_adverse_ratio_p70_p80, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey % 47) / 10.0 END AS short_favorable_adverse_ratio_p70_p80,
    (o_orderkey % 29) / 10.0 AS p70_long_favorable_pct, (o_orderkey % 23) / 10.0 AS p80_long_adverse_pct,
    CASE WHEN o_orderstatus = 'F' THEN 'fresh' ELSE 'stale' END AS context_status,
    CASE o_orderkey % 4 WHEN 0 THEN 'age_lt_30' WHEN 1 THEN 'age_30_60' WHEN 2 THEN 'age_60_120' ELSE 'age_gt_120' END AS age_bucket,
    CASE o_custkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS trajectory_entropy, CASE o_orderkey % 5 WHEN 0 THEN 'rare' WHEN 1 THEN 'uncommon' ELSE 'common' END AS transition_rarity,
    CASE o_orderkey % 7 WHEN 0 THEN 'rare' WHEN 1 THEN 'uncommon' ELSE 'common' END AS event_rarity_bucket, CASE o_orderkey % 6 WHEN 0 THEN 'transition' WHEN 1 THEN NULL ELSE 'transition+event_block' END AS sample_scope,
    (o_orderkey % 101) / 100.0 AS research_score, (o_orderkey % 31) / 100.0 AS event_block_row_share, CASE o_orderkey % 3 WHEN 0 THEN 'sparse' WHEN 1 THEN 'moderate' ELSE 'dense' END AS event_intensity_bucket,
    CASE o_orderkey % 4 WHEN 0 THEN 'long_skew' WHEN 1 THEN 'short_skew' ELSE 'neutral' END AS historical_bias_context
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def records(spark, sf_dir):
    """The same records by DataFrame functions."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    part = lambda n, of: (key % n) / F.lit(float(of))
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    one_of = lambda number, *names: F.element_at(F.array(*[F.lit(n) for n in names]), F.least(number.cast("int") + 1, F.lit(len(names))))
    share = part(89, 88)
    columns = {
        "candidate_id": text("c", key),
        "symbol": F.col("c_mktsegment"),
        "candidate_family_key": F.when(key % 11 != 0, text("f", key % 200)),
        "transition_id": text("t", customer % 40),
        "research_side": F.when(key % 3 == 0, "short").otherwise("long"),
        "valid_label_pct": part(97, 96),
        "sample_size": (key % 1300).cast("long"),
        "effective_sample_size": F.lit(None).cast("long"),
        "monthly_concentration": part(41, 100),
        "repeatability_months": (key % 19).cast("long"),
        "repeatability_days": (key % 300).cast("long"),
        "long_outcome_share": share,
        "historical_outcome_skew": 2 * share - 1,
        "long_favorable_adverse_ratio_p70_p80": part(53, 10),
        "short_favorable_adverse_ratio_p70_p80": F.when(key % 4 != 0, part(47, 10)),
        "p70_long_favorable_pct": part(29, 10),
        "p80_long_adverse_pct": part(23, 10),
        "context_status": F.when(F.col("o_orderstatus") == "F", "fresh").otherwise("stale"),
        "age_bucket": one_of(key % 4, "age_lt_30", "age_30_60", "age_60_120", "age_gt_120"),
        "trajectory_entropy": one_of(customer % 3, "low", "medium", "high"),
        "transition_rarity": one_of(key % 5, "rare", "uncommon", "common"),
        "event_rarity_bucket": one_of(key % 7, "rare", "uncommon", "common"),
        "sample_scope": F.when(key % 6 == 0, "transition").when(key % 6 > 1, "transition+event_block"),
        "research_score": part(101, 100),
        "event_block_row_share": part(31, 100),
        "event_intensity_bucket": one_of(key % 3, "sparse", "moderate", "dense"),
        "historical_bias_context": one_of(key % 4, "long_skew", "short_skew", "neutral"),
    }
    met = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), customer == F.col("c_custkey"))
    return met.select(*[c.alias(n) for n, c in columns.items()])


def ladder_sql(x: str, spec: dict) -> str:
    sign = ">" if spec["mode"] == "higher" else "<"
    return "CASE " + " ".join(f"WHEN {x} {sign} {t} THEN {s}" for t, s in spec["steps"]) + f" ELSE {spec['floor']} END"


def map_sql(x: str, scores: dict) -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{k}' THEN {v}" for k, v in scores.items()) + " ELSE 0 END"


_L, _M, _W, _B = DEFAULT["ladders"], DEFAULT["maps"], DEFAULT["weights"], DEFAULT["rating"]
WIN = "CASE WHEN research_side = 'long' THEN long_outcome_share ELSE 1 - long_outcome_share END"
FA = "CASE WHEN research_side = 'long' THEN long_favorable_adverse_ratio_p70_p80 ELSE short_favorable_adverse_ratio_p70_p80 END"
SCORED = f"""{RECORDS}, axes AS (SELECT *,
  CAST(({ladder_sql('valid_label_pct', _L['valid_label_pct'])}) + ({ladder_sql('sample_size', _L['sample_size'])}) + ({ladder_sql('monthly_concentration', _L['monthly_concentration'])}) + ({ladder_sql('repeatability_months', _L['repeatability_months'])}) AS DOUBLE) / 4 AS statistical,
  CAST(({ladder_sql(f'({WIN})', _L['win_rate'])}) + ({ladder_sql('abs(historical_outcome_skew)', _L['abs_outcome_skew'])}) + CASE WHEN ({FA}) IS NULL THEN 0 ELSE {ladder_sql(f'({FA})', _L['fa_ratio'])} END AS DOUBLE) / CASE WHEN ({FA}) IS NULL THEN 2 ELSE 3 END AS directional,
  CAST(({map_sql('context_status', _M['context_status'])}) + ({map_sql('age_bucket', _M['age_bucket'])}) + ({map_sql('trajectory_entropy', _M['trajectory_entropy'])}) AS DOUBLE) / 3 AS context,
  CAST(({map_sql('transition_rarity', _M['rarity'])}) + ({ladder_sql('research_score', _L['research_score'])}) + CASE WHEN sample_scope = 'transition' THEN 0 ELSE {map_sql('event_rarity_bucket', _M['rarity'])} END AS DOUBLE) / CASE WHEN sample_scope = 'transition' THEN 2 ELSE 3 END AS rarity FROM records),
scored AS (SELECT *, round(statistical * {_W['statistical']} + directional * {_W['directional']} + context * {_W['context']} + rarity * {_W['rarity']}, 4) AS total FROM axes)"""
RATED = f"CASE WHEN total >= {_B['strong_min']} THEN 'STRONG' WHEN total >= {_B['moderate_min']} THEN 'MODERATE' ELSE 'WEAK' END"


@query("l12_l15_scores", f"""WITH {SCORED} SELECT candidate_id, round(statistical, 4) AS statistical, round(directional, 4) AS directional, round(context, 4) AS context, round(rarity, 4) AS rarity, total, {RATED} AS rating FROM scored""")
def scores(spark, sf_dir):
    return R.score(records(spark, sf_dir)).select("candidate_id", "statistical", "directional", "context", "rarity", "total", "rating")


#: A profile of one symbol that changes a ladder and a weight pair.
OWN = {"extends": "_default", "ladders": {"sample_size": {"steps": [[800, 1.0], [300, 0.5]]}}, "weights": {"context": 0.15, "rarity": 0.20}}
_P = resolve("BUILDING", {"BUILDING": OWN})
_OWN_STAT = f"CAST(({ladder_sql('valid_label_pct', _L['valid_label_pct'])}) + ({ladder_sql('sample_size', _P['ladders']['sample_size'])}) + ({ladder_sql('monthly_concentration', _L['monthly_concentration'])}) + ({ladder_sql('repeatability_months', _L['repeatability_months'])}) AS DOUBLE) / 4"


@query("j04_scores_by_profile", f"""WITH {SCORED}, own AS (SELECT *, {_OWN_STAT} AS own_stat FROM scored)
SELECT candidate_id, CASE WHEN symbol = 'BUILDING' THEN 'BUILDING' ELSE '_default' END AS profile, CASE WHEN symbol = 'BUILDING' THEN round(own_stat * 0.3 + directional * 0.35 + context * 0.15 + rarity * 0.2, 4) ELSE total END AS total, total AS baseline_total FROM own""")
def profiled(spark, sf_dir):
    return R.score_by_symbol(records(spark, sf_dir), {"BUILDING": _P}).select("candidate_id", "profile", "total", "baseline_total")


@query("b11_validator_flags", f"""WITH {RECORDS} SELECT candidate_id, array_to_string(list_filter([CASE WHEN symbol IS NULL THEN 'symbol_defaulted' END, CASE WHEN symbol NOT IN ('BUILDING', 'MACHINERY') THEN 'unknown_symbol_profile' END,
  CASE WHEN context_status = 'stale' THEN 'context_status_stale' END, CASE WHEN age_bucket = 'age_gt_120' THEN 'age_gt_120' END, CASE WHEN context_status = 'stale' AND age_bucket = 'age_gt_120' THEN 'stale_and_aged_combined' END,
  CASE WHEN transition_rarity = 'common' THEN 'transition_rarity_common' END, CASE WHEN valid_label_pct < 0.7 THEN 'low_valid_label_pct' END, CASE WHEN research_score > 0.85 AND valid_label_pct < 0.7 THEN 'false_confidence_high_score_low_validity' END,
  CASE WHEN monthly_concentration > 0.3 THEN 'high_monthly_concentration_seasonal_risk' END, CASE WHEN sample_size < 100 THEN 'very_small_sample_size' END, CASE WHEN repeatability_months < 3 THEN 'low_repeatability_months' END], lambda x: x IS NOT NULL), ',') AS flags FROM records""")
def flags(spark, sf_dir):
    return records(spark, sf_dir).select("candidate_id", F.array_join(R.flags(["BUILDING", "MACHINERY"]), ",").alias("flags"))


@query("b12_conflicts", f"""WITH {RECORDS} SELECT 'contradictory_direction' AS conflict_type, symbol, transition_id AS subject, count(*) AS candidates FROM records GROUP BY symbol, transition_id HAVING count(DISTINCT research_side) > 1
UNION ALL SELECT 'stale_and_old_context', symbol, candidate_id, 1 FROM records WHERE context_status = 'stale' AND age_bucket = 'age_gt_120'
UNION ALL SELECT 'false_confidence', symbol, candidate_id, 1 FROM records WHERE research_score > 0.85 AND valid_label_pct < 0.7
UNION ALL SELECT 'seasonal_concentration', symbol, candidate_id, 1 FROM records WHERE monthly_concentration > 0.3""")
def conflicts(spark, sf_dir):
    return R.conflicts(records(spark, sf_dir))


@query("b13_f06_best_per_family", f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol, coalesce(candidate_family_key, candidate_id) ORDER BY total + CASE WHEN context_status = 'fresh' THEN 0.05 ELSE 0 END DESC, candidate_id) AS place FROM scored WHERE total >= 0.6)
SELECT candidate_id, symbol, total FROM r WHERE place = 1""")
def best(spark, sf_dir):
    return R.best_per_family(R.above_minimum(R.score(records(spark, sf_dir)))).select("candidate_id", "symbol", "total")


@query("l16_texts", f"""WITH {SCORED}, x AS (SELECT *, round(statistical, 4) AS s, round(directional, 4) AS d FROM scored), y AS (SELECT *,
  CAST(s >= 0.7 AS INT) + CAST(d >= 0.7 AS INT) + CAST(context_status = 'fresh' AS INT) + CAST(transition_rarity = 'rare' AS INT) AS a,
  CAST(s < 0.4 AS INT) + CAST(d < 0.4 AS INT) + CAST(context_status = 'stale' AS INT) + CAST(monthly_concentration > 0.3 AS INT) AS b FROM x)
SELECT candidate_id, {RATED} || ' ' || research_side || ': ' || printf('%.4f', total) || ', ' || CAST(a AS VARCHAR) || ' strengths, ' || CAST(b AS VARCHAR) || ' risks' AS summary FROM y""")
def texts(spark, sf_dir):
    return R.texts(R.score(records(spark, sf_dir))).select("candidate_id", "summary")


_PLACES = {n: "CASE " + " ".join(f"WHEN {n} = '{k}' THEN {v}" for k, v in m.items()) + " ELSE 0.5 END" for n, m in R.EMBEDDED.items()}


@query("b22_embedding", f"""WITH {RECORDS} SELECT candidate_id, 32 AS width, round(CAST(CAST(research_score AS FLOAT) AS DOUBLE), 5) AS s1, round(CAST(CAST(least(long_favorable_adverse_ratio_p70_p80 / 10, 1.0) AS FLOAT) AS DOUBLE), 5) AS s5,
  round(CAST(CAST({_PLACES['trajectory_entropy']} AS FLOAT) AS DOUBLE), 5) AS s12, round(CAST(CAST({_PLACES['age_bucket']} AS FLOAT) AS DOUBLE), 5) AS s16, CAST(CASE WHEN research_side = 'long' THEN 1 ELSE 0 END AS DOUBLE) AS s17,
  round(CAST(CAST({_PLACES['historical_bias_context']} AS FLOAT) AS DOUBLE), 5) AS s18, CAST(0 AS DOUBLE) AS s19 FROM records""")
def embedding(spark, sf_dir):
    slot = lambda i: F.round(F.element_at("e", i).cast("double"), 5).alias(f"s{i}")
    return records(spark, sf_dir).withColumn("e", R.embedding()).select("candidate_id", F.size("e").alias("width"), *[slot(i) for i in (1, 5, 12, 16, 17, 18, 19)])


@query("d32_score_report", f"""WITH {SCORED}, r AS (SELECT *, {RATED} AS rating FROM scored) SELECT rating, count(*) AS n, round(median(total), 6) AS middle, round(quantile_cont(total, 0.75) - quantile_cont(total, 0.25), 6) AS spread,
  round(avg(round(statistical, 4)), 6) AS mean_statistical, round(stddev_pop(round(statistical, 4)), 6) AS std_statistical, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM r GROUP BY rating""")
def report(spark, sf_dir):
    s = R.score(records(spark, sf_dir)).groupBy("rating").agg(
        F.count(F.lit(1)).alias("n"), F.percentile("total", F.lit(0.5)).alias("middle"), (F.percentile("total", F.lit(0.75)) - F.percentile("total", F.lit(0.25))).alias("spread"),
        F.avg("statistical").alias("mean_statistical"), F.stddev_pop("statistical").alias("std_statistical"),
    )
    return rounded(s.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())))


@query("d33_ladder_thresholds", f"""WITH {RECORDS} SELECT round(quantile_cont(sample_size, 0.9), 6) AS p90, round(quantile_cont(sample_size, 0.75), 6) AS p75, round(quantile_cont(sample_size, 0.5), 6) AS p50,
  round(quantile_cont(monthly_concentration, 0.1), 6) AS low10, round(quantile_cont(monthly_concentration, 0.25), 6) AS low25 FROM records""")
def thresholds(spark, sf_dir):
    """Ladder steps that a share of candidates passes."""
    p = lambda c, q: F.round(F.percentile(c, F.lit(q)), 6)
    return records(spark, sf_dir).agg(
        p("sample_size", 0.9).alias("p90"), p("sample_size", 0.75).alias("p75"), p("sample_size", 0.5).alias("p50"), p("monthly_concentration", 0.1).alias("low10"), p("monthly_concentration", 0.25).alias("low25")
    )
