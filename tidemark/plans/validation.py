"""Queries that test what was found: bootstraps by blocks, graded effects, importances, surrogate panels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators import gradation as G
from tidemark.operators import importance as I
from tidemark.operators import resampling as R
from tidemark.operators import surrogates as S
from tidemark.plans.shared import rounded
from tidemark.registry import Registry
from tidemark.tables import table

REGISTRY = Registry()
query = REGISTRY.query

# -- fragments of the oracles


def _u(part: int, *names: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(names)})), {8 * part + 1}, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _laid(by: str, length: int, unit: int, samples: int) -> str:
    """CTE laid(g, sample, place, source) from series(g, units); by: columns of g, with a comma behind each."""
    return f"""places AS (SELECT {by} units, unnest(range(units)) AS place FROM series),
drawn AS (SELECT {by} units, place, k.range AS sample, place % {R.STRETCH} = 0 OR {_u(0, '0', 'k.range', 'place')} < {min(1.0, unit / length)}::DOUBLE AS begins, CAST(floor({_u(1, '0', 'k.range', 'place')} * units) AS BIGINT) AS first FROM places, range({samples}) k),
laid AS (
  SELECT {by} sample, place, (last_value(CASE WHEN begins THEN first - place END IGNORE NULLS) OVER (PARTITION BY {by} sample, place // {R.STRETCH} ORDER BY place) + place) % units AS source FROM drawn
  UNION ALL SELECT {by} -1, place, place FROM places)"""


def _apart(rows: str, by: list[str], order: str, xs: list[str], ys: list[str], length: int, samples: int) -> str:
    """CTE sums(by, feature, sample, n, sx, sxx, s_y, ss_y, sx_y, ...) from the CTE named rows."""
    unit = R.unit_of(length, None)
    g, on = "".join(f"{c}, " for c in by), lambda a, b: "".join(f" AND {a}.{c} = {b}.{c}" for c in by)
    lists = ", ".join(f"list({c} ORDER BY place) AS {c}" for c in [*xs, *ys])
    each = " UNION ALL ".join(f"SELECT {''.join(f'l.{c}, ' for c in by)} '{x}' AS feature, sample, s.{x}[1:least(len(s.{x}), len(t.{x}))] AS x, {', '.join(f't.{y}[1:least(len(s.{y}), len(t.{y}))] AS {y}' for y in ys)} FROM laid l JOIN held s ON s.unit = l.source{on('s', 'l')} JOIN held t ON t.unit = l.place{on('t', 'l')}" for x in xs)
    sums = ", ".join(f"sum(list_sum({y})) AS s_{y}, sum(list_dot_product({y}, {y})) AS ss_{y}, sum(list_dot_product(x, {y})) AS sx_{y}" for y in ys)
    return f"""numbered AS (SELECT *, row_number() OVER ({f"PARTITION BY {', '.join(by)} " if by else ''}ORDER BY {order}) - 1 AS place FROM {rows}),
held AS (SELECT {g} place // {unit} AS unit, {lists} FROM numbered GROUP BY {g} place // {unit}), series AS (SELECT {g} max(unit) + 1 AS units FROM held {f"GROUP BY {', '.join(by)}" if by else ''}),
{_laid(g, length, unit, samples)},
met AS ({each}),
sums AS (SELECT {g} feature, sample, sum(len(x))::DOUBLE AS n, sum(list_sum(x)) AS sx, sum(list_dot_product(x, x)) AS sxx, {sums} FROM met GROUP BY {g} feature, sample)"""


def _corr(y: str) -> str:
    return f"CASE WHEN sxx - sx * sx / n > 1e-9 * sxx AND ss_{y} - s_{y} * s_{y} / n > 1e-9 * ss_{y} THEN (sx_{y} - sx * s_{y} / n) / sqrt((sxx - sx * sx / n) * (ss_{y} - s_{y} * s_{y} / n)) END"


_TREND = "CASE WHEN sxx - sx * sx / n > 1e-9 * sxx AND ss_y - s_y * s_y / n > 1e-9 * ss_y THEN (sx_y - sx * s_y / n) / sqrt((ss_y / n - s_y * s_y / (n * n)) * (sxx - sx * sx / n)) END"


def _tested(stats: str, by: str, one_sided: bool = False) -> str:
    """CTE tested(by, stat, p, usable) from stats(by, sample, stat)."""
    size = (lambda c: c) if one_sided else (lambda c: f"abs({c})")
    return f"""own AS (SELECT {by}, stat AS own FROM {stats} WHERE sample = -1), k AS (SELECT {by}, first(own) AS stat, count(*) FILTER (WHERE {size('s.stat')} >= {size('own')}) AS k, count(s.stat) AS usable FROM {stats} s JOIN own USING ({by}) WHERE sample >= 0 GROUP BY {by}),
tested AS (SELECT {by}, stat, CASE WHEN stat IS NULL OR usable = 0 THEN 1 ELSE (1.0 + k) / (1 + usable) END AS p, usable FROM k)"""


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
LINES = ", ".join(LINE)
LENGTH, SAMPLES = 512, 99

# -- lift of atoms and intervals


def tagged(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    tags = F.array_compact(F.array(F.col("event_type"), F.when(F.col("user_id") % 3 == 0, F.lit("third")), F.when(F.hour("ts") < 8, F.lit("night"))))
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return e.select("event_id", "value", seconds.alias("t"), tags.alias("atoms"))


_GAP = "sum(value) FILTER (WHERE {0} AND {1}) / count(*) FILTER (WHERE {0} AND {1}) - sum(value) FILTER (WHERE {0} AND NOT {1}) / count(*) FILTER (WHERE {0} AND NOT {1})"


def lift_sql() -> str:
    unit = R.unit_of(96, None)
    return f"""WITH e AS (SELECT event_id, value, [x FOR x IN [event_type, CASE WHEN user_id % 3 = 0 THEN 'third' END, CASE WHEN hour(ts) < 8 THEN 'night' END] IF x IS NOT NULL] AS atoms FROM events),
ranked AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS place, floor((SELECT count(*) FROM e) * 0.7) AS cut FROM e), names AS (SELECT DISTINCT unnest(atoms) AS atom FROM e),
flags AS (SELECT atom, place, place < cut AS train, value, list_contains(atoms, atom) AS f FROM ranked, names),
gaps AS (SELECT atom, count(*) FILTER (WHERE f) AS n, {_GAP.format('train', 'f')} AS train_gap, {_GAP.format('NOT train', 'f')} AS test_gap FROM flags GROUP BY atom),
held AS (SELECT atom, place // {unit} AS unit, list(f::INT::DOUBLE ORDER BY place) AS x, list(value ORDER BY place) AS y FROM flags WHERE train GROUP BY atom, place // {unit}), series AS (SELECT max(unit) + 1 AS units FROM held),
{_laid('', 96, unit, 200)},
met AS (SELECT s.atom, sample, s.x[1:least(len(s.x), len(t.y))] AS x, t.y[1:least(len(s.x), len(t.y))] AS y FROM laid l JOIN held s ON s.unit = l.source JOIN held t ON t.unit = l.place AND t.atom = s.atom),
sums AS (SELECT atom, sample, sum(len(x))::DOUBLE AS n, sum(list_sum(x)) AS sx, sum(list_sum(y)) AS sy, sum(list_dot_product(x, y)) AS sxy FROM met GROUP BY atom, sample),
stats AS (SELECT atom, sample, CASE WHEN sx > 0 AND sx < n THEN sxy / sx - (sy - sxy) / (n - sx) END AS stat FROM sums), {_tested('stats', 'atom')}
SELECT atom, n, round(train_gap, 6) AS train_gap, round(test_gap, 6) AS test_gap, round(coalesce(p, 1), 6) AS p, coalesce(usable, 0) AS usable, coalesce(test_gap / nullif(train_gap, 0) BETWEEN 0.5 AND 2, false) AS confirmed FROM gaps LEFT JOIN tested USING (atom)"""


@query("m04_m05_m06_lift", lift_sql())
def lift(spark, sf_dir):
    """Lift of each atom with a stationary bootstrap's p, and its confirmation on later rows."""
    return rounded(R.lift_by_atom(tagged(spark, sf_dir), "atoms", "value", ["event_id"], 96, samples=200))


@query("m09_bootstrap_interval", f"""WITH numbered AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS place FROM events),
held AS (SELECT event_type, place // 12 AS unit, sum(value) AS s, count(value) AS c FROM numbered GROUP BY event_type, place // 12), series AS (SELECT event_type, max(unit) + 1 AS units FROM held GROUP BY event_type),
{_laid('event_type, ', 96, 12, 300)},
m AS (SELECT l.event_type, sample, sum(s) / sum(c) AS m FROM laid l JOIN held h ON h.event_type = l.event_type AND h.unit = l.source GROUP BY l.event_type, sample)
SELECT event_type, round(max(m) FILTER (WHERE sample < 0), 6) AS mean, round(quantile_cont(m, 0.025) FILTER (WHERE sample >= 0), 6) AS low, round(quantile_cont(m, 0.975) FILTER (WHERE sample >= 0), 6) AS high FROM m GROUP BY event_type""")
def interval(spark, sf_dir):
    """Mean value of each event type and its stationary bootstrap interval."""
    return rounded(R.intervals(table(spark, sf_dir, "events"), ["event_id"], F.col("value"), ["event_type"], 96))


# -- trends and gradations


@query("m07_trend_bootstrap", f"""WITH rows AS (SELECT *, floor((l_quantity - 1) / 10)::DOUBLE AS step, CASE WHEN l_discount > 0.05::DOUBLE THEN 1.0::DOUBLE ELSE 0 END AS y FROM lineitem),
{_apart('rows', ['l_returnflag'], LINES, ['step'], ['y'], LENGTH, SAMPLES)},
stats AS (SELECT l_returnflag, sample, {_TREND} AS stat FROM sums), {_tested('stats', 'l_returnflag')}
SELECT l_returnflag, round(stat, 6) AS z, round(p, 6) AS p, usable FROM tested""")
def trend(spark, sf_dir):
    """Trend of a share over ordered groups for each return flag, with the p of samples in which the groups are moved by blocks."""
    rows = table(spark, sf_dir, "lineitem")
    step, hit = F.floor((F.col("l_quantity") - 1) / 10), F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0)
    sums = R.apart(rows, LINE, {"step": step}, {"y": hit}, LENGTH, SAMPLES, ["l_returnflag"])
    found = R.tested(sums.select("l_returnflag", "sample", R.of_target(R.trend_z, "y").alias("stat")), ["l_returnflag"])
    return rounded(found.withColumnRenamed("stat", "z"))


_GRADED = ["l_quantity", "l_discount", "l_tax", "lateness"]


def gradation_sql() -> str:
    return f"""WITH every AS (SELECT *, ((l_partkey * 31 + l_suppkey * 17) % 997)::DOUBLE AS lateness FROM lineitem),
ranked AS (SELECT *, row_number() OVER (ORDER BY {LINES}) - 1 AS pos, floor((SELECT count(*) FROM lineitem) * 0.7) AS cut FROM every),
long AS ({' UNION ALL '.join(f"SELECT '{f}' AS name, CASE WHEN pos < cut THEN 'train' ELSE 'test' END AS part, pos, {f}::DOUBLE AS x, l_extendedprice / 1000 AS y FROM ranked" for f in _GRADED)}),
cuts AS (SELECT name, part, list_sort(list_distinct(quantile_cont(x, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS edges FROM long GROUP BY name, part),
placed AS (SELECT name, part, pos, y, greatest(len(list_filter(edges, lambda e: e < x)) - 1, 0)::DOUBLE AS bin FROM long JOIN cuts USING (name, part)),
cells AS (SELECT name, part, bin, avg(y) AS share, count(*) AS c FROM placed GROUP BY name, part, bin),
told AS (SELECT name, part, sum(c) AS n, list(share ORDER BY bin) AS shares, count(*) AS bins FROM cells GROUP BY name, part),
spreads AS (SELECT *, shares[-1] - shares[1] AS spread, list_transform(range(1, len(shares)), lambda i: shares[i + 1] - shares[i]) AS steps FROM told),
turned AS (SELECT *, len(list_filter(steps, lambda d: d * CASE WHEN spread >= 0 THEN 1 ELSE -1 END < 0)) AS inversions FROM spreads),
trained AS (SELECT * FROM placed WHERE part = 'train'), {_apart('trained', ['name'], 'pos', ['bin'], ['y'], LENGTH, SAMPLES)},
stats AS (SELECT name, sample, {_TREND} AS stat FROM sums), {_tested('stats', 'name')},
later AS (SELECT name, spread AS test_spread FROM turned WHERE part = 'test' AND bins >= 3),
zs AS (SELECT name, corr(bin, y) * sqrt(count(*)) AS test_z FROM placed WHERE part = 'test' GROUP BY name)
SELECT name AS feature, n, bins, list_transform(shares, lambda s: round(s, 6)) AS shares, round(spread, 6) AS spread, inversions, inversions = 0 AND bins >= 3 AS monotone, round(stat, 6) AS z, round(p, 6) AS p,
  p <= 0.05 / (SELECT count(*) FROM tested) AS significant, round(test_spread, 6) AS test_spread, round(test_z, 6) AS test_z,
  coalesce(p <= 0.05 / (SELECT count(*) FROM tested) AND inversions = 0 AND bins >= 3 AND test_spread / nullif(spread, 0) BETWEEN 0.5 AND 2, false) AS confirmed
FROM turned JOIN tested USING (name) LEFT JOIN later USING (name) LEFT JOIN zs USING (name) WHERE part = 'train'"""


@query("m08_gradation", gradation_sql())
def gradation(spark, sf_dir):
    """Price over quantile bins of four features: profile, trend, its p, and whether later rows confirm it."""
    lateness = ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 17) % 997).cast("double")
    features = {f: lateness if f == "lateness" else F.col(f) for f in _GRADED}
    found = G.gradation(table(spark, sf_dir, "lineitem"), features, F.col("l_extendedprice") / 1000, LINE, LENGTH, samples=SAMPLES)
    return rounded(found).withColumn("shares", F.transform("shares", lambda s: F.round(s, 6)))


# -- links of ranks

_RANKS = "(rank() OVER (PARTITION BY l_returnflag ORDER BY {0}) + (count(*) OVER (PARTITION BY l_returnflag, {0}) - 1) / 2.0)::DOUBLE AS {1}"
_RANKED = f"rows AS (SELECT {LINES}, l_returnflag, {_RANKS.format('l_quantity', 'a')}, {_RANKS.format('l_tax', 'b')}, {_RANKS.format('l_extendedprice', 'y')} FROM lineitem)"


@query("m16_rank_links", f"""WITH {_RANKED}, {_apart('rows', ['l_returnflag'], LINES, ['a', 'b'], ['y'], LENGTH, SAMPLES)},
stats AS (SELECT l_returnflag, feature, sample, {_corr('y')} AS stat FROM sums), {_tested('stats', 'l_returnflag, feature')}
SELECT l_returnflag, CASE feature WHEN 'a' THEN 'l_quantity' ELSE 'l_tax' END AS feature, round(stat, 6) AS rho, round(p, 6) AS p, usable FROM tested""")
def links(spark, sf_dir):
    """Spearman's rho of quantity and of tax with price for each return flag, with its bootstrap p."""
    rows = table(spark, sf_dir, "lineitem").select(*LINE, "l_returnflag", "l_quantity", "l_tax", F.col("l_extendedprice").alias("price"))
    return rounded(R.rank_links(rows, LINE, ["l_quantity", "l_tax"], "price", LENGTH, SAMPLES, ["l_returnflag"]))


def stronger_sql() -> str:
    moments = {"n": "1.0::DOUBLE", "sa": "a", "saa": "a * a", "sb": "b", "sbb": "b * b", "sy": "y", "syy": "y * y", "say": "a * y", "sby": "b * y"}
    unit = R.unit_of(LENGTH, None)
    rho = lambda s: f"(s{s}y - s{s} * sy / n) / sqrt((s{s}{s} - s{s} * s{s} / n) * (syy - sy * sy / n))"
    return f"""WITH {_RANKED}, numbered AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {LINES}) - 1 AS place FROM rows),
held AS (SELECT l_returnflag, place // {unit} AS unit, {', '.join(f'sum({v}) AS {k}' for k, v in moments.items())} FROM numbered GROUP BY l_returnflag, place // {unit}), series AS (SELECT l_returnflag, max(unit) + 1 AS units FROM held GROUP BY l_returnflag),
{_laid('l_returnflag, ', LENGTH, unit, SAMPLES)},
sums AS (SELECT l.l_returnflag, sample, {', '.join(f'sum({k}) AS {k}' for k in moments)} FROM laid l JOIN held h ON h.l_returnflag = l.l_returnflag AND h.unit = l.source GROUP BY l.l_returnflag, sample),
r AS (SELECT l_returnflag, sample, {rho('a')} AS ra, {rho('b')} AS rb FROM sums)
SELECT l_returnflag, round(max(ra) FILTER (WHERE sample < 0), 6) AS rho_a, round(max(rb) FILTER (WHERE sample < 0), 6) AS rho_b, round((1.0 + count(*) FILTER (WHERE sample >= 0 AND abs(ra) <= abs(rb))) / (1 + count(*) FILTER (WHERE sample >= 0)), 6) AS p FROM r GROUP BY l_returnflag"""


@query("m16_paired_difference", stronger_sql())
def paired(spark, sf_dir):
    """Whether quantity is linked with price more than tax is, both under the same samples."""
    rows = table(spark, sf_dir, "lineitem").select(*LINE, "l_returnflag", "l_quantity", "l_tax", F.col("l_extendedprice").alias("price"))
    return rounded(R.stronger(rows, LINE, "l_quantity", "l_tax", "price", LENGTH, SAMPLES, ["l_returnflag"]))


_FULL = "(yb * yb + yp * yp - 2 * yb * yp * bp) / nullif(1 - bp * bp, 0)"


@query("m16_added", f"""WITH {_RANKED}, {_apart('rows', ['l_returnflag'], LINES, ['a'], ['y', 'b'], LENGTH, SAMPLES)},
fixed AS (SELECT l_returnflag, corr(b, y) AS yb FROM rows GROUP BY l_returnflag), linked AS (SELECT l_returnflag, sample, yb, {_corr('y')} AS yp, {_corr('b')} AS bp FROM sums JOIN fixed USING (l_returnflag)),
stats AS (SELECT *, {_FULL} - yb * yb AS stat FROM linked), {_tested('stats', 'l_returnflag', one_sided=True)}
SELECT l_returnflag, round(yb * yb, 6) AS r2_base, round({_FULL}, 6) AS r2_full, round((yp - yb * bp) / sqrt(greatest((1 - yb * yb) * (1 - bp * bp), 1e-12)), 6) AS partial, round(p, 6) AS p FROM linked JOIN tested USING (l_returnflag) WHERE sample = -1""")
def added(spark, sf_dir):
    """What quantity adds to tax in telling the price, on ranks."""
    rows = table(spark, sf_dir, "lineitem").select(*LINE, "l_returnflag", "l_quantity", "l_tax", F.col("l_extendedprice").alias("price"))
    return rounded(R.added(rows, LINE, "l_quantity", "l_tax", "price", LENGTH, SAMPLES, ["l_returnflag"]))


# -- importances

_SCORE = "(a0 + b1 * {0} + b2 * {1} > 0.5) = (label > 0.5)"


@query("m13_permutation_importance", f"""WITH rows AS (SELECT *, CASE WHEN l_extendedprice > 30000 THEN 1.0::DOUBLE ELSE 0 END AS label FROM lineitem),
m AS (SELECT var_pop(l_quantity) AS v1, var_pop(l_tax) AS v2, covar_pop(l_quantity, l_tax) AS c, covar_pop(l_quantity, label) AS y1, covar_pop(l_tax, label) AS y2, avg(l_quantity) AS m1, avg(l_tax) AS m2, avg(label) AS my FROM rows WHERE l_orderkey % 10 < 7),
f AS (SELECT (v2 * y1 - c * y2) / (v1 * v2 - c * c) AS b1, (v1 * y2 - c * y1) / (v1 * v2 - c * c) AS b2, m1, m2, my FROM m), fit AS (SELECT b1, b2, my - b1 * m1 - b2 * m2 AS a0 FROM f),
placed AS (SELECT *, row_number() OVER (ORDER BY {LINES}) - 1 AS place FROM rows WHERE l_orderkey % 10 >= 7), dealt AS (SELECT *, row_number() OVER (ORDER BY {_u(0, '7', 'place')}, place) - 1 AS spot FROM placed),
pairs AS (SELECT d.label, d.l_quantity AS q, d.l_tax AS x, p.l_quantity AS pq, p.l_tax AS px, fit.* FROM dealt d JOIN placed p ON d.spot = p.place, fit),
acc AS (SELECT avg(({_SCORE.format('q', 'x')})::INT) AS base, avg(({_SCORE.format('pq', 'x')})::INT) AS a, avg(({_SCORE.format('q', 'px')})::INT) AS b FROM pairs)
SELECT 'l_quantity' AS feature, round(base - a, 6) AS drop, round(base, 6) AS base FROM acc UNION ALL SELECT 'l_tax', round(base - b, 6), round(base, 6) FROM acc""")
def importances(spark, sf_dir):
    """What a linear model of high prices, fitted on some orders, owes to quantity and to tax on the others."""
    rows = table(spark, sf_dir, "lineitem").withColumn("label", F.when(F.col("l_extendedprice") > 30000, 1.0).otherwise(0.0))
    features = ["l_quantity", "l_tax"]
    fit = I.least_squares(rows.where("l_orderkey % 10 < 7"), features, "label")
    return rounded(I.permutation_importance(rows.where("l_orderkey % 10 >= 7"), features, "label", lambda df: df.withColumn("score", I.linear(fit, features)), LINE, seed=7))


@query("m15_gain_of_columns", """WITH train AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 0), test AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 1), mean AS (SELECT avg(l_extendedprice) AS my FROM train),
m AS (SELECT var_pop(l_quantity) AS v1, var_pop(l_tax) AS v2, covar_pop(l_quantity, l_tax) AS c, covar_pop(l_quantity, l_extendedprice) AS y1, covar_pop(l_tax, l_extendedprice) AS y2, avg(l_quantity) AS m1, avg(l_tax) AS m2 FROM train),
f AS (SELECT (v2 * y1 - c * y2) / (v1 * v2 - c * c) AS b1, (v1 * y2 - c * y1) / (v1 * v2 - c * c) AS b2, y2 / v2 AS b0, * FROM m),
r AS (SELECT 1 - sum((l_extendedprice - my - b0 * (l_tax - m2)) ** 2) / sum((l_extendedprice - my) ** 2) AS r2_base, 1 - sum((l_extendedprice - my - b1 * (l_quantity - m1) - b2 * (l_tax - m2)) ** 2) / sum((l_extendedprice - my) ** 2) AS r2_full FROM test, f, mean)
SELECT round(r2_base, 6) AS r2_base, round(r2_full, 6) AS r2_full, round(r2_full - r2_base, 6) AS gain FROM r""")
def gain_of_columns(spark, sf_dir):
    """R2 out of sample of tax, and what quantity adds, by least squares on several columns."""
    rows = table(spark, sf_dir, "lineitem")
    return rounded(I.r2_gain(rows.where("l_orderkey % 2 = 0"), rows.where("l_orderkey % 2 = 1"), ["l_tax"], ["l_quantity"], "l_extendedprice"))


# -- surrogates


@query("m22_surrogate_null", f"""WITH v AS (SELECT CAST(floor(epoch(ts) / 43200) AS BIGINT) AS h, user_id % 25 AS s, avg(value) AS x, count(*) AS n FROM events GROUP BY ALL),
p AS (SELECT h, s, x, lead(x) OVER (PARTITION BY s ORDER BY h) / x - 1 AS o FROM v), known AS (SELECT * FROM p WHERE o IS NOT NULL),
r AS (SELECT h, CAST(s AS VARCHAR) AS number, (rank() OVER (PARTITION BY h ORDER BY x) + (count(*) OVER (PARTITION BY h, x) - 1) / 2.0)::DOUBLE AS x, (rank() OVER (PARTITION BY h ORDER BY o) + (count(*) OVER (PARTITION BY h, o) - 1) / 2.0)::DOUBLE AS y, count(*) OVER (PARTITION BY h) AS k FROM known),
t AS (SELECT h, (row_number() OVER (ORDER BY h) - 1) // 4 AS stretch FROM (SELECT DISTINCT h FROM r WHERE k >= 4)), e AS (SELECT r.h, stretch, number, x, y, d.range AS sample FROM r JOIN t USING (h), range(-1, 200) d WHERE k >= 4),
a AS (SELECT *, row_number() OVER (PARTITION BY h, sample ORDER BY number) AS i, row_number() OVER (PARTITION BY h, sample ORDER BY CASE WHEN sample >= 0 THEN {_u(0, '3', 'sample', 'stretch', 'number')} END, number) AS j FROM e),
c AS (SELECT a.h, a.sample, corr(b.x, a.y) AS ic FROM a JOIN a b ON a.h = b.h AND a.sample = b.sample AND a.i = b.j GROUP BY a.h, a.sample HAVING stddev_pop(b.x) > 0 AND stddev_pop(a.y) > 0),
stats AS (SELECT 1 AS one, sample, avg(ic) AS stat, count(ic) AS times FROM c GROUP BY sample), {_tested('stats', 'one')},
z AS (SELECT avg(stat) AS null_mean, stddev_samp(stat) AS null_sd FROM stats WHERE sample >= 0)
SELECT (SELECT times FROM stats WHERE sample = -1) AS times, round(stat, 6) AS ic, round(p, 6) AS p, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, usable AS draws FROM tested, z""")
def surrogate(spark, sf_dir):
    """Mean rank correlation, across groups of users, of half a day's mean value and its change, against 200 surrogate panels."""
    at = F.floor(F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 43_200)
    means = table(spark, sf_dir, "events").groupBy(at.alias("at"), (F.col("user_id") % 25).alias("s")).agg(F.avg("value").alias("x"))
    panel = means.withColumn("o", F.lead("x").over(Window.partitionBy("s").orderBy("at")) / F.col("x") - 1)
    return rounded(S.surrogate_null(panel, "at", "s", "x", "o", least=4, draws=200, block=4, seed=3))
