"""DuckDB texts of the queries in ``relational``, written apart from them: filters, joins, aggregates, sorts, sets, upserts and measures."""

from __future__ import annotations

from collections.abc import Callable

from tidemark.functions.duck import DuckSql, doubled

ORACLES: dict[str, str] = {}


def q(name: str) -> Callable:
    def add(text: Callable[[DuckSql], str]) -> Callable[[DuckSql], str]:
        ORACLES[name] = doubled(text(DuckSql()))
        return text

    return add


# Projections and predicates


@q("a02_klines_normalised")
def klines(d: DuckSql) -> str:
    """Opening times in milli- or microseconds by size; rows whose numbers don't parse are dropped."""
    return f"""WITH raw AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN {d.micros('ts')} ELSE CAST(floor({d.micros('ts')} / 1000) AS BIGINT) END AS stamp,
      CASE WHEN event_id % 17 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR(20)) END AS price FROM events)
    SELECT event_id, CASE WHEN stamp > 100000000000000 THEN CAST(floor(stamp / 1000000) AS BIGINT) ELSE CAST(floor(stamp / 1000) AS BIGINT) END AS t, {d.try_double('price')} AS price FROM raw WHERE {d.try_double('price')} IS NOT NULL"""


@q("a09_range_scan")
def range_scan(d: DuckSql) -> str:
    return "SELECT event_id, event_type, value FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-12 00:00:00'"


@q("a10_array_columns")
def array_columns(d: DuckSql) -> str:
    e = lambda i: d.item("embedding", i)
    return f"SELECT vec_id, round(CAST({e(1)} AS DOUBLE), 5) AS f1, round(CAST({e(2)} AS DOUBLE), 5) AS f2, round(CAST({e(64)} AS DOUBLE), 5) AS f64 FROM embeddings"


@q("a28_coverage")
def coverage(d: DuckSql) -> str:
    e = d.epoch("ts")
    return f"""WITH r AS (SELECT event_type AS symbol, {e} AS t, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM events)
    SELECT symbol, count(*) AS n, min(t) AS first_t, max(t) AS last_t, max(CASE WHEN place = 1 THEN value END) AS last_value FROM r GROUP BY symbol"""


@q("b01_filtered_page")
def page(d: DuckSql) -> str:
    return "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100"


@q("b02_membership")
def membership(d: DuckSql) -> str:
    return "SELECT o_orderpriority, count(*) AS n FROM orders WHERE list_contains(['1-URGENT', '5-LOW'], o_orderpriority) GROUP BY o_orderpriority"


@q("b03_half_open_range")
def half_open(d: DuckSql) -> str:
    return f"SELECT {d.day('o_orderdate')} AS day, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) BETWEEN 2 AND 4 GROUP BY {d.day('o_orderdate')}"


@q("b04_json_predicate")
def json_predicate(d: DuckSql) -> str:
    return f"SELECT event_id, CAST({d.json('props', 'k')} AS INT) AS k FROM events WHERE coalesce(CAST({d.json('props', 'k')} AS INT), -1) = 7 OR event_id % 500 = 0"


@q("b06_b07_b08_buckets")
def buckets(d: DuckSql) -> str:
    return """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 2 THEN 'sparse' WHEN l_quantity <= 5 THEN 'moderate' ELSE 'dense' END AS intensity,
      CASE WHEN l_discount < 0.002 THEN 'rare' WHEN l_discount < 0.01 THEN 'uncommon' ELSE 'common' END AS rarity,
      CASE WHEN l_quantity < 30 THEN 'age_lt_30' WHEN l_quantity < 60 THEN 'age_30_60' WHEN l_quantity < 120 THEN 'age_60_120' ELSE 'age_gt_120' END AS age,
      CASE WHEN l_tax > 0.5 + 0.05 THEN 'long_skew' WHEN l_tax < 0.5 - 0.05 THEN 'short_skew' ELSE 'neutral' END AS bias FROM lineitem"""


@q("b09_b10_ladder_and_map")
def ladder(d: DuckSql) -> str:
    return """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 1.0 WHEN o_totalprice > 200000 THEN 0.7 WHEN o_totalprice > 100000 THEN 0.4 ELSE 0.1 END AS score,
      CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 ELSE 0.0 END AS mapped FROM orders"""


@q("b14_c13_rule_matches")
def rules(d: DuckSql) -> str:
    """Rules with nullable fields, null meaning any, against every order: a nested-loop join with the small side."""
    text, number = "CAST(NULL AS VARCHAR(20))", "CAST(NULL AS DOUBLE)"
    rows = [(1, "'O'", number, text), (2, text, "250000.0", text), (3, "'F'", "150000.0", "'1-URGENT'"), (4, text, number, "'5-LOW'")]
    values = " UNION ALL ".join(f"SELECT {i} AS rule_id, {s} AS status, {least} AS least, {p} AS priority" for i, s, least, p in rows)
    return f"""WITH rules AS ({values}) SELECT rule_id, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM rules JOIN orders ON (status IS NULL OR status = o_orderstatus) AND (least IS NULL OR o_totalprice >= least) AND (priority IS NULL OR priority = o_orderpriority) GROUP BY rule_id"""


@q("b15_b16_payload")
def payload(d: DuckSql) -> str:
    return """SELECT o_orderkey, concat('{"id":', CAST(o_orderkey AS VARCHAR(20)), ',"segment":"', c_mktsegment, '","status":"', o_orderstatus, '"}') AS payload FROM orders JOIN customer ON o_custkey = c_custkey"""


@q("b17_row_loss_guard")
def guard(d: DuckSql) -> str:
    return f"SELECT count(*) AS n, count(CASE WHEN CAST({d.json('props', 'k')} AS INT) > 1 THEN 1 END) AS kept, round(1 - count(CASE WHEN CAST({d.json('props', 'k')} AS INT) > 1 THEN 1 END) * 1.0 / count(*), 9) AS lost FROM events"


@q("b18_finite_rows")
def finite(d: DuckSql) -> str:
    """Infinite quotients become null and their rows go."""
    return "SELECT count(*) AS n, round(sum(x), 4) AS total FROM (SELECT l_extendedprice / nullif(l_discount, 0) AS x FROM lineitem) AS r WHERE x IS NOT NULL"


@q("b19_robust_scale")
def robust(d: DuckSql) -> str:
    p = lambda v: d.percentile("l_extendedprice", v)
    return f"""WITH s AS (SELECT {p(0.5)} AS mid, {p(0.75)} - {p(0.25)} AS iqr FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(least(5.0, greatest(-5.0, (l_extendedprice - mid) / CASE WHEN iqr = 0 THEN 1.0 ELSE iqr END)), 6) AS x FROM lineitem CROSS JOIN s"""


@q("b20_closed_bars")
def closed(d: DuckSql) -> str:
    return f"SELECT event_id FROM events WHERE {d.epoch('ts')} + 3600 <= (SELECT max({d.epoch('ts')}) FROM events)"


@q("b21_hash_ids")
def hashes(d: DuckSql) -> str:
    return "SELECT c_custkey, substr(sha1(concat_ws('|', c_mktsegment, CAST(c_custkey AS VARCHAR(20)), c_name)), 1, 20) AS id FROM customer"


# Joins


@q("c01_left_join")
def left_join(d: DuckSql) -> str:
    return "SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"


@q("c02_inner_join")
def inner_join(d: DuckSql) -> str:
    return "SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority"


@q("c04_k08_day_lag_join")
def day_lag(d: DuckSql) -> str:
    """A daily series known one day late: the value of day D serves day D + 1; the seven-day change needs the full calendar."""
    day = f"CAST(floor({d.epoch('ts')} / 86400) AS BIGINT)"
    return f"""WITH daily AS (SELECT {day} AS day, avg(value) AS v FROM events GROUP BY {day}),
    known AS (SELECT a.day + 1 AS day, a.v, a.v - b.v AS change FROM daily a LEFT JOIN daily b ON b.day = a.day - 7)
    SELECT e.event_id, round((k.v - 50) / 50, 6) AS level, round(k.change / 50, 6) AS change_7d, coalesce(k.v < 25, false) AS fear, coalesce(k.v > 75, false) AS greed FROM events e LEFT JOIN known k ON k.day = CAST(floor({d.epoch('e.ts')} / 86400) AS BIGINT)"""


@q("c05_last_before")
def last_before(d: DuckSql) -> str:
    return f"SELECT event_type, max_by(value, {d.epoch('ts')} * 100000 + event_id) AS last FROM events WHERE {d.epoch('ts')} < 1705276800 GROUP BY event_type"


@q("c06_latest_per_key")
def latest(d: DuckSql) -> str:
    return """SELECT c.c_custkey, l.o_orderkey, l.o_totalprice FROM customer c LEFT JOIN (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders) l ON l.o_custkey = c.c_custkey AND l.place = 1"""


@q("c07_c08_labelled_set")
def labelled(d: DuckSql) -> str:
    return "SELECT n_name, p_brand, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name, p_brand"


@q("c09_share_of_total")
def share(d: DuckSql) -> str:
    return "SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) * 1.0 / max(total), 9) AS share FROM lineitem CROSS JOIN (SELECT count(*) AS total FROM lineitem) AS t GROUP BY l_returnflag, l_linestatus"


@q("c10_deliveries_and_rules")
def deliveries(d: DuckSql) -> str:
    return "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'"


@q("c11_anti_join")
def anti(d: DuckSql) -> str:
    return "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"


@q("c12_semi_join")
def semi(d: DuckSql) -> str:
    return "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)"


@q("c16_one_hop")
def one_hop(d: DuckSql) -> str:
    """Edges of the transition graph with both nodes' sizes, rare ones only."""
    return f"""WITH s AS (SELECT event_type AS b, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events),
    e AS (SELECT a, b, count(*) AS n FROM s WHERE a <> b GROUP BY a, b), k AS (SELECT {d.percentile('n', 0.33)} AS low FROM e), n AS (SELECT event_type AS g, count(*) AS size FROM events GROUP BY event_type)
    SELECT a, b, e.n, x.size AS size_a, y.size AS size_b FROM e JOIN k ON e.n <= k.low JOIN n x ON x.g = a JOIN n y ON y.g = b"""


@q("c17_neighbourhood")
def neighbours(d: DuckSql) -> str:
    return """WITH s AS (SELECT event_type AS b, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events), e AS (SELECT a, b, count(*) AS n FROM s WHERE a <> b GROUP BY a, b),
    r AS (SELECT 'in' AS way, a AS other, n, row_number() OVER (ORDER BY n DESC, a) AS place FROM e WHERE b = 'click' UNION ALL SELECT 'out', b, n, row_number() OVER (ORDER BY n DESC, b) FROM e WHERE a = 'click')
    SELECT way, other, n, place FROM r WHERE place <= 20"""


@q("c18_dense_panel")
def panel(d: DuckSql) -> str:
    """Every hour of every symbol; hours without events are null."""
    hour = f"CAST(floor({d.epoch('ts')} / 3600) AS BIGINT)"
    return f"""WITH v AS (SELECT {hour} AS h, event_type AS s, avg(value) AS x FROM events GROUP BY {hour}, event_type)
    SELECT a.h, b.s, round(v.x, 6) AS x FROM (SELECT DISTINCT h FROM v) a CROSS JOIN (SELECT DISTINCT s FROM v) b LEFT JOIN v ON v.h = a.h AND v.s = b.s"""


@q("c20_merge_with_suffixes")
def suffixes(d: DuckSql) -> str:
    return "SELECT a.doc_id, a.n_chars AS n_chars_left, b.quality AS quality_right FROM documents a JOIN labels b ON a.doc_id = b.doc_id"


# Upserts and sinks, as the rows they leave


@q("a12_upsert")
def upsert(d: DuckSql) -> str:
    """Newest row of each key after three batches: a union and row_number."""
    return """WITH batches AS (SELECT o_custkey AS k, o_totalprice AS v, 0 AS batch, o_orderkey AS id FROM orders UNION ALL SELECT o_custkey, o_totalprice * 2, 1, o_orderkey FROM orders WHERE o_orderkey % 5 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY batch DESC, id DESC) AS place FROM batches) SELECT k, round(v, 2) AS v, batch FROM r WHERE place = 1"""


@q("a13_subset_upsert")
def subset_upsert(d: DuckSql) -> str:
    """A new payload keeps the evaluation that the old row has."""
    return """WITH old AS (SELECT o_orderkey AS k, o_totalprice AS payload, o_orderpriority AS rating FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey AS k, o_totalprice + 1 AS payload, CAST(NULL AS VARCHAR(20)) AS rating FROM orders WHERE o_orderkey % 2 = 0)
    SELECT coalesce(n.k, o.k) AS k, round(coalesce(n.payload, o.payload), 2) AS payload, coalesce(n.rating, o.rating) AS rating FROM old o FULL OUTER JOIN new n ON o.k = n.k"""


@q("a14_revisions")
def revisions(d: DuckSql) -> str:
    return f"""WITH old AS (SELECT {d.day('o_orderdate')} AS day, max(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY {d.day('o_orderdate')}), new AS (SELECT {d.day('o_orderdate')} AS day, max(o_totalprice) AS v FROM orders GROUP BY {d.day('o_orderdate')})
    SELECT o.day, o.v AS old_v, n.v AS new_v FROM old o JOIN new n ON o.day = n.day WHERE o.v IS DISTINCT FROM n.v"""


@q("a15_bulk_update")
def bulk_update(d: DuckSql) -> str:
    return """WITH given AS (SELECT o_orderkey AS k, 'seen' AS status FROM orders WHERE o_orderkey % 7 = 0) SELECT o_orderkey, coalesce(g.status, o_orderstatus) AS status FROM orders LEFT JOIN given g ON g.k = o_orderkey"""


@q("a16_claim")
def claim(d: DuckSql) -> str:
    """Keys of a batch that nobody claimed before, one row each."""
    return """WITH claimed AS (SELECT DISTINCT user_id FROM events WHERE event_id < 300), batch AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_id >= 300 GROUP BY user_id)
    SELECT b.user_id, b.event_id FROM batch b WHERE NOT EXISTS (SELECT 1 FROM claimed c WHERE c.user_id = b.user_id)"""


@q("a20_d21_d22_graph_merge")
def graph_merge(d: DuckSql) -> str:
    """Edges merged from two batches: counts and sums add up, means follow, the latest label wins."""
    return f"""WITH s AS (SELECT event_id, event_type AS b, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, value FROM events), e AS (SELECT * FROM s WHERE a <> b),
    parts AS (SELECT a, b, event_id % 2 AS batch, count(*) AS n, sum(value) AS total, max_by(CAST(value > 50 AS INT), event_id) AS label, max(event_id) AS at_id FROM e GROUP BY a, b, event_id % 2)
    SELECT a, b, sum(n) AS n, round(sum(total) / sum(n), 6) AS avg_value, max_by(label, at_id) AS label FROM parts GROUP BY a, b""".replace("sum(n) AS n", "CAST(sum(n) AS BIGINT) AS n")


@q("a21_delete_symbol")
def delete_symbol(d: DuckSql) -> str:
    return "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY event_type"


@q("a27_retention")
def retention(d: DuckSql) -> str:
    return f"SELECT event_id FROM events WHERE {d.epoch('ts')} >= (SELECT max({d.epoch('ts')}) FROM events) - 10 * 86400"


# Aggregates


@q("d06_first_of_duplicates")
def firsts(d: DuckSql) -> str:
    return "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS place FROM events) AS r WHERE place = 1"


@q("d13_d14_filtered_counts")
def filtered(d: DuckSql) -> str:
    return "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS large, round(avg(l_tax) FILTER (WHERE l_discount = 0), 6) AS tax, count(DISTINCT l_suppkey) FILTER (WHERE l_quantity > 40) AS suppliers FROM lineitem GROUP BY l_returnflag"


@q("d15_counts_by_two")
def counts(d: DuckSql) -> str:
    return "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_orderstatus, o_orderpriority"


@q("d16_i07_hourly_and_daily")
def continuous(d: DuckSql) -> str:
    e = d.epoch("ts")
    part = lambda s: f"SELECT {s} AS width, CAST(floor({e} / {s}) AS BIGINT) * {s} AS bucket, event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, count(CASE WHEN value > 100 THEN 1 END) AS strong FROM events GROUP BY CAST(floor({e} / {s}) AS BIGINT) * {s}, event_type"
    return f"{part(3600)} UNION ALL {part(86400)}"


@q("d17_percent_of_total")
def percent(d: DuckSql) -> str:
    return "SELECT o_orderpriority, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM orders GROUP BY o_orderpriority"


@q("d19_percentiles")
def percentiles(d: DuckSql) -> str:
    return "SELECT l_returnflag, " + ", ".join(f"round({d.percentile('l_extendedprice', p)}, 6) AS p{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.7, 0.8, 0.9)) + " FROM lineitem GROUP BY l_returnflag"


@q("d20_monthly_concentration")
def concentration(d: DuckSql) -> str:
    return "SELECT o_custkey, sum(n) AS n, round(max(n) * 1.0 / sum(n), 9) AS concentration FROM (SELECT o_custkey, year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY o_custkey, year(o_orderdate), month(o_orderdate)) AS r GROUP BY o_custkey".replace("sum(n) AS n", "CAST(sum(n) AS BIGINT) AS n")


@q("d23_downsample")
def downsample(d: DuckSql) -> str:
    """At most 720 buckets over the series; mean and peak of each."""
    e = d.epoch("ts")
    return f"""WITH s AS (SELECT min({e}) AS a, greatest(60, CAST(ceil((max({e}) - min({e})) / 720.0 / 60) AS BIGINT) * 60) AS width FROM events)
    SELECT CAST(floor({e} / width) AS BIGINT) * width AS bucket, round(avg(value), 6) AS mean, max(value) AS peak FROM events CROSS JOIN s GROUP BY CAST(floor({e} / width) AS BIGINT) * width"""


@q("d24_quantile_bins")
def bins(d: DuckSql) -> str:
    """Right-closed bins at exact quintiles."""
    p = lambda v: d.percentile("l_extendedprice", v)
    return f"""WITH e AS (SELECT {p(0.2)} AS a, {p(0.4)} AS b, {p(0.6)} AS c, {p(0.8)} AS dd FROM lineitem),
    x AS (SELECT CASE WHEN l_extendedprice <= a THEN 0 WHEN l_extendedprice <= b THEN 1 WHEN l_extendedprice <= c THEN 2 WHEN l_extendedprice <= dd THEN 3 ELSE 4 END AS bin, l_quantity FROM lineitem CROSS JOIN e)
    SELECT bin, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM x GROUP BY bin"""


@q("d25_target_encoding")
def target_encoding(d: DuckSql) -> str:
    """Means by part on the training half, drawn to the prior; unknown parts get the prior."""
    return """WITH train AS (SELECT l_partkey, l_quantity FROM lineitem WHERE l_orderkey % 2 = 0), prior AS (SELECT avg(l_quantity) AS p FROM train), code AS (SELECT l_partkey, (sum(l_quantity) + 20 * max(p)) / (count(*) + 20) AS v FROM train CROSS JOIN prior GROUP BY l_partkey)
    SELECT l_orderkey, l_linenumber, round(coalesce(v, p), 6) AS encoded FROM lineitem CROSS JOIN prior LEFT JOIN code USING (l_partkey) WHERE l_orderkey % 2 = 1"""


@q("d26_configuration_percentiles")
def configuration(d: DuckSql) -> str:
    """Percentiles by the fine key where it has enough rows, else by the coarse one."""
    p = lambda v: d.percentile("l_extendedprice", v)
    return f"""WITH fine AS (SELECT l_suppkey, l_returnflag, {p(0.7)} AS v FROM lineitem GROUP BY l_suppkey, l_returnflag HAVING count(*) >= 150), coarse AS (SELECT l_returnflag, {p(0.7)} AS v FROM lineitem GROUP BY l_returnflag)
    SELECT k.l_suppkey, k.l_returnflag, round(coalesce(f.v, c.v), 6) AS v FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem) k LEFT JOIN fine f ON f.l_suppkey = k.l_suppkey AND f.l_returnflag = k.l_returnflag LEFT JOIN coarse c ON c.l_returnflag = k.l_returnflag"""


@q("d27_d28_frequencies")
def frequencies(d: DuckSql) -> str:
    return "SELECT year(o_orderdate) AS y, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS share, round(avg(CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.0 END END), 6) AS given FROM orders GROUP BY year(o_orderdate)"


@q("d29_correlations")
def correlations(d: DuckSql) -> str:
    cols = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(cols) for b in cols[i + 1 :])


@q("d31_run_list")
def runs(d: DuckSql) -> str:
    return "SELECT o_orderpriority, count(DISTINCT o_custkey) AS symbols, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS latest_done FROM orders GROUP BY o_orderpriority"


# Windows


@q("e12_i15_rates")
def rates(d: DuckSql) -> str:
    e = d.epoch("ts")
    return f"SELECT event_id, round(greatest(0, value - lag(value) OVER w) / nullif({e} - lag({e}) OVER w, 0), 6) AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)".replace("greatest(0, value - lag(value) OVER w)", "CASE WHEN value > lag(value) OVER w THEN value - lag(value) OVER w ELSE CASE WHEN lag(value) OVER w IS NOT NULL THEN 0 END END")


@q("e16_e17_e18_islands")
def island(d: DuckSql) -> str:
    return """WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seq FROM m)
    SELECT event_id, CAST(seq AS BIGINT) AS seq, row_number() OVER (PARTITION BY user_id, seq ORDER BY ts, event_id) - 1 AS age FROM s"""


@q("e21_calendar")
def calendar(d: DuckSql) -> str:
    return f"SELECT event_id, hour(ts) AS h, {d.weekday('ts')} AS wd, {d.weekday('ts')} >= 5 AS weekend FROM events"


@q("e23_e24_demeaned")
def demeaned(d: DuckSql) -> str:
    h = f"CAST(floor({d.epoch('ts')} / 86400) AS BIGINT)"
    return f"""WITH v AS (SELECT {h} AS day, event_type AS s, sum(value) AS x FROM events GROUP BY {h}, event_type), p AS (SELECT day, s, x - avg(x) OVER (PARTITION BY day) AS away, x / sum(x) OVER (PARTITION BY day) AS share, stddev_samp(x) OVER (PARTITION BY day) AS spread FROM v)
    SELECT day, s, round(away, 6) AS away, round(share, 9) AS share, round(spread, 6) AS spread, round(share - lag(share) OVER (PARTITION BY s ORDER BY day), 9) AS change FROM p"""


@q("e25_ranked_dedup")
def ranked(d: DuckSql) -> str:
    return "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END DESC, o_orderkey DESC) AS place FROM orders) AS r WHERE place = 1"


@q("e28_autocorrelation")
def autocorrelation(d: DuckSql) -> str:
    lagged = " UNION ALL ".join(f"SELECT {k} AS k, value AS x, lag(value, {k}) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS y FROM events" for k in (1, 2, 3, 5, 8))
    return f"SELECT k, round(corr(x, y), 6) AS r FROM ({lagged}) AS r WHERE y IS NOT NULL GROUP BY k"


@q("e29_block_length")
def block_length(d: DuckSql) -> str:
    """Mean number of rows in a day ahead, over complete windows."""
    e = d.epoch("ts")
    return f"""WITH r AS (SELECT event_type, {e} AS t FROM events), w AS (SELECT event_type, t, count(*) OVER (PARTITION BY event_type ORDER BY t RANGE BETWEEN CURRENT ROW AND 86399 FOLLOWING) AS n, max(t) OVER (PARTITION BY event_type) AS last FROM r)
    SELECT event_type, round(avg(n), 6) AS rows_per_day FROM w WHERE t + 86399 <= last GROUP BY event_type"""


@q("e30_thinned_phases")
def thinned(d: DuckSql) -> str:
    """One row of each day for each of 24 phases: windows that don't overlap."""
    e = d.epoch("ts")
    return f"""WITH p AS (SELECT i, event_id, value, row_number() OVER (PARTITION BY i, CAST(floor(({e} - i * 3600) / 86400) AS BIGINT) ORDER BY ts, event_id) AS place FROM events CROSS JOIN {d.numbers(24)} n)
    SELECT i, count(*) AS n, round(avg(value), 6) AS mean FROM p WHERE place = 1 GROUP BY i"""


# Sorts, sets


@q("f02_f03_window_end")
def window_end(d: DuckSql) -> str:
    return "SELECT event_id, value FROM (SELECT event_id, value, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) AS r"


@q("f05_top_transitions")
def top_transitions(d: DuckSql) -> str:
    return "SELECT a, b, n FROM (SELECT a, b, count(*) AS n FROM (SELECT event_type AS b, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events) AS s WHERE a <> b GROUP BY a, b) AS e ORDER BY n DESC, a, b LIMIT 10"


@q("f07_strong_newest")
def newest(d: DuckSql) -> str:
    return f"SELECT o_orderkey, {d.day('o_orderdate')} AS day FROM orders WHERE o_totalprice > 200000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 20"


@q("f09_lookup")
def lookup(d: DuckSql) -> str:
    return "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 77 ORDER BY o_orderkey LIMIT 1"


@q("g01_g02_g07_unions")
def unions(d: DuckSql) -> str:
    return "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'"


@q("g03_intersection")
def intersection(d: DuckSql) -> str:
    return "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'"


@q("g04_difference")
def difference(d: DuckSql) -> str:
    return "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000"


@q("g05_g06_array_sets")
def array_sets(d: DuckSql) -> str:
    return f"SELECT user_id, {d.list_sorted('event_type')} AS kinds FROM events GROUP BY user_id"


@q("h_naming_phrases")
def naming(d: DuckSql) -> str:
    return """WITH x AS (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) * 8 AS x FROM embeddings),
    best AS (SELECT *, row_number() OVER (PARTITION BY vec_id, i // 4 ORDER BY abs(x) DESC, i) AS r FROM x WHERE abs(x) >= 1.5),
    top AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, i // 4) AS place FROM best WHERE r = 1),
    names AS (SELECT vec_id, string_agg('x' || CAST(i AS VARCHAR) || CASE WHEN x > 0 THEN ' high' ELSE ' low' END, ' · ' ORDER BY i) AS name FROM top WHERE place <= 3 GROUP BY vec_id)
    SELECT vec_id, coalesce(name, 'neutral') AS name FROM embeddings LEFT JOIN names USING (vec_id)"""


TOPS = """x AS (SELECT label, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) * 8 AS x FROM embeddings), means AS (SELECT label, i, avg(x) AS x FROM x GROUP BY label, i),
    tops AS (SELECT label, i, x, row_number() OVER (PARTITION BY label ORDER BY abs(x) DESC, i) AS place FROM means)"""


@q("f10_centroid_features")
def centroid_features(d: DuckSql) -> str:
    return f"WITH {TOPS} SELECT label, CAST(place AS INT) AS place, 'x' || CAST(i AS VARCHAR) AS feature, round(x, 6) AS value FROM tops WHERE place <= 3"


@q("f10_named_share")
def named_share(d: DuckSql) -> str:
    return f"WITH {TOPS}, hits AS (SELECT label, max(CASE WHEN i < 16 THEN 1 ELSE 0 END) AS hit FROM tops WHERE place <= 3 GROUP BY label) SELECT count(*) AS groups, round(avg(hit), 6) AS share FROM hits"


@q("k09_derivative_quadrants")
def quadrants(d: DuckSql) -> str:
    """Signs of the change of an open-interest stand-in and of price, hour on hour; zeros count as missing."""
    h = f"CAST(floor({d.epoch('ts')} / 3600) AS BIGINT)"
    return f"""WITH v AS (SELECT event_type AS s, {h} AS h, sum(CAST({d.json('props', 'k')} AS DOUBLE)) AS oi, avg(value) AS p FROM events GROUP BY event_type, {h}), c AS (SELECT s, h, ln(nullif(oi, 0) / lag(nullif(oi, 0)) OVER w) AS doi, ln(p / lag(p) OVER w) AS dp FROM v WINDOW w AS (PARTITION BY s ORDER BY h))
    SELECT s, h, round(doi, 6) AS oi_change, coalesce(doi > 0 AND dp > 0, false) AS up_up, coalesce(doi > 0 AND dp < 0, false) AS up_down, coalesce(doi < 0 AND dp > 0, false) AS down_up, coalesce(doi < 0 AND dp < 0, false) AS down_down FROM c"""


@q("l18_prefix_rarity")
def prefix_rarity(d: DuckSql) -> str:
    """Rarity of transitions from the first part of history only."""
    e = d.epoch("ts")
    return f"""WITH s AS (SELECT {e} AS t, event_type AS b, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events), e AS (SELECT a, b, count(*) AS n FROM s WHERE a <> b AND t < 1705276800 GROUP BY a, b), k AS (SELECT {d.percentile('n', 0.33)} AS x, {d.percentile('n', 0.66)} AS y FROM e)
    SELECT a, b, n, CASE WHEN n <= x THEN 'rare' WHEN n <= y THEN 'uncommon' ELSE 'common' END AS rarity FROM e CROSS JOIN k"""


# Measures


@q("m01_two_proportions")
def proportions(d: DuckSql) -> str:
    return """WITH g AS (SELECT l_returnflag AS f, count(*) * 1.0 AS n, sum(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) AS k FROM lineitem GROUP BY l_returnflag), t AS (SELECT sum(n) AS n, sum(k) AS k FROM g),
    x AS (SELECT f, g.n AS a, g.k AS ka, t.n - g.n AS b, t.k - g.k AS kb, t.k / t.n AS p FROM g CROSS JOIN t)
    SELECT f, round((ka / a - kb / b) / sqrt(p * (1 - p) * (1 / a + 1 / b)), 5) AS z FROM x"""


@q("m02_benjamini_hochberg")
def hochberg(d: DuckSql) -> str:
    """Stand-in p-values; those at or below the largest that passes its step are kept."""
    return """WITH p AS (SELECT p_partkey AS id, (p_partkey * 37 % 1009) / 1009.0 * ((p_partkey * 13 % 101) / 101.0) AS p FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS m FROM p), c AS (SELECT max(CASE WHEN p <= k * 0.05 / m THEN k END) AS top FROM r)
    SELECT id, k <= coalesce(top, 0) AS kept, p <= 0.05 / m AS bonferroni FROM r CROSS JOIN c"""


@q("m03_m11_splits")
def splits(d: DuckSql) -> str:
    """Five walk-forward folds in time order, each trained on what ends a gap of 50 rows before it."""
    return """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events), f AS (SELECT event_id, i, n, CAST(floor(i * 6.0 / n) AS INT) AS part FROM r)
    SELECT part AS fold, count(*) AS test_rows, min(i) AS first_row, greatest(0, min(i) - 50) AS train_rows FROM f WHERE part > 0 GROUP BY part"""


@q("m07_m08_trend")
def trend(d: DuckSql) -> str:
    """Cochran-Armitage trend of a share over ordered groups, in closed form."""
    return """WITH g AS (SELECT CAST(floor((l_quantity - 1) / 10) AS INT) AS x, count(*) * 1.0 AS n, sum(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) AS k FROM lineitem GROUP BY CAST(floor((l_quantity - 1) / 10) AS INT)),
    t AS (SELECT sum(n) AS n, sum(k) AS k, sum(n * x) AS nx, sum(n * x * x) AS nxx, sum(k * x) AS kx FROM g)
    SELECT round((kx - k / n * nx) / sqrt(k / n * (1 - k / n) * (nxx - nx * nx / n)), 5) AS z FROM t"""


@q("m10_calibration")
def calibration(d: DuckSql) -> str:
    """Brier score, skill over the base rate, and expected calibration error over ten bins of a stand-in forecast."""
    return """WITH f AS (SELECT l_quantity / 51.0 AS p, CASE WHEN l_extendedprice > 30000 THEN 1.0 ELSE 0.0 END AS y FROM lineitem), b AS (SELECT avg(y) AS base FROM f), s AS (SELECT avg((p - y) * (p - y)) AS brier, avg((base - y) * (base - y)) AS naive FROM f CROSS JOIN b),
    c AS (SELECT CAST(floor(p * 10) AS INT) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM f GROUP BY CAST(floor(p * 10) AS INT)), e AS (SELECT sum(n * gap) / sum(n) AS ece FROM c)
    SELECT round(brier, 6) AS brier, round(1 - brier / naive, 6) AS skill, round(ece, 6) AS ece FROM s CROSS JOIN e"""


@q("m13_auc")
def auc(d: DuckSql) -> str:
    """Area under the curve from mean ranks."""
    return """WITH f AS (SELECT l_quantity AS s, CASE WHEN l_extendedprice > 30000 THEN 1 ELSE 0 END AS y FROM lineitem), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM f),
    t AS (SELECT sum(CASE WHEN y = 1 THEN rk ELSE 0 END) AS ranks, sum(y) * 1.0 AS pos, count(*) - sum(y) * 1.0 AS neg FROM r) SELECT round((ranks - pos * (pos + 1) / 2) / (pos * neg), 6) AS auc FROM t"""


@q("m14_m15_least_squares")
def least_squares(d: DuckSql) -> str:
    """A line fitted on the even orders; R2 out of sample against the mean of the training rows."""
    return """WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, avg(l_extendedprice) AS base FROM lineitem WHERE l_orderkey % 2 = 0)
    SELECT round(max(b), 4) AS slope, round(1 - sum((l_extendedprice - a - b * l_quantity) * (l_extendedprice - a - b * l_quantity)) / sum((l_extendedprice - base) * (l_extendedprice - base)), 6) AS r2 FROM lineitem CROSS JOIN m WHERE l_orderkey % 2 = 1"""


@q("m16_spearman")
def spearman(d: DuckSql) -> str:
    rank = lambda x: f"rank() OVER (PARTITION BY l_returnflag ORDER BY {x}) + (count(*) OVER (PARTITION BY l_returnflag, {x}) - 1) / 2.0"
    return f"WITH r AS (SELECT l_returnflag, {rank('l_quantity')} AS x, {rank('l_extendedprice')} AS y FROM lineitem) SELECT l_returnflag, round(corr(x, y), 6) AS rho FROM r GROUP BY l_returnflag"


@q("m18_pinball_and_coverage")
def pinball(d: DuckSql) -> str:
    p = lambda v: d.percentile("l_extendedprice", v)
    loss = lambda c, t: f"round(avg(CASE WHEN l_extendedprice >= {c} THEN {t} * (l_extendedprice - {c}) ELSE (1 - {t}) * ({c} - l_extendedprice) END), 4)"
    return f"WITH h AS (SELECT {p(0.25)} AS a, {p(0.9)} AS b FROM lineitem WHERE l_orderkey % 2 = 0) SELECT {loss('a', 0.25)} AS loss25, {loss('b', 0.9)} AS loss90, round(avg(CASE WHEN l_extendedprice <= b THEN 1.0 ELSE 0.0 END), 6) AS covered90 FROM lineitem CROSS JOIN h WHERE l_orderkey % 2 = 1"


@q("m19_seasonality")
def seasonality(d: DuckSql) -> str:
    a = "(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440.0)"
    return f"SELECT event_id, round(sin({a}), 6) AS s1, round(cos({a}), 6) AS c1, round(sin(2 * {a}), 6) AS s2, round(cos(2 * {a}), 6) AS c2, {d.weekday('ts')} >= 5 AS weekend FROM events"


@q("m20_dispersion")
def dispersion(d: DuckSql) -> str:
    h = f"CAST(floor({d.epoch('ts')} / 86400) AS BIGINT)"
    return f"""WITH v AS (SELECT {h} AS day, event_type AS s, avg(value) AS x FROM events GROUP BY {h}, event_type), r AS (SELECT day, s, ln(x / lag(x) OVER (PARTITION BY s ORDER BY day)) AS ret FROM v), k AS (SELECT * FROM r WHERE ret IS NOT NULL)
    SELECT day, s, round(ret - avg(ret) OVER (PARTITION BY day), 6) AS own, round(stddev_samp(ret) OVER (PARTITION BY day), 6) AS dispersion FROM k"""


@q("m21_information_coefficient")
def information(d: DuckSql) -> str:
    """Rank correlation, day by day across symbols, of a signal and of what follows."""
    h = f"CAST(floor({d.epoch('ts')} / 86400) AS BIGINT)"
    return f"""WITH v AS (SELECT {h} AS day, event_type AS s, avg(value) AS x, count(*) AS n FROM events GROUP BY {h}, event_type), f AS (SELECT day, s, n, lead(x) OVER (PARTITION BY s ORDER BY day) / x - 1 AS y FROM v), k AS (SELECT * FROM f WHERE y IS NOT NULL),
    r AS (SELECT day, rank() OVER (PARTITION BY day ORDER BY n) + (count(*) OVER (PARTITION BY day, n) - 1) / 2.0 AS a, rank() OVER (PARTITION BY day ORDER BY y) + (count(*) OVER (PARTITION BY day, y) - 1) / 2.0 AS b, count(*) OVER (PARTITION BY day) AS k FROM k)
    SELECT day, round(corr(a, b), 6) AS ic FROM r WHERE k >= 4 GROUP BY day HAVING stddev_samp(a) > 0 AND stddev_samp(b) > 0"""


@q("m23_demeaned_correlation")
def demeaned_correlation(d: DuckSql) -> str:
    return "WITH r AS (SELECT value - avg(value) OVER (PARTITION BY event_type) AS x, user_id - avg(user_id) OVER (PARTITION BY event_type) AS y FROM events) SELECT round(corr(x, y), 6) AS r, round(1.96 / sqrt(count(*)), 6) AS detectable FROM r"


@q("m24_adjusted_rand")
def rand(d: DuckSql) -> str:
    return """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) * 1.0 AS n FROM lineitem GROUP BY l_returnflag, l_linestatus), ra AS (SELECT sum(n) AS n FROM c GROUP BY a), rb AS (SELECT sum(n) AS n FROM c GROUP BY b), t AS (SELECT sum(n) AS n FROM c),
    x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS i, (SELECT sum(n * (n - 1) / 2) FROM ra) AS p, (SELECT sum(n * (n - 1) / 2) FROM rb) AS q, n * (n - 1) / 2 AS m FROM t)
    SELECT round((i - p * q / m) / ((p + q) / 2 - p * q / m), 6) AS ari FROM x"""


@q("m25_lag_convention")
def lag_convention(d: DuckSql) -> str:
    h = f"CAST(floor({d.epoch('ts')} / 3600) AS BIGINT)"
    return f"""WITH v AS (SELECT {h} AS h, avg(value) AS x, count(*) AS y FROM events GROUP BY {h}), l AS (SELECT x, y, lag(y) OVER (ORDER BY h) AS before FROM v) SELECT round(corr(x, y), 6) AS same, round(corr(x, before), 6) AS lagged FROM l WHERE before IS NOT NULL"""


@q("l03_group_floor")
def group_floor(d: DuckSql) -> str:
    return "SELECT label, count(*) AS n, count(*) >= greatest(30, 0.0025 * (SELECT count(*) FROM embeddings)) AS large_enough FROM embeddings GROUP BY label"


@q("i11_first_in_ttl")
def ttl(d: DuckSql) -> str:
    """A key is taken again when its last sighting is half an hour old."""
    e = d.epoch("ts")
    return f"SELECT event_id FROM (SELECT event_id, {e} AS t, lag({e}) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) AS r WHERE before IS NULL OR t - before > 1800"


@q("i17_age_cut")
def age_cut(d: DuckSql) -> str:
    return f"SELECT event_id FROM events WHERE {d.epoch('ts')} >= (SELECT max({d.epoch('ts')}) FROM events) - 180 * 60 AND value > 20"
