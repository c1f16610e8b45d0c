"""Outcomes ahead, snapshots of configurations, and what their matured past says."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.accumulate import Accumulator
from tidemark.operators.growing import growing
from tidemark.operators.past import STRETCH, in_stretches
from tidemark.operators.states import bias
from tidemark.operators.windows import ahead, ordered
from tidemark.tables import written

#: Weights of the research score. Fixed values.
SCORE_WEIGHTS = {"skew": 0.25, "sample": 0.20, "repeat": 0.15, "spread": 0.15, "valid": 0.15, "rare": 0.10}
RARITY = {"rare": 1.0, "uncommon": 0.66, "common": 0.33}


def outcomes(bars: DataFrame, horizon: int, seconds: int) -> DataFrame:
    """What followed each bar over the next ``horizon`` bars: ret, mfe, mae, is_up, range, rv_fwd, range_ratio, valid.

    Null where the horizon does not fit; valid: it fits and the bars have no gap.
    """
    w, full = ahead(horizon), F.count(F.lit(1)).over(ahead(horizon)) == horizon
    b = bars.withColumn("step", F.ln("close") - F.ln(F.lag("close").over(ordered())))
    later = lambda c: F.lead(c, horizon).over(ordered())
    high, low = F.when(full, F.max("high").over(w)), F.when(full, F.min("low").over(w))
    b = b.withColumns({"top": high, "bottom": low, "end": later("close"), "end_t": later("t"), "rv_fwd": F.when(full, F.stddev_samp("step").over(w))})
    ret = (F.col("end") / F.col("close") - 1) * 100
    rng = (F.col("top") - F.col("bottom")) / F.col("close") * 100
    atr = F.nullif(F.col("atr") / F.col("close") * 100 * (horizon**0.5), F.lit(0.0))
    return b.select(
        "symbol",
        "t",
        ret.alias("ret_pct"),
        ((F.col("top") / F.col("close") - 1) * 100).alias("mfe_pct"),
        ((F.col("bottom") / F.col("close") - 1) * 100).alias("mae_pct"),
        (ret > 0).alias("is_up"),
        rng.alias("range_pct"),
        "rv_fwd",
        (rng / atr).alias("range_ratio"),
        (F.col("end").isNotNull() & F.coalesce(F.col("end_t") - F.col("t") == horizon * seconds, F.lit(False))).alias("valid"),
    )


def snapshots(states: DataFrame, offsets: list[int]) -> DataFrame:
    """Rows of the same state ``offset`` rows after each transition: each row looks back, so states are made and read once.

    states: (symbol, t, state_seq, transition_id, prev_group_id, ...) in order; offsets in rows.
    """
    back = lambda c, o: F.lag(c, o).over(ordered()) if o else F.col(c)
    named = states.where("symbol is not null").withColumns({f"__{c}{i}": back(c, o) for i, o in enumerate(offsets) for c in ("transition_id", "state_seq")})
    found = [F.when(F.col(f"__transition_id{i}").isNotNull() & (F.col(f"__state_seq{i}") == F.col("state_seq")), F.struct(F.col(f"__transition_id{i}").alias("transition_id"), F.lit(o).alias("offset"))) for i, o in enumerate(offsets)]
    others = [c for c in states.columns if c not in ("symbol", "transition_id")]
    return named.select("symbol", *others, F.explode(F.array_compact(F.array(*found))).alias("__s")).select("symbol", "__s.*", *others)


#: Rows from which a key is more than one task's work, and rows of whole keys that a task takes at once.
HOT, AT_ONCE = 1_048_576, 65_536


def matured(rows: DataFrame, key: list[str], horizon: int, finer: list[str] | None = None, name: str = "past", hot: int = HOT, stretch: int = STRETCH) -> DataFrame:
    """Adds past (or name): statistics of the rows with the same key whose horizon (in units of t) was over at each row.

    With finer, also narrow: the same of the rows that agree in those columns as well. All these rows lie at or before
    t - horizon, so nothing of the future is seen. Rows: t, ret_pct, mfe_pct, mae_pct, valid, state_seq.
    A key of up to ``hot`` rows is one task's; keys of more are cut into stretches of time (see ``past``). Both give the same.
    """
    rows = written(rows, "matured")
    times = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min(F.col("t").cast("long")).alias("_first"), F.max(F.col("t").cast("long")).alias("_last"))
    large = written(times.where(F.col("_n") > hot), "hot")
    if large.isEmpty():
        return folded(rows, key, horizon, finer, name)
    named = large.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(key)])
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(key)]
    wide = in_stretches(rows, large, key, horizon, name, stretch)
    if finer:
        wide = matured(wide, [*key, *finer], horizon, None, "narrow", hot, stretch)
    return folded(rows.join(named, same, "left_anti"), key, horizon, finer, name).unionByName(wide)


def folded(rows: DataFrame, key: list[str], horizon: int, finer: list[str] | None = None, name: str = "past") -> DataFrame:
    """``matured`` with one task for a key.

    One shuffle brings a key's rows together in order of t; a task takes whole keys, as many as make ``AT_ONCE`` rows, and computes
    the statistics of all their rows as arrays (see ``growing``), in time that grows with the rows and the logarithm of their number.
    """
    names = [name, "narrow"] if finer else [name]
    # Keys as one number each: a task only tells them apart. A hash skips nulls, so it is told where they are.
    hashed = lambda columns: F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])
    keyed = rows.withColumns({"__key": hashed(key), "__fine": hashed([*key, *(finer or [])]), "__t": F.col("t").cast("long")})
    ordered_rows = keyed.repartition(*key).sortWithinPartitions("__key", "__t")
    fields = [T.StructField(n, T.StructType.fromDDL(Accumulator.SCHEMA)) for n in names]
    schema = T.StructType([*keyed.schema.fields, *fields])
    arrow = pa.struct([pa.field(x.name, pa.float64() if x.dataType == T.DoubleType() else pa.int64()) for x in fields[0].dataType.fields])

    def together(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches)
        key_of, fine, t = (whole.column(c).fill_null(0).to_numpy() for c in ("__key", "__fine", "__t"))
        ret, mfe, mae = (whole.column(c).cast(pa.float64()).fill_null(0.0).to_numpy() for c in ("ret_pct", "mfe_pct", "mae_pct"))
        sequence = whole.column("state_seq").combine_chunks().dictionary_encode("encode").indices.to_numpy()
        facts = [t, whole.column("__t").is_valid().to_numpy(), ret, mfe, mae, whole.column("valid").fill_null(False).to_numpy(), sequence]
        found = [growing(key_of, *facts, horizon)]
        if finer:
            by_fine = np.argsort(fine, kind="stable")
            back = np.empty_like(by_fine)
            back[by_fine] = np.arange(len(fine))
            found.append([x[back] for x in growing(fine[by_fine], *[x[by_fine] for x in facts], horizon)])
        structs = [pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], fields=list(arrow)) for columns in found]
        done = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *[s.slice(done, batch.num_rows) for s in structs]], names=[*batch.schema.names, *names])
            done += batch.num_rows

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, current = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("__key").to_numpy()
            others = np.flatnonzero(keys != keys[-1])
            cut = int(others[-1]) + 1 if len(others) else 0
            # The last key of a batch may go on in the next one; what is before it is whole.
            if n + cut >= AT_ONCE and (cut or current != keys[-1]):
                yield from together([*held, batch.slice(0, cut)] if cut else held)
                held, n, batch = [], 0, batch.slice(cut)
            held.append(batch)
            n, current = n + batch.num_rows, keys[-1]
        if held:
            yield from together(held)

    return ordered_rows.mapInArrow(fold, schema).drop("__key", "__fine", "__t")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 1e-9, a / F.when(b > 1e-9, b)).otherwise(a)


def candidates(rows: DataFrame, horizon: int, least: int = 30, least_effective: int = 30, min_skew: float = 0.06, bias_threshold: float = 0.05) -> DataFrame:
    """Point-in-time statistics for each snapshot with enough matured past.

    The past of (symbol, transition_id, event_block_id), else of (symbol, transition_id). rows: snapshots with outcomes,
    transition_rarity and event_rarity.
    """
    both = matured(rows, ["symbol", "transition_id"], horizon, ["event_block_id"]).withColumnRenamed("past", "wide")
    enough = lambda p: (F.col(f"{p}.sample_size") >= least) & (F.col(f"{p}.effective_sample_size") >= least_effective)
    chosen = both.withColumn("scope", F.when(enough("narrow"), "transition+event_block").when(enough("wide"), "transition")).where("scope is not null")
    p = chosen.withColumn("p", F.when(F.col("scope") == "transition", F.col("wide")).otherwise(F.col("narrow"))).where("p.valid_label_count > 0")
    share = F.col("p.long_outcome_count") / F.col("p.valid_label_count")
    skew = 2 * share - 1
    rarity = F.create_map(*[F.lit(x) for kv in RARITY.items() for x in kv])
    valid = F.col("p.valid_label_count") / F.col("p.sample_size")
    concentration = F.col("p.top_month") / F.col("p.sample_size")
    event = F.when(F.col("scope") == "transition", "common").otherwise(F.col("event_rarity"))
    parts = {
        "skew": F.least(F.lit(1.0), F.abs(skew) / 0.5),
        "sample": F.least(F.lit(1.0), F.log10(F.col("p.effective_sample_size") + 1) / 3),
        "repeat": F.least(F.lit(1.0), F.col("p.repeatability_months") / 18),
        "spread": 1 - F.least(F.lit(1.0), concentration / 0.5),
        "valid": valid,
        "rare": (F.coalesce(rarity[F.col("transition_rarity")], F.lit(0.33)) + F.coalesce(rarity[event], F.lit(0.33))) / 2,
    }
    score = sum((parts[k] * w for k, w in SCORE_WEIGHTS.items()), F.lit(0.0))
    return p.where(F.abs(skew) >= min_skew).select(
        "symbol",
        "t",
        "offset",
        "transition_id",
        "event_block_id",
        "scope",
        F.substring(F.sha1(F.concat_ws("|", "symbol", "t", "transition_id", "event_block_id", "offset")), 1, 20).alias("candidate_id"),
        F.col("p.sample_size").alias("sample_size"),
        F.col("p.effective_sample_size").alias("effective_sample_size"),
        F.col("p.valid_label_count").alias("valid_label_count"),
        valid.alias("valid_label_pct"),
        F.col("p.repeatability_days").alias("repeatability_days"),
        F.col("p.repeatability_months").alias("repeatability_months"),
        concentration.alias("monthly_concentration"),
        share.alias("long_outcome_share"),
        skew.alias("historical_outcome_skew"),
        F.when(skew > 0, "long").otherwise("short").alias("research_side"),
        bias(share, bias_threshold).alias("historical_bias_context"),
        F.col("p.favorable").alias("p70_long_favorable_pct"),
        F.col("p.adverse").alias("p80_long_adverse_pct"),
        _ratio(F.col("p.favorable"), F.col("p.adverse")).alias("long_favorable_adverse_ratio_p70_p80"),
        F.when(F.col("p.falls") > 0, _ratio(F.col("p.favorable_short"), F.col("p.adverse_short"))).alias("short_favorable_adverse_ratio_p70_p80"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("research_score"),
    )
