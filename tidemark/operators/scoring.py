"""Scores, flags, conflicts and selection of candidates under a profile, as generated expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions.profiles import DEFAULT, fingerprint


def ladder(x: Column, spec: dict) -> Column:
    """Score of the first step that x passes strictly; the floor if it passes none or is null."""
    out = None
    for threshold, score in spec["steps"]:
        passed = x > threshold if spec["mode"] == "higher" else x < threshold
        out = F.when(passed, F.lit(float(score))) if out is None else out.when(passed, F.lit(float(score)))
    return out.otherwise(F.lit(float(spec["floor"])))


def mapped(x: Column, scores: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(v) for kv in scores.items() for v in kv])
    return F.coalesce(table[x], F.lit(0.0))


def win_rate() -> Column:
    return F.when(F.col("research_side") == "long", F.col("long_outcome_share")).otherwise(1 - F.col("long_outcome_share"))


def fa_ratio() -> Column:
    return F.when(F.col("research_side") == "long", F.col("long_favorable_adverse_ratio_p70_p80")).otherwise(F.col("short_favorable_adverse_ratio_p70_p80"))


def _mean_known(*scores: tuple[Column, Column]) -> Column:
    """Mean of the scores whose criterion is there: (score, whether)."""
    total = sum((F.when(there, s).otherwise(0.0) for s, there in scores), F.lit(0.0))
    return total / sum((there.cast("int") for _, there in scores), F.lit(0))


def axes(profile: dict) -> dict[str, Column]:
    """The four axes of a candidate row, each a mean of its criteria; a criterion without data drops out."""
    lad, maps, always = profile["ladders"], profile["maps"], F.lit(True)
    size = ladder(F.col("sample_size"), lad["sample_size"])
    if "effective_sample_size" in lad:
        effective = F.col("effective_sample_size")
        size = F.when(effective.isNotNull(), ladder(effective, lad["effective_sample_size"])).otherwise(size)
    ratio = fa_ratio()
    return {
        "statistical": _mean_known(
            (ladder(F.col("valid_label_pct"), lad["valid_label_pct"]), always),
            (size, always),
            (ladder(F.col("monthly_concentration"), lad["monthly_concentration"]), always),
            (ladder(F.col("repeatability_months"), lad["repeatability_months"]), always),
        ),
        "directional": _mean_known(
            (ladder(win_rate(), lad["win_rate"]), always),
            (ladder(F.abs("historical_outcome_skew"), lad["abs_outcome_skew"]), always),
            (ladder(ratio, lad["fa_ratio"]), ratio.isNotNull()),
        ),
        "context": _mean_known(
            (mapped(F.col("context_status"), maps["context_status"]), always),
            (mapped(F.col("age_bucket"), maps["age_bucket"]), always),
            (mapped(F.col("trajectory_entropy"), maps["trajectory_entropy"]), always),
        ),
        "rarity": _mean_known(
            (mapped(F.col("transition_rarity"), maps["rarity"]), always),
            (ladder(F.col("research_score"), lad["research_score"]), always),
            (mapped(F.col("event_rarity_bucket"), maps["rarity"]), F.coalesce(F.col("sample_scope") != "transition", F.lit(True))),
        ),
    }


def rating(total: Column, profile: dict) -> Column:
    bounds = profile["rating"]
    return F.when(total >= bounds["strong_min"], "STRONG").when(total >= bounds["moderate_min"], "MODERATE").otherwise("WEAK")


def _scored(profile: dict) -> dict[str, Column]:
    """Columns that scoring adds under a profile."""
    found, base = axes(profile), axes(DEFAULT)
    weigh = lambda a, p: sum((a[k] * w for k, w in p["weights"].items()), F.lit(0.0))
    total = F.round(weigh(found, profile), 4)
    return {k: F.round(v, 4) for k, v in found.items()} | {
        "total": total, "baseline_total": F.round(weigh(base, DEFAULT), 4), "rating": rating(total, profile), "profile": F.lit(profile["name"]), "fingerprint": F.lit(fingerprint(profile))
    }


def score(rows: DataFrame, profile: dict = DEFAULT) -> DataFrame:
    """Adds the axes, total, baseline_total (under the default profile), rating, profile and fingerprint."""
    return rows.withColumns(_scored(profile))


def score_by_symbol(rows: DataFrame, profiles: dict[str, dict], fallback: dict = DEFAULT) -> DataFrame:
    """Each row under its symbol's profile, in one pass; profiles are few: one case each."""
    out = _scored(fallback)
    for symbol, profile in profiles.items():
        own = _scored(profile)
        out = {k: F.when(F.col("symbol") == symbol, own[k]).otherwise(v) for k, v in out.items()}
    return rows.withColumns(out)


def flags(known_symbols: list[str] | None = None, profile: dict = DEFAULT) -> Column:
    """Warnings about a candidate row, in a fixed order."""
    v, c = profile["validator"], F.col
    stale, old, low = c("context_status") == "stale", c("age_bucket") == "age_gt_120", c("valid_label_pct") < v["valid_label_pct"]
    rules = [
        ("symbol_defaulted", c("symbol").isNull()),
        ("unknown_symbol_profile", ~c("symbol").isin(known_symbols) if known_symbols is not None else F.lit(False)),
        ("context_status_stale", stale),
        ("age_gt_120", old),
        ("stale_and_aged_combined", stale & old),
        ("transition_rarity_common", c("transition_rarity") == "common"),
        ("low_valid_label_pct", low),
        ("false_confidence_high_score_low_validity", (c("research_score") > v["false_confidence"]) & low),
        ("high_monthly_concentration_seasonal_risk", c("monthly_concentration") > v["monthly_concentration"]),
        ("very_small_sample_size", c("sample_size") < v["sample_size"]),
        ("low_repeatability_months", c("repeatability_months") < v["repeatability_months"]),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))


def conflicts(rows: DataFrame, profile: dict = DEFAULT) -> DataFrame:
    """Contradictions among candidates: (conflict_type, symbol, subject, candidates).

    Contradicting sides of one transition count the candidates; the others name one candidate each.
    """
    v, c = profile["validator"], F.col
    sides = (
        rows.groupBy("symbol", "transition_id")
        .agg(F.count_distinct("research_side").alias("sides"), F.count(F.lit(1)).alias("candidates"))
        .where("sides > 1")
        .select(F.lit("contradictory_direction").alias("conflict_type"), "symbol", c("transition_id").alias("subject"), "candidates")
    )
    single = {
        "stale_and_old_context": (c("context_status") == "stale") & (c("age_bucket") == "age_gt_120"),
        "false_confidence": (c("research_score") > v["false_confidence"]) & (c("valid_label_pct") < v["valid_label_pct"]),
        "seasonal_concentration": c("monthly_concentration") > v["monthly_concentration"],
    }
    kinds = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in single.items()]))
    each = rows.select(F.explode(kinds).alias("conflict_type"), "symbol", c("candidate_id").alias("subject"), F.lit(1).cast("long").alias("candidates"))
    return sides.unionByName(each)


def above_minimum(scored: DataFrame, minimum: float | None = None, profile: dict = DEFAULT) -> DataFrame:
    return scored.where(F.col("total") >= (profile["batch"]["min_quality"] if minimum is None else minimum))


def best_per_family(scored: DataFrame, profile: dict = DEFAULT) -> DataFrame:
    """One candidate for each symbol and family (or id, without family): the best score, fresh ones with a bonus.

    Equal ones go by id. An aggregate with map-side combining, not a sort of each family.
    """
    key = F.coalesce("candidate_family_key", "candidate_id")
    rank = F.col("total") + F.when(F.col("context_status") == "fresh", profile["batch"]["fresh_bonus"]).otherwise(0.0)
    row = F.struct(*scored.columns)
    best = scored.groupBy("symbol", key.alias("family")).agg(F.min_by(row, F.struct((-rank).alias("rank"), F.col("candidate_id"))).alias("best"))
    return best.select("best.*")


def texts(scored: DataFrame) -> DataFrame:
    """Adds strengths, risks and a summary line made from the scores, without any model."""
    c = F.col
    strengths = F.array_compact(
        F.array(
            F.when(c("statistical") >= 0.7, F.format_string("sample of %d cases over %d months", c("sample_size").cast("long"), c("repeatability_months").cast("long"))),
            F.when(c("directional") >= 0.7, F.format_string("outcomes lean %s at %.1f%%", c("research_side"), win_rate() * 100)),
            F.when(c("context_status") == "fresh", F.lit("fresh context")),
            F.when(c("transition_rarity") == "rare", F.lit("rare transition")),
        )
    )
    risks = F.array_compact(
        F.array(
            F.when(c("statistical") < 0.4, F.lit("weak sample")),
            F.when(c("directional") < 0.4, F.lit("weak direction")),
            F.when(c("context_status") == "stale", F.lit("stale context")),
            F.when(c("monthly_concentration") > 0.30, F.lit("concentrated in few months")),
        )
    )
    summary = F.format_string("%s %s: %.4f, %d strengths, %d risks", c("rating"), c("research_side"), c("total"), F.size("strengths"), F.size("risks"))
    return scored.withColumns({"strengths": strengths, "risks": risks}).withColumn("summary", summary)


#: Places of enum values in an embedding. Fixed values.
EMBEDDED = {
    "trajectory_entropy": {"low": 0.0, "medium": 0.5, "high": 1.0},
    "transition_rarity": {"rare": 0.0, "uncommon": 0.5, "common": 1.0},
    "event_rarity_bucket": {"rare": 0.0, "uncommon": 0.5, "common": 1.0},
    "event_intensity_bucket": {"sparse": 0.0, "moderate": 0.5, "dense": 1.0},
    "age_bucket": {"age_lt_30": 0.0, "age_30_60": 0.33, "age_60_120": 0.66, "age_gt_120": 1.0},
    "historical_bias_context": {"long_skew": 1.0, "neutral": 0.5, "short_skew": 0.0},
}


def embedding(width: int = 32) -> Column:
    """A candidate row as normalised slots in a fixed order, padded with zeros to ``width`` floats. Unknown enum values lie in the middle."""
    c, capped = F.col, lambda x, top: F.least(c(x) / top, F.lit(1.0))
    place = lambda name: F.coalesce(F.create_map(*[F.lit(v) for kv in EMBEDDED[name].items() for v in kv])[c(name)], F.lit(0.5))
    slots = [
        c("research_score"),
        c("valid_label_pct"),
        c("long_outcome_share"),
        (c("historical_outcome_skew") + 1) / 2,
        capped("long_favorable_adverse_ratio_p70_p80", 10.0),
        c("monthly_concentration"),
        capped("repeatability_months", 24.0),
        c("event_block_row_share"),
        capped("p70_long_favorable_pct", 10.0),
        capped("p80_long_adverse_pct", 10.0),
        (c("context_status") == "fresh").cast("double"),
        place("trajectory_entropy"),
        place("transition_rarity"),
        place("event_rarity_bucket"),
        place("event_intensity_bucket"),
        place("age_bucket"),
        (c("research_side") == "long").cast("double"),
        place("historical_bias_context"),
    ]
    return F.concat(F.array(*[F.coalesce(s.cast("float"), F.lit(0.0).cast("float")) for s in slots]), F.array_repeat(F.lit(0.0).cast("float"), width - len(slots)))
