"""Composite score: gates, components, bonus, penalty, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FROZEN, Params, digest
from ..functions import metrics as M
from ..functions.core import clamp, sha256
from ..functions.text import cohort_id
from ..session import cut_lineage
from . import momentum as MOM
from .fundamentals import fundamentals_at
from .ranking import blended_percentiles, competition_rank, midrank, weighted_component

# Component weights and gates.
COMPONENT_WEIGHT = 0.30
VALUE_WEIGHTS = {"pe": 0.25, "pb": 0.25, "ev_ebitda": 0.25, "fcf_yield": 0.25}
QUALITY_WEIGHTS = {"roic": 0.20, "interest_coverage": 0.15, "debt_ebitda": 0.15, "current_ratio": 0.10}
PIOTROSKI_WEIGHT = 0.40
MIN_VALID = 3


def score_date(bars: DataFrame, as_of: Column) -> DataFrame:
    """Latest session at or before a date, one row."""
    return bars.where(F.col("date") <= as_of).agg(F.max("date").alias("score_date"))


def universe_decision(securities: DataFrame, applicable: DataFrame) -> DataFrame:
    """Included, or the first reason a security stays out of the ranked population."""
    out = securities.join(applicable.select("security_id", F.col("model_applicable").alias("_a")), "security_id", "left")
    reason = (
        F.when(F.col("security_type") == "unknown", "classification unknown")
        .when(F.col("security_type") != "common_stock", F.concat(F.lit("not common stock: "), F.col("security_type")))
        .when(F.col("_a").isNull(), "no derived fundamentals")
        .when(~F.col("_a"), "model not applicable")
    )
    return out.withColumns(
        {
            "exclusion_reason": reason,
            "status": F.when(reason.isNull(), "included").otherwise("excluded"),
            "cohort_id": cohort_id("sic_code"),
        }
    ).drop("_a")


def snapshot_id(score_date: Column, params: Params = FROZEN, pool: str = "fixture") -> Column:
    """Same date, parameters and population give the same snapshot, so it is reused."""
    return F.concat(
        F.lit("universe-"), score_date.cast("string"), F.lit(f"-{digest(params)[:8]}-"), F.substring(F.sha2(F.lit(pool), 256), 1, 8)
    )


def ensure_snapshot(existing: DataFrame, decided: DataFrame, score_date: Column, params: Params = FROZEN, pool: str = "fixture") -> DataFrame:
    """Snapshot rows to append: none when this snapshot id is already stored."""
    rows = decided.select(
        snapshot_id(score_date, params, pool).alias("snapshot_id"), "security_id", score_date.alias("snapshot_date"),
        "status", "exclusion_reason",
    )
    return rows.join(existing.select("snapshot_id").distinct(), "snapshot_id", "left_anti")


def _long(df: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    return df.unpivot(keep, [F.col(n).cast("double").alias(n) for n in names], "metric", "value")


def components(members: DataFrame, fundamentals: DataFrame, momentum: DataFrame, params: Params = FROZEN) -> DataFrame:
    """Value, quality and momentum per included security, with submetric detail.

    `members`: security_id, cohort_id. `fundamentals`: flat metric values plus
    prior_period. `momentum`: output of momentum_inputs.
    """
    base = members.select("security_id", "cohort_id")
    f = base.join(fundamentals, "security_id", "left")
    fund_names = [*VALUE_WEIGHTS, *QUALITY_WEIGHTS]
    ranked = blended_percentiles(_long(f, fund_names, ["security_id", "cohort_id"]), params=params)
    value = weighted_component(ranked, ["security_id"], VALUE_WEIGHTS, "value", MIN_VALID)
    quality = weighted_component(ranked, ["security_id"], QUALITY_WEIGHTS, "quality", MIN_VALID, share=1 - PIOTROSKI_WEIGHT)

    m = base.join(momentum, "security_id", "left").withColumn("_open", F.col("gate_reason").isNull() & F.col("bar_count").isNotNull())
    usable = m.where("_open")
    long = midrank(_long(usable, list(MOM.RANKED), ["security_id"]), "value", ["metric"], "market_")
    long = long.select("security_id", "metric", F.col("market_pct").alias("percentile"))
    direct = _long(usable, ["range52", "trend"], ["security_id"]).withColumnRenamed("value", "percentile")
    mom = weighted_component(
        long.unionByName(direct), ["security_id"], MOM.WEIGHTS, "momentum", len(MOM.WEIGHTS), renormalise=False
    )
    f_points = M.f_score(lambda n: F.col(n), F.col("prior_period").isNotNull())
    out = f.select("security_id", "cohort_id", f_points.alias("f_score"))
    out = out.join(value, "security_id", "left").join(quality, "security_id", "left").join(mom, "security_id", "left")
    out = out.join(m.select("security_id", F.coalesce("gate_reason", F.when(~F.col("_open"), F.lit("no bars"))).alias("momentum_gate")), "security_id", "left")
    fixed = F.col("f_score") / F.lit(9.0) * 100.0 * PIOTROSKI_WEIGHT
    return out.withColumn("quality_score", F.col("quality_score") + fixed)


def composite(parts: DataFrame, bonus: DataFrame, coverage: DataFrame, dilution: DataFrame, params: Params = FROZEN) -> DataFrame:
    """0.3 V + 0.3 Q + 0.3 M + bonus - dilution in [0, 100], or why it is withheld.

    No weight moves between components: a missing one withholds the security.
    """
    out = parts.join(bonus.select("security_id", "b1_cluster", "b2_executive", "b3_size", "b4_conviction", "bonus"), "security_id", "left")
    out = out.join(coverage.select("security_id", "coverage_complete", "coverage_reason"), "security_id", "left")
    out = out.join(dilution.select("security_id", F.col("dilution_score").alias("_d")), "security_id", "left")
    proven = F.coalesce(F.col("coverage_complete"), F.lit(False))
    reasons = [
        F.when(F.col("value_score").isNull(), F.concat(F.lit("value gate: "), F.coalesce(F.col("value_valid"), F.lit(0)).cast("string"), F.lit(" of 4 valid"))),
        F.when(F.col("f_score").isNull(), F.lit("quality gate: F-score incomplete")).when(F.col("quality_score").isNull(), F.lit("quality gate: too few metrics")),
        F.when(F.col("momentum_score").isNull(), F.concat(F.lit("momentum gate: "), F.coalesce("momentum_gate", F.lit("unranked input")))),
        F.when(~proven, F.concat(F.lit("insider coverage: "), F.coalesce("coverage_reason", F.lit("unknown")))),
    ]
    withheld = F.nullif(F.concat_ws("; ", *reasons), F.lit(""))
    out = out.withColumns(
        {
            "insider_bonus": F.when(proven, F.coalesce(F.col("bonus"), F.lit(0.0))),
            "dilution_penalty": F.coalesce(F.col("_d"), F.lit(0.0)),
            "withhold_reason": withheld,
        }
    )
    total = (
        COMPONENT_WEIGHT * F.col("value_score") + COMPONENT_WEIGHT * F.col("quality_score")
        + COMPONENT_WEIGHT * F.col("momentum_score") + F.col("insider_bonus") - F.col("dilution_penalty")
    )
    out = out.withColumn("rankable", F.col("withhold_reason").isNull())
    return out.withColumn("composite_score", F.when(F.col("rankable"), clamp(total, 0.0, 100.0))).drop("bonus", "_d")


def score_universe(
    securities: DataFrame, fundamentals: DataFrame, momentum: DataFrame, bonus: DataFrame, coverage: DataFrame,
    dilution: DataFrame, on: Column, cutoff: Column, params: Params = FROZEN,
) -> DataFrame:
    """Scores of a date: ranked, withheld and excluded securities, each with a reason."""
    known = cut_lineage(fundamentals_at(fundamentals, cutoff))
    decided = universe_decision(securities, known)
    members = decided.where(F.col("status") == "included")
    # the rank reads its input more than once, so components and scores are stored first
    parts = cut_lineage(components(members, known, momentum, params))
    scored = composite(parts, bonus, coverage, dilution, params)
    # a stored score is rounded where only float summation order could differ
    scored = cut_lineage(scored.withColumn("composite_score", F.round("composite_score", 9)))
    ranked = competition_rank(scored, "composite_score")
    out_of_scope = decided.where(F.col("status") == "excluded").select(
        "security_id", "cohort_id", F.lit(False).alias("rankable"), F.col("exclusion_reason").alias("withhold_reason"),
        F.lit(0.0).alias("dilution_penalty"),
    )
    out = ranked.unionByName(out_of_scope, allowMissingColumns=True)
    return out.withColumns(
        {
            "score_date": on, "strategy_version": F.lit(params.strategy_version),
            "config_hash": F.lit(digest(params)), "snapshot_id": snapshot_id(on, params),
        }
    )


def price_snapshot_hash(momentum: DataFrame) -> DataFrame:
    """One hash over (security, last bar, bar count) of everything scored.

    Rows are hashed in parallel and summed exactly, so no task holds all of them.
    """
    seen = momentum.where(F.col("as_of_bar_date").isNotNull())
    line = F.concat_ws(":", F.col("security_id").cast("string"), F.col("as_of_bar_date").cast("string"), F.col("bar_count").cast("string"))
    part = F.conv(F.substring(F.sha2(line, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return seen.agg(F.count("*").alias("rows"), F.sum(part).alias("_s")).select(
        sha256("rows", "_s").alias("price_snapshot_hash"), "rows"
    )


def explanation(scores: DataFrame) -> DataFrame:
    """Nested explanation kept as structs; JSON is made only here, at the sink."""
    part = lambda name: F.struct(
        F.lit(COMPONENT_WEIGHT).alias("weight"), F.col(f"{name}_score").alias("score"), F.col(f"{name}_submetrics").alias("submetrics")
    ).alias(name)
    body = F.struct(
        F.struct(part("value"), part("quality"), part("momentum")).alias("components"),
        F.struct("b1_cluster", "b2_executive", "b3_size", "b4_conviction").alias("insider_bonus"),
        "dilution_penalty", "composite_score", "rankable", "withhold_reason", "snapshot_id",
    )
    return scores.withColumn("explanation_json", F.to_json(body, {"ignoreNullFields": "false"}))
