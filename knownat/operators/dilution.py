"""Dilution evidence from classified filings and the D1-D4 score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FROZEN, Params
from ..functions.core import clamp
from ..functions.text import SCORING_OUTCOMES, SHELF_FORMS, TAKEDOWN_FORMS, classify_filing
from .fundamentals import share_growth

# Windows, points and limits of the score.
SHELF_LIFE_DAYS = 3 * 365
TTM_DAYS = 365
MAX_SCORE = 30.0


def shelf_unexpired(filed, as_of: Column) -> Column:
    return F.datediff(as_of, F.col(filed) if isinstance(filed, str) else filed) <= SHELF_LIFE_DAYS


def candidate_filings(filings: DataFrame, as_of: Column, key: str = "cik", limit: int | None = None) -> DataFrame:
    """Shelves of three years and takedowns of one, in the order they are read.

    Shelves first, then 424B5, then other takedowns, each newest first. With a
    `limit` only so many are kept, and the rest are counted on every row of the company.
    """
    form, filed = F.col("form_type"), F.col("filed_date")
    shelf = form.isin(*SHELF_FORMS) & filed.between(F.date_sub(as_of, SHELF_LIFE_DAYS), as_of)
    takedown = form.isin(*TAKEDOWN_FORMS) & filed.between(F.date_sub(as_of, TTM_DAYS), as_of)
    group = F.when(form.isin(*SHELF_FORMS), 0).when(form == "424B5", 1).otherwise(2)
    kept = filings.where(shelf | takedown).withColumn("read_group", group)
    order = [F.col("read_group"), F.desc("filed_date"), F.col("accession_no")]
    w = Window.partitionBy(key).orderBy(*order)
    totals = kept.groupBy(key).agg(F.count("*").alias("candidates"))
    out = kept.withColumn("read_order", F.row_number().over(w)).join(totals, key)
    if limit is None:
        return out.withColumn("skipped_by_cap", F.lit(0).cast("long"))
    skipped = F.greatest(F.lit(0).cast("long"), F.col("candidates") - limit)
    return out.where(F.col("read_order") <= limit).withColumn("skipped_by_cap", skipped)


def evidence(candidates: DataFrame, as_of: Column, text: str = "text") -> DataFrame:
    """Outcome, tier and whether it scores: D1 live shelf, D2 takedown, D3 other."""
    out = candidates.withColumn("_c", classify_filing("form_type", text))
    outcome = F.col("_c.outcome")
    live = shelf_unexpired("filed_date", as_of)
    counts = outcome.isin(*SCORING_OUTCOMES)
    scores = F.when(outcome == "shelf_415", live).otherwise(counts)
    tier = (
        F.when((outcome == "shelf_415") & live, "D1")
        .when(outcome == "shelf_415", F.lit(None))
        .when(counts & F.col("form_type").isin(*TAKEDOWN_FORMS), "D2")
        .when(counts, "D3")
    )
    return out.withColumns(
        {"outcome": outcome, "reason": F.col("_c.reason"), "scores": scores, "tier": tier}
    ).drop("_c")


def d4_points(growth: Column) -> Column:
    return F.coalesce(12.0 * clamp((growth - 0.05) / 0.35, 0.0, 1.0), F.lit(0.0))


def score(evidence_rows: DataFrame, growth: DataFrame, params: Params = FROZEN) -> DataFrame:
    """D1 4, D2 4/7/10, D3 the larger of 4 and 8, D4 up to 12; capped at 30.

    `growth`: security_id, cik, shares_yoy_growth - one row per security scored.
    """
    scoring = F.col("scores")
    per = evidence_rows.groupBy("cik").agg(
        F.bool_or(scoring & (F.col("outcome") == "shelf_415")).alias("_shelf"),
        F.count_if(scoring & (F.col("tier") == "D2")).alias("takedowns"),
        F.bool_or(scoring & (F.col("outcome") == "atm_programme")).alias("_atm"),
        F.bool_or(scoring & (F.col("outcome") == "variable_convertible")).alias("_variable"),
        F.count("*").alias("classified"),
        F.count_if(F.col("outcome") == "unknown").alias("unknown_filings"),
        F.count_if(F.col("outcome") == "debt_or_structured").alias("debt_filings"),
        F.max("skipped_by_cap").alias("skipped_by_cap"),
    )
    out = growth.join(per, "cik", "left")
    n = F.coalesce(F.col("takedowns"), F.lit(0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = out.withColumns(
        {
            "d1_capacity": F.when(yes("_shelf"), 4.0).otherwise(0.0),
            "d2_issuance": F.when(n >= 3, 10.0).when(n == 2, 7.0).when(n == 1, 4.0).otherwise(0.0),
            "d3_structural": F.when(yes("_variable"), 8.0).when(yes("_atm"), 4.0).otherwise(0.0),
            "d4_realised": d4_points(F.col("shares_yoy_growth")),
        }
    )
    total = F.least(
        F.lit(MAX_SCORE), F.col("d1_capacity") + F.col("d2_issuance") + F.col("d3_structural") + F.col("d4_realised")
    )
    out = out.withColumn("dilution_score", total)
    return out.withColumn("is_disqualified", F.col("dilution_score") >= params.dilution_disqualify).drop(
        "_shelf", "_atm", "_variable"
    )


def dilution_signals(
    filings: DataFrame, facts: DataFrame, securities: DataFrame, actions: DataFrame, as_of: Column,
    params: Params = FROZEN,
) -> tuple[DataFrame, DataFrame]:
    """(one signal row per security, the evidence behind it) at a date."""
    rows = evidence(candidate_filings(filings, as_of), as_of)
    growth = share_growth(facts, securities, actions, as_of)
    return score(rows, growth, params).withColumn("as_of_date", as_of), rows


def latest_signal(signals: DataFrame, as_of: Column) -> DataFrame:
    """Newest signal at or before a date, per security."""
    from .asof import latest_per_key

    return latest_per_key(signals.where(F.col("as_of_date") <= as_of), ["security_id"], [F.col("as_of_date")])
