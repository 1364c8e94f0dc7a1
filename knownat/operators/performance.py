"""Ledger statistics, per horizon and never pooled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FROZEN
from ..functions.core import whole_months, wilson
from .ordered import running_peak

_MONEY = "decimal(28,6)"


def win_loss(trades: DataFrame, keys: Sequence[str] = ("horizon_days",)) -> DataFrame:
    """Counts, averages, profit factor and the Wilson interval in one aggregation."""
    pnl = F.col("net_pnl")
    out = trades.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(pnl > 0).alias("wins"), F.count_if(pnl < 0).alias("losses"),
        F.count_if(pnl == 0).alias("scratches"), F.avg(F.when(pnl > 0, pnl)).alias("avg_win"),
        F.avg(F.when(pnl < 0, pnl)).alias("avg_loss"),
        F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0)).alias("gross_win"),
        F.coalesce(F.sum(F.when(pnl < 0, pnl)), F.lit(0.0)).alias("gross_loss"),
    )
    w = wilson("wins", "n")
    reason = F.when((F.col("gross_loss") == 0) & (F.col("gross_win") == 0), "no closed trades").when(
        F.col("gross_loss") == 0, "no losing trades"
    )
    return out.withColumns(
        {
            "profit_factor": F.when(F.col("gross_loss") != 0, F.col("gross_win") / F.abs("gross_loss")),
            "profit_factor_undefined": reason,
            "wilson_lower": w["lower"], "wilson_upper": w["upper"], "wilson_center": w["center"],
        }
    )


def equity_curve(trades: DataFrame, keys: Sequence[str] = ("horizon_days",), start_nav: float = FROZEN.book_starting_nav) -> DataFrame:
    """NAV after each closed trade and the peak so far, in (exit_date, trade_id) order.

    Money is summed as decimals: exact, so any grouping of partial sums agrees.
    """
    money = trades.withColumn("_pnl", F.col("net_pnl").cast(_MONEY))
    out = running_peak(money, F.struct("exit_date", "trade_id"), "_pnl", keys, "_run", "_high")
    return out.withColumns(
        {"nav": (F.col("_run") + F.lit(start_nav).cast(_MONEY)), "peak": (F.col("_high") + F.lit(start_nav).cast(_MONEY))}
    ).drop("_run", "_high", "_pnl")


def max_drawdown(trades: DataFrame, keys: Sequence[str] = ("horizon_days",), start_nav: float = FROZEN.book_starting_nav) -> DataFrame:
    """Deepest fall from a peak over the starting NAV; the first one wins ties."""
    curve = equity_curve(trades, keys, start_nav)
    fall = F.col("peak") - F.col("nav")
    worst = curve.groupBy(*keys).agg(
        F.min_by(F.struct(fall.alias("fall"), "nav", "peak"), F.struct(-fall, F.col("exit_date"), F.col("trade_id"))).alias("_w")
    )
    hit = F.col("_w.fall") > 0
    return worst.select(
        *keys, (F.col("_w.fall").cast("double") / start_nav).alias("drawdown_pct"),
        F.when(hit, F.col("_w.nav").cast("double")).otherwise(start_nav).alias("trough_nav"),
        F.when(hit, F.col("_w.peak").cast("double")).otherwise(start_nav).alias("peak_nav"),
    )


def concentration(trades: DataFrame, keys: Sequence[str] = ("horizon_days",)) -> DataFrame:
    """Share of trades per cohort."""
    per = trades.groupBy(*keys, F.coalesce("cohort_id", F.lit("SIC-UNKNOWN")).alias("cohort_id")).agg(F.count("*").alias("trades"))
    total = per.groupBy(*keys).agg(F.sum("trades").alias("_all"))
    out = per.join(total, list(keys)) if keys else per.join(total)
    return out.withColumn("share", F.col("trades") / F.col("_all")).drop("_all")


def observation_window(trades: DataFrame, keys: Sequence[str] = ("horizon_days",)) -> DataFrame:
    return trades.groupBy(*keys).agg(F.min("exit_date").alias("start"), F.max("exit_date").alias("end"))


def cancellation_rate(attempts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cancelled entries over attempted ones; NULL when none was attempted."""
    tried = attempts.where(F.col("outcome") != "not_yet_due")
    out = tried.groupBy(*keys).agg(F.count("*").alias("attempted"), F.count_if(F.col("outcome") == "cancelled").alias("cancelled"))
    return out.withColumn("cancellation_rate", F.when(F.col("attempted") > 0, F.col("cancelled") / F.col("attempted")))


def with_pending(trades: DataFrame, pending: DataFrame, as_of: Column) -> DataFrame:
    """Two labelled views: closed trades only, and with pending equity at zero."""
    columns = ["trade_id", "exit_date", "net_pnl", "gross_pnl", "pnl_pct", "cohort_id", "horizon_days"]
    provisional = pending.select(
        "trade_id", as_of.alias("exit_date"), (F.col("dividends_received") - F.col("notional")).alias("net_pnl"),
        (-F.col("notional")).alias("gross_pnl"),
        ((F.col("dividends_received") - F.col("notional")) / F.col("notional")).alias("pnl_pct"), "cohort_id", "horizon_days",
    )
    closed = trades.select(*columns)
    return closed.withColumn("view", F.lit("excluding_pending")).unionByName(
        closed.unionByName(provisional).withColumn("view", F.lit("including_pending"))
    )


def evidence_band(closed: Column, started: Column, as_of: Column) -> Column:
    """How much a trade count supports: 30 and 100 trades, then 12 months."""
    months = F.coalesce(whole_months(started, as_of), F.lit(0))
    return F.when(closed < 30, "insufficient").when(closed < 100, "preliminary").when(months >= 12, "evaluation_possible").otherwise("preliminary")
