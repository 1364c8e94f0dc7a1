"""Rules-based universe: metrics, entry, retention, snapshots, pool discovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FROZEN, Params
from ..functions.core import first_match
from ..functions.text import classify_listing
from .asof import current_symbol, latest_per_key
from .bars import latest_close
from .calendar import quarter_streak, sessions_missed
from .dilution import latest_signal
from .fundamentals import market_cap_at
from .momentum import dollar_adv
from .ordered import numbered

# Listing venues and directory codes.
ALLOWED_EXCHANGES = ("NYSE", "Nasdaq", "NYSE American")
EXCHANGE_CODES = {"A": "NYSE American", "N": "NYSE", "P": "NYSE Arca", "Z": "Cboe BZX", "V": "IEX"}
CONFIDENT = ("high", "medium")
ADV_DAYS = 60


def included_latest(snapshots: DataFrame) -> DataFrame:
    """Members included in each security's newest snapshot."""
    newest = snapshots.groupBy("security_id").agg(F.max_by("status", F.struct("snapshot_date", "snapshot_id")).alias("_s"))
    return newest.where(F.col("_s") == "included").select("security_id")


def held_securities(positions: DataFrame, candidates: DataFrame) -> DataFrame:
    held = positions.where(F.col("status").isin("open", "pending_resolution")).select("candidate_id")
    return candidates.join(held, "candidate_id", "left_semi").select("security_id")


def securities_to_evaluate(
    pool: DataFrame, manifest: DataFrame, snapshots: DataFrame, positions: DataFrame, candidates: DataFrame,
    extra: DataFrame | None = None, pool_versions: list[str] | None = None,
) -> DataFrame:
    """Pool, manifest, current members, held securities and explicit ids, once each."""
    named = pool.where(F.col("pool_version").isin(*pool_versions)) if pool_versions else pool
    parts = [
        named.select("security_id"), manifest.select("security_id"), included_latest(snapshots),
        held_securities(positions, candidates),
    ]
    if extra is not None:
        parts.append(extra.select("security_id"))
    return reduce(DataFrame.union, parts).distinct()


def members_present(population: DataFrame, snapshot: DataFrame) -> DataFrame:
    """How many of a population a snapshot holds: (total, present), one row."""
    held = snapshot.select("security_id").distinct().withColumn("_held", F.lit(1))
    return population.join(held, "security_id", "left").agg(F.count("*").alias("total"), F.count("_held").alias("present"))


def securities_to_monitor(snapshots: DataFrame, positions: DataFrame, candidates: DataFrame) -> DataFrame:
    return included_latest(snapshots).union(held_securities(positions, candidates)).distinct()


def gather_metrics(
    securities: DataFrame, listings: DataFrame, bars: DataFrame, fundamentals: DataFrame, facts: DataFrame,
    filings: DataFrame, signals: DataFrame, as_of: Column,
) -> DataFrame:
    """Everything the rules look at, one row per security."""
    upto = bars.where(F.col("date") <= as_of)
    adv = latest_per_key(dollar_adv(upto, ADV_DAYS).select("security_id", "date", "adv"), ["security_id"], [F.col("date")])
    reports = filings.where(F.col("form_type").isin("10-K", "10-Q")).select("cik").distinct().withColumn("files_10k_10q", F.lit(True))
    out = securities.join(current_symbol(listings), "security_id", "left")
    out = out.join(latest_close(bars, as_of), "security_id", "left")
    out = out.join(adv.select("security_id", F.col("adv").alias("adv_dollar")), "security_id", "left")
    out = out.join(market_cap_at(fundamentals, as_of), "security_id", "left")
    gap = sessions_missed(bars, securities.select("security_id"), as_of).select("security_id", F.col("missed").alias("price_data_gap_days"))
    out = out.join(gap, "security_id", "left")
    out = out.join(quarter_streak(facts, as_of), "cik", "left").join(reports, "cik", "left")
    dq = latest_signal(signals, as_of).select("security_id", F.col("is_disqualified").alias("dilution_severe"))
    out = out.join(dq, "security_id", "left")
    return out.withColumnRenamed("streak", "xbrl_consecutive_quarters").na.fill(
        {"xbrl_consecutive_quarters": 0, "files_10k_10q": False, "dilution_severe": False}
    )


def entry_exclusion(params: Params = FROZEN) -> Column:
    """First of eleven entry checks a security fails; NULL when it may enter."""
    c = F.col
    low = lambda name, floor: c(name).isNull() | (c(name) < floor)
    return first_match(
        (~F.coalesce(c("exchange").isin(*ALLOWED_EXCHANGES), F.lit(False)), "exchange"),
        (c("security_type") != "common_stock", "security_type"),
        (~c("classification_confidence").isin(*CONFIDENT), "confidence"),
        (c("cik").isNull(), "no_cik"),
        (~c("files_10k_10q"), "no_periodic_report"),
        (c("price_data_gap_days").isNull(), "no_price_data"),
        (c("price_data_gap_days") >= params.universe_price_data_max_gap_days, "price_gap"),
        (low("price", params.universe_entry_price_min), "price"),
        (low("market_cap", params.universe_entry_market_cap_min), "market_cap"),
        (low("adv_dollar", params.universe_entry_adv_min), "adv"),
        (c("xbrl_consecutive_quarters") < params.universe_entry_xbrl_quarters_min, "xbrl_quarters"),
    )


def below_retention(params: Params = FROZEN) -> Column:
    low = lambda name, floor: F.col(name).isNull() | (F.col(name) < floor)
    return (
        low("price", params.universe_retention_price_min)
        | low("market_cap", params.universe_retention_market_cap_min)
        | low("adv_dollar", params.universe_retention_adv_min)
    )


def safety_reason(params: Params = FROZEN) -> Column:
    gap = F.col("price_data_gap_days")
    return first_match(
        (gap.isNull() | (gap >= params.universe_price_data_max_gap_days), "stale_price_data"),
        (F.col("dilution_severe"), "severe_dilution"),
    )


def prior_state(snapshots: DataFrame) -> DataFrame:
    """Newest stored status and counter per security."""
    best = F.max_by(F.struct("status", "days_below_retention"), F.struct("snapshot_date", "snapshot_id"))
    return snapshots.groupBy("security_id").agg(best.alias("_p")).select(
        "security_id", F.col("_p.status").alias("prior_status"), F.col("_p.days_below_retention").alias("prior_days")
    )


def evaluate(metrics: DataFrame, prior: DataFrame, run_type: str, params: Params = FROZEN) -> DataFrame:
    """Status, reason and hysteresis counter after a daily or monthly run.

    A member below retention counts one more day per daily run, is dropped by a
    monthly run at the limit, and starts again at zero once it is above.
    """
    daily = run_type == "daily_safety"
    out = metrics.join(prior, "security_id", "left")
    member = F.coalesce(F.col("prior_status") == "included", F.lit(False))
    before = F.coalesce(F.col("prior_days"), F.lit(0))
    entry, weak = entry_exclusion(params), below_retention(params)
    unsafe = safety_reason(params) if daily else F.lit(None).cast("string")
    days = before + (1 if daily else 0)
    limit = params.universe_retention_hysteresis_days
    dropped = weak & (days >= limit) & F.lit(not daily)
    status = (
        F.when(member & unsafe.isNotNull(), "watch").when(member & dropped, "excluded").when(member, "included")
        .when(entry.isNull(), "included").otherwise("excluded")
    )
    reason = (
        F.when(member & unsafe.isNotNull(), unsafe).when(member & dropped, "below_retention_limit")
        .when(member & weak, "below_retention").when(~member, entry)
    )
    counter = F.when(member & unsafe.isNotNull(), before).when(member & weak, days).otherwise(0)
    return out.withColumns({"status": status, "exclusion_reason": reason, "days_below_retention": counter.cast("int")})


def snapshot_rows(evaluated: DataFrame, snapshot_id: str, on: Column) -> DataFrame:
    return evaluated.select(
        F.lit(snapshot_id).alias("snapshot_id"), "security_id", on.alias("snapshot_date"), "status", "exclusion_reason",
        "adv_dollar", "market_cap", "market_cap_confidence", "days_below_retention",
    )


def membership_changes(evaluated: DataFrame, run_type: str) -> DataFrame:
    """Monthly status changes; a security never seen before counts as excluded."""
    moved = F.col("status") != F.coalesce("prior_status", F.lit("excluded"))
    return evaluated.where(moved & F.lit(run_type == "monthly_membership")).select(
        "security_id", F.when(F.col("status") == "included", "entered").otherwise("exited").alias("change_type"),
        F.col("prior_status").alias("previous_status"), F.col("status").alias("new_status"),
        F.coalesce("exclusion_reason", F.lit("cleared all entry thresholds")).alias("reason"),
    )


def hysteresis_history(days: DataFrame, keys: tuple = ("security_id",), order: str = "snapshot_date", below: str = "below") -> DataFrame:
    """Running count of days below since the last day above, over stored history."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)  # one row per security and day
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = days.withColumn("_block", F.sum(F.when(F.col(below), 0).otherwise(1)).over(upto))
    inner = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("days_below", F.sum(F.col(below).cast("int")).over(inner)).drop("_block")


def stride_sample(df: DataFrame, key: Column, target: int) -> DataFrame:
    """Rows floor(i * n / target) of the ordered set; all rows when n <= target."""
    rows = numbered(df, key, name="_no", total="_all")
    stride = F.col("_all") / F.lit(float(target))
    k = F.col("_no") - 1
    near = F.ceil(k / stride)
    hit = F.exists(
        F.array(near - 1, near, near + 1),
        lambda i: (i >= 0) & (i < target) & (F.floor(i * stride) == k),
    )
    return rows.where((F.col("_all") <= target) | hit).drop("_no", "_all")


def discover_pool(directory: DataFrame, tickers: DataFrame, target: int = 200) -> DataFrame:
    """Common stock on the allowed venues with a company number, stride-sampled by symbol."""
    from ..functions.core import sec_symbol

    listed = directory.where(F.col("exchange").isin(*ALLOWED_EXCHANGES)).withColumn(
        "_c", classify_listing("security_name", "is_test_issue", "is_etf")
    )
    listed = listed.where((F.col("_c.security_type") == "common_stock") & F.col("_c.confidence").isin(*CONFIDENT))
    t = tickers.select(F.col("ticker").alias("_t"), "cik")
    by_sec = listed.join(t.withColumnRenamed("cik", "_cik1"), sec_symbol("symbol") == F.col("_t"), "left").drop("_t")
    both = by_sec.join(t.withColumnRenamed("cik", "_cik2"), F.col("symbol") == F.col("_t"), "left").drop("_t")
    kept = both.withColumn("cik", F.coalesce("_cik1", "_cik2")).drop("_cik1", "_cik2").where(F.col("cik").isNotNull())
    return stride_sample(kept, F.col("symbol"), target).select("symbol", "security_name", "exchange", "cik", "_c.*")


def fill_sic(securities: DataFrame, submissions: DataFrame) -> DataFrame:
    """Industry code from the submissions dimension where it is still unknown."""
    known = submissions.groupBy("cik").agg(F.max("sic").alias("_sic"))
    return securities.join(known, "cik", "left").withColumn("sic_code", F.coalesce(F.nullif("sic_code", F.lit("")), "_sic")).drop("_sic")


def assign_ids(entries: DataFrame, existing: DataFrame, natural_key: Column) -> DataFrame:
    """New entities get ids above every id ever used, in natural-key order."""
    top = existing.agg(F.coalesce(F.max("security_id"), F.lit(0)).alias("_top"))
    fresh = numbered(entries, natural_key, name="_no")
    return fresh.join(F.broadcast(top)).withColumn("security_id", F.col("_top") + F.col("_no")).drop("_no", "_top")
