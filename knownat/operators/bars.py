"""Daily bars: adjustment at read time, revisions, versions, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import latest_per_key

PRICE_TOLERANCE = 0.005
PRICES = ("open", "high", "low", "close")


def split_events(actions: DataFrame) -> DataFrame:
    """Usable splits: positive ratio, not held for review."""
    return actions.where(
        (F.col("action_type") == "split") & (F.col("ratio") > 0) & ~F.col("requires_manual_review")
    )


def dividend_events(actions: DataFrame) -> DataFrame:
    return actions.where(
        (F.col("action_type") == "dividend") & F.col("cash_amount").isNotNull() & ~F.col("requires_manual_review")
    )


def _ledger(events: DataFrame, value: str, name: str) -> DataFrame:
    """Sorted event array per security: a company has few splits and dividends."""
    return events.groupBy("security_id").agg(
        F.sort_array(F.collect_set(F.struct("ex_date", F.col(value).cast("double").alias("amount")))).alias(name)
    )


def _later_product(events: Column, day: Column, term) -> Column:
    later = F.filter(events, lambda e: e["ex_date"] > day)
    return F.coalesce(F.aggregate(later, F.lit(1.0), lambda acc, e: acc * term(e["amount"])), F.lit(1.0))


def adjusted_bars(
    bars: DataFrame, actions: DataFrame, include_dividends: bool = False, as_of: Column | None = None
) -> DataFrame:
    """Split-adjusted (optionally dividend-adjusted) OHLCV with the factor used.

    `as_of` keeps later ex-dates out, for levels as they stood on a date.
    """
    usable = actions if as_of is None else actions.where(F.col("ex_date") <= as_of)
    out = bars.join(_ledger(split_events(usable), "ratio", "_splits"), "security_id", "left")
    out = out.withColumn("factor", _later_product(F.col("_splits"), F.col("date"), lambda r: r))
    back = F.lit(1.0)
    if include_dividends:
        out = out.join(_ledger(dividend_events(usable), "cash_amount", "_dividends"), "security_id", "left")
        raw = F.col("close")
        kept = _later_product(
            F.col("_dividends"), F.col("date"),
            lambda cash: F.greatest(F.lit(1e-9), 1.0 - cash / F.nullif(raw, F.lit(0.0))),
        )
        back = F.when(raw > 0, kept).otherwise(1.0)
    prices = {c: F.bround(F.col(c) / F.col("factor") * back, 6) for c in PRICES}
    volume = F.bround(F.col("volume") * F.col("factor"), 0).cast("long")
    return out.withColumns({**prices, "volume": volume}).drop("_splits", "_dividends")


def unadjusted_bars(vendor: DataFrame, splits: DataFrame) -> DataFrame:
    """Traded prices from a vendor series that was already split-adjusted."""
    out = vendor.join(_ledger(splits.where(F.col("ratio") != 0), "ratio", "_splits"), "security_id", "left")
    factor = _later_product(F.col("_splits"), F.col("date"), lambda r: r)
    out = out.withColumn("factor", factor)
    prices = {c: F.bround(F.nanvl(F.col(c), F.lit(None)) * F.col("factor"), 6) for c in PRICES}
    return out.withColumns(
        {**prices, "volume": F.bround(F.col("volume") / F.col("factor"), 0).cast("long")}
    ).drop("_splits")


def typed_actions(vendor: DataFrame) -> DataFrame:
    """Vendor split and dividend columns as ledger rows; odd ratios go to review."""
    from ..functions.core import clean_split_ratio

    ratio = F.col("split_ratio")
    ok = clean_split_ratio(ratio) & ratio.between(0.001, 1000.0)
    splits = vendor.where(ratio.isNotNull() & ~F.isnan(ratio) & (ratio != 0)).select(
        "security_id", F.col("date").alias("ex_date"),
        F.when(ok, "split").otherwise("other").alias("action_type"),
        F.round(ratio, 8).alias("ratio"), F.lit(None).cast("double").alias("cash_amount"),
        (~ok).alias("requires_manual_review"),
    )
    cash = F.col("dividend")
    dividends = vendor.where(cash.isNotNull() & ~F.isnan(cash) & (cash != 0)).select(
        "security_id", F.col("date").alias("ex_date"), F.lit("dividend").alias("action_type"),
        F.lit(None).cast("double").alias("ratio"), F.round(cash, 8).alias("cash_amount"),
        F.lit(False).alias("requires_manual_review"),
    )
    return splits.unionByName(dividends)


def _differs(old: Column, new: Column) -> Column:
    both = old.isNotNull() & new.isNotNull()
    return F.when(both, F.abs(old - new) > PRICE_TOLERANCE).otherwise(old.isNotNull() | new.isNotNull())


def detect_revisions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Each incoming bar as new, revised or unchanged against the stored series."""
    fields = [*PRICES, "volume"]
    old = stored.select(
        "security_id", "date", *[F.col(c).alias(f"old_{c}") for c in fields],
        F.col("revision").alias("_rev"), F.col("price_data_version").alias("price_data_version_before"),
        F.lit(True).alias("_stored"),
    )
    new = incoming.select("security_id", "date", *[F.col(c).alias(f"new_{c}") for c in fields])
    both = new.join(old, ["security_id", "date"], "left")
    moved = F.lit(False)
    for c in PRICES:
        moved = moved | _differs(F.col(f"old_{c}"), F.col(f"new_{c}"))
    moved = moved | ~F.col("old_volume").eqNullSafe(F.col("new_volume"))
    state = F.when(F.col("_stored").isNull(), "new").when(moved, "revised").otherwise("unchanged")
    return both.withColumn("change", state).withColumn(
        "revision", F.when(F.col("change") == "revised", F.col("_rev") + 1).otherwise(F.coalesce(F.col("_rev"), F.lit(0)))
    ).drop("_rev", "_stored")


def apply_revisions(stored: DataFrame, changes: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """(bars after the load, revision log rows) at dataset version `version`."""
    fields = [*PRICES, "volume"]
    touched = changes.where(F.col("change") != "unchanged")
    fresh = touched.select(
        "security_id", "date", *[F.col(f"new_{c}").alias(c) for c in fields],
        F.col("revision"), F.lit(version).alias("price_data_version"),
    )
    kept = stored.select(*fresh.columns).join(touched.select("security_id", "date"), ["security_id", "date"], "left_anti")
    log = changes.where(F.col("change") == "revised").select(
        "security_id", "date", "revision", *[f"old_{c}" for c in fields], *[f"new_{c}" for c in fields],
        "price_data_version_before", F.lit(version).alias("price_data_version_after"),
    )
    return kept.unionByName(fresh), log


def bars_at_version(bars: DataFrame, revisions: DataFrame, version: int) -> DataFrame:
    """Series as it stood at a dataset version: later revisions undone, later rows gone."""
    fields = [*PRICES, "volume"]
    undo = (
        revisions.where(F.col("price_data_version_after") > version)
        .groupBy("security_id", "date")
        .agg(
            F.min_by(
                F.struct(*[f"old_{c}" for c in fields], "revision", "price_data_version_before"), F.col("revision")
            ).alias("_u")
        )
    )
    out = bars.join(undo, ["security_id", "date"], "left")
    back = F.col("_u").isNotNull()
    cols = {c: F.when(back, F.col(f"_u.old_{c}")).otherwise(F.col(c)) for c in fields}
    cols["revision"] = F.when(back, F.col("_u.revision") - 1).otherwise(F.col("revision"))
    cols["price_data_version"] = F.when(back, F.col("_u.price_data_version_before")).otherwise(F.col("price_data_version"))
    return out.withColumns(cols).where(F.col("price_data_version") <= version).drop("_u")


def next_dataset_version(versions: DataFrame, changes: DataFrame, provider: str) -> DataFrame:
    """The version row a load adds: none when it changed nothing."""
    counts = changes.agg(
        F.count_if(F.col("change") == "new").alias("new_rows"),
        F.count_if(F.col("change") == "revised").alias("corrections"),
    )
    newest = versions.agg(F.coalesce(F.max("dataset_version"), F.lit(0)).alias("_v"))
    changed = F.col("new_rows") + F.col("corrections")
    reason = F.concat_ws(
        "; ",
        F.when(F.col("new_rows") > 0, F.concat(F.col("new_rows").cast("string"), F.lit(" new rows"))),
        F.when(F.col("corrections") > 0, F.concat(F.col("corrections").cast("string"), F.lit(" vendor corrections"))),
    )
    return counts.join(newest).where(changed > 0).select(
        (F.col("_v") + 1).alias("dataset_version"), F.lit(provider).alias("provider"),
        reason.alias("reason"), changed.alias("changed_row_count"),
    )


def record_provenance(provenance: DataFrame, securities: DataFrame, provider: str, at: Column) -> DataFrame:
    """Open a window for securities new to `provider`; a switch closes the old one."""
    open_here = provenance.where((F.col("provider") == provider) & F.col("valid_to").isNull()).select("security_id")
    fresh = securities.select("security_id").distinct().join(open_here, "security_id", "left_anti")
    mark = fresh.withColumn("_new", F.lit(True))
    closed = provenance.join(mark, "security_id", "left").withColumn(
        "valid_to", F.when(F.col("valid_to").isNull() & F.col("_new"), F.greatest(at, F.col("valid_from") + F.expr("INTERVAL 1 SECOND"))).otherwise(F.col("valid_to"))
    ).drop("_new")
    added = fresh.select("security_id", F.lit(provider).alias("provider"), at.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    return closed.unionByName(added)


def switch_provider(bars: DataFrame, incoming: DataFrame, provider: str) -> DataFrame:
    """Replace the whole series of every incoming security; never splice."""
    swapped = incoming.select("security_id").distinct()
    kept = bars.where(F.col("provider") == provider).unionByName(
        bars.where(F.col("provider") != provider).join(swapped, "security_id", "left_anti")
    )
    stale = kept.join(incoming.select("security_id", "date"), ["security_id", "date"], "left_anti")
    return stale.unionByName(incoming.select(*bars.columns))


def _by_date() -> Window:
    """A security's bars: at most one row per session, so the partition is bounded."""
    return Window.partitionBy("security_id").orderBy("date")


def daily_returns(bars: DataFrame) -> DataFrame:
    """close / previous close - 1 against the previous bar."""
    prev = F.lag("close").over(_by_date())
    return bars.withColumn("daily_return", F.when((prev != 0) & (F.col("close") != 0), F.col("close") / prev - 1.0))


def largest_move(bars: DataFrame) -> DataFrame:
    """Largest absolute one-day return per security; the first date wins ties."""
    moves = daily_returns(bars).withColumn("_abs", F.abs("daily_return"))
    best = F.max_by(F.struct("_abs", "date"), F.struct("_abs", -F.unix_date("date")))
    out = moves.groupBy("security_id").agg(best.alias("_m"))
    size = F.coalesce(F.col("_m._abs"), F.lit(0.0))
    return out.select("security_id", size.alias("largest_move"), F.when(size > 0, F.col("_m.date")).alias("move_date"))


def latest_close(bars: DataFrame, as_of: Column) -> DataFrame:
    """Last non-null close at or before a date, per security."""
    known = bars.where(F.col("close").isNotNull() & (F.col("date") <= as_of)).select("security_id", "date", "close")
    return latest_per_key(known, ["security_id"], [F.col("date")]).select(
        "security_id", F.col("date").alias("price_date"), F.col("close").alias("price")
    )


def timeframe(bars: DataFrame, days: int) -> DataFrame:
    """Points within `days` of each security's newest bar."""
    newest = bars.groupBy("security_id").agg(F.max("date").alias("_newest"))
    return bars.join(newest, "security_id").where(F.col("date") >= F.date_sub("_newest", days)).drop("_newest")
