"""Insider transactions: views, amendments, coverage proof and the four-part bonus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import insider_key, is_ceo_or_cfo
from .asof import asof_join

# Credibility by plan status, windows, caps.
CREDIBILITY = {"discretionary": 1.00, "unknown": 0.75, "confirmed_10b5_1": 0.50}
DECAY_DAYS = 180
CLUSTER_DAYS = 90
SIZE_DAYS = 180
SELLING_DAYS = 90
CONVICTION = 0.25
MAX_BONUS = 10.0
MAX_ORIGINALS = 60
MAX_AMENDMENTS = 10


def effective(transactions: DataFrame) -> DataFrame:
    return transactions.where(F.col("superseded_by_accession").isNull())


def scored_purchases(transactions: DataFrame) -> DataFrame:
    """Open-market purchases: table I, code P, not superseded."""
    return effective(transactions).where((F.col("table_type") == "I") & (F.col("transaction_code") == "P"))


def amendment_links(transactions: DataFrame) -> DataFrame:
    """(amendment, original): the latest original of the same security and insider.

    It was filed no later, and carries the same transaction date or none. Both
    lookups are as-of joins, so no amendment meets all originals of its group.
    """
    key = {
        "_sec": F.coalesce(F.col("security_id").cast("string"), F.lit("")),
        "_who": F.coalesce(F.col("insider_cik").cast("string"), F.lit("")),
        "_day": F.coalesce(F.col("transaction_date").cast("string"), F.lit("")),
    }
    cols = ["_sec", "_who", "_day", "accession_no", "filed_date"]
    keyed = transactions.withColumns(key)
    amendments = keyed.where(F.col("is_amendment")).select(*cols).distinct()
    originals = keyed.where(~F.col("is_amendment")).select(
        *cols[:3], F.col("accession_no").alias("original"), F.col("filed_date").alias("original_filed"), "filed_date"
    ).distinct()
    same = asof_join(
        amendments, originals, ["_sec", "_who", "_day"], "filed_date", "filed_date",
        ["original", "original_filed"], tie_break=[F.col("original")], prefix="a_",
    )
    undated = originals.where(F.col("_day") == "").drop("_day")
    both = asof_join(
        same, undated, ["_sec", "_who"], "filed_date", "filed_date",
        ["original", "original_filed"], tie_break=[F.col("original")], prefix="b_",
    )
    use_b = F.col("b_original").isNotNull() & (
        F.col("a_original").isNull()
        | (F.struct("b_original_filed", "b_original") > F.struct("a_original_filed", "a_original"))
    )
    return both.select(
        F.col("accession_no").alias("amendment"), "filed_date",
        F.when(use_b, F.col("b_original")).otherwise(F.col("a_original")).alias("original"),
        F.when(use_b, F.col("b_original_filed")).otherwise(F.col("a_original_filed")).alias("original_filed"),
    ).where(F.col("original").isNotNull()).distinct()


def link_amendments(transactions: DataFrame) -> DataFrame:
    """Transactions with amends_accession and superseded_by_accession filled in."""
    links = amendment_links(transactions)
    superseded = links.groupBy(F.col("original").alias("accession_no")).agg(
        F.min_by("amendment", F.struct("filed_date", "amendment")).alias("_by")
    )
    amends = links.groupBy(F.col("amendment").alias("accession_no")).agg(
        F.max_by("original", F.struct("original_filed", "original")).alias("_of")
    )
    out = transactions.join(superseded, "accession_no", "left").join(amends, "accession_no", "left")
    return out.withColumns(
        {
            "superseded_by_accession": F.coalesce(F.col("superseded_by_accession"), F.when(~F.col("is_amendment"), F.col("_by"))),
            "amends_accession": F.when(F.col("is_amendment"), F.coalesce(F.col("_of"), F.col("amends_accession"))),
        }
    ).drop("_by", "_of")


def credibility(status) -> Column:
    status = F.col(status) if isinstance(status, str) else status
    known = F.create_map(*[F.lit(x) for kv in CREDIBILITY.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.coalesce(status, F.lit("unknown"))), F.lit(0.75))


def decay(age: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - age / F.lit(float(DECAY_DAYS)))


def bonus_parts(purchases: DataFrame, as_of: Column, market_caps: DataFrame | None = None) -> DataFrame:
    """B1, B2, B4 and the size ratio S per security from purchases up to `as_of`.

    Purchases collapse to one row per (security, insider) first, so one person
    counts once and a security with very many purchases is combined map-side.
    """
    p = purchases.where(F.col("transaction_date").isNotNull() & (F.col("transaction_date") <= as_of))
    age = F.datediff(as_of, "transaction_date")
    w = credibility("plan_status") * decay(age)
    prior = F.col("shares_owned_after") - F.col("shares")
    grew = (F.col("shares") > 0) & (
        (prior == 0) | ((prior > 0) & (F.col("shares") / F.nullif(prior, F.lit(0.0)) > CONVICTION))
    )
    person = p.groupBy("security_id", insider_key("insider_cik", "insider_name").alias("insider")).agg(
        F.max(F.when(age <= CLUSTER_DAYS, w)).alias("q"),
        F.max(F.when(is_ceo_or_cfo("officer_title"), w)).alias("x"),
        F.sum(F.when(age <= SIZE_DAYS, F.col("total_value") * w)).alias("s"),
        F.max(F.when(F.coalesce(grew, F.lit(False)), w)).alias("c"),
        F.count("*").alias("n"),
    )
    out = person.groupBy("security_id").agg(
        F.count("q").alias("cluster_insiders"), F.avg("q").alias("_mean_q"), F.max("x").alias("_x"),
        F.coalesce(F.sum("s"), F.lit(0.0)).alias("weighted_dollars"), F.max("c").alias("_c"), F.sum("n").alias("purchases"),
    )
    factor = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("cluster_insiders") - 2) / F.lit(2.0)))
    out = out.select(
        "security_id", "cluster_insiders", "purchases", "weighted_dollars",
        F.coalesce(4.0 * factor * F.col("_mean_q"), F.lit(0.0)).alias("b1_cluster"),
        F.coalesce(2.0 * F.col("_x"), F.lit(0.0)).alias("b2_executive"),
        F.coalesce(2.0 * F.col("_c"), F.lit(0.0)).alias("b4_conviction"),
    )
    if market_caps is None:
        return out
    # every security with a market cap has an S; no purchases is an observed zero
    out = market_caps.join(out, "security_id", "full_outer")
    zeros = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("weighted_dollars", "b1_cluster", "b2_executive", "b4_conviction")}
    out = out.withColumns(zeros)
    return out.withColumn("size_ratio", F.when(F.col("market_cap") > 0, F.col("weighted_dollars") / F.col("market_cap")))


def with_size_bonus(parts: DataFrame, population: tuple = ()) -> DataFrame:
    """B3 = 2 x percentile of S among positive S / 100, and the capped sum."""
    from .ranking import positive_midrank

    ranked = positive_midrank(parts, "size_ratio", population, "size_pct")
    ranked = ranked.withColumn("b3_size", F.coalesce(2.0 * F.col("size_pct") / 100.0, F.lit(0.0)))
    total = F.col("b1_cluster") + F.col("b2_executive") + F.col("b3_size") + F.col("b4_conviction")
    return ranked.withColumn("bonus", F.least(F.lit(MAX_BONUS), total))


def filing_counts(transactions: DataFrame) -> DataFrame:
    """Distinct originals and amendments and the oldest filing per security."""
    # accession first, so the count per security is a plain sum of combined rows
    per = transactions.groupBy("security_id", "accession_no", "is_amendment").agg(F.min("filed_date").alias("_filed"))
    return per.groupBy("security_id").agg(
        F.count_if(~F.col("is_amendment")).alias("originals"),
        F.count_if(F.col("is_amendment")).alias("amendments"),
        F.min("_filed").alias("oldest_filed"),
    )


def cap_hit() -> Column:
    return (F.coalesce(F.col("originals"), F.lit(0)) >= MAX_ORIGINALS) | (
        F.coalesce(F.col("amendments"), F.lit(0)) >= MAX_AMENDMENTS
    )


def scoring_coverage(
    securities: DataFrame, counts: DataFrame, last_success: Column, as_of: Column, sla_hours: float | None,
    attempted: Column | None = None,
) -> DataFrame:
    """Proof that the insider record is complete for the size window.

    Zero filings under a current run is complete: an observed zero.
    """
    start = F.date_sub(as_of, SIZE_DAYS)
    stale_hours = F.greatest(F.lit(0), F.datediff(as_of, last_success.cast("date"))) * 24.0
    out = securities.join(counts, "security_id", "left")
    reason = (
        F.when(~(attempted if attempted is not None else F.lit(True)), "not attempted")
        .when(last_success.isNull(), "no successful run")
        .when(F.lit(sla_hours is not None) & (stale_hours > F.lit(sla_hours)), "stale run")
        .when(cap_hit() & ~F.coalesce(F.col("oldest_filed") <= start, F.lit(False)), "cap reached inside the window")
    )
    return out.withColumn("coverage_reason", reason).withColumn("coverage_complete", reason.isNull())


def panel_coverage(securities: DataFrame, counts: DataFrame, as_of: Column) -> DataFrame:
    """Risk-panel view of coverage: no filings at all counts as incomplete."""
    start = F.date_sub(as_of, SELLING_DAYS)
    out = securities.join(counts, "security_id", "left")
    none = (F.coalesce(F.col("originals"), F.lit(0)) == 0) & (F.coalesce(F.col("amendments"), F.lit(0)) == 0)
    reason = F.when(none, "no filings recorded").when(
        cap_hit() & ~F.coalesce(F.col("oldest_filed") <= start, F.lit(False)), "cap reached inside the window"
    )
    return out.withColumn("coverage_reason", reason).withColumn("coverage_complete", reason.isNull())


def selling_summary(transactions: DataFrame, as_of: Column, days: int = SELLING_DAYS) -> DataFrame:
    """Open-market sales in the window: rows, sellers, value and the newest one."""
    sales = effective(transactions).where(
        (F.col("table_type") == "I") & (F.col("transaction_code") == "S")
        & F.col("transaction_date").between(F.date_sub(as_of, days), as_of)
    )
    who = F.coalesce("insider_name", "insider_cik", F.lit("?"))
    per = sales.groupBy("security_id", who.alias("_who")).agg(
        F.count("*").alias("_n"), F.sum("total_value").alias("_v"),
        F.max(F.struct("transaction_date", "accession_no", "insider_name")).alias("_last"),
    )
    return per.groupBy("security_id").agg(
        F.sum("_n").alias("sales"), F.count("*").alias("sellers"), F.coalesce(F.sum("_v"), F.lit(0.0)).alias("value"),
        F.max("_last").alias("_l"),
    ).select(
        "security_id", "sales", "sellers", "value", F.col("_l.transaction_date").alias("newest_date"),
        F.col("_l.insider_name").alias("newest_name"), F.col("_l.accession_no").alias("newest_accession"),
    )


def cluster_summary(transactions: DataFrame) -> DataFrame:
    """Distinct buyers, purchases, date span and value per security."""
    per = scored_purchases(transactions).groupBy("security_id", "insider_cik").agg(
        F.count("*").alias("_n"), F.min("transaction_date").alias("_a"), F.max("transaction_date").alias("_z"),
        F.sum("total_value").alias("_v"),
    )
    return per.groupBy("security_id").agg(
        F.count("insider_cik").alias("purchasers"), F.sum("_n").alias("purchases"),
        F.min("_a").alias("first_date"), F.max("_z").alias("last_date"), F.sum("_v").alias("total_value"),
    )
