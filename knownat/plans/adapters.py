"""Financial tables as Spark derives them from the driver's tables.

Suppliers are securities with daily bars built from their line items; customers
are companies whose orders are filings and facts; events are the run ledger.
Each adapter collapses to its grain first (for example one bar per security and
date), so a supplier holding a third of all line items is one bar series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables_sql import CONCEPT_ROWS


def day(literal: str) -> Column:
    return F.lit(literal).cast("date")


def plus(start: str, n: Column) -> Column:
    return F.date_add(day(start), n.cast("int"))


def by_mod(key: str, n: int, *values, otherwise=None) -> Column:
    """values[i] where key % n = i, `otherwise` beyond them."""
    out = None
    for i, v in enumerate(values):
        hit = F.col(key) % n == i
        v = F.lit(v)
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out.otherwise(F.lit(otherwise))


def bars(t) -> DataFrame:
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")  # a number, so that bars are hash aggregates; lines go up to 7
    return t.lineitem.groupBy(F.col("l_suppkey").alias("security_id"), F.col("l_shipdate").cast("date").alias("date")).agg(
        F.min_by("l_extendedprice", line).alias("open"), F.max("l_extendedprice").alias("high"),
        F.min(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("low"), F.max_by("l_extendedprice", line).alias("close"),
        F.sum("l_quantity").cast("bigint").alias("volume"),
    )


def benchmark(b: DataFrame) -> DataFrame:
    """Equal-weight index of all securities, one row per session, exact in cents."""
    cents = lambda c: f"(sum(cast(round({c} * 100) as bigint)) div count(*)) / 100.0D"
    return b.groupBy("date").agg(
        F.expr(cents("close")).alias("close"), F.expr(cents("open")).alias("open"), F.sum("volume").alias("volume")
    ).withColumn("security_id", F.lit(-1).cast("bigint"))


def actions(t) -> DataFrame:
    s = t.supplier.select(F.col("s_suppkey").alias("security_id"))
    k = F.col("security_id")
    none = F.lit(None).cast("double")

    def rows(df, ex, kind, ratio, cash, review) -> DataFrame:
        return df.select(
            "security_id", ex.alias("ex_date"), F.lit(kind).alias("action_type"), ratio.cast("double").alias("ratio"),
            cash.cast("double").alias("cash_amount"), review.alias("requires_manual_review"),
        )

    no = F.lit(False)
    return (
        rows(s, plus("1996-01-01", k * 37 % 1800), "split", by_mod("security_id", 4, 2.0, 3.0, 0.5, otherwise=1.5), none, k % 11 == 0)
        .unionByName(rows(s, plus("2001-06-01", k * 53 % 150), "split", F.lit(2.0), none, no))
        .unionByName(rows(s, plus("1996-03-01", k * 29 % 1900), "dividend", none, 1 + k % 7, no))
        .unionByName(rows(s.where(k % 13 == 5), plus("1999-01-01", k % 300), "spinoff", F.lit(1.1), none, no))
    )


def securities(t) -> DataFrame:
    gone = F.col("s_suppkey") % 17 == 3
    return t.supplier.select(
        F.col("s_suppkey").alias("security_id"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik"),
        F.concat("s_name", by_mod("s_suppkey", 10, " Warrant", " 5% Preferred Stock", "", " Class A Common Stock", " Class B", otherwise=" Common Stock")).alias("name"),
        by_mod("s_suppkey", 10, "warrant", "preferred_share", "unknown", otherwise="common_stock").alias("security_type"),
        F.when(F.col("s_suppkey") % 10 == 2, "low").when(F.col("s_suppkey") % 10 == 4, "medium").otherwise("high").alias("classification_confidence"),
        (F.col("s_nationkey") * 389 + 100).cast("string").alias("sic_code"), (~gone).alias("is_active"),
        F.when(gone, plus("1999-06-01", F.col("s_suppkey") % 200)).alias("delisted_date"),
    )


def listings(t) -> DataFrame:
    k = F.col("s_suppkey")
    moved = plus("1997-01-01", k * 31 % 900)
    old = t.supplier.select(
        k.alias("security_id"), F.concat(F.lit("R"), F.expr("s_suppkey div 2").cast("string")).alias("symbol"), F.lit("NYSE").alias("exchange"),
        day("1995-01-01").alias("valid_from"), moved.alias("valid_to"), (k % 3 != 0).alias("is_primary"),
    )
    new = t.supplier.select(
        k.alias("security_id"), F.concat(F.lit("T"), k.cast("string")).alias("symbol"), F.lit("Nasdaq").alias("exchange"),
        moved.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_primary"),
    )
    return old.unionByName(new)


def facts(t) -> DataFrame:
    """Twenty-odd facts per order: a customer's filings of a fiscal year restate it."""
    concepts = F.array(*[
        F.struct(
            F.lit(tax).alias("taxonomy"), F.lit(c).alias("concept"), F.lit(bool(d)).alias("dur"), F.lit(k).alias("coef"),
            F.lit(m).alias("spread"), F.lit(a).alias("absent"),
        )
        for tax, c, d, k, m, a in CONCEPT_ROWS
    ])
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", F.explode(concepts).alias("_c"))
    k = F.col("o_orderkey")
    o = o.where((k + F.col("_c.spread")) % F.col("_c.absent") != 0)
    year = F.year("o_orderdate")
    end = F.make_date(year, F.lit(12), F.lit(31))
    start = F.when(k % 5 == 2, F.date_sub(end, 91)).otherwise(F.make_date(year, F.lit(1), F.lit(1)))
    sign = F.when((F.col("_c.concept") == "NetIncomeLoss") & (k % 6 == 0), -1).otherwise(1)
    value = F.col("o_totalprice") * F.col("_c.coef") * (1 + (k * F.col("_c.spread") % 7) * 0.1) * sign
    accepted = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(days=(k % 400).cast("int"), secs=(k % 80000).cast("decimal(18,6)"))
    return o.select(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), "_c.taxonomy", "_c.concept",
        F.when(F.col("_c.dur"), start).alias("period_start"), end.alias("period_end"), value.alias("normalized_numeric_value"),
        by_mod("o_orderkey", 5, "10-K", "10-K/A", "10-Q", otherwise="10-K").alias("form_type"),
        F.concat(F.lit("A"), k.cast("string")).alias("accession_no"), F.col("o_orderdate").cast("date").alias("filed_date"),
        F.when(k % 23 != 0, accepted).alias("accepted_at"),
    )


def companies(t) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("security_id"), F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"),
        (F.col("c_nationkey") * 389 + 100).cast("string").alias("sic_code"),
        F.when(F.col("c_custkey") % 10 == 0, 2).otherwise(1).alias("class_count"), F.col("c_name").alias("name"), "c_mktsegment",
    )


def company_bars(t) -> DataFrame:
    return t.orders.groupBy(F.col("o_custkey").alias("security_id"), F.col("o_orderdate").cast("date").alias("date")).agg(
        (F.max("o_totalprice") / 1000).alias("close")
    )


def insiders(t) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    l = t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    plan = F.when(F.col("o_orderpriority") == "1-URGENT", "discretionary").when(F.col("o_orderpriority") == "2-HIGH", "confirmed_10b5_1").otherwise("unknown")
    filed = F.date_add(F.col("l_shipdate").cast("date"), (k % 3 + 1).cast("int"))
    return l.select(
        F.concat(F.lit("F"), k.cast("string")).alias("accession_no"), F.col("l_linenumber").alias("line_no"),
        F.col("l_suppkey").alias("security_id"), F.col("o_custkey").cast("string").alias("insider_cik"),
        F.lit(None).cast("string").alias("insider_name"),
        by_mod("l_partkey", 5, "Chief Executive Officer", "CFO", "Director", "EVP, C.F.O.").alias("officer_title"),
        F.when(F.col("l_linestatus") == "F", "I").otherwise("II").alias("table_type"),
        F.when(F.col("l_returnflag") == "R", "S").otherwise("P").alias("transaction_code"), plan.alias("plan_status"),
        F.when(p % 50 != 0, F.col("l_shipdate").cast("date")).alias("transaction_date"), filed.alias("filed_date"),
        filed.cast("timestamp_ntz").alias("accepted_at"), F.col("l_quantity").alias("shares"),
        F.col("l_extendedprice").alias("total_value"), (F.col("l_quantity") * (p % 6)).alias("shares_owned_after"),
        (k % 9 == 0).alias("is_amendment"),
        F.when(k % 12 == 5, F.concat(F.lit("F"), (k + 4).cast("string"))).alias("superseded_by_accession"),
    )


def scores(t) -> DataFrame:
    p = F.col("p_partkey")
    opened = F.filter(F.array(F.when(p % 5 == 0, F.lit(20)), F.when(p % 25 == 0, F.lit(60))), lambda h: h.isNotNull())
    return t.part.select(
        p.alias("security_id"), F.col("p_type").alias("cohort_id"), ((p * 7919 % 1000) / 10.0).alias("composite"),
        (F.col("p_size") * 2.0).alias("quality"), (p % 13 != 0).alias("rankable"), (p % 17 != 0).alias("model_applicable"),
        (p % 2).cast("int").alias("inputs_complete"), (p % 29).cast("double").alias("dilution_score"),
        (p % 29 >= 22).alias("dilution_disqualified"), (p % 31 == 0).alias("high_going_concern"),
        F.when(p % 37 == 0, F.array(F.lit("active_issuance"))).otherwise(F.array().cast("array<string>")).alias("high_dilution_flags"),
        plus("2000-01-01", p % 30).alias("last_exit_session"), plus("2000-01-01", p % 23).alias("last_gap_cancel_session"),
        opened.alias("open_horizons"), F.lit(None).cast("bigint").alias("rank"),
    )


def runs(t) -> DataFrame:
    e = F.col("event_type")
    stage = F.when(e == "click", "price_ingest").when(e == "view", "insider").when(e == "signup", "fundamentals").when(e == "purchase", "fixture_load").otherwise("selection")
    ts = F.col("ts").cast("timestamp_ntz")
    return t.events.select(
        F.col("event_id").cast("string").alias("run_id"), stage.alias("stage"),
        (ts - F.make_dt_interval(secs=(F.col("event_id") % 3000).cast("decimal(18,6)"))).alias("started_at"),
        F.when(F.col("event_id") % 10 != 2, ts).alias("finished_at"),
        by_mod("event_id", 10, "failed", "partial", "running", otherwise="success").alias("status"),
        (F.col("event_id") % 4).alias("records_written"), "user_id",
    )


def progress(t) -> DataFrame:
    return t.events.select(
        F.col("ts").cast("date").cast("string").alias("batch_id"), F.col("event_type").alias("stage"), F.col("user_id").cast("string").alias("item_key"),
        by_mod("event_id", 5, "failed", "skipped", otherwise="success").alias("status"), F.col("ts").cast("timestamp_ntz").alias("attempted_at"),
        F.col("event_id").cast("string").alias("run_id"),
    )


def trades(t) -> DataFrame:
    pnl = F.col("o_totalprice") - 250000
    return t.orders.select(
        F.col("o_orderkey").alias("trade_id"), F.col("o_orderdate").cast("date").alias("exit_date"), pnl.alias("net_pnl"), pnl.alias("gross_pnl"),
        (pnl / 1000).alias("pnl_pct"), F.col("o_orderpriority").alias("cohort_id"),
        F.when(F.col("o_orderkey") % 2 == 0, 20).otherwise(60).alias("horizon_days"),
    )


# Sentences appended to the documents so that every filing rule is met somewhere.
PHRASES = (
    " senior notes due 2030", " shares of common stock under Rule 415", " an at-the-market offering of our common stock",
    " floating conversion terms", " resale of ordinary shares", " a convertible debenture",
    " These conditions raise substantial doubt about the Company's ability to continue as a going concern.",
    " This did not raise substantial doubt about our ability to continue as a going concern.",
    " Our ability to continue as a going concern: substantial doubt was alleviated by plans.",
    " We assess whether there is substantial doubt about our ability to continue as a going concern.",
)


def filings(t) -> DataFrame:
    d = F.col("doc_id")
    return t.documents.select(
        F.concat(F.lit("D"), d.cast("string")).alias("accession_no"), F.col("source").alias("cik"),
        by_mod("doc_id", 7, "S-3", "424B5", "424B2", "S-1", "10-K", "10-Q", otherwise="8-K").alias("form_type"),
        plus("2020-01-01", d * 17 % 1500).alias("filed_date"), "n_chars", "doc_id",
        F.concat("text", by_mod("doc_id", 11, *PHRASES, otherwise="")).alias("text"),
    )
