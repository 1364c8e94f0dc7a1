"""Queries over positions, candidates, panels, snapshots, sinks and audit rules."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions import core as C, text as T
from ..operators import bars as B, dilution as DIL, ledger as L, report as REP, selection as SEL, universe as U, verify as V
from ..session import shared_folder
from ..sources import sinks as S
from . import adapters as A
from .registry import query


def _signals(t):
    """Signals of a hundred securities, one a day and security."""
    p = F.col("p_partkey")
    return t.part.select(
        (p % 100).alias("security_id"), A.plus("2000-01-01", F.expr("p_partkey div 100")).alias("as_of_date"),
        (p * 7 % 31).cast("double").alias("dilution_score"), (p * 7 % 31 >= 22).alias("is_disqualified"),
    )


@query("latest_dilution_signal", "", """
    SELECT p_partkey % 100 AS security_id, CAST(max(DATE '2000-01-01' + CAST(p_partkey // 100 AS INTEGER)) AS VARCHAR) AS as_of_date, arg_max(CAST(p_partkey * 7 % 31 AS DOUBLE), p_partkey // 100) AS dilution_score
    FROM part WHERE p_partkey // 100 <= 9 GROUP BY 1""")
def latest_dilution_signal(t):
    return DIL.latest_signal(_signals(t), A.day("2000-01-10")).select("security_id", "as_of_date", "dilution_score")


def _candidates(t):
    return t.orders.select(F.col("o_orderkey").alias("candidate_id"), F.col("o_custkey").alias("security_id"))


def _cancelled(t):
    late = t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1))
    return late.groupBy(F.col("l_orderkey").alias("candidate_id")).agg(F.max("l_shipdate").alias("cancelled_at"))


def _positions(t):
    """A position for each large first line that was not cancelled; open, closed or pending by its key."""
    l = t.lineitem.where((F.col("l_returnflag") != "R") & (F.col("l_linenumber") == 1) & (F.col("l_quantity") > 20))
    k, sold = F.col("l_orderkey"), F.date_add(F.col("l_shipdate").cast("date"), 30)
    closed = k % 3 == 0
    rows = l.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("l_shipdate"), F.max("l_quantity").alias("shares"))
    return rows.select(
        F.concat(F.lit("P"), k.cast("string")).alias("position_id"), k.alias("candidate_id"), F.col("l_shipdate").cast("date").alias("entry_date"),
        A.by_mod("l_orderkey", 3, "closed", "open", otherwise="pending_resolution").alias("status"), F.when(closed, sold).alias("exit_date"),
        F.when(closed, F.lit("time_exit")).alias("exit_reason"), F.when(k % 2 == 0, 20).otherwise(60).alias("horizon_days"), "shares",
        F.when(k % 41 == 0, -1.0).otherwise(5.0).alias("slippage_bps"), F.when(closed & (k % 5 != 0), F.lit(10.0)).alias("exit_price"), F.lit(9.0).alias("entry_price"),
    )


_POS = """
    can AS (SELECT o_orderkey AS candidate_id, o_custkey AS security_id FROM orders),
    cx AS (SELECT l_orderkey AS candidate_id, max(l_shipdate) AS cancelled_at FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1 GROUP BY 1),
    pos AS (SELECT 'P' || l_orderkey AS position_id, l_orderkey AS candidate_id, CAST(max(l_shipdate) AS DATE) AS entry_date, CASE l_orderkey % 3 WHEN 0 THEN 'closed' WHEN 1 THEN 'open' ELSE 'pending_resolution' END AS status,
        CASE WHEN l_orderkey % 3 = 0 THEN CAST(max(l_shipdate) AS DATE) + 30 END AS exit_date, CASE WHEN l_orderkey % 2 = 0 THEN 20 ELSE 60 END AS horizon_days
        FROM lineitem WHERE l_returnflag <> 'R' AND l_linenumber = 1 AND l_quantity > 20 GROUP BY l_orderkey)"""


@query("unresolved_candidates", "", "WITH" + _POS + " SELECT candidate_id FROM can WHERE candidate_id NOT IN (SELECT candidate_id FROM cx) AND candidate_id NOT IN (SELECT candidate_id FROM pos)")
def unresolved_candidates(t):
    return L.unresolved(_candidates(t), _cancelled(t), _positions(t)).select("candidate_id")


@query("originating_candidates", "", "WITH" + _POS + " SELECT count(DISTINCT candidate_id) AS candidates FROM (SELECT candidate_id FROM cx UNION SELECT candidate_id FROM pos)")
def originating_candidates(t):
    return REP.originating_candidates(_positions(t), _cancelled(t))


@query("position_state", "", "WITH" + _POS + """,
    p AS (SELECT security_id, max(exit_date) FILTER (status = 'closed' AND exit_date <= DATE '2000-06-30') AS last_exit, string_agg(DISTINCT CASE WHEN status = 'open' THEN CAST(horizon_days AS VARCHAR) END, ',' ORDER BY CASE WHEN status = 'open' THEN CAST(horizon_days AS VARCHAR) END) AS hs FROM pos JOIN can USING (candidate_id) GROUP BY 1),
    c AS (SELECT security_id, max(CAST(cancelled_at AS DATE)) AS last_cancel FROM cx JOIN can USING (candidate_id) WHERE CAST(cancelled_at AS DATE) <= DATE '2000-06-30' GROUP BY 1)
    SELECT security_id, CAST(last_exit AS VARCHAR) AS last_exit_session, coalesce(hs, '') AS open_horizons, CAST(last_cancel AS VARCHAR) AS last_gap_cancel_session FROM p FULL JOIN c USING (security_id)""")
def position_state(t):
    s = SEL.position_state(_positions(t), _cancelled(t), _candidates(t), A.day("2000-06-30"))
    return s.withColumn("open_horizons", F.coalesce(F.array_join(F.col("open_horizons").cast("array<string>"), ","), F.lit("")))


_START = "DATE '1998-01-01'"


@query("pre_launch", "", f"""
    SELECT 'P' || o_orderkey AS position_id FROM orders WHERE o_custkey % 7 = 0 OR CAST(o_orderdate AS DATE) < {_START}""")
def pre_launch(t):
    rows = t.orders.select(
        F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("position_id"), F.col("o_orderdate").cast("date").alias("generated_at"),
        F.when(F.col("o_custkey") % 7 == 0, "abc+").otherwise("abc").alias("code_version"),
    )
    experiments = t.region.select(F.when(F.col("r_regionkey") == 2, "active").otherwise("retired").alias("status"), A.plus("1996-01-01", F.col("r_regionkey") * 365 + 1).alias("started_at"))
    return REP.pre_launch(rows, REP.official(rows, experiments)).select("position_id")


@query("snapshot_members", "", """
    SELECT count(*) AS total, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')) AS present FROM customer""")
def snapshot_members(t):
    population = t.customer.select(F.col("c_custkey").alias("security_id"))
    return U.members_present(population, t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("security_id")))


@query("verification_counts", "", """
    SELECT count(*) AS total, count(*) FILTER (event_id % 5 NOT IN (0, 1)) AS verified, count(*) FILTER (event_id % 5 = 0) AS mismatched FROM events""")
def verification_counts(t):
    return REP.verification_counts(t.events.select(A.by_mod("event_id", 5, "mismatch", "skipped", otherwise="verified").alias("status")))


@query("payload_summary", "", """
    SELECT count(*) AS payloads, CAST(sum(n_chars) AS BIGINT) AS bytes, count(DISTINCT source) AS sources, CAST(max(DATE '2020-01-01' + CAST(doc_id * 17 % 1500 AS INTEGER)) AS VARCHAR) AS latest FROM documents""")
def payload_summary(t):
    f = A.filings(t).select(F.col("n_chars").alias("byte_size"), F.col("cik").alias("source"), F.col("filed_date").alias("fetched_at"))
    return REP.payload_summary(f)


def _dated_scores(t):
    p = F.col("security_id")
    return A.scores(t).withColumns({"score_date": A.plus("2001-01-01", p % 30), "composite_score": F.col("composite"), "rank": F.when(F.col("rankable"), p), "withhold_reason": F.when(~F.col("rankable"), "gap")})


@query("ranked_count", "scores", """
    SELECT CAST(DATE '2001-01-01' + CAST(security_id % 30 AS INTEGER) AS VARCHAR) AS score_date, count(*) AS ranked FROM scores WHERE rankable GROUP BY 1""")
def ranked_count(t):
    return REP.ranked_count(_dated_scores(t))


@query("top_ranked_symbols", "listings securities scores", """
    SELECT s.security_id, s.name, 'T' || s.security_id AS symbol, CAST(c.security_id AS BIGINT) AS rank FROM scores c JOIN securities s USING (security_id)
    WHERE c.rankable AND c.security_id % 30 = (SELECT max(security_id % 30) FROM scores) AND c.security_id IN (SELECT security_id FROM scores WHERE rankable AND security_id % 30 = (SELECT max(security_id % 30) FROM scores) ORDER BY security_id LIMIT 60)""")
def top_ranked_symbols(t):
    return REP.top_ranked(_dated_scores(t), A.securities(t), A.listings(t), 60).select("security_id", "name", "symbol", "rank")


@query("search_symbols", "listings securities scores", """
    SELECT s.security_id, 'T' || s.security_id AS symbol, CASE WHEN c.rankable AND s.security_id % 30 = (SELECT max(security_id % 30) FROM scores) THEN CAST(s.security_id AS BIGINT) END AS rank
    FROM securities s LEFT JOIN scores c USING (security_id) WHERE 'T' || s.security_id LIKE '%T1%' OR upper(s.name) LIKE '%T1%'
    ORDER BY ('T' || s.security_id = 'T1') DESC, 3 NULLS LAST, s.name, 1 LIMIT 200""")
def search_symbols(t):
    return REP.search(A.securities(t), A.listings(t), _dated_scores(t), "t1", 200).select("security_id", "symbol", "rank")


def _flags(t):
    d = F.col("doc_id")
    return A.filings(t).select(
        (d % 50).alias("security_id"), A.plus("2023-01-01", d % 3).alias("as_of_date"), A.by_mod("doc_id", 6, "high", "medium", "low", "none", "context", otherwise="unknown").alias("severity"),
        F.concat(F.lit("flag"), d.cast("string")).alias("flag_code"), F.when(d % 4 != 0, F.col("accession_no")).otherwise(F.lit("ledger")).alias("source_accession"),
    )


_FLAGS = """fl AS (SELECT doc_id % 50 AS security_id, DATE '2023-01-01' + CAST(doc_id % 3 AS INTEGER) AS as_of_date, doc_id, doc_id % 6 AS sev, 'flag' || doc_id AS flag_code FROM documents)"""


@query("risk_panel", "filings", ", " + _FLAGS + """
    SELECT fl.security_id, fl.flag_code, CASE WHEN fl.doc_id % 4 <> 0 THEN f.form_type END AS source_form, CASE fl.sev WHEN 3 THEN 5 WHEN 4 THEN 3 WHEN 5 THEN 4 ELSE CAST(fl.sev AS INTEGER) END AS severity_order FROM fl JOIN filings f USING (doc_id)
    WHERE fl.as_of_date = (SELECT max(g.as_of_date) FROM fl g WHERE g.security_id = fl.security_id)""")
def risk_panel(t):
    return REP.risk_panel(_flags(t), A.filings(t)).select("security_id", "flag_code", "source_form", F.col("severity_order").cast("int").alias("severity_order"))


@query("daily_operations", "", "WITH " + _FLAGS + "," + _POS + """
    SELECT 'severe_flag' AS event, CAST(security_id AS VARCHAR) AS subject, flag_code AS detail FROM fl WHERE sev = 0 AND as_of_date = DATE '2023-01-02'
    UNION ALL SELECT 'opened', position_id, CASE WHEN status = 'closed' THEN 'time_exit' ELSE status END FROM pos WHERE entry_date = DATE '2023-01-02'
    UNION ALL SELECT 'closed', position_id, 'time_exit' FROM pos WHERE entry_date <> DATE '2023-01-02' AND exit_date = DATE '2023-01-02'
    UNION ALL SELECT 'pending', position_id, status FROM pos WHERE status = 'pending_resolution' AND entry_date <> DATE '2023-01-02'""")
def daily_operations(t):
    return REP.daily_operations(_flags(t), _positions(t), A.day("2023-01-02"))


@query("pool_in_force", "", "SELECT 'v' || max(o_orderkey % 9) AS pool_version FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)")
def pool_in_force(t):
    pool = t.orders.select(F.concat(F.lit("v"), (F.col("o_orderkey") % 9).cast("string")).alias("pool_version"), F.col("o_orderdate").cast("date").alias("discovered_at"))
    return REP.pool_in_force(pool)


@query("position_details", "", "WITH" + _POS + """
    SELECT position_id, security_id, 'c' || security_id % 5 AS cohort_id, CASE WHEN security_id IN (SELECT s_suppkey FROM supplier) THEN 'T' || security_id END AS symbol FROM pos JOIN can USING (candidate_id)""")
def position_details(t):
    c = _candidates(t).withColumns({
        "composite_at_generation": F.lit(1.0), "rank_at_generation": F.lit(1),
        "score_snapshot_json": F.to_json(F.struct(F.concat(F.lit("c"), (F.col("security_id") % 5).cast("string")).alias("cohort_id"))),
    })
    return REP.position_details(_positions(t).withColumn("security_id", F.lit(0)), c, A.listings(t)).select("position_id", "security_id", "cohort_id", "symbol")


@query("position_rules", "", "WITH" + _POS + """
    SELECT position_id, unnest(list_filter([CASE WHEN candidate_id % 41 = 0 THEN 'positive_slippage' END, CASE WHEN candidate_id % 3 = 0 AND candidate_id % 5 = 0 THEN 'closed_complete' END], lambda x: x IS NOT NULL)) AS rule FROM pos""")
def position_rules(t):
    return V.failed_rules(_positions(t), V.position_rules(), ["position_id"])


@query("score_rules", "scores", """
    SELECT security_id, unnest(list_filter([CASE WHEN composite * 1.02 > 100 AND rankable THEN 'composite_range' END, CASE WHEN quality * 1.1 > 100 THEN 'quality_range' END, CASE WHEN security_id % 29 > 26 THEN 'bonus_range' END,
      CASE WHEN NOT rankable AND security_id % 2 = 0 THEN 'withheld_has_reason' END], lambda x: x IS NOT NULL)) AS rule FROM scores""")
def score_rules(t):
    s, p = A.scores(t), F.col("security_id")
    rows = s.select(
        p, (F.col("quality") * 1.1).alias("quality_score"), F.lit(50.0).alias("value_score"), F.lit(None).cast("double").alias("momentum_score"), "rankable",
        F.when(F.col("rankable"), F.col("composite") * 1.02).alias("composite_score"), ((p % 29) * 10 / 26.0).alias("insider_bonus"), F.lit(30.0).alias("dilution_penalty"),
        F.when(~F.col("rankable") & (p % 2 == 1), "gap").alias("withhold_reason"),
    )
    return V.failed_rules(rows, V.score_rules(), ["security_id"])


@query("audit_verdicts", "securities bars", """
    SELECT 'classification' AS check_name, count(*) AS violations, CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END AS status FROM securities WHERE security_type = 'unknown'
    UNION ALL SELECT 'positive_volume', count(*), CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END FROM bars WHERE volume <= 0""")
def audit_verdicts(t):
    kinds = V.unknown_classifications(A.securities(t).withColumn("classification_source", F.lit("directory")))
    return V.verdicts({"classification": kinds, "positive_volume": A.bars(t).where("volume <= 0")})


@query("series_differences", "bars", """
    SELECT security_id, CAST(date AS VARCHAR) AS date, x.side AS side FROM bars, (VALUES ('before'), ('after')) x(side) WHERE volume % 7 = 0""")
def series_differences(t):
    before = A.bars(t).select("security_id", "date", "close")
    after = A.bars(t).select("security_id", "date", F.when(F.col("volume") % 7 == 0, F.col("close") + 1).otherwise(F.col("close")).alias("close"))
    return V.series_differences(before, after).select("security_id", "date", "side")


@query("bars_upsert", "bars", """
    SELECT b.security_id, CAST(b.date AS VARCHAR) AS date, CASE WHEN volume % 10 = 3 THEN 7 ELSE volume END AS volume FROM bars b
    UNION ALL SELECT s_suppkey, '2030-01-02', 1 FROM supplier""")
def bars_upsert(t):
    old = A.bars(t).select("security_id", "date", "volume")
    changed = old.where(F.col("volume") % 10 == 3).withColumn("volume", F.lit(7).cast("bigint"))
    fresh = A.securities(t).select("security_id", A.day("2030-01-02").alias("date"), F.lit(1).cast("bigint").alias("volume"))
    return S.upsert(old, changed.unionByName(fresh), ["security_id", "date"])


@query("provider_windows", "", """
    SELECT s_suppkey AS security_id, 'a' AS provider, CASE WHEN s_suppkey % 3 = 0 THEN '2001-01-01 00:00:00' END AS valid_to FROM supplier
    UNION ALL SELECT s_suppkey, 'b', NULL FROM supplier WHERE s_suppkey % 3 = 0""")
def provider_windows(t):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    now = A.securities(t).select("security_id", F.lit("a").alias("provider"), at("1999-01-01").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    moved = A.securities(t).where(F.col("security_id") % 3 == 0)
    return B.record_provenance(now, moved, "b", at("2001-01-01")).select("security_id", "provider", "valid_to")


@query("provider_switch", "bars", """
    SELECT security_id, CAST(date AS VARCHAR) AS date, 'a' AS provider FROM bars WHERE security_id % 4 <> 1
    UNION ALL SELECT security_id, CAST(date AS VARCHAR), 'b' FROM bars WHERE security_id % 4 = 1 AND date >= DATE '1998-01-01'""")
def provider_switch(t):
    old = A.bars(t).select("security_id", "date", "close", F.lit("a").alias("provider"))
    new = old.where((F.col("security_id") % 4 == 1) & (F.col("date") >= A.day("1998-01-01"))).withColumn("provider", F.lit("b"))
    return B.switch_provider(old, new, "b").select("security_id", "date", "provider")


@query("missing_sources", "", """
    WITH f AS (SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS a, c_custkey IN (SELECT user_id FROM events) AS b, c_custkey IN (SELECT doc_id FROM labels) AS c FROM customer)
    SELECT c_custkey AS security_id, concat_ws(',', CASE WHEN NOT a THEN 'prices' END, CASE WHEN NOT b THEN 'form4' END, CASE WHEN NOT c THEN 'xbrl' END) AS missing FROM f WHERE NOT (a AND b AND c)""")
def missing_sources(t):
    from .q_reports import _flagged

    rows = REP.worst_coverage(_flagged(t), ("prices", "form4", "xbrl"), None)
    return rows.select("security_id", F.array_join("missing", ",").alias("missing"))


@query("facts_appended", "concepts facts", """
    , k AS (SELECT cik, taxonomy, concept, period_end, accession_no, period_start, value, CASE WHEN form_type = '10-Q' THEN 'first' ELSE 'second' END AS run_id FROM facts)
    SELECT run_id, taxonomy, concept, count(*) AS facts, count(DISTINCT cik) AS companies, round(sum(value), 2) AS total FROM k GROUP BY ALL""", places=2)
def facts_appended(t):
    """Facts written by three runs: one that commits, one that dies after its rows, and the same again, twice.

    Each fact is read back once, under the run that committed it.
    """
    spark = t.orders.sparkSession
    path = f"{shared_folder(spark)}/facts-{uuid4().hex}"
    facts, keys = A.facts(t), ["cik", "taxonomy", "concept", "period_end", "accession_no"]
    S.append_run(facts.where("form_type = '10-Q'"), path, "first", keys)
    S.stage_run(facts.where("form_type <> '10-K'"), path, "second")  # rows without a marker: the job was killed here
    S.append_run(facts, path, "second", keys)
    S.append_run(facts, path, "second", keys)
    rows = S.read_appended(spark, path, facts.schema)
    return rows.groupBy("run_id", "taxonomy", "concept").agg(
        F.count("*").alias("facts"), F.countDistinct("cik").alias("companies"),
        F.round(F.sum("normalized_numeric_value"), 2).alias("total"),
    )


@query("money_texts", "", """
    SELECT o_orderkey, CASE WHEN abs(v) >= 1e9 THEN format('{:,.2f}', v / 1e9) || 'B' WHEN abs(v) >= 1e6 THEN format('{:,.2f}', v / 1e6) || 'M' WHEN abs(v) >= 1e3 THEN format('{:,.2f}', v / 1e3) || 'K' ELSE format('{:,.0f}', v) END AS said
    FROM (SELECT o_orderkey, (o_totalprice - 200000) * CASE o_orderkey % 4 WHEN 0 THEN 0.001 WHEN 1 THEN 1.0 WHEN 2 THEN 100.0 ELSE 100000.0 END AS v FROM orders)""")
def money_texts(t):
    scale = A.by_mod("o_orderkey", 4, 0.001, 1.0, 100.0, otherwise=100000.0)
    return t.orders.select("o_orderkey", C.money_text((F.col("o_totalprice") - 200000) * scale).alias("said"))


@query("industry_labels", "", """
    SELECT c_custkey, CASE WHEN sic = '6798' THEN 'REIT' WHEN sic LIKE '602%' OR sic IN ('6035', '6036') THEN 'Bank' END AS label FROM (SELECT c_custkey, CAST(6000 + c_custkey % 900 AS VARCHAR) AS sic FROM customer)""")
def industry_labels(t):
    sic = (6000 + F.col("c_custkey") % 900).cast("string")
    return t.customer.select("c_custkey", T.industry_label(sic).alias("label"))


@query("rating_shares", "", """
    WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS a, count(*) FILTER (o_orderpriority = '2-HIGH') AS b, count(*) FILTER (o_orderpriority = '5-LOW') AS c FROM orders GROUP BY 1)
    SELECT o_custkey, round(a / nullif(a + b + c, 0), 6) AS strong_buy, round(b / nullif(a + b + c, 0), 6) AS buy, round(c / nullif(a + b + c, 0), 6) AS sell FROM c""")
def rating_shares(t):
    count = lambda p: F.count_if(F.col("o_orderpriority") == p)
    per = t.orders.groupBy("o_custkey").agg(count("1-URGENT").alias("_a"), count("2-HIGH").alias("_b"), count("5-LOW").alias("_c"))
    shares = T.rating_shares("_a", "_b", "_c")
    return per.select("o_custkey", shares[0].alias("strong_buy"), shares[1].alias("buy"), shares[2].alias("sell"))
