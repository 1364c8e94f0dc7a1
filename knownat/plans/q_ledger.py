"""Queries over insiders, selection, the trade ledger and the universe."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, bars as B, insider as INS, ledger as L, momentum as MOM, performance as PERF, risk as RK, selection as SEL, universe as U
from . import adapters as A
from .registry import query, stored

_W = """
    p AS (SELECT *, CASE plan_status WHEN 'discretionary' THEN 1.0 WHEN 'confirmed_10b5_1' THEN 0.5 ELSE 0.75 END * greatest(0.0, 1 - (DATE '2001-06-30' - transaction_date) / 180.0) AS w,
             DATE '2001-06-30' - transaction_date AS age, shares_owned_after - shares AS prior
          FROM insiders WHERE table_type = 'I' AND transaction_code = 'P' AND superseded_by_accession IS NULL AND transaction_date <= DATE '2001-06-30'),
    q AS (SELECT security_id, insider_cik, max(w) FILTER (age <= 90) AS q, max(w) FILTER (officer_title IN ('Chief Executive Officer', 'CFO', 'EVP, C.F.O.')) AS x,
             sum(total_value * w) FILTER (age <= 180) AS s, max(w) FILTER (shares > 0 AND (prior = 0 OR (prior > 0 AND shares / prior > 0.25))) AS c FROM p GROUP BY 1, 2),
    b AS (SELECT security_id, count(q) AS n, coalesce(4.0 * least(1.0, greatest(0.0, (count(q) - 2) / 2.0)) * avg(q), 0) AS b1, coalesce(2.0 * max(x), 0) AS b2, coalesce(sum(s), 0) AS s, coalesce(2.0 * max(c), 0) AS b4 FROM q GROUP BY 1)"""
_INS = "insiders"


def _sql(names: str, tail: str) -> str:
    from .registry import sql_with

    return sql_with(names, "").rstrip() + ", " + tail.strip()


def _parts(t, caps=None):
    return INS.bonus_parts(INS.scored_purchases(A.insiders(t)), A.day("2001-06-30"), caps)


@query("insider_cluster", "", _sql(_INS, _W + " SELECT security_id, n AS cluster_insiders, round(b1, 6) AS b1_cluster FROM b"))
def insider_cluster(t):
    return _parts(t).select("security_id", "cluster_insiders", "b1_cluster")


@query("insider_executive", "", _sql(_INS, _W + " SELECT security_id, round(b2, 6) AS b2_executive, round(b4, 6) AS b4_conviction FROM b"))
def insider_executive(t):
    return _parts(t).select("security_id", "b2_executive", "b4_conviction")


@query("insider_size", "", _sql(_INS, _W + """,
    z AS (SELECT s_suppkey AS security_id, coalesce(b1, 0) AS b1, coalesce(b2, 0) AS b2, coalesce(b4, 0) AS b4, CASE WHEN s_acctbal > 0 THEN coalesce(s, 0) / s_acctbal END AS sr FROM supplier LEFT JOIN b ON security_id = s_suppkey),
    y AS (SELECT security_id, 100.0 * (rank() OVER (ORDER BY sr) - 1 + (count(*) OVER (PARTITION BY sr) - 1) / 2.0) / nullif(count(*) OVER () - 1, 0) AS pct FROM z WHERE sr > 0)
    SELECT security_id, round(sr, 6) AS size_ratio, round(coalesce(2 * pct / 100, 0), 6) AS b3_size, round(least(10.0, b1 + b2 + b4 + coalesce(2 * pct / 100, 0)), 6) AS bonus FROM z LEFT JOIN y USING (security_id)"""))
def insider_size(t):
    caps = t.supplier.select(F.col("s_suppkey").alias("security_id"), F.col("s_acctbal").alias("market_cap"))
    # a stored, rounded S: the ranking reads its input twice
    parts = _parts(t, caps).withColumn("size_ratio", F.round("size_ratio", 9))
    return INS.with_size_bonus(parts).select("security_id", "size_ratio", "b3_size", "bonus")


@query("insider_summary", "insiders", """
    SELECT security_id, count(DISTINCT insider_cik) AS purchasers, count(*) AS purchases, CAST(min(transaction_date) AS VARCHAR) AS first_date, CAST(max(transaction_date) AS VARCHAR) AS last_date, round(sum(total_value), 2) AS total_value
    FROM insiders WHERE table_type = 'I' AND transaction_code = 'P' AND superseded_by_accession IS NULL GROUP BY 1""", places=2)
def insider_summary(t):
    return INS.cluster_summary(A.insiders(t))


@query("insider_effective", "insiders", "SELECT table_type, transaction_code, count(*) AS n FROM insiders WHERE superseded_by_accession IS NULL GROUP BY ALL")
def insider_effective(t):
    return INS.effective(A.insiders(t)).groupBy("table_type", "transaction_code").agg(F.count("*").alias("n"))


@query("insider_selling", "insiders", """
    SELECT security_id, count(*) AS sales, count(DISTINCT insider_cik) AS sellers, round(sum(total_value), 2) AS value, CAST(max(transaction_date) AS VARCHAR) AS newest_date
    FROM insiders WHERE table_type = 'I' AND transaction_code = 'S' AND superseded_by_accession IS NULL AND transaction_date BETWEEN DATE '2001-06-30' - 90 AND DATE '2001-06-30' GROUP BY 1""", places=2)
def insider_selling(t):
    return INS.selling_summary(A.insiders(t), A.day("2001-06-30")).select("security_id", "sales", "sellers", "value", "newest_date")


@query("insider_coverage", "insiders", """
    SELECT security_id, count(DISTINCT accession_no) FILTER (NOT is_amendment) AS originals, count(DISTINCT accession_no) FILTER (is_amendment) AS amendments, CAST(min(filed_date) AS VARCHAR) AS oldest_filed,
      NOT ((count(DISTINCT accession_no) FILTER (NOT is_amendment) >= 60 OR count(DISTINCT accession_no) FILTER (is_amendment) >= 10) AND min(filed_date) > DATE '1995-07-10' - 180) AS coverage_complete FROM insiders GROUP BY 1""")
def insider_coverage(t):
    x = A.insiders(t)
    ids = t.supplier.select(F.col("s_suppkey").alias("security_id"))
    out = INS.scoring_coverage(ids, INS.filing_counts(x), F.lit("1995-07-09").cast("timestamp_ntz"), A.day("1995-07-10"), 96.0)
    return out.select("security_id", "originals", "amendments", "oldest_filed", "coverage_complete")


def _amend(t):
    o, k = t.orders, F.col("o_orderkey")
    return o.select(
        F.lpad(k.cast("string"), 12, "0").alias("accession_no"), F.col("o_custkey").alias("security_id"), F.col("o_orderstatus").alias("insider_cik"),
        F.when(k % 4 != 0, F.trunc(F.col("o_orderdate").cast("date"), "year")).alias("transaction_date"), F.col("o_orderdate").cast("date").alias("filed_date"),
        (k % 3 == 0).alias("is_amendment"), F.lit(None).cast("string").alias("superseded_by_accession"), F.lit(None).cast("string").alias("amends_accession"),
    )


@query("amendment_link", "", """
    WITH x AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS a, o_custkey AS s, o_orderstatus AS i, CASE WHEN o_orderkey % 4 <> 0 THEN date_trunc('year', o_orderdate)::DATE END AS d, o_orderdate AS f, o_orderkey % 3 = 0 AS am FROM orders)
    SELECT m.a AS amendment, arg_max(o.a, (o.f, o.a)) AS original FROM x m JOIN x o ON m.am AND NOT o.am AND o.s = m.s AND o.i = m.i AND o.f <= m.f AND (o.d IS NOT DISTINCT FROM m.d OR o.d IS NULL) GROUP BY m.a""")
def amendment_link(t):
    return INS.amendment_links(_amend(t)).select("amendment", "original")


@query("amendment_applied", "", """
    WITH x AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS a, o_custkey AS s, o_orderstatus AS i, CASE WHEN o_orderkey % 4 <> 0 THEN date_trunc('year', o_orderdate)::DATE END AS d, o_orderdate AS f, o_orderkey % 3 = 0 AS am FROM orders),
    l AS (SELECT m.a AS amendment, m.f, arg_max(o.a, (o.f, o.a)) AS original FROM x m JOIN x o ON m.am AND NOT o.am AND o.s = m.s AND o.i = m.i AND o.f <= m.f AND (o.d IS NOT DISTINCT FROM m.d OR o.d IS NULL) GROUP BY m.a, m.f)
    SELECT original AS accession_no, arg_min(amendment, (f, amendment)) AS superseded_by_accession FROM l GROUP BY 1""")
def amendment_applied(t):
    return INS.link_amendments(_amend(t)).where(F.col("superseded_by_accession").isNotNull()).select("accession_no", "superseded_by_accession")


_SURV = """
    f AS (SELECT *, CASE WHEN NOT rankable THEN 'not_rankable' WHEN NOT model_applicable THEN 'model_not_applicable' WHEN dilution_disqualified OR dilution_score >= 22 THEN 'dilution_disqualified'
             WHEN high_going_concern THEN 'risk_flag_going_concern' WHEN has_dilution_flag THEN 'risk_flag_dilution_disqualify' WHEN composite < 55 THEN 'below_composite_threshold'
             WHEN last_exit_session > DATE '2000-01-25' THEN 'cooldown_recent_exit' WHEN last_gap_cancel_session > DATE '2000-01-20' THEN 'cooldown_gap_cancelled' END AS reason FROM scores),
    s AS (SELECT *, row_number() OVER (ORDER BY composite DESC, quality DESC, inputs_complete DESC, security_id) AS k FROM f WHERE reason IS NULL),
    live AS (SELECT *, row_number() OVER (PARTITION BY cohort_id ORDER BY k) AS kc FROM s WHERE NOT (open20 AND open60)),
    pick AS (SELECT *, row_number() OVER (ORDER BY k) AS pos FROM live WHERE kc <= 2 QUALIFY pos <= 5),
    lim AS (SELECT CASE WHEN count(*) = 5 THEN max(k) END AS full_at FROM pick)"""


def _select(t, capacity=None):
    return SEL.select(A.scores(t), capacity or {20: 100, 60: 100}, A.day("2000-01-25"), A.day("2000-01-20"))


@query("select_caps", "", _sql("scores", _SURV + " SELECT security_id, cohort_id, composite, CAST(pos AS BIGINT) AS position FROM pick"))
def select_caps(t):
    return _select(t)[0].select("security_id", "cohort_id", "composite", F.col("position").cast("bigint").alias("position"))


@query("suppressions", "", _sql("scores", _SURV + """
    , h AS (SELECT * FROM (VALUES (20), (60)) v(horizon_days)),
    late AS (SELECT s.security_id, h.horizon_days, CASE WHEN (h.horizon_days = 20 AND open20) OR (h.horizon_days = 60 AND open60) THEN 'open_position' WHEN s.security_id IN (SELECT security_id FROM pick) THEN NULL
        WHEN open20 AND open60 THEN NULL WHEN s.k > (SELECT full_at FROM lim) THEN 'selection_cap' ELSE 'cohort_cap' END AS reason FROM s, h)
    SELECT security_id, horizon_days, reason FROM f, h WHERE reason IS NOT NULL UNION ALL SELECT security_id, horizon_days, reason FROM late WHERE reason IS NOT NULL"""))
def suppressions(t):
    return _select(t)[1].select("security_id", "horizon_days", "reason")


@query("suppression_summary", "", _sql("scores", _SURV + " SELECT reason, count(DISTINCT security_id) AS securities, 2 * count(*) AS rows FROM f WHERE reason IS NOT NULL GROUP BY reason"))
def suppression_summary(t):
    from ..operators import report as REP

    out = REP.suppression_summary(_select(t)[1])
    return out.where(~F.col("reason").isin("open_position", "book_capacity", "selection_cap", "cohort_cap"))


@query("suppression_summary_all", "", _sql("scores", _SURV + """
    , h AS (SELECT * FROM (VALUES (20), (60)) v(horizon_days)),
    late AS (SELECT s.security_id, h.horizon_days, CASE WHEN (h.horizon_days = 20 AND open20) OR (h.horizon_days = 60 AND open60) THEN 'open_position' WHEN s.security_id IN (SELECT security_id FROM pick) THEN NULL
        WHEN open20 AND open60 THEN NULL WHEN s.k > (SELECT full_at FROM lim) THEN 'selection_cap' ELSE 'cohort_cap' END AS reason FROM s, h),
    every AS (SELECT security_id, reason FROM f, h WHERE reason IS NOT NULL UNION ALL SELECT security_id, reason FROM late WHERE reason IS NOT NULL)
    SELECT reason, count(DISTINCT security_id) AS securities, count(*) AS rows FROM every GROUP BY reason"""))
def suppression_summary_all(t):
    """All reasons; `suppression_summary` leaves out those that come after eligibility and cooldown."""
    from ..operators import report as REP

    return REP.suppression_summary(_select(t)[1])


@query("select_tight_books", "", _sql("scores", _SURV + """,
    greedy AS (WITH RECURSIVE w AS (
        SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS security_id, 1 AS r20, 2 AS r60, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS b20, CAST(NULL AS VARCHAR) AS b60, CAST(NULL AS VARCHAR) AS verdict
        UNION ALL
        SELECT k, security_id, CASE WHEN verdict = 'selected' AND b20 IS NULL THEN r20 - 1 ELSE r20 END, CASE WHEN verdict = 'selected' AND b60 IS NULL THEN r60 - 1 ELSE r60 END,
          CASE WHEN verdict = 'selected' THEN list_append(taken, cohort_id) ELSE taken END, b20, b60, verdict
        FROM (SELECT *, CASE WHEN b20 IS NOT NULL AND b60 IS NOT NULL THEN 'blocked' WHEN len(taken) >= 5 THEN 'selection_cap'
                WHEN len(list_filter(taken, lambda c: c = cohort_id)) >= 2 THEN 'cohort_cap' ELSE 'selected' END AS verdict
              FROM (SELECT s.k, s.security_id, s.cohort_id, w.r20, w.r60, w.taken, CASE WHEN s.open20 THEN 'open_position' WHEN w.r20 <= 0 THEN 'book_capacity' END AS b20,
                      CASE WHEN s.open60 THEN 'open_position' WHEN w.r60 <= 0 THEN 'book_capacity' END AS b60 FROM w JOIN s ON s.k = w.k + 1)))
      SELECT * FROM w WHERE k > 0),
    late AS (SELECT security_id, h AS horizon_days, coalesce(CASE WHEN h = 20 THEN b20 ELSE b60 END, CASE WHEN verdict IN ('selection_cap', 'cohort_cap') THEN verdict END) AS reason FROM greedy, (VALUES (20), (60)) v(h))
    SELECT security_id, h AS horizon_days, reason FROM f, (VALUES (20), (60)) v(h) WHERE reason IS NOT NULL UNION ALL SELECT security_id, horizon_days, reason FROM late WHERE reason IS NOT NULL"""))
def select_tight_books(t):
    return _select(t, {20: 1, 60: 2})[1].select("security_id", "horizon_days", "reason")


@query("threshold_sweep", "", _sql("scores", """
    th AS (SELECT * FROM range(50, 91, 5) r(threshold)),
    f AS (SELECT th.threshold, s.*, rankable AND model_applicable AND NOT dilution_disqualified AND dilution_score < 22 AND NOT high_going_concern AND NOT has_dilution_flag AND composite >= th.threshold AS ok FROM scores s, th),
    k AS (SELECT *, row_number() OVER (PARTITION BY threshold, cohort_id ORDER BY composite DESC, quality DESC, inputs_complete DESC, security_id) AS kc FROM f WHERE ok AND NOT (open20 AND open60)),
    pick AS (SELECT * FROM k WHERE kc <= 2 QUALIFY row_number() OVER (PARTITION BY threshold ORDER BY composite DESC, quality DESC, inputs_complete DESC, security_id) <= 5)
    SELECT CAST(th.threshold AS INTEGER) AS threshold, count(p.security_id) AS candidates, round(CASE WHEN count(p.security_id) > 0 THEN round(100 / count(p.security_id) + 4.0, 1) END, 6) AS weeks_to_100_20
    FROM th LEFT JOIN pick p USING (threshold) GROUP BY 1"""))
def threshold_sweep(t):
    return SEL.threshold_sweep(A.scores(t), {20: 100, 60: 100}).select("threshold", "candidates", "weeks_to_100_20")


@query("first_failure_checklist", "", _sql("scores", _SURV + """
    SELECT security_id, reason, CASE WHEN reason = 'not_rankable' THEN 1 WHEN reason = 'model_not_applicable' THEN 2 WHEN reason = 'dilution_disqualified' THEN 3 WHEN reason LIKE 'risk%' THEN 4 WHEN reason LIKE 'below%' THEN 5 ELSE 6 END AS passed
    FROM f WHERE reason IS NOT NULL"""))
def first_failure_checklist(t):
    from ..functions.text import checklist

    fail = F.coalesce(SEL.eligibility_failure(F.lit(55.0)), SEL.cooldown_failure(A.day("2000-01-25"), A.day("2000-01-20")))
    rows = A.scores(t).withColumn("reason", fail).where(F.col("reason").isNotNull())
    steps = F.filter(checklist("reason"), lambda s: s["state"] == "pass")
    return rows.select("security_id", "reason", F.size(steps).alias("passed"))


@query("freshness_gate", "runs", """
    , g AS (SELECT stage, max(finished_at) AS fin FROM runs WHERE status IN ('success', 'partial') AND finished_at IS NOT NULL GROUP BY 1),
    p AS (SELECT * FROM (VALUES ('symbol_master', 'fixture_load', 168), ('prices_daily', 'price_ingest', 72), ('fundamentals', 'fundamentals', 720), ('corporate_actions', 'price_ingest', 72), ('filings', 'sec_facts', 96), ('filings', 'insider', 96)) v(source, stage, sla))
    SELECT source, p.stage, strftime(fin, '%Y-%m-%d %H:%M:%S') AS last_success, CASE WHEN fin IS NULL THEN 'never succeeded' WHEN fin < TIMESTAMP '2024-01-30 21:00:00' THEN 'finished before the cutoff'
       WHEN date_sub('second', fin, TIMESTAMP '2024-02-05 00:00:00') / 3600.0 > sla THEN 'older than its budget' END AS failure FROM p LEFT JOIN g USING (stage)""")
def freshness_gate(t):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    out = SEL.pipeline_freshness(A.runs(t), ts("2024-01-30 21:00:00"), ts("2024-02-05 00:00:00"))
    return out.select("source", "stage", "last_success", "failure")


@query("permitted_horizons", "scores", """
    SELECT security_id, h AS horizon_days FROM scores, (VALUES (20), (60)) v(h) WHERE NOT ((h = 20 AND open20) OR (h = 60 AND open60))""")
def permitted_horizons(t):
    s = A.scores(t).withColumn("run_id", F.lit("r"))
    c = s.select(F.col("security_id").cast("string").alias("candidate_id"), "run_id", "security_id")
    blocked = s.select("run_id", "security_id", F.explode("open_horizons").alias("horizon_days"), F.lit("open_position").alias("reason"))
    return SEL.permitted_horizons(c, blocked, (20, 60)).select("security_id", "horizon_days")


_ENTRY = """
    nx AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM cal),
    tr AS (SELECT *, CASE WHEN p IS NOT NULL THEN greatest(high - low, abs(high - p), abs(low - p)) END AS tr FROM (SELECT *, lag(close) OVER (PARTITION BY security_id ORDER BY date) AS p FROM bars)),
    sig AS (SELECT security_id, date, close, CASE WHEN count(tr) OVER w = 14 THEN round(avg(tr) OVER w, 6) END AS atr, CASE WHEN count(*) OVER w20 = 20 THEN avg(close * volume) OVER w20 END AS adv
        FROM tr WINDOW w AS (PARTITION BY security_id ORDER BY date ROWS 13 PRECEDING), w20 AS (PARTITION BY security_id ORDER BY date ROWS 19 PRECEDING)),
    cand AS (SELECT * FROM sig),
    e AS (SELECT c.security_id, c.date AS cutoff, c.close AS prior_close, c.atr, c.adv, n.nxt, b.open AS eo, coalesce(s.ratio, 1.0) AS ratio FROM cand c JOIN nx n USING (date) LEFT JOIN bars b ON b.security_id = c.security_id AND b.date = n.nxt
        LEFT JOIN splits s ON s.security_id = c.security_id AND s.ex_date = n.nxt),
    d AS (SELECT *, eo - prior_close / ratio AS gap, CASE WHEN adv > 50000000 THEN 5.0 WHEN adv >= 500000 THEN 15.0 END AS bps FROM e),
    v AS (SELECT *, CASE WHEN nxt IS NULL OR nxt > DATE '2001-06-30' THEN 'not_yet_due' WHEN eo IS NULL OR atr IS NULL THEN 'no_regular_open' WHEN gap > atr THEN 'gap_above_prior_close' WHEN bps IS NULL THEN 'adv_below_protocol_bands' ELSE 'filled' END AS verdict FROM d)"""
_ENTRY_TABLES = "bars cal actions splits"


def _params():
    from dataclasses import replace

    from ..config import FROZEN

    return replace(FROZEN, adv_mid_liquidity=500_000.0)


def _bars(t):
    """Bars as the steps of a ledger query share them: entries, extremes and exits read one table."""
    return stored(t, "bars", lambda: A.bars(t))


def _candidates(t):
    sig = MOM.average_true_range(_bars(t), 14)
    return sig.select(
        F.concat_ws("-", "security_id", "date").alias("candidate_id"), "security_id", F.col("date").alias("price_data_cutoff"),
        F.col("close").alias("signal_close"), F.round("atr", 6).alias("atr_value"), F.lit(1.0).alias("gap_limit_atr"),
    )


def _decisions(t):
    return L.entry_decisions(_candidates(t), _bars(t), A.actions(t), A.day("2001-06-30"), _params())


@query("gap_entry", "", _sql(_ENTRY_TABLES, _ENTRY + """
    SELECT security_id, CAST(cutoff AS VARCHAR) AS price_data_cutoff, verdict, round(CASE WHEN verdict = 'filled' THEN eo * (1 + bps * 1e-4) END, 6) AS entry_price FROM v"""))
def gap_entry(t):
    verdict = F.when(F.col("outcome") == "cancelled", F.col("cancel_reason")).otherwise(F.col("outcome"))
    return _decisions(t).select("security_id", "price_data_cutoff", verdict.alias("verdict"), "entry_price")


@query("cancellation_rate", "", _sql(_ENTRY_TABLES, _ENTRY + """
    SELECT count(*) AS attempted, count(*) FILTER (verdict <> 'filled') AS cancelled, round(count(*) FILTER (verdict <> 'filled') / count(*), 6) AS cancellation_rate FROM v WHERE verdict <> 'not_yet_due'"""))
def cancellation_rate(t):
    return PERF.cancellation_rate(_decisions(t))


def _positions(t):
    def build():
        # read twice, as entries and horizons: only what positions are made of is stored
        held = ["candidate_id", "security_id", "outcome", "entry_session", "entry_price", "slippage_bps", "shares", "stop_price", "target_price"]
        d = stored(t, "decisions", lambda: _decisions(t).where(F.col("outcome") == "filled").select(*held))
        h = d.select("candidate_id", F.explode(F.array(F.lit(20), F.lit(60))).alias("horizon_days"))
        return L.open_positions(d, h, _params())

    return stored(t, "positions", build)


def _resolved(t):
    return L.resolve_positions(_positions(t), _bars(t), A.actions(t), A.securities(t), A.day("2001-06-30"))


_EXIT = _ENTRY + """,
    pos AS (SELECT security_id, nxt AS entry_date, h AS horizon, eo * (1 + bps * 1e-4) AS ep, bps, 1000 / (eo * (1 + bps * 1e-4)) AS sh, eo * (1 + bps * 1e-4) - 2 * atr AS stop, eo * (1 + bps * 1e-4) + 4 * atr AS target, c.session_no AS en
        FROM v JOIN cal c ON c.date = v.nxt, (VALUES (20), (60)) x(h) WHERE verdict = 'filled'),
    fz AS (SELECT p.security_id, p.entry_date, p.horizon, min(a.ex_date) AS frozen FROM pos p LEFT JOIN actions a ON a.security_id = p.security_id AND a.action_type = 'spinoff' AND a.ex_date > p.entry_date AND a.ex_date <= DATE '2001-06-30' GROUP BY 1, 2, 3),
    po AS (SELECT p.*, f.frozen, s.delisted_date AS gone, least(f.frozen, s.delisted_date) AS stop_at FROM pos p JOIN fz f USING (security_id, entry_date, horizon) JOIN securities s USING (security_id)),
    pb AS (SELECT p.*, b.date, b.open, b.high, b.low, b.close, c.session_no - p.en AS held,
          coalesce((SELECT product(s.ratio) FROM splits s WHERE s.security_id = p.security_id AND s.ex_date > p.entry_date AND s.ex_date <= b.date), 1.0) AS r
        FROM po p JOIN bars b ON b.security_id = p.security_id AND b.date > p.entry_date AND b.date <= DATE '2001-06-30' JOIN cal c ON c.date = b.date WHERE (p.stop_at IS NULL OR b.date < p.stop_at) AND c.session_no - p.en <= 200),
    ex AS (SELECT *, CASE WHEN open <= stop / r THEN 'gap_through_stop' WHEN open >= target / r THEN 'gap_through_target' WHEN low <= stop / r THEN 'stop' WHEN high >= target / r THEN 'target' WHEN held >= horizon THEN 'time_exit' END AS reason,
          CASE WHEN open <= stop / r THEN open WHEN open >= target / r THEN open WHEN low <= stop / r THEN stop / r WHEN high >= target / r THEN target / r ELSE close END AS raw FROM pb),
    fx AS (SELECT * FROM ex WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY security_id, entry_date, horizon ORDER BY date) = 1),
    res AS (SELECT p.security_id, p.entry_date, p.horizon, p.bps, p.ep, p.sh, p.gone, p.frozen, f.date AS exit_date, f.reason, f.raw, f.r FROM po p LEFT JOIN fx f USING (security_id, entry_date, horizon)),
    fin AS (SELECT *, reason IS NULL AND gone IS NOT NULL AND gone <= (SELECT max(date) FROM cal WHERE date <= DATE '2001-06-30') AND (frozen IS NULL OR gone <= frozen) AND (SELECT max(date) FROM cal WHERE date <= DATE '2001-06-30') > entry_date AS del FROM res)"""


@query("barrier_exit", "", _sql(_ENTRY_TABLES + " securities", _EXIT + """
    SELECT security_id, CAST(entry_date AS VARCHAR) AS entry_date, horizon AS horizon_days, CASE WHEN reason IS NOT NULL OR (del AND DATE '2001-06-30' - gone >= 180) THEN 'closed' WHEN del THEN 'pending_resolution' ELSE 'open' END AS status,
      CAST(CASE WHEN reason IS NOT NULL THEN exit_date WHEN del AND DATE '2001-06-30' - gone >= 180 THEN gone + 180 END AS VARCHAR) AS exit_date,
      CASE WHEN reason IS NOT NULL THEN reason WHEN del AND DATE '2001-06-30' - gone >= 180 THEN 'delisting_zero_after_180d' END AS exit_reason,
      round(CASE WHEN reason IS NOT NULL THEN raw * (1 - bps * 1e-4) WHEN del AND DATE '2001-06-30' - gone >= 180 THEN 0.0 END, 8) AS exit_price, reason IS NULL AND NOT del AND frozen IS NOT NULL AS requires_manual_review FROM fin"""), places=8)
def barrier_exit(t):
    return _resolved(t).select("security_id", "entry_date", "horizon_days", "status", "exit_date", "exit_reason", "exit_price", "requires_manual_review")


@query("position_pnl", "", _sql(_ENTRY_TABLES + " securities", _EXIT + """
    SELECT security_id, CAST(entry_date AS VARCHAR) AS entry_date, horizon AS horizon_days, round(sh * r * (raw * (1 - bps * 1e-4) - ep / r), 5) AS gross_pnl,
      round(coalesce((SELECT sum(a.cash_amount * sh * coalesce((SELECT product(s.ratio) FROM splits s WHERE s.security_id = fin.security_id AND s.ex_date > fin.entry_date AND s.ex_date <= a.ex_date), 1.0)) FROM actions a
        WHERE a.security_id = fin.security_id AND a.action_type = 'dividend' AND a.ex_date > fin.entry_date AND a.ex_date <= fin.exit_date), 0), 5) AS dividends_received FROM fin WHERE reason IS NOT NULL"""), places=5)
def position_pnl(t):
    r = _resolved(t).where(F.col("exit_reason") != "delisting_zero_after_180d")
    return r.select("security_id", "entry_date", "horizon_days", "gross_pnl", "dividends_received")


_CLOSED = _EXIT + """,
    closed AS (SELECT * REPLACE (CASE WHEN reason IS NOT NULL THEN exit_date ELSE gone + 180 END AS exit_date) FROM fin WHERE reason IS NOT NULL OR (del AND DATE '2001-06-30' - gone >= 180))"""


@query("position_pnl_all", "", _sql(_ENTRY_TABLES + " securities", _CLOSED + """
    SELECT security_id, CAST(entry_date AS VARCHAR) AS entry_date, horizon AS horizon_days, round(CASE WHEN reason IS NOT NULL THEN sh * r * (raw * (1 - bps * 1e-4) - ep / r) ELSE -sh * ep END, 5) AS gross_pnl,
      round(coalesce((SELECT sum(a.cash_amount * sh * coalesce((SELECT product(s.ratio) FROM splits s WHERE s.security_id = closed.security_id AND s.ex_date > closed.entry_date AND s.ex_date <= a.ex_date), 1.0)) FROM actions a
        WHERE a.security_id = closed.security_id AND a.action_type = 'dividend' AND a.ex_date > closed.entry_date AND a.ex_date <= closed.exit_date), 0), 5) AS dividends_received FROM closed"""), places=5)
def position_pnl_all(t):
    """Every closed position; `position_pnl` leaves out those closed at zero after a delisting."""
    r = _resolved(t).where(F.col("status") == "closed")
    return r.select("security_id", "entry_date", "horizon_days", "gross_pnl", "dividends_received")


@query("books", "",_sql(_ENTRY_TABLES + " securities", _EXIT + """
    SELECT horizon AS horizon_days, count(*) FILTER (reason IS NULL AND NOT del) AS open_position_count FROM fin GROUP BY 1"""))
def books(t):
    return L.books(_resolved(t), (20, 60)).select("horizon_days", "open_position_count")


@query("position_events")
def position_events(t):
    return L.position_events(_resolved(t), A.actions(t)).groupBy("action_type").agg(F.count("*").alias("n"), F.sum("cash_accrued").alias("cash"))


@query("position_events_all", "", _sql(_ENTRY_TABLES + " securities", _EXIT + """,
    he AS (SELECT *, CASE WHEN reason IS NOT NULL THEN exit_date WHEN del AND DATE '2001-06-30' - gone >= 180 THEN gone + 180 END AS ended FROM fin),
    ev AS (SELECT h.*, a.ex_date, a.action_type, a.cash_amount, coalesce((SELECT product(s.ratio) FROM splits s WHERE s.security_id = h.security_id AND s.ex_date > h.entry_date AND s.ex_date <= a.ex_date), 1.0) AS r1,
             coalesce((SELECT product(s.ratio) FROM splits s WHERE s.security_id = h.security_id AND s.ex_date > h.entry_date AND s.ex_date < a.ex_date), 1.0) AS r0
           FROM he h JOIN actions a ON a.security_id = h.security_id AND a.ex_date > h.entry_date AND (h.ended IS NULL OR a.ex_date <= h.ended))
    SELECT security_id, CAST(entry_date AS VARCHAR) AS entry_date, horizon AS horizon_days, CAST(ex_date AS VARCHAR) AS ex_date, action_type, round(CASE WHEN action_type = 'dividend' THEN cash_amount * sh * r1 ELSE 0.0 END, 5) AS cash_accrued,
      round(sh * r0, 5) AS shares_before, round(sh * r1, 5) AS shares_after, action_type IN ('split', 'dividend') AS entitled FROM ev"""), places=5)
def position_events_all(t):
    """Every action met by every position; `position_events` counts them by kind."""
    out = L.position_events(_resolved(t), A.actions(t), ["security_id", "entry_date", "horizon_days"])
    return out.select("security_id", "entry_date", "horizon_days", "ex_date", "action_type", "cash_accrued", "shares_before", "shares_after", "entitled")


@query("books_nav", "", _sql(_ENTRY_TABLES + " securities", _CLOSED + """,
    pn AS (SELECT horizon, CASE WHEN reason IS NOT NULL THEN sh * r * (raw * (1 - bps * 1e-4) - ep / r) ELSE -sh * ep END
      + coalesce((SELECT sum(a.cash_amount * sh * coalesce((SELECT product(s.ratio) FROM splits s WHERE s.security_id = closed.security_id AND s.ex_date > closed.entry_date AND s.ex_date <= a.ex_date), 1.0)) FROM actions a
        WHERE a.security_id = closed.security_id AND a.action_type = 'dividend' AND a.ex_date > closed.entry_date AND a.ex_date <= closed.exit_date), 0) AS net FROM closed),
    op AS (SELECT horizon, count(*) FILTER (reason IS NULL AND NOT (del AND DATE '2001-06-30' - gone >= 180) AND NOT del) AS n FROM fin GROUP BY 1)
    SELECT horizon AS horizon_days, n AS open_position_count, CAST(100 - n AS BIGINT) AS capacity, round(100000.0 + coalesce((SELECT sum(net) FROM pn WHERE pn.horizon = op.horizon), 0), 2) AS current_nav FROM op"""), places=2)
def books_nav(t):
    """Open count, room left and NAV of each book; `books` compares the count only."""
    return L.books(_resolved(t), (20, 60)).select("horizon_days", "open_position_count", "capacity", "current_nav")


@query("benchmark_pair", "", _sql(_ENTRY_TABLES + " securities bench", _EXIT + """,
    ba AS (SELECT date, CASE WHEN count(*) OVER w = 20 THEN avg(close * volume) OVER w END AS adv FROM bench WINDOW w AS (ORDER BY date ROWS 19 PRECEDING)),
    bp AS (SELECT f.security_id, f.entry_date, f.horizon, f.exit_date, b.open, CASE WHEN a.adv > 50000000 THEN 5.0 WHEN a.adv >= 500000 THEN 15.0 ELSE 5.0 END AS sl, c.close
        FROM (SELECT * FROM fin WHERE reason IS NOT NULL) f JOIN bench b ON b.date = f.entry_date ASOF LEFT JOIN ba a ON a.date < f.entry_date LEFT JOIN bench c ON c.date = f.exit_date)
    SELECT security_id, CAST(entry_date AS VARCHAR) AS entry_date, horizon AS horizon_days, round(1000 / (open * (1 + sl * 1e-4)) * (close * (1 - sl * 1e-4) - open * (1 + sl * 1e-4)), 6) AS benchmark_pnl FROM bp"""))
def benchmark_pair(t):
    r = _resolved(t).where((F.col("status") == "closed") & (F.col("exit_reason") != "delisting_zero_after_180d"))
    out = L.benchmark_positions(r, A.benchmark(_bars(t)), _params(), ["security_id"])
    return out.select("security_id", "entry_date", "horizon_days", F.col("net_pnl").alias("benchmark_pnl"))


@query("benchmark_pair_all", "", _sql(_ENTRY_TABLES + " securities bench", _CLOSED + """,
    ba AS (SELECT date, CASE WHEN count(*) OVER w = 20 THEN avg(close * volume) OVER w END AS adv FROM bench WINDOW w AS (ORDER BY date ROWS 19 PRECEDING)),
    bp AS (SELECT f.security_id, f.entry_date, f.horizon, b.open, CASE WHEN a.adv > 50000000 THEN 5.0 WHEN a.adv >= 500000 THEN 15.0 ELSE 5.0 END AS sl, c.close
        FROM closed f JOIN bench b ON b.date = f.entry_date ASOF LEFT JOIN ba a ON a.date < f.entry_date ASOF LEFT JOIN bench c ON c.date <= f.exit_date)
    SELECT security_id, CAST(entry_date AS VARCHAR) AS entry_date, horizon AS horizon_days, round(1000 / (open * (1 + sl * 1e-4)) * (close * (1 - sl * 1e-4) - open * (1 + sl * 1e-4)), 6) AS benchmark_pnl FROM bp"""))
def benchmark_pair_all(t):
    """Every closed position; `benchmark_pair` leaves out those closed at zero after a delisting."""
    r = _resolved(t).where(F.col("status") == "closed")
    out = L.benchmark_positions(r, A.benchmark(_bars(t)), _params(), ["security_id"])
    return out.select("security_id", "entry_date", "horizon_days", F.col("net_pnl").alias("benchmark_pnl"))


@query("wilson", "trades","""
    , s AS (SELECT horizon_days, count(*) AS n, count(*) FILTER (net_pnl > 0) AS wins FROM trades GROUP BY 1), q AS (SELECT *, wins / n AS p, 1.959963985 * 1.959963985 AS z2 FROM s)
    SELECT horizon_days, n, wins, round((p + z2 / (2 * n) - 1.959963985 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n), 6) AS wilson_lower,
      round((p + z2 / (2 * n) + 1.959963985 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n), 6) AS wilson_upper FROM q""")
def wilson(t):
    return PERF.win_loss(A.trades(t)).select("horizon_days", "n", "wins", "wilson_lower", "wilson_upper")


@query("profit_factor", "trades", """
    SELECT horizon_days, count(*) FILTER (net_pnl < 0) AS losses, round(avg(net_pnl) FILTER (net_pnl > 0), 4) AS avg_win, round(avg(net_pnl) FILTER (net_pnl < 0), 4) AS avg_loss,
      round(sum(net_pnl) FILTER (net_pnl > 0) / abs(sum(net_pnl) FILTER (net_pnl < 0)), 6) AS profit_factor FROM trades GROUP BY 1""")
def profit_factor(t):
    return PERF.win_loss(A.trades(t)).select("horizon_days", "losses", F.round("avg_win", 4).alias("avg_win"), F.round("avg_loss", 4).alias("avg_loss"), "profit_factor")


@query("drawdown", "trades", """
    , c AS (SELECT *, 100000 + sum(CAST(net_pnl AS DECIMAL(28,6))) OVER (PARTITION BY horizon_days ORDER BY exit_date, trade_id) AS nav FROM trades),
    d AS (SELECT *, greatest(100000, max(nav) OVER (PARTITION BY horizon_days ORDER BY exit_date, trade_id)) AS peak FROM c)
    SELECT horizon_days, round(CAST(peak - nav AS DOUBLE) / 100000, 6) AS drawdown_pct, round(CAST(nav AS DOUBLE), 2) AS trough_nav, round(CAST(peak AS DOUBLE), 2) AS peak_nav
    FROM d QUALIFY row_number() OVER (PARTITION BY horizon_days ORDER BY peak - nav DESC, exit_date, trade_id) = 1""")
def drawdown(t):
    d = PERF.max_drawdown(A.trades(t))
    return d.select("horizon_days", "drawdown_pct", F.round("trough_nav", 2).alias("trough_nav"), F.round("peak_nav", 2).alias("peak_nav"))


@query("equity_curve", "trades", """
    SELECT trade_id, horizon_days, round(CAST(100000 + sum(CAST(net_pnl AS DECIMAL(28,6))) OVER (PARTITION BY horizon_days ORDER BY exit_date, trade_id) AS DOUBLE), 2) AS nav FROM trades""", places=2)
def equity_curve(t):
    return PERF.equity_curve(A.trades(t)).select("trade_id", "horizon_days", F.col("nav").cast("double").alias("nav"))


@query("concentration", "trades", """
    SELECT horizon_days, cohort_id, count(*) AS trades, round(count(*) / sum(count(*)) OVER (PARTITION BY horizon_days), 6) AS share FROM trades GROUP BY 1, 2""")
def concentration(t):
    return PERF.concentration(A.trades(t))


@query("observation_window", "trades", 'SELECT horizon_days, CAST(min(exit_date) AS VARCHAR) AS start, CAST(max(exit_date) AS VARCHAR) AS "end" FROM trades GROUP BY 1')
def observation_window(t):
    return PERF.observation_window(A.trades(t))


@query("pending_views", "trades", """
    , v AS (SELECT 'excluding_pending' AS view, horizon_days, net_pnl FROM trades UNION ALL SELECT 'including_pending', horizon_days, net_pnl FROM trades UNION ALL SELECT 'including_pending', 20, -1000 FROM customer)
    SELECT view, horizon_days, count(*) AS n, round(sum(net_pnl), 2) AS net_pnl FROM v GROUP BY 1, 2""", places=2)
def pending_views(t):
    p = t.customer.select(F.col("c_custkey").alias("trade_id"), F.lit(0.0).alias("dividends_received"), F.lit(1000.0).alias("notional"), F.lit(None).cast("string").alias("cohort_id"), F.lit(20).alias("horizon_days"))
    return PERF.with_pending(A.trades(t), p, A.day("2002-01-01")).groupBy("view", "horizon_days").agg(F.count("*").alias("n"), F.sum("net_pnl").alias("net_pnl"))


@query("evidence_band", "", """
    SELECT o_custkey, count(*) AS n, CASE WHEN count(*) * 9 < 30 THEN 'insufficient' WHEN count(*) * 9 < 100 THEN 'preliminary' WHEN date_sub('month', CAST(min(o_orderdate) AS DATE), DATE '2000-01-01') >= 12 THEN 'evaluation_possible' ELSE 'preliminary' END AS band FROM orders GROUP BY 1""")
def evidence_band(t):
    g = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("_s"))
    return g.select("o_custkey", "n", PERF.evidence_band(F.col("n") * 9, F.col("_s"), A.day("2000-01-01")).alias("band"))


@query("symbol_at_date", "listings bars", """
    , q AS (SELECT DISTINCT 'R' || (security_id // 2) AS symbol, date FROM bars)
    SELECT q.symbol, CAST(q.date AS VARCHAR) AS as_of, arg_max(l.security_id, (CAST(l.is_primary AS INTEGER), l.valid_from, -l.security_id)) AS security_id
    FROM q LEFT JOIN listings l ON l.symbol = q.symbol AND l.valid_from <= q.date AND (l.valid_to IS NULL OR l.valid_to > q.date) GROUP BY 1, 2""")
def symbol_at_date(t):
    q = A.bars(t).select(F.concat(F.lit("R"), F.expr("security_id div 2").cast("string")).alias("symbol"), F.col("date").alias("as_of")).distinct()
    return asof.symbol_at(q, A.listings(t)).select("symbol", "as_of", "security_id")


@query("scd2_update", "listings", """
    SELECT security_id, symbol, CAST(valid_from AS VARCHAR) AS valid_from, CAST(CASE WHEN valid_to IS NULL AND security_id % 2 = 0 THEN DATE '2002-01-01' ELSE valid_to END AS VARCHAR) AS valid_to FROM listings
    UNION ALL SELECT s_suppkey, 'N' || s_suppkey, '2002-01-01', NULL FROM supplier WHERE s_suppkey % 2 = 0""")
def scd2_update(t):
    k = F.col("s_suppkey")
    inc = t.supplier.select(k.alias("security_id"), F.concat(F.when(k % 2 == 0, "n").otherwise("t"), k.cast("string")).alias("symbol"), F.lit("NYSE").alias("exchange"), A.day("2002-01-01").alias("valid_from"))
    return asof.scd2_apply(A.listings(t), inc).select("security_id", "symbol", "valid_from", "valid_to")


@query("soft_delete", "listings securities", """
    SELECT l.security_id, l.symbol, CAST(coalesce(l.valid_to, s.delisted_date) AS VARCHAR) AS valid_to FROM listings l JOIN securities s USING (security_id)""")
def soft_delete(t):
    gone = A.securities(t).where(F.col("delisted_date").isNotNull()).select("security_id", "delisted_date")
    return asof.mark_delisted(A.securities(t), A.listings(t), gone)[1].select("security_id", "symbol", "valid_to")


@query("current_symbol", "listings securities", "SELECT s.security_id, s.name, coalesce(l.symbol, s.cik) AS symbol FROM securities s LEFT JOIN listings l ON l.security_id = s.security_id AND l.valid_to IS NULL")
def current_symbol(t):
    return asof.with_current_symbol(A.securities(t), A.listings(t), "cik").select("security_id", "name", "symbol")


@query("latest_state", "", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def latest_state(t):
    return asof.latest_per_key(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], [F.col("turn")])


@query("latest_set", "", "SELECT event_id, user_id FROM (SELECT *, max(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS m FROM events) WHERE CAST(ts AS DATE) = m")
def latest_set(t):
    e = t.events.select("event_id", "user_id", F.col("ts").cast("date").alias("d"))
    return asof.latest_set(e, ["user_id"], "d").select("event_id", "user_id")


@query("issuer_attribution", "listings securities", """
    SELECT o_orderkey, coalesce((SELECT min(l.security_id) FROM listings l WHERE l.valid_to IS NULL AND l.symbol = 'T' || (o_custkey % 40)), (SELECT min(s.security_id) FROM securities s WHERE s.security_type = 'common_stock' AND s.cik = lpad(CAST(o_custkey % 90 AS VARCHAR), 10, '0'))) AS security_id FROM orders""".replace("'T' || (o_custkey % 40)", "CASE WHEN o_custkey % 3 = 0 THEN 'T' || (o_custkey % 40) ELSE 'none' END"))
def issuer_attribution(t):
    k = F.col("o_custkey")
    f = t.orders.select("o_orderkey", F.when(k % 3 == 0, F.concat(F.lit(" t"), (k % 40).cast("string"))).otherwise("none").alias("issuer_symbol"), (k % 90).cast("string").alias("issuer_cik"))
    return asof.attribute_issuer(f, A.listings(t), A.securities(t)).select("o_orderkey", "security_id")


@query("rank_exclusion", "securities", """
    SELECT security_id, CASE WHEN security_type = 'unknown' THEN 'unknown classification' WHEN security_type <> 'common_stock' THEN 'not common stock: ' || security_type WHEN classification_confidence NOT IN ('high', 'medium') THEN 'low confidence: ' || classification_confidence END AS reason FROM securities""")
def rank_exclusion(t):
    from ..functions.text import rank_exclusion_reason

    return A.securities(t).select("security_id", rank_exclusion_reason("security_type", "classification_confidence").alias("reason"))


@query("classify_listing", "securities", "SELECT security_id, security_type, CASE WHEN security_id % 10 = 3 THEN 'A' WHEN security_id % 10 = 4 THEN 'B' END AS share_class, classification_confidence AS confidence FROM securities")
def classify_listing(t):
    from ..functions.text import classify_listing as classify

    c = classify("name", F.lit(False), F.lit(False))
    return A.securities(t).select("security_id", c["security_type"].alias("security_type"), c["share_class"].alias("share_class"), c["confidence"].alias("confidence"))


@query("sic_cohort", "securities", """
    SELECT security_id, CASE WHEN m BETWEEN 1 AND 9 THEN 'SIC-A' WHEN m BETWEEN 10 AND 14 THEN 'SIC-B' WHEN m BETWEEN 15 AND 17 THEN 'SIC-C' WHEN m BETWEEN 20 AND 39 THEN 'SIC-D' WHEN m BETWEEN 40 AND 49 THEN 'SIC-E' WHEN m BETWEEN 50 AND 51 THEN 'SIC-F'
      WHEN m BETWEEN 52 AND 59 THEN 'SIC-G' WHEN m BETWEEN 60 AND 67 THEN 'SIC-H' WHEN m BETWEEN 70 AND 89 THEN 'SIC-I' WHEN m BETWEEN 91 AND 99 THEN 'SIC-J' ELSE 'SIC-UNKNOWN' END AS cohort_id
    FROM (SELECT security_id, CAST(substr(sic_code, 1, 2) AS INTEGER) AS m FROM securities)""")
def sic_cohort(t):
    from ..functions.text import cohort_id

    return A.securities(t).select("security_id", cohort_id("sic_code").alias("cohort_id"))


@query("union_evaluate", "", """
    SELECT DISTINCT k AS security_id FROM (SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT l_suppkey FROM lineitem UNION ALL SELECT user_id FROM events WHERE event_type = 'purchase')""")
def union_evaluate(t):
    pool = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("security_id"), F.lit("p").alias("pool_version"))
    manifest = t.lineitem.select(F.col("l_suppkey").alias("security_id"))
    extra = t.events.where(F.col("event_type") == "purchase").select(F.col("user_id").alias("security_id"))
    none = t.region.where("r_regionkey < 0")
    snaps = none.select(F.col("r_regionkey").cast("bigint").alias("security_id"), F.lit("x").alias("status"), A.day("2000-01-01").alias("snapshot_date"), F.lit("s").alias("snapshot_id"))
    pos = none.select(F.lit("c").alias("candidate_id"), F.lit("open").alias("status"))
    cand = none.select(F.lit("c").alias("candidate_id"), F.col("r_regionkey").cast("bigint").alias("security_id"))
    return U.securities_to_evaluate(pool, manifest, snaps, pos, cand, extra)


@query("hysteresis", "", """
    , g AS (SELECT *, sum(CASE WHEN below THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY d) AS blk FROM s)
    SELECT user_id, CAST(d AS VARCHAR) AS d, CAST(sum(CAST(below AS INTEGER)) OVER (PARTITION BY user_id, blk ORDER BY d) AS BIGINT) AS days_below FROM g""".replace(", g AS", "WITH s AS (SELECT user_id, CAST(ts AS DATE) AS d, max(value) < 100 AS below FROM events GROUP BY 1, 2), g AS", 1))
def hysteresis(t):
    d = t.events.groupBy("user_id", F.col("ts").cast("date").alias("d")).agg((F.max("value") < 100).alias("below"))
    return U.hysteresis_history(d, ("user_id",), "d").select("user_id", "d", "days_below")
