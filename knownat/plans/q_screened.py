"""Screened rows on tables computed from bars, filings, facts and positions, and the selection that they feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import core as C, metrics as M, text as T
from ..operators import asof, dilution as DIL, ranking as R, risk as RK, selection as SEL
from . import adapters as A
from .q_flags import NEEDED
from .q_states import _POS, _cancelled, _candidates, _positions
from .registry import query, stored

SESSION = "2001-06-29"
EXITS, PAUSES = "2001-06-15", "2001-06-26"


def _filings(t):
    """Ten documents a security, dated so that the newest lie before the session."""
    own = F.lpad(F.expr("CAST(doc_id div 10 + 1 AS STRING)"), 10, "0")
    return A.filings(t).withColumns({"cik": own, "filed_date": F.date_sub("filed_date", 8036), "primary_doc_url": F.lit("u")})


def _scores(t):
    """Scores of the session: percentiles of the shares traded and of the sessions traded in ninety days, as whole numbers."""
    on = A.day(SESSION)
    b = A.bars(t).where((F.col("date") <= on) & (F.col("date") > F.date_sub(on, 90)))
    m = stored(t, "quarter", lambda: b.groupBy("security_id").agg(F.sum("volume").alias("v"), F.count("*").alias("n")))
    placed = R.midrank(R.midrank(m, "v", [], "v_"), "n", [], "n_")
    ids = A.securities(t).select("security_id", T.cohort_id("sic_code").alias("cohort_id"))
    out = placed.select("security_id", F.col("v_pct").alias("composite_score"), F.col("n_pct").alias("quality_score"), (F.col("n") >= 5).alias("rankable"))
    out = R.competition_rank(stored(t, "placed", lambda: out), "composite_score")
    return out.join(ids, "security_id").withColumn("score_date", on)


def _evidence(t):
    on = A.day(SESSION)
    return stored(t, "evidence", lambda: DIL.evidence(DIL.candidate_filings(_filings(t), on), on).drop("text"))


def _flags(t):
    """Flags of seven in eight securities: the screening of the others has not been run."""
    on, ids = A.day(SESSION), A.securities(t).where("security_id % 8 <> 0")
    filings = _filings(t)
    periodic = filings.where(F.col("form_type").isin("10-K", "10-Q"))
    doubts = RK.going_concern_flags(ids, filings, RK.going_concern(periodic), on)
    stacked = RK.union_flags(on, RK.dilution_flags(ids, _evidence(t)), RK.reverse_splits(ids, A.actions(t), on), doubts)
    return stacked.select("security_id", "as_of_date", "flag.flag_code", "flag.severity")


def _signals(t):
    """Signals of eight in nine securities."""
    growth = t.supplier.where("s_suppkey % 9 <> 0").select(
        F.col("s_suppkey").alias("security_id"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik"), (F.col("s_acctbal") / 10000).alias("shares_yoy_growth")
    )
    return DIL.score(_evidence(t), growth).withColumn("as_of_date", A.day(SESSION))


def _states(t):
    """Knowledge states: a period of a company at each acceptance, complete if all needed concepts came with it."""
    whole = F.count_distinct(F.when(F.col("concept").isin(*NEEDED), F.col("concept"))) == len(NEEDED)
    known = A.facts(t).where("accepted_at IS NOT NULL").groupBy("cik", "period_end", F.col("accepted_at").alias("knowledge_date")).agg(whole.cast("int").alias("inputs_complete"))
    ids = A.companies(t).select("cik", "security_id", M.model_applicable("sic_code")["applicable"].alias("model_applicable"))
    return known.join(ids, "cik")


def _screened(t):
    def build():
        open_now = A.listings(t).where("security_id % 12 <> 5")
        universe = A.securities(t).select("security_id").join(asof.current_symbol(open_now), "security_id", "left")
        who = _candidates(t)
        return SEL.screened_rows(
            universe, _scores(t), _flags(t), _signals(t), _states(t), SEL.with_security(_positions(t), who),
            SEL.with_security(_cancelled(t), who), A.day(SESSION), C.session_close_utc(F.lit(SESSION)),
        )

    return stored(t, "screened", build)


_TABLES = "bars listings actions splits securities filings concepts facts companies"
_ROWS = "," + _POS + """,
    q AS (SELECT security_id, sum(volume) AS v, count(*) AS n FROM bars WHERE date <= DATE '2001-06-29' AND date > DATE '2001-06-29' - 90 GROUP BY 1),
    sc AS (SELECT security_id, n >= 5 AS rankable,
        CASE WHEN count(*) OVER () > 1 THEN 100.0 * ((rank() OVER (ORDER BY v) - 1) + (count(*) OVER (PARTITION BY v) - 1) / 2.0) / (count(*) OVER () - 1) END AS composite,
        CASE WHEN count(*) OVER () > 1 THEN 100.0 * ((rank() OVER (ORDER BY n) - 1) + (count(*) OVER (PARTITION BY n) - 1) / 2.0) / (count(*) OVER () - 1) END AS quality,
        CASE WHEN count(*) OVER () > 1 THEN rank() OVER (ORDER BY v DESC) END AS rank FROM q),
    sf AS (SELECT * REPLACE (lpad(CAST(doc_id // 10 + 1 AS VARCHAR), 10, '0') AS cik, filed_date - 8036 AS filed_date) FROM filings),
    kf AS (SELECT *, CASE WHEN form_type IN ('S-3', 'S-1') THEN 0 WHEN form_type = '424B5' THEN 1 ELSE 2 END AS g FROM sf
         WHERE (form_type IN ('S-3', 'S-1') AND filed_date BETWEEN DATE '2001-06-29' - 1095 AND DATE '2001-06-29') OR (form_type IN ('424B2', '424B5') AND filed_date BETWEEN DATE '2001-06-29' - 365 AND DATE '2001-06-29')),
    cf AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY g, filed_date DESC, accession_no) AS read_order FROM kf),
    ev AS (SELECT *, CASE WHEN contains(text, 'floating conversion terms') THEN 'variable_convertible' WHEN contains(text, 'senior notes due 2030') THEN 'debt_or_structured' WHEN contains(text, 'an at-the-market offering') THEN 'atm_programme'
         WHEN g = 0 AND contains(text, 'under Rule 415') THEN 'shelf_415' WHEN (contains(text, 'under Rule 415') OR contains(text, 'resale of ordinary shares')) THEN 'equity_offering' ELSE 'unknown' END AS outcome FROM cf),
    et AS (SELECT *, CASE WHEN g > 0 AND outcome IN ('equity_offering', 'atm_programme', 'variable_convertible') THEN 1 ELSE 0 END AS taken FROM ev),
    ex AS (SELECT cik, bool_or(outcome = 'shelf_415') AS sh, sum(taken) AS td, bool_or(outcome = 'atm_programme') AS atm, bool_or(outcome = 'variable_convertible') AS vc,
        arg_min(outcome, read_order) FILTER (outcome IN ('atm_programme', 'variable_convertible')) AS st FROM et GROUP BY cik),
    gn AS (SELECT cik, form_type, arg_max(text, (filed_date, accession_no)) AS text FROM sf WHERE form_type IN ('10-K', '10-Q') AND filed_date <= DATE '2001-06-29' GROUP BY 1, 2),
    gd AS (SELECT cik, contains(text, 'substantial doubt was alleviated') AS eased, form_type FROM gn WHERE contains(text, 'These conditions raise substantial doubt') OR contains(text, 'substantial doubt was alleviated')),
    gc AS (SELECT cik, NOT arg_min(eased, form_type) AS doubt FROM gd GROUP BY 1),
    fl AS (SELECT s.security_id, coalesce(td >= 3, false) AS issuing, coalesce(st = 'variable_convertible', false) AS converting, coalesce(doubt, false) AS doubt FROM securities s LEFT JOIN ex USING (cik) LEFT JOIN gc USING (cik) WHERE s.security_id % 8 <> 0),
    dl AS (SELECT s_suppkey AS security_id, least(30.0, CASE WHEN coalesce(sh, false) THEN 4.0 ELSE 0.0 END + CASE WHEN td >= 3 THEN 10.0 WHEN td = 2 THEN 7.0 WHEN td = 1 THEN 4.0 ELSE 0.0 END
        + CASE WHEN coalesce(vc, false) THEN 8.0 WHEN coalesce(atm, false) THEN 4.0 ELSE 0.0 END + 12.0 * least(greatest((s_acctbal / 10000 - 0.05) / 0.35, 0), 1)) AS score
        FROM supplier LEFT JOIN ex ON cik = lpad(CAST(s_suppkey AS VARCHAR), 10, '0') WHERE s_suppkey % 9 <> 0),
    ks AS (SELECT cik, period_end, accepted_at, count(DISTINCT concept) FILTER (concept IN ('Assets', 'Liabilities', 'NetIncomeLoss')) = 3 AS complete FROM facts WHERE accepted_at <= TIMESTAMP '2001-06-29 20:00:00' GROUP BY 1, 2, 3),
    fu AS (SELECT cik, arg_max(complete, (period_end, accepted_at)) AS complete FROM ks GROUP BY 1),
    ap AS (SELECT c.security_id, complete, NOT CAST(sic_code AS INTEGER) BETWEEN 6000 AND 6799 AS applicable FROM companies c JOIN fu USING (cik)),
    px AS (SELECT security_id, max(exit_date) FILTER (status = 'closed' AND exit_date <= DATE '2001-06-29') AS last_exit, bool_or(status = 'open' AND horizon_days = 20) AS open20, bool_or(status = 'open' AND horizon_days = 60) AS open60 FROM pos JOIN can USING (candidate_id) GROUP BY 1),
    cn AS (SELECT security_id, max(CAST(cancelled_at AS DATE)) AS last_cancel FROM cx JOIN can USING (candidate_id) WHERE CAST(cancelled_at AS DATE) <= DATE '2001-06-29' GROUP BY 1),
    sr AS (SELECT u.security_id, CASE WHEN u.security_id % 12 = 5 THEN CAST(u.security_id AS VARCHAR) ELSE 'T' || u.security_id END AS symbol,
        CASE WHEN sc.security_id IS NOT NULL AND division IS NOT NULL THEN 'SIC-' || division ELSE 'SIC-UNKNOWN' END AS cohort_id, coalesce(rankable, false) AS rankable, coalesce(applicable, false) AS model_applicable,
        composite, rank, quality, CAST(coalesce(complete, false) AS INTEGER) AS inputs_complete, dl.score AS dilution_score, coalesce(dl.score >= 22, false) AS dilution_disqualified,
        coalesce(doubt, false) AS high_going_concern, concat_ws(',', CASE WHEN issuing THEN 'active_issuance' END, CASE WHEN converting THEN 'atm_or_convertible' END) AS high_dilution_flags,
        last_exit AS last_exit_session, last_cancel AS last_gap_cancel_session, coalesce(open20, false) AS open20, coalesce(open60, false) AS open60,
        concat_ws(',', CASE WHEN dl.security_id IS NULL THEN 'dilution_signals' END, CASE WHEN fl.security_id IS NULL THEN 'risk_flags' END) AS missing
      FROM (SELECT *, CAST(left(sic_code, 2) AS INTEGER) AS d FROM securities) u LEFT JOIN sc USING (security_id) LEFT JOIN fl USING (security_id) LEFT JOIN dl USING (security_id)
        LEFT JOIN ap USING (security_id) LEFT JOIN px USING (security_id) LEFT JOIN cn USING (security_id)
        LEFT JOIN (VALUES (1, 9, 'A'), (10, 14, 'B'), (15, 17, 'C'), (20, 39, 'D'), (40, 49, 'E'), (50, 51, 'F'), (52, 59, 'G'), (60, 67, 'H'), (70, 89, 'I'), (91, 99, 'J')) v(lo, hi, division) ON d BETWEEN lo AND hi)"""


@query("screened_rows", _TABLES, _ROWS + """
    SELECT security_id, symbol, cohort_id, rankable, model_applicable, round(composite, 6) AS composite, rank, round(quality, 6) AS quality, inputs_complete, round(dilution_score, 6) AS dilution_score, dilution_disqualified, high_going_concern, high_dilution_flags,
      CAST(last_exit_session AS VARCHAR) AS last_exit_session, CAST(last_gap_cancel_session AS VARCHAR) AS last_gap_cancel_session, concat_ws(',', CASE WHEN open20 THEN '20' END, CASE WHEN open60 THEN '60' END) AS open_horizons, missing FROM sr""")
def screened_rows(t):
    """Every security with what five computed sources say of it at the session, screened or not."""
    rows = _screened(t).drop("screened")
    return rows.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("high_dilution_flags", "open_horizons", "missing")})


@query("screened_selection", _TABLES, _ROWS + """,
    f AS (SELECT *, CASE WHEN missing <> '' THEN 'dilution_or_riskflags_unknown' WHEN NOT rankable THEN 'not_rankable' WHEN NOT model_applicable THEN 'model_not_applicable' WHEN dilution_disqualified OR dilution_score >= 22 THEN 'dilution_disqualified'
             WHEN high_going_concern THEN 'risk_flag_going_concern' WHEN high_dilution_flags <> '' THEN 'risk_flag_dilution_disqualify' WHEN composite IS NULL OR composite < 55 THEN 'below_composite_threshold'
             WHEN last_exit_session > DATE '2001-06-15' THEN 'cooldown_recent_exit' WHEN last_gap_cancel_session > DATE '2001-06-26' THEN 'cooldown_gap_cancelled' END AS reason FROM sr),
    s AS (SELECT *, row_number() OVER (ORDER BY composite DESC, quality DESC, inputs_complete DESC, security_id) AS k FROM f WHERE reason IS NULL),
    live AS (SELECT *, row_number() OVER (PARTITION BY cohort_id ORDER BY k) AS kc FROM s WHERE NOT (open20 AND open60)),
    pick AS (SELECT *, row_number() OVER (ORDER BY k) AS place FROM live WHERE kc <= 2 QUALIFY place <= 5),
    lim AS (SELECT CASE WHEN count(*) = 5 THEN max(k) END AS full_at FROM pick),
    h AS (SELECT * FROM (VALUES (20), (60)) v(horizon_days)),
    late AS (SELECT s.security_id, h.horizon_days, CASE WHEN (h.horizon_days = 20 AND open20) OR (h.horizon_days = 60 AND open60) THEN 'open_position' WHEN s.security_id IN (SELECT security_id FROM pick) THEN 'selected'
        WHEN open20 AND open60 THEN NULL WHEN s.k > (SELECT full_at FROM lim) THEN 'selection_cap' ELSE 'cohort_cap' END AS reason FROM s, h)
    SELECT security_id, horizon_days, reason FROM f, h WHERE reason IS NOT NULL UNION ALL SELECT security_id, horizon_days, reason FROM late WHERE reason IS NOT NULL""")
def screened_selection(t):
    """The selection over screened rows: what became of every security in every horizon, unscreened ones included."""
    judged, rest = SEL.load_rows(_screened(t))
    picked, dropped = SEL.select(judged, {20: 100, 60: 100}, A.day(EXITS), A.day(PAUSES))
    free = F.array_except(F.array(F.lit(20), F.lit(60)), "open_horizons")
    won = picked.select("security_id", F.explode(free).alias("horizon_days"), F.lit("selected").alias("reason"))
    unknown = SEL.suppress_all(rest, (20, 60), "dilution_or_riskflags_unknown")
    return won.unionByName(dropped.select(*won.columns)).unionByName(unknown.select(*won.columns))
