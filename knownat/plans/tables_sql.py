"""Common tables of the reference SQL: the adapters of `adapters.py` once more, in SQL."""

CONCEPT_ROWS = (
    # taxonomy, concept, duration?, coefficient, spread multiplier, absent when (key + spread) % absent = 0
    ("us-gaap", "Revenues", 1, 1.0, 3, 19),
    ("us-gaap", "RevenueFromContractWithCustomerExcludingAssessedTax", 1, 1.02, 5, 3),
    ("us-gaap", "CostOfRevenue", 1, 0.6, 11, 17),
    ("us-gaap", "GrossProfit", 1, 0.41, 13, 2),
    ("us-gaap", "NetIncomeLoss", 1, 0.1, 17, 29),
    ("us-gaap", "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest", 1, 0.13, 19, 13),
    ("us-gaap", "IncomeTaxExpenseBenefit", 1, 0.03, 23, 11),
    ("us-gaap", "EarningsPerShareDiluted", 1, 0.00002, 29, 5),
    ("us-gaap", "OperatingIncomeLoss", 1, 0.15, 31, 23),
    ("us-gaap", "DepreciationDepletionAndAmortization", 1, 0.04, 37, 31),
    ("us-gaap", "InterestExpense", 1, 0.01, 41, 7),
    ("us-gaap", "NetCashProvidedByUsedInOperatingActivities", 1, 0.12, 43, 37),
    ("us-gaap", "PaymentsToAcquirePropertyPlantAndEquipment", 1, 0.05, 47, 41),
    ("us-gaap", "StockholdersEquity", 0, 0.5, 53, 43),
    ("us-gaap", "Assets", 0, 1.2, 59, 47),
    ("us-gaap", "Liabilities", 0, 0.7, 61, 53),
    ("us-gaap", "AssetsCurrent", 0, 0.4, 67, 59),
    ("us-gaap", "LiabilitiesCurrent", 0, 0.25, 71, 61),
    ("us-gaap", "CashAndCashEquivalentsAtCarryingValue", 0, 0.1, 73, 67),
    ("us-gaap", "DebtCurrent", 0, 0.05, 79, 5),
    ("us-gaap", "LongTermDebtNoncurrent", 0, 0.2, 83, 71),
    ("us-gaap", "RetainedEarningsAccumulatedDeficit", 0, 0.3, 89, 73),
    ("dei", "EntityCommonStockSharesOutstanding", 0, 0.02, 97, 79),
)
_CONCEPT_VALUES = ", ".join(f"('{t}', '{c}', {d}, CAST({k!r} AS DOUBLE), {m}, {a})" for t, c, d, k, m, a in CONCEPT_ROWS)

CTES = {
    "bars": """
        SELECT l_suppkey AS security_id, CAST(l_shipdate AS DATE) AS date,
               first(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS open,
               max(l_extendedprice) AS high, min(l_extendedprice * (1 - l_discount)) AS low,
               last(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS close,
               CAST(sum(l_quantity) AS BIGINT) AS volume
        FROM lineitem GROUP BY 1, 2""",
    "bench": """
        SELECT date, (sum(CAST(round(close * 100) AS BIGINT)) // count(*)) / 100.0 AS close,
               (sum(CAST(round(open * 100) AS BIGINT)) // count(*)) / 100.0 AS open,
               CAST(sum(volume) AS BIGINT) AS volume
        FROM bars GROUP BY date""",
    "cal": "SELECT date, row_number() OVER (ORDER BY date) AS session_no FROM (SELECT DISTINCT date FROM bars)",
    "actions": """
        SELECT s_suppkey AS security_id, DATE '1996-01-01' + CAST(s_suppkey * 37 % 1800 AS INTEGER) AS ex_date, 'split' AS action_type,
               CASE s_suppkey % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 3.0 WHEN 2 THEN 0.5 ELSE 1.5 END::DOUBLE AS ratio,
               NULL::DOUBLE AS cash_amount, s_suppkey % 11 = 0 AS requires_manual_review FROM supplier
        UNION ALL SELECT s_suppkey, DATE '2001-06-01' + CAST(s_suppkey * 53 % 150 AS INTEGER), 'split', 2.0::DOUBLE, NULL, false FROM supplier
        UNION ALL SELECT s_suppkey, DATE '1996-03-01' + CAST(s_suppkey * 29 % 1900 AS INTEGER), 'dividend', NULL, (1 + s_suppkey % 7)::DOUBLE, false FROM supplier
        UNION ALL SELECT s_suppkey, DATE '1999-01-01' + CAST(s_suppkey % 300 AS INTEGER), 'spinoff', 1.1::DOUBLE, NULL, false FROM supplier WHERE s_suppkey % 13 = 5""",
    "splits": "SELECT security_id, ex_date, ratio FROM actions WHERE action_type = 'split' AND ratio > 0 AND NOT requires_manual_review",
    "factors": """
        SELECT b.security_id, b.date, coalesce(product(s.ratio), 1.0) AS factor
        FROM bars b LEFT JOIN splits s ON s.security_id = b.security_id AND s.ex_date > b.date GROUP BY 1, 2""",
    "adj": """
        SELECT b.security_id, b.date, round_even(b.open / f.factor, 6) AS open, round_even(b.high / f.factor, 6) AS high,
               round_even(b.low / f.factor, 6) AS low, round_even(b.close / f.factor, 6) AS close,
               CAST(round_even(b.volume * f.factor, 0) AS BIGINT) AS volume, f.factor
        FROM bars b JOIN factors f USING (security_id, date)""",
    "securities": """
        SELECT s_suppkey AS security_id, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik,
               s_name || CASE s_suppkey % 10 WHEN 0 THEN ' Warrant' WHEN 1 THEN ' 5% Preferred Stock' WHEN 2 THEN ''
                   WHEN 3 THEN ' Class A Common Stock' WHEN 4 THEN ' Class B' ELSE ' Common Stock' END AS name,
               CASE s_suppkey % 10 WHEN 0 THEN 'warrant' WHEN 1 THEN 'preferred_share' WHEN 2 THEN 'unknown' ELSE 'common_stock' END AS security_type,
               CASE s_suppkey % 10 WHEN 2 THEN 'low' WHEN 4 THEN 'medium' ELSE 'high' END AS classification_confidence,
               CAST(s_nationkey * 389 + 100 AS VARCHAR) AS sic_code, s_suppkey % 17 <> 3 AS is_active,
               CASE WHEN s_suppkey % 17 = 3 THEN DATE '1999-06-01' + CAST(s_suppkey % 200 AS INTEGER) END AS delisted_date
        FROM supplier""",
    "listings": """
        SELECT s_suppkey AS security_id, 'R' || (s_suppkey // 2) AS symbol, DATE '1995-01-01' AS valid_from,
               DATE '1997-01-01' + CAST(s_suppkey * 31 % 900 AS INTEGER) AS valid_to, s_suppkey % 3 <> 0 AS is_primary FROM supplier
        UNION ALL SELECT s_suppkey, 'T' || s_suppkey, DATE '1997-01-01' + CAST(s_suppkey * 31 % 900 AS INTEGER), NULL, true FROM supplier""",
    "concepts": f"SELECT * FROM (VALUES {_CONCEPT_VALUES}) AS v(taxonomy, concept, is_duration, coef, spread, absent)",
    "facts": """
        SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, c.taxonomy, c.concept,
               CASE WHEN is_duration = 0 THEN NULL WHEN o_orderkey % 5 = 2 THEN make_date(year(o_orderdate), 12, 31) - 91
                    ELSE make_date(year(o_orderdate), 1, 1) END AS period_start,
               make_date(year(o_orderdate), 12, 31) AS period_end,
               o_totalprice * coef * (1 + (o_orderkey * spread % 7) * 0.1) * CASE WHEN c.concept = 'NetIncomeLoss' AND o_orderkey % 6 = 0 THEN -1 ELSE 1 END AS value,
               CASE o_orderkey % 5 WHEN 1 THEN '10-K/A' WHEN 2 THEN '10-Q' ELSE '10-K' END AS form_type,
               'A' || o_orderkey AS accession_no, CAST(o_orderdate AS DATE) AS filed_date,
               CASE WHEN o_orderkey % 23 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 400 AS INTEGER)) + to_seconds(CAST(o_orderkey % 80000 AS INTEGER)) END AS accepted_at
        FROM orders, concepts c WHERE (o_orderkey + spread) % absent <> 0""",
    "companies": """
        SELECT c_custkey AS security_id, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, CAST(c_nationkey * 389 + 100 AS VARCHAR) AS sic_code,
               CASE WHEN c_custkey % 10 = 0 THEN 2 ELSE 1 END AS class_count, c_name AS name, c_mktsegment FROM customer""",
    "cbars": """
        SELECT o_custkey AS security_id, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) / 1000 AS close FROM orders GROUP BY 1, 2""",
    "insiders": """
        SELECT 'F' || l_orderkey AS accession_no, l_linenumber AS line_no, l_suppkey AS security_id, CAST(o_custkey AS VARCHAR) AS insider_cik,
               CASE l_partkey % 5 WHEN 0 THEN 'Chief Executive Officer' WHEN 1 THEN 'CFO' WHEN 2 THEN 'Director' WHEN 3 THEN 'EVP, C.F.O.' END AS officer_title,
               CASE WHEN l_linestatus = 'F' THEN 'I' ELSE 'II' END AS table_type, CASE WHEN l_returnflag = 'R' THEN 'S' ELSE 'P' END AS transaction_code,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'discretionary' WHEN '2-HIGH' THEN 'confirmed_10b5_1' ELSE 'unknown' END AS plan_status,
               CASE WHEN l_partkey % 50 <> 0 THEN CAST(l_shipdate AS DATE) END AS transaction_date,
               CAST(l_shipdate AS DATE) + CAST(l_orderkey % 3 + 1 AS INTEGER) AS filed_date,
               l_quantity AS shares, l_extendedprice AS total_value, l_quantity * (l_partkey % 6) AS shares_owned_after,
               l_orderkey % 9 = 0 AS is_amendment, CASE WHEN l_orderkey % 12 = 5 THEN 'F' || (l_orderkey + 4) END AS superseded_by_accession
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "scores": """
        SELECT p_partkey AS security_id, p_type AS cohort_id, (p_partkey * 7919 % 1000) / 10.0 AS composite, p_size * 2.0 AS quality,
               p_partkey % 13 <> 0 AS rankable, p_partkey % 17 <> 0 AS model_applicable, CAST(p_partkey % 2 AS INTEGER) AS inputs_complete,
               CAST(p_partkey % 29 AS DOUBLE) AS dilution_score, p_partkey % 29 >= 22 AS dilution_disqualified, p_partkey % 31 = 0 AS high_going_concern,
               p_partkey % 37 = 0 AS has_dilution_flag, DATE '2000-01-01' + CAST(p_partkey % 30 AS INTEGER) AS last_exit_session,
               DATE '2000-01-01' + CAST(p_partkey % 23 AS INTEGER) AS last_gap_cancel_session,
               p_partkey % 5 = 0 AS open20, p_partkey % 25 = 0 AS open60 FROM part""",
    "runs": """
        SELECT CAST(event_id AS VARCHAR) AS run_id, CASE event_type WHEN 'click' THEN 'price_ingest' WHEN 'view' THEN 'insider' WHEN 'signup' THEN 'fundamentals'
                   WHEN 'purchase' THEN 'fixture_load' ELSE 'selection' END AS stage,
               ts - to_seconds(CAST(event_id % 3000 AS INTEGER)) AS started_at, CASE WHEN event_id % 10 <> 2 THEN ts END AS finished_at,
               CASE event_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' WHEN 2 THEN 'running' ELSE 'success' END AS status,
               CAST(event_id % 4 AS BIGINT) AS records_written, user_id FROM events""",
    "progress": """
        SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS batch_id, event_type AS stage, CAST(user_id AS VARCHAR) AS item_key,
               CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'success' END AS status, ts AS attempted_at, CAST(event_id AS VARCHAR) AS run_id FROM events""",
    "trades": """
        SELECT o_orderkey AS trade_id, CAST(o_orderdate AS DATE) AS exit_date, o_totalprice - 250000 AS net_pnl, o_totalprice - 250000 AS gross_pnl,
               (o_totalprice - 250000) / 1000 AS pnl_pct, o_orderpriority AS cohort_id, CASE WHEN o_orderkey % 2 = 0 THEN 20 ELSE 60 END AS horizon_days
        FROM orders""",
    "filings": """
        SELECT 'D' || doc_id AS accession_no, source AS cik, CASE doc_id % 7 WHEN 0 THEN 'S-3' WHEN 1 THEN '424B5' WHEN 2 THEN '424B2' WHEN 3 THEN 'S-1'
                   WHEN 4 THEN '10-K' WHEN 5 THEN '10-Q' ELSE '8-K' END AS form_type,
               DATE '2020-01-01' + CAST(doc_id * 17 % 1500 AS INTEGER) AS filed_date, n_chars, doc_id,
               text || CASE doc_id % 11 WHEN 0 THEN ' senior notes due 2030' WHEN 1 THEN ' shares of common stock under Rule 415' WHEN 2 THEN ' an at-the-market offering of our common stock'
                   WHEN 3 THEN ' floating conversion terms' WHEN 4 THEN ' resale of ordinary shares' WHEN 5 THEN ' a convertible debenture'
                   WHEN 6 THEN ' These conditions raise substantial doubt about the Company''s ability to continue as a going concern.'
                   WHEN 7 THEN ' This did not raise substantial doubt about our ability to continue as a going concern.'
                   WHEN 8 THEN ' Our ability to continue as a going concern: substantial doubt was alleviated by plans.'
                   WHEN 9 THEN ' We assess whether there is substantial doubt about our ability to continue as a going concern.' ELSE '' END AS text
        FROM documents""",
}
