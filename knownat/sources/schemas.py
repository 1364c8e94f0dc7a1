"""Explicit schemas; nothing is inferred on read."""

BARS = (
    "security_id bigint, date date, open double, high double, low double, close double, volume bigint, "
    "provider string, revision int, price_data_version int"
)
ACTIONS = (
    "security_id bigint, ex_date date, action_type string, ratio double, cash_amount double, provider string, "
    "requires_manual_review boolean"
)
LISTINGS = "security_id bigint, symbol string, exchange string, valid_from date, valid_to date, is_primary boolean"
SECURITIES = (
    "security_id bigint, cik string, share_class string, name string, security_type string, "
    "classification_confidence string, classification_source string, sic_code string, first_seen timestamp_ntz, "
    "last_seen timestamp_ntz, is_active boolean, delisted_date date"
)
FACTS = (
    "payload_id string, source_fact_key string, cik string, taxonomy string, concept string, unit string, "
    "context_type string, period_start date, period_end date, raw_value string, normalized_numeric_value double, "
    "form_type string, accession_no string, filed_date date, accepted_at timestamp_ntz, semantic_hash string"
)
INSIDER = (
    "accession_no string, line_no int, security_id bigint, insider_cik string, insider_name string, "
    "officer_title string, table_type string, transaction_code string, plan_status string, "
    "plan_status_source string, transaction_date date, filed_date date, accepted_at timestamp_ntz, shares double, "
    "price_per_share double, total_value double, shares_owned_after double, is_amendment boolean, "
    "amends_accession string, superseded_by_accession string"
)
RUNS = (
    "run_id string, stage string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, "
    "records_written bigint, errors_json string, code_version string"
)
ANALYSTS = (
    "security_id bigint, fetched_at timestamp_ntz, consensus_mean double, rating_strong_buy int, rating_buy int, "
    "rating_hold int, rating_sell int, rating_strong_sell int, target_low double, target_mean double, "
    "target_high double, currency string, fetch_error string"
)
# One entry of a company-facts payload: {taxonomy: {concept: {units: {unit: [entry]}}}}.
FACT_ENTRY = (
    "struct<start:string,end:string,val:string,accn:string,fy:int,fp:string,form:string,filed:string,frame:string>"
)
COMPANY_FACTS = f"struct<cik:string,facts:map<string,map<string,struct<units:map<string,array<{FACT_ENTRY}>>>>>>"
SUBMISSIONS_BLOCK = (
    "struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,"
    "acceptanceDateTime:array<string>,reportDate:array<string>,primaryDocument:array<string>>"
)
