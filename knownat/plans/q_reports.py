"""Queries over reports, universe rules, news, audits and the composite score."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import core as C, metrics as M, text as T
from ..operators import asof, bars as B, calibrate as CB, fundamentals as FU, insider as INS, momentum as MOM, news as N, report as REP, risk as RK, score as SC, universe as U, verify as V
from ..sources import directory as D, form4 as F4
from . import adapters as A
from .q_facts import _fund
from .registry import query, stored


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("histogram", "", """
    WITH c AS (SELECT least(19, greatest(0, CAST(floor((p_retailprice - 900) / 10) AS INTEGER))) AS bucket, count(*) AS n FROM part GROUP BY 1)
    SELECT CAST(b AS INTEGER) AS bucket, 900.0 + b * 10 AS bucket_start, 900.0 + (b + 1) * 10 AS bucket_end, coalesce(n, 0) AS count FROM range(20) r(b) LEFT JOIN c ON c.bucket = b""")
def histogram(t):
    return CB.histogram(t.part, "p_retailprice", 10, 900.0, 1100.0)


@query("rankable_vs_withheld", "scores", """
    SELECT rankable, CASE WHEN NOT rankable THEN 'F' || (security_id % 3) END AS reason, count(*) AS count FROM scores GROUP BY 1, 2""")
def rankable_vs_withheld(t):
    return CB.rankable_vs_withheld(A.scores(t).withColumn("withhold_reason", F.concat(F.lit("F"), (F.col("security_id") % 3).cast("string"))))


@query("cohort_sizes", "scores", "SELECT cohort_id, count(*) AS count FROM scores GROUP BY 1")
def cohort_sizes(t):
    return CB.cohort_sizes(A.scores(t))


@query("type_counts", "securities", """
    SELECT classification_confidence, count(*) AS count, CASE classification_confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS place FROM securities GROUP BY 1""")
def type_counts(t):
    return REP.count_by(A.securities(t), "classification_confidence", ["high", "medium", "low"])


@query("coverage", "", """
    WITH f AS (SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS a, c_custkey IN (SELECT user_id FROM events) AS b, c_custkey IN (SELECT doc_id FROM labels) AS c FROM customer)
    SELECT source, CAST(sum(CAST(v AS INTEGER)) AS BIGINT) AS covered, count(*) AS total, round(100.0 * sum(CAST(v AS INTEGER)) / count(*), 6) AS pct
    FROM (SELECT 'prices' AS source, a AS v FROM f UNION ALL SELECT 'form4', b FROM f UNION ALL SELECT 'xbrl', c FROM f) GROUP BY 1""")
def coverage(t):
    return REP.source_coverage(_flagged(t), ("prices", "form4", "xbrl"))


def _flagged(t):
    k = lambda df, c: (df.select(F.col(c).alias("security_id")), "security_id")
    pop = t.customer.select(F.col("c_custkey").alias("security_id"))
    return REP.coverage_by_source(pop, {"prices": k(t.orders, "o_custkey"), "form4": k(t.events, "user_id"), "xbrl": k(t.labels, "doc_id")})


@query("worst_coverage", "", """
    WITH f AS (SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS a, c_custkey IN (SELECT user_id FROM events) AS b, c_custkey IN (SELECT doc_id FROM labels) AS c FROM customer)
    SELECT c_custkey AS security_id, CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER) AS sources_present FROM f WHERE NOT (a AND b AND c) ORDER BY 2, 1 LIMIT 20""")
def worst_coverage(t):
    return REP.worst_coverage(_flagged(t), ("prices", "form4", "xbrl")).select("security_id", "sources_present")


@query("staleness_buckets", "bars", """
    SELECT CASE WHEN age IS NULL THEN 'no data' WHEN age <= 1 THEN '0-1d' WHEN age <= 3 THEN '1-3d' WHEN age <= 7 THEN '3-7d' ELSE '7d+' END AS bucket, count(*) AS count
    FROM (SELECT c_custkey, DATE '2001-11-05' - m AS age FROM customer LEFT JOIN (SELECT security_id, max(date) AS m FROM bars GROUP BY 1) ON security_id = c_custkey) GROUP BY 1""")
def staleness_buckets(t):
    return REP.staleness_buckets(t.customer.select(F.col("c_custkey").alias("security_id")), A.bars(t), A.day("2001-11-05"))


@query("source_health", "runs", """
    , ok AS (SELECT stage, max(finished_at) FILTER (status = 'success') AS ls FROM runs GROUP BY 1)
    SELECT ok.stage, strftime(ls, '%Y-%m-%d %H:%M:%S') AS last_success, count(r.run_id) AS consecutive_failures FROM ok LEFT JOIN runs r ON r.stage = ok.stage AND r.status = 'failed' AND (ls IS NULL OR r.finished_at > ls) GROUP BY 1, 2""")
def source_health(t):
    return REP.source_health(A.runs(t), source="stage").select("stage", "last_success", "consecutive_failures")


_LASTP = "l AS (SELECT * FROM progress QUALIFY row_number() OVER (PARTITION BY batch_id, stage, item_key ORDER BY attempted_at DESC) = 1)"


@query("batch_summary", "progress", ", " + _LASTP + """
    SELECT batch_id, stage, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM l GROUP BY 1, 2""")
def batch_summary(t):
    return REP.batch_summary(A.progress(t))


@query("pending_items", "progress", ", " + _LASTP + """
    SELECT DISTINCT batch_id, stage, item_key FROM l WHERE status = 'failed'""")
def pending_items(t):
    p = A.progress(t)
    return REP.pending_items(p.select("batch_id", "stage", "item_key").distinct(), p)


@query("stage_progress", "progress", "SELECT run_id, count(DISTINCT item_key) AS completed, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS total FROM progress WHERE stage = 'click' AND status = 'success' GROUP BY 1")
def stage_progress(t):
    members = t.customer.select(F.when(F.col("c_acctbal") > 0, "included").otherwise("excluded").alias("status"))
    return REP.stage_progress(A.progress(t), members, "click")


@query("run_activity", "progress runs", """
    SELECT p.item_key, p.run_id, r.status AS run_status FROM progress p LEFT JOIN runs r USING (run_id) ORDER BY attempted_at DESC, item_key LIMIT 20""")
def run_activity(t):
    return REP.run_activity(A.progress(t), A.runs(t)).select("item_key", "run_id", "run_status")


@query("recent_runs", "runs", "SELECT run_id, stage, status FROM runs ORDER BY started_at DESC, run_id LIMIT 25")
def recent_runs(t):
    return REP.recent(A.runs(t), [F.desc("started_at"), F.col("run_id")], 25).select("run_id", "stage", "status")


@query("published_run", "runs", "SELECT run_id FROM runs WHERE stage = 'selection' AND run_id NOT IN (SELECT CAST(event_id AS VARCHAR) FROM events WHERE event_id % 3 = 0) ORDER BY started_at DESC, run_id DESC LIMIT 1")
def published_run(t):
    stale = t.events.where(F.col("event_id") % 3 == 0).select(F.col("event_id").cast("string").alias("run_id"), F.lit("stale_source").alias("reason"))
    return REP.published_run(A.runs(t), stale).select("run_id")


@query("status_rollup", "runs scores", """
    , r AS (SELECT * FROM runs WHERE stage = 'selection' ORDER BY started_at DESC, run_id DESC LIMIT 1)
    SELECT (SELECT count(*) FROM scores WHERE rankable) AS ranked_count, CASE WHEN r.records_written = 0 AND CAST(r.run_id AS BIGINT) % 3 = 0 THEN 'blocked_stale_source' WHEN r.records_written = 0 THEN 'zero_candidates' ELSE 'published' END AS selection_status,
      r.records_written AS selected_count FROM r""")
def status_rollup(t):
    stale = t.events.where(F.col("event_id") % 3 == 0).select(F.col("event_id").cast("string").alias("run_id"), F.lit("stale_source").alias("reason"))
    s = A.scores(t).withColumn("score_date", A.day("2000-01-28"))
    return REP.status_rollup(s, A.runs(t), stale).select("ranked_count", "selection_status", "selected_count")


@query("official_rows", "", """
    SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderdate >= (SELECT max(o_orderdate) FROM orders WHERE o_orderkey % 997 = 5)""")
def official_rows(t):
    o = t.orders
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "v1+pool").otherwise("v1").alias("code_version"), F.col("o_orderdate").alias("generated_at"))
    exp = o.where(F.col("o_orderkey") % 997 == 5).select(F.lit("active").alias("status"), F.col("o_orderdate").alias("started_at"))
    return REP.official(rows, exp).select("o_orderkey")


@query("search_names", "", "SELECT p_partkey AS security_id, p_name AS name FROM part WHERE contains(upper(p_name), 'RING') ORDER BY p_name, p_partkey LIMIT 50")
def search_names(t):
    s = t.part.select(F.col("p_partkey").alias("security_id"), F.col("p_name").alias("name"))
    none = s.where("security_id < 0")
    listings = none.select("security_id", F.col("name").alias("symbol"), F.lit("x").alias("exchange"), A.day("2000-01-01").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_primary"))
    sc = none.select("security_id", A.day("2000-01-01").alias("score_date"), F.lit(0.0).alias("composite_score"), F.lit(1).alias("rank"), F.lit("x").alias("withhold_reason"))
    return REP.search(s, listings, sc, " ring ", 50).select("security_id", "name")


@query("risk_merge", "", """
    WITH f AS (SELECT user_id, event_type AS code, event_id % 3 = 0 AS unk, event_id AS o, CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'none' END AS sev FROM events)
    SELECT user_id AS security_id, code AS flag_code, coalesce(arg_min(sev, o) FILTER (NOT unk), 'unknown') AS severity, bool_and(unk) AS is_unknown FROM f GROUP BY 1, 2""")
def risk_merge(t):
    e = t.events
    sev = A.by_mod("event_id", 4, "high", "medium", otherwise="none")
    known = F.struct(F.col("event_type").alias("flag_code"), sev.alias("severity"), F.lit("seen").alias("evidence_text"), F.lit("a").alias("source_accession"), F.lit(False).alias("is_unknown"))
    unk = F.struct(F.col("event_type").alias("flag_code"), F.lit("unknown").alias("severity"), F.lit("not seen").alias("evidence_text"), F.lit(None).cast("string").alias("source_accession"), F.lit(True).alias("is_unknown"))
    rows = e.select(F.col("user_id").alias("security_id"), A.day("2024-02-01").alias("as_of_date"), F.when(F.col("event_id") % 3 == 0, unk).otherwise(known).alias("flag"), F.col("event_id").alias("source_order"))
    return RK.merge_flags(rows).select("security_id", "flag_code", "severity", "is_unknown")


@query("anti_effective", "", """
    SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1 AND d.turn % 2 = 1)""")
def anti_effective(t):
    key = lambda n: F.concat_ws("-", "conv_id", F.col("turn") - n)
    e = t.conversations.select("conv_id", "turn", key(0).alias("event_id"), F.when(F.col("turn") % 2 == 1, key(1)).alias("supersedes_event_id"))
    return N.effective_events(e).select("conv_id", "turn")


@query("event_validation", "", """
    WITH e AS (SELECT event_id, event_id % 3 = 0 AS ab, CASE WHEN event_id % 4 = 0 THEN 'r' END AS reason, CASE WHEN event_id % 5 < 3 AND event_id % 3 <> 0 THEN 'binding' WHEN event_id % 5 = 4 THEN 'guess' END AS tier, event_id % 7 < 3 AS ex, CASE WHEN event_id % 7 < 4 THEN value END AS amt FROM events)
    SELECT event_id, CASE WHEN ab AND tier IS NOT NULL THEN 'abstain_with_type' WHEN ab AND reason IS NULL THEN 'abstain_without_reason' WHEN NOT ab AND reason IS NOT NULL THEN 'event_with_abstain_reason'
      WHEN NOT ab AND (tier IS NULL OR tier = 'guess') THEN 'tier' WHEN ex AND amt IS NULL THEN 'explicit_without_amount' WHEN NOT ex AND amt IS NOT NULL THEN 'inferred_amount' END AS error FROM e""")
def event_validation(t):
    k = F.col("event_id")
    e = t.events.select(
        "event_id", (k % 3 == 0).alias("is_abstain"), F.when(k % 4 == 0, "r").alias("abstain_reason"), F.lit(None).cast("string").alias("event_type_candidate"),
        F.when((k % 5 < 3) & (k % 3 != 0), "binding").when(k % 5 == 4, "guess").alias("confirmation_tier"), (k % 7 < 3).alias("amount_explicit"),
        F.when(k % 7 < 4, F.col("value")).alias("amount_stated"), F.lit("p").alias("supporting_passage"), F.lit("d").alias("source_document"),
    )
    return e.select("event_id", N.event_error().alias("error"))


def _news(t):
    d = t.documents
    f = d.select(F.col("source").alias("accession_no"), F.lit("8-K").alias("form_type"), A.day("2024-01-02").alias("filed_date"), F.lit("doc-7").alias("primary_document")).distinct()
    docs = d.select(F.col("source").alias("accession_no"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_name"), F.col("doc_id").alias("document_order"), "text")
    return f, docs


@query("news_roles", "", """
    SELECT source AS accession_no, 'doc-' || doc_id AS document_name, CASE WHEN doc_id = 7 OR (NOT bool_or(doc_id = 7) OVER (PARTITION BY source) AND doc_id = min(doc_id) OVER (PARTITION BY source)) THEN 'primary' ELSE 'exhibit' END AS role FROM documents""")
def news_roles(t):
    f, docs = _news(t)
    return N.document_roles(f, docs.drop("text"), A.day("2024-01-01")).select("accession_no", "document_name", "role")


@query("document_bundle", "", """
    WITH r AS (SELECT source, 'doc-' || doc_id AS n, text, CASE WHEN doc_id = 7 OR (NOT bool_or(doc_id = 7) OVER (PARTITION BY source) AND doc_id = min(doc_id) OVER (PARTITION BY source)) THEN 'primary' ELSE 'exhibit' END AS role FROM documents)
    SELECT source AS accession_no, n AS document_name, length(text) AS chars FROM r""")
def document_bundle(t):
    f, docs = _news(t)
    out = N.document_bundles(f, N.document_roles(f, docs, A.day("2024-01-01")))
    return out.select("accession_no", "document_name", F.length("bundle_text").cast("bigint").alias("chars"))


@query("pending_documents", "", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_documents(t):
    return N.pending_filings(t.documents.select(F.col("doc_id").alias("accession_no")), t.labels.select(F.col("doc_id").alias("accession_no"))).select(F.col("accession_no").alias("doc_id"))


@query("html_text", "", r"""
    SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(
        regexp_replace(regexp_replace(html, '(?i)&(?:nbsp|#160|#xa0);', ' ', 'g'), '<[^>]*>', ' ', 'g'),
        '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', chr(34)), '&amp;?', '&', 'g'), '[\x{200b}\x{a0}\x{feff}]', ' ', 'g'),
        '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS text FROM pages""")
def html_text(t):
    return t.pages.select("page_id", T.html_to_text("html").alias("text"))


@query("row_hash_audit", "", """
    SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0""")
def row_hash_audit(t):
    cols = [("o_orderkey", "string"), ("o_totalprice", "double"), ("o_orderstatus", "string")]
    stored_rows = t.orders.withColumn("row_hash", C.row_hash(cols)).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return stored_rows.where(F.col("row_hash") != C.row_hash(cols)).select("o_orderkey")


@query("row_hash_text", "", """
    SELECT o_orderkey, sha256('o_orderkey=' || o_orderkey || chr(10) || 'q=' || CAST(CAST(l AS BIGINT) AS VARCHAR) || chr(10) || 'x=null') AS h FROM (SELECT o_orderkey, floor(o_totalprice) AS l FROM orders)""")
def row_hash_text(t):
    o = t.orders.select("o_orderkey", F.floor("o_totalprice").cast("double").alias("q"), F.lit(None).cast("string").alias("x"))
    return o.select("o_orderkey", C.row_hash([("o_orderkey", "string"), ("q", "double"), ("x", "string")]).alias("h"))


@query("append_only_audit", "", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'deleted' ELSE 'updated' END AS violation FROM orders WHERE o_orderstatus = 'F' AND (o_orderkey % 7 = 0 OR o_orderkey % 13 = 0)""")
def append_only_audit(t):
    old = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    new = old.where(k % 7 != 0).withColumn("o_totalprice", F.when(k % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return V.altered_rows(old, new, ["o_orderkey"], F.col("o_orderstatus") == "F")


@query("check_rules", "scores", """
    SELECT security_id, 'penalty_range' AS rule FROM scores WHERE dilution_score > 25 UNION ALL SELECT security_id, 'rankable_complete' FROM scores WHERE rankable AND composite < 3""")
def check_rules(t):
    s = A.scores(t)
    rules = {"penalty_range": F.col("dilution_score").between(0, 25), "rankable_complete": ~F.col("rankable") | (F.col("composite") >= 3)}
    return V.failed_rules(s, rules, ["security_id"])


@query("double_open", "", "SELECT o_custkey AS security_id, 20 AS horizon_days, count(*) AS open_count FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 HAVING count(*) > 1")
def double_open(t):
    o = t.orders.select(F.col("o_orderkey").alias("candidate_id"), F.col("o_custkey").alias("security_id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"), F.lit(20).alias("horizon_days"))
    return V.double_open(o.drop("security_id"), o.select("candidate_id", "security_id"))


@query("evidence_cutoff", "", """
    SELECT l_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'unresolvable' ELSE 'after_cutoff' END AS offence FROM (SELECT DISTINCT l_orderkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 5 = 0 OR o_orderdate > TIMESTAMP '2000-01-01'""")
def evidence_cutoff(t):
    from ..operators import selection as SEL

    k = F.col("o_orderkey")
    table = lambda m: t.orders.where((k % 5 == m) | (k % 5 == m + 2)).select(k.cast("string").alias("accession_no"), F.col("o_orderdate").cast("timestamp_ntz").alias("accepted_at"))
    cited = t.lineitem.select("l_orderkey", F.col("l_orderkey").cast("string").alias("accession_no")).distinct()
    return SEL.evidence_offences(cited, table(1), table(2), table(1), _ts("2000-01-01 00:00:00")).select("l_orderkey", "offence")


@query("accession_walk", "", "SELECT o_orderkey, 'A' || o_orderkey || ',B' || o_custkey AS cited FROM orders")
def accession_walk(t):
    body = F.concat(
        F.lit('{"x":{"accession":"A'), F.col("o_orderkey").cast("string"), F.lit('","pe_accession": "B'), F.col("o_custkey").cast("string"),
        F.lit('"},"y":[{"source_accession":"ledger:corporate_actions:1:none"},{"accession":"none"},{"accession":null},{"accession":"A'), F.col("o_orderkey").cast("string"), F.lit('"}]}'),
    )
    return t.orders.select("o_orderkey", F.array_join(T.cited_accessions(body), ",").alias("cited"))


@query("analyst_latest", "", """
    SELECT user_id AS security_id, CASE WHEN m <= 1.5 THEN 'Strong bullish' WHEN m <= 2.5 THEN 'Bullish' WHEN m <= 3.5 THEN 'Neutral' WHEN m <= 4.5 THEN 'Bearish' ELSE 'Strong bearish' END AS tier
    FROM (SELECT user_id, 1 + (arg_max(event_id, ts) % 9) / 2.0 AS m FROM events GROUP BY 1)""")
def analyst_latest(t):
    e = t.events.select(F.col("user_id").alias("security_id"), F.col("ts").alias("fetched_at"), (1 + (F.col("event_id") % 9) / 2.0).alias("consensus_mean"))
    return REP.newest_row(e, ["security_id"], [F.col("fetched_at")]).select("security_id", T.consensus_tier("consensus_mean").alias("tier"))


@query("form4_xml", "", """
    SELECT 'X' || o_orderkey AS accession_no, i AS line_no, CASE WHEN i = 3 THEN 'II' ELSE 'I' END AS table_type, CASE WHEN i = 1 THEN 'P' ELSE 'S' END AS transaction_code, o_orderkey % 5 = 0 AS is_amendment,
      CASE WHEN o_orderkey % 3 = 0 THEN 'confirmed_10b5_1' WHEN o_orderkey % 3 = 1 THEN 'discretionary' ELSE 'unknown' END AS plan_status, CAST(o_custkey AS VARCHAR) AS insider_cik, round(o_totalprice, 2) AS shares,
      CASE WHEN i <> 2 THEN round(o_totalprice * 2, 2) END AS total_value FROM orders, (VALUES (1), (2), (3)) v(i)""", places=2)
def form4_xml(t):
    k = F.col("o_orderkey")
    num = F.format_number("o_totalprice", 2)
    tx = lambda tag, code, price: F.concat(
        F.lit(f"<{tag}><securityTitle><value>Common</value></securityTitle><transactionDate><value>2026-06-11</value></transactionDate><transactionCoding><transactionCode>{code}</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>"),
        num, F.lit(f"</value></transactionShares><transactionPricePerShare>{price}</transactionPricePerShare></transactionAmounts></{tag}>"),
    )
    xml = F.concat(
        F.lit("junk <ownershipDocument><documentType>"), F.when(k % 5 == 0, "4/A").otherwise("4"), F.lit("</documentType>"),
        F.when(k % 3 == 0, "<aff10b5One>1</aff10b5One>").otherwise(""),
        F.lit("<issuer><issuerCik>1</issuerCik></issuer><reportingOwner><reportingOwnerId><rptOwnerCik>"), F.col("o_custkey").cast("string"),
        F.lit("</rptOwnerCik><rptOwnerName>A B</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isOfficer>1</isOfficer></reportingOwnerRelationship></reportingOwner><nonDerivativeTable>"),
        tx("nonDerivativeTransaction", "P", "<value>$2</value>"), tx("nonDerivativeTransaction", "S", "<footnoteId id='F1'/>"), F.lit("</nonDerivativeTable><derivativeTable>"),
        tx("derivativeTransaction", "S", "<value>2.00</value>"), F.lit("</derivativeTable>"),
        F.when(k % 3 == 1, "<footnotes><footnote id='F1'>Not made under a Rule 10b5-1 plan.</footnote></footnotes>").otherwise(""), F.lit("</ownershipDocument> tail"),
    )
    docs = t.orders.select(F.concat(F.lit("X"), k.cast("string")).alias("accession_no"), xml.alias("xml"))
    return F4.parse_form4(docs).select("accession_no", "line_no", "table_type", "transaction_code", "is_amendment", "plan_status", "insider_cik", "shares", "total_value")


@query("directory_merge", "", """
    SELECT upper(p_brand) AS symbol, 'Nasdaq' AS exchange, CAST(min(p_size) FILTER (p_size % 2 = 0) AS BIGINT) AS least FROM part GROUP BY 1""")
def directory_merge(t):
    base = t.part.select(F.col("p_brand").alias("symbol"), F.col("p_name").alias("security_name"), "p_size", F.lit(False).alias("is_etf"), F.lit(False).alias("is_test_issue"))
    keep = ["symbol", "security_name", "exchange", "is_etf", "is_test_issue"]
    a = base.where(F.col("p_size") % 2 == 0).withColumn("exchange", F.lit("Nasdaq")).select(*keep)
    b = base.withColumn("exchange", D.exchange_name(F.lit("N"))).select(*keep)
    least = base.where(F.col("p_size") % 2 == 0).groupBy(F.upper("symbol").alias("symbol")).agg(F.min("p_size").cast("bigint").alias("least"))
    return D.merge_directories(a, b).select("symbol", "exchange").join(least, "symbol", "left")


@query("pool_discovery", "", """
    WITH e AS (SELECT DISTINCT p_partkey, 'S' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS symbol FROM part WHERE p_size % 5 <> 0 AND p_size % 7 <> 0), n AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS k, count(*) OVER () AS n FROM e),
    i AS (SELECT DISTINCT CAST(floor(i * ((SELECT max(n) FROM n) / 60.0)) AS BIGINT) AS k FROM range(60) r(i))
    SELECT symbol FROM n JOIN i USING (k)""")
def pool_discovery(t):
    sym = F.concat(F.lit("S"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"))
    d = t.part.select(
        sym.alias("symbol"), F.concat("p_name", F.when(F.col("p_size") % 5 == 0, " Warrant").otherwise(" Common Stock")).alias("security_name"),
        F.when(F.col("p_size") % 7 == 0, "IEX").otherwise("NYSE").alias("exchange"), F.lit(False).alias("is_etf"), F.lit(False).alias("is_test_issue"),
    )
    tickers = t.part.select(sym.alias("ticker"), F.col("p_partkey").cast("string").alias("cik"))
    return U.discover_pool(d, tickers, 60).select("symbol")


@query("assign_ids", "", "SELECT p_partkey, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY p_name, p_partkey) AS security_id FROM part")
def assign_ids(t):
    return U.assign_ids(t.part.select("p_partkey", "p_name"), t.supplier.select(F.col("s_suppkey").alias("security_id")), F.struct("p_name", "p_partkey")).select("p_partkey", "security_id")


@query("entity_match", "", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN (SELECT min(c_custkey) FROM customer WHERE c_name = 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AND c_custkey % 2 = 0) WHEN o_custkey % 2 = 1 THEN o_custkey END AS security_id FROM orders")
def entity_match(t):
    c, k = t.customer, F.col("c_custkey")
    sec = c.select(k.alias("security_id"), F.when(k % 2 == 1, k.cast("string")).alias("cik"), F.lit(None).cast("string").alias("share_class"), F.lit("common_stock").alias("security_type"), F.col("c_name").alias("name"))
    e = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey").cast("string")).alias("cik"), F.lit(None).cast("string").alias("share_class"), F.lit("common_stock").alias("security_type"),
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("name"),
    )
    return asof.match_entities(e, sec).select("o_orderkey", "security_id")


def _universe_rows(t):
    p, k = t.part, F.col("p_partkey")
    m = p.select(
        k.alias("security_id"), F.when(k % 11 == 0, "IEX").otherwise("NYSE").alias("exchange"), F.when(k % 13 == 0, "adr").otherwise("common_stock").alias("security_type"),
        F.lit("high").alias("classification_confidence"), F.when(k % 17 != 0, "1").alias("cik"), (k % 19 != 0).alias("files_10k_10q"), (k % 7).cast("int").alias("price_data_gap_days"),
        (F.col("p_size") / 4.0).alias("price"), (F.col("p_retailprice") * 300000).alias("market_cap"), ((k % 100) * 200000.0).alias("adv_dollar"), (k % 40).cast("int").alias("xbrl_consecutive_quarters"), (k % 23 == 0).alias("dilution_severe"),
    )
    prior = p.where(k % 3 != 0).select(k.alias("security_id"), F.when(k % 3 == 1, "included").otherwise("excluded").alias("prior_status"), (k % 25).cast("int").alias("prior_days"))
    return m, prior


_UNI = """
    WITH m AS (SELECT p_partkey AS k, p_partkey % 7 AS gap, p_size / 4.0 AS price, p_retailprice * 300000 AS cap, p_partkey % 100 * 200000.0 AS adv, p_partkey % 40 AS q FROM part),
    e AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'exchange' WHEN k % 13 = 0 THEN 'security_type' WHEN k % 17 = 0 THEN 'no_cik' WHEN k % 19 = 0 THEN 'no_periodic_report' WHEN gap >= 5 THEN 'price_gap' WHEN price < 3 THEN 'price'
        WHEN cap < 300000000 THEN 'market_cap' WHEN adv < 5000000 THEN 'adv' WHEN q < 8 THEN 'xbrl_quarters' END AS entry, price < 2.5 OR cap < 250000000 OR adv < 4000000 AS weak,
        CASE WHEN gap >= 5 THEN 'stale_price_data' WHEN k % 23 = 0 THEN 'severe_dilution' END AS unsafe, k % 3 = 1 AS member, CASE WHEN k % 3 <> 0 THEN k % 25 ELSE 0 END AS days FROM m)"""


@query("universe_monthly", "", _UNI + """
    SELECT k AS security_id, CASE WHEN member AND weak AND days >= 20 THEN 'excluded' WHEN member THEN 'included' WHEN entry IS NULL THEN 'included' ELSE 'excluded' END AS status,
      CASE WHEN member AND weak AND days >= 20 THEN 'below_retention_limit' WHEN member AND weak THEN 'below_retention' WHEN NOT member THEN entry END AS exclusion_reason, CASE WHEN member AND weak THEN CAST(days AS INTEGER) ELSE 0 END AS days_below_retention FROM e""")
def universe_monthly(t):
    m, prior = _universe_rows(t)
    return U.evaluate(m, prior, "monthly_membership").select("security_id", "status", "exclusion_reason", "days_below_retention")


@query("universe_daily", "", _UNI + """
    SELECT k AS security_id, CASE WHEN member AND unsafe IS NOT NULL THEN 'watch' WHEN member THEN 'included' WHEN entry IS NULL THEN 'included' ELSE 'excluded' END AS status,
      CASE WHEN member AND unsafe IS NOT NULL THEN CAST(days AS INTEGER) WHEN member AND weak THEN CAST(days + 1 AS INTEGER) ELSE 0 END AS days_below_retention FROM e""")
def universe_daily(t):
    m, prior = _universe_rows(t)
    return U.evaluate(m, prior, "daily_safety").select("security_id", "status", "days_below_retention")


@query("membership_changes", "", _UNI + """
    , s AS (SELECT *, CASE WHEN member AND weak AND days >= 20 THEN 'excluded' WHEN member THEN 'included' WHEN entry IS NULL THEN 'included' ELSE 'excluded' END AS status FROM e)
    SELECT k AS security_id, CASE WHEN status = 'included' THEN 'entered' ELSE 'exited' END AS change_type FROM s WHERE status <> CASE WHEN member THEN 'included' ELSE 'excluded' END""")
def membership_changes(t):
    m, prior = _universe_rows(t)
    return U.membership_changes(U.evaluate(m, prior, "monthly_membership"), "monthly_membership").select("security_id", "change_type")


def _scores(t):
    def build():
        b, a = A.bars(t), A.actions(t)
        on = A.day("2001-10-31")
        adjusted = B.adjusted_bars(b, a)
        mom = MOM.momentum_inputs(adjusted, A.benchmark(b), on)
        cols = [c for c in MOM.WEIGHTS]
        rounded = mom.withColumns({c: F.round(c, 9) for c in cols})
        mom = stored(t, "momentum", lambda: rounded)
        f = _fund(t, "market_cap", "market_cap_confidence", "model_applicable", *SC.VALUE_WEIGHTS, *SC.QUALITY_WEIGHTS, *M.PIOTROSKI)
        ids = A.securities(t)
        x = A.insiders(t)
        caps = FU.market_cap_at(f, on).select("security_id", "market_cap")
        own = INS.bonus_parts(INS.scored_purchases(x), on, caps).withColumn("size_ratio", F.round("size_ratio", 9))
        parts = stored(t, "bonus_parts", lambda: own)
        bonus = ids.select("security_id").join(INS.with_size_bonus(parts), "security_id", "left").na.fill(0.0)
        cov = INS.scoring_coverage(ids.select("security_id"), INS.filing_counts(x), _ts("2001-10-30 00:00:00"), on, 96.0)
        dil = ids.select("security_id", (F.col("security_id") % 23).cast("double").alias("dilution_score"))
        return SC.score_universe(ids, f, mom, bonus, cov, dil, on, C.end_of_day(F.lit("2001-10-31")))

    return stored(t, "scores", build)


@query("composite_score")
def composite_score(t):
    return _scores(t).select("security_id", "cohort_id", "rankable", "value_score", "quality_score", "momentum_score", "insider_bonus", "dilution_penalty", "composite_score", "rank", "withhold_reason")


@query("scores_reproduce", "", "SELECT 0 AS security_id, 0.0 AS stored, 0.0 AS recomputed WHERE false")
def scores_reproduce(t):
    return V.score_mismatches(_scores(t))


@query("component_distributions")
def component_distributions(t):
    return CB.component_distributions(_scores(t))


@query("submetric_distributions")
def submetric_distributions(t):
    return CB.submetric_distributions(_scores(t))


@query("universe_decision", "securities", """
    SELECT security_id, CASE WHEN security_type = 'unknown' THEN 'classification unknown' WHEN security_type <> 'common_stock' THEN 'not common stock: ' || security_type WHEN security_id % 6 = 0 THEN 'no derived fundamentals'
      WHEN CAST(sic_code AS INTEGER) BETWEEN 6000 AND 6799 THEN 'model not applicable' END AS exclusion_reason FROM securities""")
def universe_decision(t):
    from ..functions.metrics import model_applicable

    s = A.securities(t)
    a = s.where(F.col("security_id") % 6 != 0).select("security_id", model_applicable("sic_code")["applicable"].alias("model_applicable"))
    return SC.universe_decision(s, a).select("security_id", "exclusion_reason")


@query("security_rows", "", "SELECT 'orders' AS \"table\", (SELECT count(*) FROM orders WHERE o_custkey = 7) AS total, count(*) AS listed FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'events', (SELECT count(*) FROM events WHERE user_id = 7), count(*) FROM events WHERE user_id = 7")
def security_rows(t):
    tables = {"orders": t.orders.withColumnRenamed("o_custkey", "security_id"), "events": t.events.withColumnRenamed("user_id", "security_id")}
    return REP.security_rows(tables, 7, 500).groupBy("table", "total").agg(F.count("row").alias("listed"))
