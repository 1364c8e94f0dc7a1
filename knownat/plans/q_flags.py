"""Queries over risk flags that need several sources, and the audit that each flag's source exists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import insider as INS, report as REP, risk as RK, verify as V
from . import adapters as A
from .registry import query

AS_OF = "2001-06-30"

_REVERSE = """
    , r AS (SELECT security_id, max(ex_date) AS ex_date, arg_max(ratio, ex_date) AS ratio FROM splits WHERE ratio < 1 AND ex_date BETWEEN DATE '2001-06-30' - 1095 AND DATE '2001-06-30' GROUP BY 1),
    rf AS (SELECT s.security_id, CASE WHEN ex_date IS NULL THEN 'none' ELSE 'medium' END AS severity, coalesce('reverse split ' || CAST(ratio AS VARCHAR), 'no ratio below one') AS evidence_text,
           'ledger:corporate_actions:' || s.security_id || ':' || coalesce(CAST(ex_date AS VARCHAR), 'none') AS source_accession FROM securities s LEFT JOIN r USING (security_id))"""


@query("reverse_split_flags", "actions splits securities", _REVERSE + " SELECT * FROM rf")
def reverse_split_flags(t):
    out = RK.reverse_splits(A.securities(t), A.actions(t), A.day(AS_OF))
    return out.select("security_id", "flag.severity", "flag.evidence_text", "flag.source_accession")


@query("insider_selling_flags", "insiders", """
    , c AS (SELECT security_id, NOT ((count(DISTINCT accession_no) FILTER (NOT is_amendment) >= 60 OR count(DISTINCT accession_no) FILTER (is_amendment) >= 10) AND min(filed_date) > DATE '1995-07-10' - 180) AS complete FROM insiders GROUP BY 1),
    s AS (SELECT security_id, count(*) AS n, arg_max(accession_no, (transaction_date, accession_no)) AS newest FROM insiders
          WHERE table_type = 'I' AND transaction_code = 'S' AND superseded_by_accession IS NULL AND transaction_date BETWEEN DATE '2001-06-30' - 90 AND DATE '2001-06-30' GROUP BY 1)
    SELECT security_id, CASE WHEN complete THEN 'context' ELSE 'unknown' END AS severity, CASE WHEN complete THEN coalesce(newest, 'none') END AS source_accession, NOT complete AS is_unknown FROM c LEFT JOIN s USING (security_id)""")
def insider_selling_flags(t):
    x = A.insiders(t)
    ids = x.select("security_id").distinct()
    coverage = INS.scoring_coverage(ids, INS.filing_counts(x), F.lit("1995-07-09").cast("timestamp_ntz"), A.day("1995-07-10"), 96.0)
    out = RK.insider_selling_flags(coverage, INS.selling_summary(x, A.day(AS_OF)))
    return out.select("security_id", "flag.severity", "flag.source_accession", "flag.is_unknown")


# Concepts that a complete company reports, in alphabetical order.
NEEDED = ("Assets", "Liabilities", "NetIncomeLoss")
_SOURCES = {"price_ingest": "prices_daily", "insider": "filings", "fundamentals": "fundamentals", "fixture_load": "symbol_master", "selection": "corporate_actions"}
_HOURS = "(VALUES ('price_ingest', 'prices_daily', 72), ('insider', 'filings', 96), ('fundamentals', 'fundamentals', 720), ('fixture_load', 'symbol_master', 168), ('selection', 'corporate_actions', 72)) h(stage, source, hours)"


@query("completeness_flags", "concepts facts companies cbars runs", """
    , ok AS (SELECT stage, max(finished_at) FILTER (status = 'success') AS ls FROM runs GROUP BY 1),
    hl AS (SELECT ok.stage, ls, count(r.run_id) AS n FROM ok LEFT JOIN runs r ON r.stage = ok.stage AND r.status = 'failed' AND (ls IS NULL OR r.finished_at > ls) GROUP BY 1, 2),
    sh AS (SELECT source || ': ' || CASE WHEN n > 0 THEN n || ' consecutive failures' WHEN (DATE '2030-01-01' - CAST(ls AS DATE)) * 24 > hours THEN 'last success ' || CAST(ls AS VARCHAR) END AS said, n > 0 AS block FROM hl JOIN """ + _HOURS + """ USING (stage)),
    got AS (SELECT cik, count(*) FILTER (concept = 'Assets') AS a, count(*) FILTER (concept = 'Liabilities') AS l, count(*) FILTER (concept = 'NetIncomeLoss') AS i FROM facts GROUP BY 1),
    own AS (SELECT security_id, CASE WHEN a IS NULL THEN 'no derived fundamentals' WHEN least(a, l, i) = 0 THEN CAST((a = 0)::INT + (l = 0)::INT + (i = 0)::INT AS VARCHAR) || ' fields unresolved: ' || concat_ws(', ', CASE WHEN a = 0 THEN 'Assets' END, CASE WHEN l = 0 THEN 'Liabilities' END, CASE WHEN i = 0 THEN 'NetIncomeLoss' END) END AS fd, a IS NULL AS fb FROM companies LEFT JOIN got USING (cik)),
    nb AS (SELECT security_id, max(date) AS last FROM cbars GROUP BY 1),
    pr AS (SELECT c.security_id, CASE WHEN last IS NULL THEN 'no bars' WHEN last < (SELECT max(date) FROM cbars) THEN 'newest bar ' || CAST(last AS VARCHAR) || ', dataset reaches ' || CAST((SELECT max(date) FROM cbars) AS VARCHAR) END AS pd, last IS NULL AS pb FROM companies c LEFT JOIN nb USING (security_id)),
    al AS (SELECT security_id, 'sec_companyfacts: ' || fd AS said, fb AS block FROM own WHERE fd IS NOT NULL UNION ALL SELECT security_id, 'prices: ' || pd, pb FROM pr WHERE pd IS NOT NULL
           UNION ALL SELECT security_id, said, block FROM companies, sh WHERE said IS NOT NULL)
    SELECT security_id, CASE WHEN bool_or(block) THEN 'high' WHEN count(said) > 0 THEN 'medium' ELSE 'none' END AS severity, coalesce(string_agg(said, '; ' ORDER BY said), 'no problem found') AS evidence_text
    FROM companies LEFT JOIN al USING (security_id) GROUP BY 1""")
def completeness_flags(t):
    name = F.create_map(*[F.lit(x) for kv in _SOURCES.items() for x in kv])
    health = REP.source_health(A.runs(t), source="stage").withColumns(
        {"source_name": F.element_at(name, F.col("stage")), "last_error": F.when(F.col("consecutive_failures") > 0, "failed")}
    )
    companies = A.companies(t)
    needed = F.array(*[F.lit(c) for c in NEEDED])
    got = A.facts(t).groupBy("cik").agg(F.collect_set(F.when(F.col("concept").isin(*NEEDED), F.col("concept"))).alias("_got"))
    absent = F.array_except(needed, "_got")
    missing = got.join(companies.select("cik", "security_id"), "cik").select(
        "security_id", F.map_from_arrays(absent, F.array_repeat(F.lit("never reported"), F.size(absent))).alias("missing")
    )
    as_of = A.day("2030-01-01")
    problems = RK.data_problems(companies, missing, A.company_bars(t), as_of)
    out = RK.completeness_flags(companies, problems, RK.failing_sources(health, as_of))
    return out.select("security_id", "flag.severity", "flag.evidence_text")


@query("unresolved_flags", "actions splits securities filings concepts facts insiders", _REVERSE + """
    , f AS (
        SELECT security_id, 'recent_reverse_split' AS flag_code, CASE WHEN security_id % 5 = 0 THEN source_accession || '9' ELSE source_accession END AS source_accession FROM rf
        UNION ALL SELECT doc_id, 'going_concern', CASE doc_id % 10 WHEN 3 THEN accession_no || '-0' WHEN 4 THEN NULL ELSE accession_no END FROM filings
        UNION ALL SELECT o_orderkey, 'rapid_share_growth', CASE WHEN o_orderkey % 9 = 4 THEN 'A-' || o_orderkey ELSE 'A' || o_orderkey END FROM orders WHERE o_orderkey % 4 <> 0
        UNION ALL SELECT security_id, 'recent_insider_selling', CASE security_id % 6 WHEN 1 THEN 'F0' ELSE 'none' END FROM securities
        UNION ALL SELECT security_id, 'low_interest_coverage', 'none' FROM securities WHERE security_id % 6 = 2),
    open AS (SELECT * FROM f WHERE NOT coalesce(source_accession = 'none' AND flag_code = 'recent_insider_selling', false) AND NOT coalesce(source_accession LIKE 'ledger:corporate_actions:%:none', false)),
    k AS (SELECT accession_no AS source_accession FROM filings UNION SELECT accession_no FROM facts UNION SELECT accession_no FROM insiders
          UNION SELECT 'ledger:corporate_actions:' || security_id || ':' || CAST(ex_date AS VARCHAR) FROM actions)
    SELECT security_id, flag_code, source_accession FROM open ANTI JOIN k USING (source_accession)""")
def unresolved_flags(t):
    """Flags from four kinds of sources, with references planted that nothing answers to."""
    k = F.col("security_id")
    row = lambda df, code, ref, unknown=F.lit(False): df.select(
        k, F.lit(code).alias("flag_code"), ref.cast("string").alias("source_accession"), unknown.alias("is_unknown")
    )
    splits = RK.reverse_splits(A.securities(t), A.actions(t), A.day(AS_OF))
    ref = F.col("flag.source_accession")
    flags = row(splits, "recent_reverse_split", F.when(k % 5 == 0, F.concat(ref, F.lit("9"))).otherwise(ref))
    filings = A.filings(t)
    own = F.col("accession_no")
    filed = filings.withColumn("security_id", F.col("doc_id"))
    flags = flags.unionByName(row(filed, "going_concern", F.when(k % 10 == 3, F.concat(own, F.lit("-0"))).when(k % 10 == 4, F.lit(None)).otherwise(own)))
    orders = t.orders.select(F.col("o_orderkey").alias("security_id"))
    growth = F.concat(F.when(k % 9 == 4, "A-").otherwise("A"), k.cast("string"))
    flags = flags.unionByName(row(orders, "rapid_share_growth", growth, k % 4 == 0))
    ids = A.securities(t)
    flags = flags.unionByName(row(ids, "recent_insider_selling", F.when(k % 6 == 1, "F0").otherwise("none")))
    flags = flags.unionByName(row(ids.where(k % 6 == 2), "low_interest_coverage", F.lit("none")))
    return V.unresolved_flags(flags, filings, A.facts(t), A.insiders(t), A.actions(t))
