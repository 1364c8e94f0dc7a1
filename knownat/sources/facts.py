"""Company-facts payloads and submissions blocks as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import acceptance_time, context_hash, document_url, lenient_number, pad_cik, semantic_hash
from .schemas import COMPANY_FACTS, SUBMISSIONS_BLOCK


def parse_company_facts(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """One row per reported entry. `payloads`: payload_id, text of the JSON.

    The key keeps the entry's place in its array; a start date makes a duration,
    none an instant; absent fields stay NULL.
    """
    root = payloads.select("payload_id", F.from_json(text, COMPANY_FACTS).alias("_j"))
    rows = root.select("payload_id", pad_cik("_j.cik").alias("cik"), F.explode("_j.facts").alias("taxonomy", "_c"))
    rows = rows.select("payload_id", "cik", "taxonomy", F.explode("_c").alias("concept", "_b"))
    rows = rows.select("payload_id", "cik", "taxonomy", "concept", F.explode("_b.units").alias("unit", "_e"))
    rows = rows.select("payload_id", "cik", "taxonomy", "concept", "unit", F.posexplode("_e").alias("_i", "_f"))
    start, end = F.nullif("_f.start", F.lit("")), F.col("_f.end")
    kind = F.when(start.isNotNull(), "duration").otherwise("instant")
    none = F.lit(None).cast("string")
    value = F.col("_f.val")
    return rows.select(
        "payload_id",
        F.concat_ws("|", "taxonomy", "concept", "unit", F.col("_i").cast("string")).alias("source_fact_key"),
        "cik", "taxonomy", "concept", "unit", kind.alias("context_type"),
        start.try_cast("date").alias("period_start"), end.try_cast("date").alias("period_end"),
        value.alias("raw_value"),
        F.when(~F.lower(value).isin("true", "false"), lenient_number(value)).alias("normalized_numeric_value"),
        F.col("_f.fy").alias("fiscal_year"), F.col("_f.fp").alias("fiscal_period"), F.col("_f.form").alias("form_type"),
        F.col("_f.accn").alias("accession_no"), F.col("_f.filed").try_cast("date").alias("filed_date"),
        F.col("_f.frame").alias("frame"),
        context_hash(kind, start, end, none).alias("context_hash"),
        semantic_hash("taxonomy", "concept", "unit", kind, start, end, none).alias("semantic_hash"),
    )


def parse_submissions(blocks: DataFrame, text: str = "block") -> DataFrame:
    """Filing rows from parallel arrays; shorter arrays give NULL. `blocks`: cik, page_no, JSON."""
    j = blocks.select("cik", "page_no", F.from_json(text, SUBMISSIONS_BLOCK).alias("_j"))
    names = ("accessionNumber", "form", "filingDate", "acceptanceDateTime", "reportDate", "primaryDocument")
    arrays = [F.coalesce(F.col(f"_j.{n}"), F.array().cast("array<string>")).alias(n) for n in names]
    zipped = j.select("cik", "page_no", *arrays).select("cik", "page_no", F.explode(F.arrays_zip(*names)).alias("_r"))
    r = lambda n: F.nullif(F.col(f"_r.{n}"), F.lit(""))
    return zipped.where(F.col("_r.accessionNumber").isNotNull()).select(
        F.col("_r.accessionNumber").alias("accession_no"), pad_cik("cik").alias("cik"), "page_no",
        r("form").alias("form_type"), r("filingDate").try_cast("date").alias("filed_date"),
        acceptance_time("_r.acceptanceDateTime").alias("accepted_at"),
        r("reportDate").try_cast("date").alias("period_of_report"),
        document_url("cik", "_r.accessionNumber", "_r.primaryDocument").alias("primary_doc_url"),
        r("primaryDocument").alias("primary_document"),
    )


def filing_index(filings: DataFrame) -> DataFrame:
    """One row per accession; the most recent page wins."""
    best = F.min_by(F.struct(*[c for c in filings.columns if c != "accession_no"]), "page_no")
    return filings.groupBy("accession_no").agg(best.alias("_r")).select("accession_no", "_r.*")


def with_acceptance(facts: DataFrame, index: DataFrame) -> DataFrame:
    """Facts with the acceptance time of their filing; unresolved stays NULL (unusable)."""
    return facts.join(index.select("accession_no", "accepted_at"), "accession_no", "left")


def ticker_map(records: DataFrame, text: str = "payload") -> DataFrame:
    """{"0": {cik_str, ticker, title}} as rows; the last record of a ticker wins."""
    parsed = records.select(
        F.explode(F.from_json(text, "map<string,struct<cik_str:string,ticker:string,title:string>>")).alias("_k", "_r")
    )
    last = F.max_by(F.struct(pad_cik("_r.cik_str").alias("cik"), F.col("_r.title").alias("title")), F.col("_k").cast("bigint"))
    return parsed.groupBy(F.upper("_r.ticker").alias("ticker")).agg(last.alias("_v")).select("ticker", "_v.*")


def capped_form4(filings: DataFrame, since, max_originals: int | None = None, max_amendments: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(form 4 and 4/A filings since a date, filings dropped per company).

    Nothing is dropped unless a limit is given; then the newest of a company stay.
    """
    f = filings.where(F.col("form_type").isin("4", "4/A") & (F.col("filed_date") >= since))
    w = Window.partitionBy("cik", "form_type").orderBy(F.desc("filed_date"), F.desc("accession_no"))
    if max_originals is None and max_amendments is None:
        return f, f.groupBy("cik").agg(F.lit(0).cast("long").alias("dropped_by_cap"))
    most = [F.lit(n).cast("long") if n is not None else F.lit(2**62) for n in (max_amendments, max_originals)]
    cap = F.when(F.col("form_type") == "4/A", most[0]).otherwise(most[1])
    kept = f.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")
    per = f.groupBy("cik", "form_type").agg(F.count("*").alias("_all"))
    over = F.greatest(F.lit(0).cast("long"), F.col("_all") - cap)
    return kept, per.groupBy("cik").agg(F.sum(over).alias("dropped_by_cap"))
