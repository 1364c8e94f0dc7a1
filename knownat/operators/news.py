"""News filings, their documents, and validation of extracted events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import first_match
from .ranking import group_top

# Vocabulary of the event ledger.
EVENT_TYPES = (
    "binding_commercial_contract", "contract_termination", "lawsuit", "merger_acquisition",
    "financing_or_securities_issuance", "partnership_no_disclosed_commitment", "non_binding_loi_or_mou",
    "rumor_unnamed_source",
)
TIERS = ("binding", "non_binding_loi", "rumor")
AMOUNT_TYPES = ("total", "annual", "minimum", "maximum", "estimated")


def document_roles(filings: DataFrame, documents: DataFrame, since: Column) -> DataFrame:
    """Documents of current reports since a date; the first one stands in for a missing primary.

    `documents`: accession_no, document_name, document_order; `filings` names the
    primary in primary_document.
    """
    recent = filings.where(F.col("form_type").isin("8-K", "8-K/A") & (F.col("filed_date") >= since))
    docs = documents.join(recent.select("accession_no", "primary_document"), "accession_no")
    named = F.coalesce(F.col("document_name") == F.col("primary_document"), F.lit(False))
    lead = docs.groupBy("accession_no").agg(
        F.bool_or(named).alias("_has"), F.min_by("document_name", "document_order").alias("_first")
    )
    docs = docs.join(lead, "accession_no")
    primary = named | (~F.col("_has") & (F.col("document_name") == F.col("_first")))
    return docs.withColumn("role", F.when(primary, "primary").otherwise("exhibit")).drop("_has", "_first", "primary_document")


def pending_filings(filings: DataFrame, events: DataFrame) -> DataFrame:
    """Filings without any event yet; callers order by filed_date."""
    return filings.join(events.select("accession_no").distinct(), "accession_no", "left_anti")


def document_bundles(
    filings: DataFrame, documents: DataFrame, text: str = "text", exhibits: int | None = None, chars: int | None = None
) -> DataFrame:
    """Primary documents and exhibits of each filing, at full length.

    With `exhibits` only the first so many by name are kept, with `chars` only so
    much of each text; chars_cut says how much is missing. A filing without a
    readable document gives one abstain row.
    """
    kept = documents
    if exhibits is not None:
        first = group_top(documents.where(F.col("role") == "exhibit"), ["accession_no"], [F.col("document_name")], exhibits).drop("_rn")
        kept = documents.where(F.col("role") == "primary").unionByName(first)
    bundle = F.col(text) if chars is None else F.substring(text, 1, chars)
    kept = kept.withColumn("bundle_text", bundle).withColumn("chars_cut", F.length(text) - F.length("bundle_text"))
    out = filings.select("accession_no").join(kept.drop(text), "accession_no", "left")
    return out.withColumn("is_abstain", F.col("document_name").isNull())


def event_error() -> Column:
    """First rule an extracted event breaks; NULL when it may be stored."""
    c = F.col
    blank = lambda n: F.coalesce(c(n) == "", F.lit(True))
    return first_match(
        (c("is_abstain") & (c("event_type_candidate").isNotNull() | c("confirmation_tier").isNotNull()), "abstain_with_type"),
        (c("is_abstain") & blank("abstain_reason"), "abstain_without_reason"),
        (~c("is_abstain") & ~blank("abstain_reason"), "event_with_abstain_reason"),
        (~c("is_abstain") & ~F.coalesce(c("confirmation_tier").isin(*TIERS), F.lit(False)), "tier"),
        (c("amount_explicit") & c("amount_stated").isNull(), "explicit_without_amount"),
        (~c("amount_explicit") & c("amount_stated").isNotNull(), "inferred_amount"),
        (blank("supporting_passage"), "no_passage"),
        (blank("source_document"), "no_source_document"),
    )


def validate_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with the reason)."""
    checked = events.withColumn("error", event_error())
    return checked.where(F.col("error").isNull()).drop("error"), checked.where(F.col("error").isNotNull())


def effective_events(events: DataFrame) -> DataFrame:
    """Events no other event supersedes."""
    gone = events.where(F.col("supersedes_event_id").isNotNull()).select(F.col("supersedes_event_id").alias("event_id"))
    return events.join(gone.distinct(), "event_id", "left_anti")
