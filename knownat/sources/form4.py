"""Ownership documents (XML) as insider rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import form4_number
from ..functions.text import plan_status, truthy

_VALUE = "struct<value:string>"
_TX = (
    f"struct<securityTitle:{_VALUE},transactionDate:{_VALUE},transactionCoding:struct<transactionCode:string>,"
    f"transactionAmounts:struct<transactionShares:{_VALUE},transactionPricePerShare:{_VALUE}>,"
    f"postTransactionAmounts:struct<sharesOwnedFollowingTransaction:{_VALUE}>>"
)
DOCUMENT = (
    "struct<documentType:string,periodOfReport:string,dateOfOriginalSubmission:string,aff10b5One:string,"
    "issuer:struct<issuerCik:string,issuerTradingSymbol:string>,"
    "reportingOwner:array<struct<reportingOwnerId:struct<rptOwnerCik:string,rptOwnerName:string>,"
    "reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,isTenPercentOwner:string,officerTitle:string>>>,"
    f"nonDerivativeTable:struct<nonDerivativeTransaction:array<{_TX}>>,"
    f"derivativeTable:struct<derivativeTransaction:array<{_TX}>>,"
    "footnotes:struct<footnote:array<struct<_VALUE:string>>>,remarks:string>"
)


def _text(c) -> Column:
    return F.nullif(F.trim(c if isinstance(c, Column) else F.col(c)), F.lit(""))


def parse_form4(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Table I rows, then table II, numbered across both. `documents`: accession_no, xml.

    Text around the ownership document is ignored. Value = shares x price only
    when both are reported.
    """
    body = F.regexp_extract(F.col(xml), r"(?s)<ownershipDocument>.*?</ownershipDocument>", 0)
    d = documents.where(body != "").select(
        *[c for c in documents.columns if c != xml], F.from_xml(body, DOCUMENT, {"mode": "PERMISSIVE"}).alias("_d")
    )
    owner = F.get("_d.reportingOwner", F.lit(0))
    notes = F.concat_ws(
        " ",
        F.transform("_d.footnotes.footnote", lambda f: F.trim(F.regexp_replace(f["_VALUE"], r"\s+", " "))),
        _text("_d.remarks"),
    )
    plan = plan_status("_d.aff10b5One", notes)
    none = F.array().cast(f"array<{_TX}>")

    def tagged(path: str, table: str) -> Column:
        return F.transform(F.coalesce(F.col(path), none), lambda t: F.struct(F.lit(table).alias("table_type"), t.alias("t")))

    lines = F.concat(
        tagged("_d.nonDerivativeTable.nonDerivativeTransaction", "I"), tagged("_d.derivativeTable.derivativeTransaction", "II")
    )
    kept = [c for c in documents.columns if c != xml]
    rows = d.select(
        *kept,
        F.upper(F.trim("_d.documentType")).endswith("/A").alias("is_amendment"),
        _text("_d.periodOfReport").try_cast("date").alias("period_of_report"),
        _text("_d.dateOfOriginalSubmission").try_cast("date").alias("date_of_original_submission"),
        _text("_d.issuer.issuerCik").alias("issuer_cik"), _text("_d.issuer.issuerTradingSymbol").alias("issuer_symbol"),
        _text(owner["reportingOwnerId"]["rptOwnerCik"]).alias("insider_cik"),
        _text(owner["reportingOwnerId"]["rptOwnerName"]).alias("insider_name"),
        truthy(owner["reportingOwnerRelationship"]["isOfficer"]).alias("role_officer"),
        truthy(owner["reportingOwnerRelationship"]["isDirector"]).alias("role_director"),
        truthy(owner["reportingOwnerRelationship"]["isTenPercentOwner"]).alias("role_ten_percent"),
        _text(owner["reportingOwnerRelationship"]["officerTitle"]).alias("officer_title"),
        plan["status"].alias("plan_status"), plan["source"].alias("plan_status_source"),
        F.posexplode(lines).alias("_i", "_l"),
    )
    t = F.col("_l.t")
    shares = form4_number(_text(t["transactionAmounts"]["transactionShares"]["value"]))
    price = form4_number(_text(t["transactionAmounts"]["transactionPricePerShare"]["value"]))
    return rows.select(
        *[c for c in rows.columns if not c.startswith("_")],
        (F.col("_i") + 1).alias("line_no"), F.col("_l.table_type").alias("table_type"),
        _text(t["transactionCoding"]["transactionCode"]).alias("transaction_code"),
        _text(t["transactionDate"]["value"]).try_cast("date").alias("transaction_date"),
        shares.alias("shares"), price.alias("price_per_share"), (shares * price).alias("total_value"),
        form4_number(_text(t["postTransactionAmounts"]["sharesOwnedFollowingTransaction"]["value"])).alias("shares_owned_after"),
        _text(t["securityTitle"]["value"]).alias("security_title"),
    )
