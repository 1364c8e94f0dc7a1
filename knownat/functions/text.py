"""Text rules: markup removal, security and filing classification, title match."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .core import col, first_match

# Whitespace as a Unicode-aware text tool sees it.
SPACES = r"[\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"

# Instrument phrases in official names, tried in this order.
NAME_RULES = (
    (r"(?i)\bamerican depositary (shares?|receipts?)\b", "adr", "high", "name:adr"),
    (r"(?i)\bunits? of beneficial interest\b", "trust_unit", "high", "name:trust_unit"),
    (r"(?i)\bunits?\b", "unit", "high", "name:unit"),
    (r"(?i)\bwarrants?\b", "warrant", "high", "name:warrant"),
    (r"(?i)\brights?\b", "right", "high", "name:right"),
    (r"(?i)\b(preferred|depositary shares?)\b", "preferred_share", "high", "name:preferred"),
    (r"(?i)\bexchange[- ]traded note\b|\bETN\b", "etn", "high", "name:etn"),
    (r"(?i)\bclosed[- ]end fund\b", "closed_end_fund", "high", "name:closed_end_fund"),
    (r"(?i)\b(common stock|ordinary shares?|common shares?)\b", "common_stock", "high", "name:common"),
    (r"(?i)\bcapital stock\b", "common_stock", "high", "name:capital_stock"),
    (r"(?i)\bfund\b", "closed_end_fund", "medium", "name:fund_weak"),
)
SHARE_CLASS = r"(?i)\bclass\s+([A-Z])\b"

# Filing language that decides what an offering is.
DEBT = (
    r"(?i)medium[-\s]term note|senior note|subordinated note|structured note|"
    r"\bnotes\s+due\b|principal amount of|fixed[-\s]rate note|floating[-\s]rate note|"
    r"callable (fixed|step|zero)|market[-\s]linked|contingent income|autocallable|"
    r"digital note|buffered|trigger note|certificates of deposit"
)
EQUITY = (
    r"(?i)shares of (our )?common stock|ordinary shares|shares of common stock|"
    r"resale of|selling (stockholder|shareholder)s?|"
    r"offering of .{0,40}common stock|common shares"
)
AT_THE_MARKET = (
    r"(?is)at[-\s]the[-\s]market (offering|program|programme|sales|transactions?)"
    r".{0,400}?(common stock|ordinary shares)|"
    r"(common stock|ordinary shares).{0,400}?at[-\s]the[-\s]market "
    r"(offering|program|programme|sales)|"
    r"\bATM (program|programme|facility)\b|"
    r"sales agreement .{0,120}(common stock|ordinary shares)|"
    r"rule 415\(a\)\(4\)"
)
VARIABLE_CONVERTIBLE = (
    r"(?i)variable conversion price|conversion price .{0,80}(discount|percentage of|lower of)|"
    r"floating conversion|conversion price shall equal .{0,60}(market|VWAP)|"
    r"death spiral|reset provision .{0,40}conversion"
)
RULE_415 = r"(?i)rule\s*415"
CONVERTIBLE = r"(?i)convertible (note|debenture|preferred)"
SHELF_FORMS = ("S-3", "S-3/A", "S-3ASR", "S-1", "S-1/A")
TAKEDOWN_FORMS = ("424B2", "424B5")

# Executive titles.
CEO_OR_CFO = r"(?i)\bC\.?E\.?O\.?\b|chief\s+executive|\bC\.?F\.?O\.?\b|chief\s+financial"

# Trading-plan footnotes.
NEGATED_PLAN = r"(?i)\b(not|no|without|outside(?:\s+of)?|other\s+than)\b[^.]{0,80}?10b5[-\s]?1"
MENTIONED_PLAN = r"(?i)10b5[-\s]?1"

# Substantial-doubt construction and the language that voids it.
DOUBT = r"(?i)substantial\s+doubt"
GOING_CONCERN = r"(?i)ability\s+to\s+continue\s+as\s+a\s+going\s+concern"
DENIAL = (
    r"(?i)(?:do(?:es)?|did|have|has|had|was|were|is|are)\s+not\s+(?:\w+\s+){0,3}"
    r"(?:raise|indicate|create|exist)"
    r"|no\s+(?:longer\s+)?substantial\s+doubt"
    r"|not\s+(?:been\s+)?(?:raise|raised|identified)"
)
DEFINITION = (
    r"(?i)\b(?:if|whether|when|where|should|would|could|may|might)\b"
    r"(?:\W+\w+){0,6}\W+substantial\s+doubt"
    r"|substantial\s+doubt\s+(?:is|were)\s+to\s+(?:exist|arise)"
    r"|in\s+accordance\s+with\s+asc\s+205-40[^.]{0,120}substantial\s+doubt"
)
ALLEVIATED = (
    r"(?i)alleviat\w*"
    r"|mitigat\w+\s+(?:the\s+)?substantial\s+doubt"
    r"|substantial\s+doubt\s+(?:has|had|was)\s+been\s+(?:resolved|removed)"
)
SELF_REFERENCE = (
    r"(?i)\b(?:its|our|the\s+Compan(?:y|y's|ies')|the\s+Registrant(?:'s)?"
    r"|we\s+(?:will|may|would|could)|the\s+Group's)\b"
)
ANCHOR_GAP = 240
CONTEXT_MARGIN = 160
QUOTE_MARGIN = 320


@F.pandas_udf(StringType())
def decode_entities(texts: pd.Series) -> pd.Series:
    """Character references as text; Spark has no built-in for the full table. Null stays null."""
    return texts.map(html.unescape, na_action="ignore")


def html_to_text(markup) -> Column:
    """Readable text of a document: tags become spaces, entities are decoded."""
    text = F.regexp_replace(col(markup), r"(?i)&(?:nbsp|#160|#xa0);", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    text = F.coalesce(decode_entities(F.when(F.contains(text, F.lit("&")), text)), text)  # others never leave the JVM
    text = F.regexp_replace(text, "[\u200b\u00a0\ufeff]", " ")
    return F.trim(F.regexp_replace(text, SPACES, " "))


def share_class(name) -> Column:
    return F.nullif(F.upper(F.regexp_extract(F.coalesce(col(name), F.lit("")), SHARE_CLASS, 1)), F.lit(""))


def _instrument(kind, confidence, source, cls) -> Column:
    parts = (kind, confidence, source)
    named = [
        (v if isinstance(v, Column) else F.lit(v)).alias(n)
        for v, n in zip(parts, ("security_type", "confidence", "source"))
    ]
    return F.struct(*named, cls.alias("share_class"))


def classify_listing(name, is_test_issue, is_etf, present=None, origin: str = "nasdaq") -> Column:
    """Instrument type with confidence and evidence; directory flags decide first."""
    present = F.lit(True) if present is None else present
    text = F.coalesce(col(name), F.lit(""))
    cls = share_class(name)
    no_class = F.lit(None).cast("string")
    rules = [
        (~present, _instrument("unknown", "low", "no_listing_record", no_class)),
        (F.coalesce(col(is_test_issue), F.lit(False)), _instrument("test_issue", "high", f"{origin}:test_issue_flag", cls)),
        (F.coalesce(col(is_etf), F.lit(False)), _instrument("etf", "high", f"{origin}:etf_flag", cls)),
    ]
    rules += [
        (text.rlike(pattern), _instrument(kind, conf, f"{origin}:{label}", cls))
        for pattern, kind, conf, label in NAME_RULES
    ]
    rules.append((cls.isNotNull(), _instrument("common_stock", "medium", f"{origin}:name_class_only", cls)))
    return first_match(*rules, otherwise=_instrument("unknown", "low", f"{origin}:name_unmatched", cls))


def classify_title(title) -> Column:
    """Same rules on a cover-page security title."""
    text = F.coalesce(col(title), F.lit(""))
    cls = share_class(title)
    origin = "sec:dei:Security12bTitle"
    rules = [(F.trim(text) == "", _instrument("unknown", "low", "sec:security_title_missing", F.lit(None).cast("string")))]
    rules += [
        (text.rlike(pattern), _instrument(kind, conf, f"{origin}:{label}", cls))
        for pattern, kind, conf, label in NAME_RULES
    ]
    rules.append((cls.isNotNull(), _instrument("common_stock", "medium", f"{origin}:class_only", cls)))
    return first_match(*rules, otherwise=_instrument("unknown", "low", f"{origin}:unmatched", cls))


def rank_exclusion_reason(security_type, confidence) -> Column:
    """Why a security is never ranked; NULL when it may be."""
    kind, conf = col(security_type), col(confidence)
    return first_match(
        (kind == "unknown", "unknown classification"),
        (kind != "common_stock", F.concat(F.lit("not common stock: "), kind)),
        (~conf.isin("high", "medium"), F.concat(F.lit("low confidence: "), conf)),
    )


def industry_label(sic) -> Column:
    code = F.trim(col(sic).cast("string"))
    return first_match(
        (code == "6798", "REIT"),
        (code.startswith("602") | code.isin("6020", "6021", "6022", "6035", "6036"), "Bank"),
    )


# Standard industry divisions by two-digit major group.
DIVISIONS = (
    (1, 9, "A", "Agriculture, Forestry and Fishing"),
    (10, 14, "B", "Mining"),
    (15, 17, "C", "Construction"),
    (20, 39, "D", "Manufacturing"),
    (40, 49, "E", "Transportation, Communications, Electric, Gas and Sanitary Services"),
    (50, 51, "F", "Wholesale Trade"),
    (52, 59, "G", "Retail Trade"),
    (60, 67, "H", "Finance, Insurance and Real Estate"),
    (70, 89, "I", "Services"),
    (91, 99, "J", "Public Administration"),
)


def cohort_id(sic) -> Column:
    """Division letter of an industry code, SIC-UNKNOWN outside the table."""
    digits = F.regexp_replace(col(sic).cast("string"), r"\D", "")
    major = F.substring(digits, 1, 2).try_cast("int")
    return F.coalesce(
        first_match(*[(major.between(lo, hi), f"SIC-{letter}") for lo, hi, letter, _ in DIVISIONS]),
        F.lit("SIC-UNKNOWN"),
    )


def cohort_label(cohort) -> Column:
    cohort = col(cohort)
    return first_match(
        *[(cohort == f"SIC-{letter}", f"SIC division {letter} - {name}") for _, _, letter, name in DIVISIONS],
        otherwise="Unclassified (no SIC division)",
    )


def is_ceo_or_cfo(title) -> Column:
    return F.coalesce(col(title), F.lit("")).rlike(CEO_OR_CFO)


def insider_key(cik, name) -> Column:
    """One key per person: padded CIK, else the collapsed upper-case name."""
    from .core import pad_cik

    cik_text = F.nullif(col(cik).cast("string"), F.lit(""))
    name_text = F.nullif(F.upper(F.trim(F.regexp_replace(F.coalesce(col(name), F.lit("")), SPACES, " "))), F.lit(""))
    return F.coalesce(
        F.concat(F.lit("cik:"), pad_cik(cik_text)),
        F.concat(F.lit("name:"), name_text),
        F.lit("unidentified"),
    )


def truthy(raw) -> Column:
    return F.coalesce(F.lower(F.trim(col(raw).cast("string"))).isin("1", "true", "y", "yes"), F.lit(False))


def plan_status(checkbox, footnotes) -> Column:
    """Trading-plan status and its evidence; the checkbox outranks footnotes."""
    box = F.nullif(F.trim(col(checkbox).cast("string")), F.lit(""))
    notes = F.coalesce(col(footnotes), F.lit(""))

    def made(status: str, source: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(source).alias("source"))

    return first_match(
        (box.isNotNull() & truthy(box), made("confirmed_10b5_1", "checkbox")),
        (box.isNotNull(), made("discretionary", "checkbox")),
        (notes.rlike(NEGATED_PLAN), made("discretionary", "footnote")),
        (notes.rlike(MENTIONED_PLAN), made("confirmed_10b5_1", "footnote")),
        otherwise=made("unknown", "absent"),
    )


def classify_filing(form, text) -> Column:
    """What a filing offers. Debt language wins unless the terms float."""
    form = F.upper(F.coalesce(col(form), F.lit("")))
    body = F.coalesce(col(text), F.lit(""))
    equity, variable = body.rlike(EQUITY), body.rlike(VARIABLE_CONVERTIBLE)
    shelf, takedown = form.isin(*SHELF_FORMS), form.isin(*TAKEDOWN_FORMS)

    def outcome(name: str, why: str) -> Column:
        return F.struct(F.lit(name).alias("outcome"), F.lit(why).alias("reason"))

    return first_match(
        (F.trim(body) == "", outcome("unknown", "no document text")),
        (variable, outcome("variable_convertible", "floating conversion terms")),
        (body.rlike(DEBT), outcome("debt_or_structured", "note language")),
        (body.rlike(AT_THE_MARKET), outcome("atm_programme", "at-the-market programme for common equity")),
        (shelf & body.rlike(RULE_415) & equity, outcome("shelf_415", "Rule 415 shelf for common equity")),
        ((shelf | takedown) & equity, outcome("equity_offering", "common equity offered")),
        (shelf, outcome("unknown", "registration without clear common equity")),
        (takedown & body.rlike(CONVERTIBLE), outcome("unknown", "convertible without floating terms")),
        (takedown, outcome("unknown", "supplement without clear common equity")),
        otherwise=outcome("unknown", "form outside the rules"),
    )


SCORING_OUTCOMES = ("equity_offering", "atm_programme", "variable_convertible", "shelf_415")


def cited_accessions(json_text) -> Column:
    """Accessions named under any *accession key in stored JSON, sorted, distinct."""
    found = F.regexp_extract_all(
        col(json_text), F.lit(r'"(?:[^"\\]*_)?accession"\s*:\s*"([^"\\]+)"'), F.lit(1)
    )
    return F.array_sort(F.array_distinct(F.filter(found, lambda a: ~a.startswith("ledger:") & (a != "none"))))


def share_growth_detail(notes, schema: str) -> Column:
    """The JSON a note carries after its marker, up to the separator."""
    notes = col(notes)
    marker = "share growth basis: "
    tail = F.when(F.contains(notes, F.lit(marker)), F.substring_index(notes, marker, -1))
    return F.from_json(F.substring_index(tail, " | ", 1), schema)


# Mean analyst rating, 1 is the most positive.
CONSENSUS_TIERS = ((1.5, "Strong bullish"), (2.5, "Bullish"), (3.5, "Neutral"), (4.5, "Bearish"))


def consensus_tier(mean) -> Column:
    mean = col(mean)
    return F.when(
        mean.isNotNull(),
        first_match(*[(mean <= cut, label) for cut, label in CONSENSUS_TIERS], otherwise="Strong bearish"),
    )


def rating_shares(*counts) -> Column:
    """Share of each rating in the row's own total; NULL when there is none."""
    values = [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in counts]
    total = sum(values[1:], values[0])
    return F.when(total > 0, F.array(*[v / total for v in values]))


# Screening steps in order with the reasons that fail them.
CHECKLIST = (
    ("Fresh market data", ("stale_source",)),
    ("Composite score", ("not_rankable",)),
    ("Model supported", ("model_not_applicable",)),
    ("Dilution screen", ("dilution_disqualified",)),
    ("Risk-flag screen", ("risk_flag_going_concern", "risk_flag_dilution_disqualify")),
    ("Minimum score", ("composite_threshold_unset", "below_composite_threshold")),
    ("Cooldown clear", ("cooldown_recent_exit", "cooldown_gap_cancelled")),
    ("Portfolio limits", ("open_position", "book_capacity", "selection_cap", "cohort_cap")),
)


def checklist(reason, detail=None, composite=None) -> Column:
    """Ordered (label, state) steps: before the failing one pass, after it unknown."""
    reason = col(reason)
    failed_at = first_match(*[(reason.isin(*codes), i) for i, (_, codes) in enumerate(CHECKLIST)], otherwise=-1)

    def step(label: str, state: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), state.alias("state"))

    def at(i: int) -> Column:
        return first_match((failed_at == -1, "unknown"), (failed_at > i, "pass"), (failed_at == i, "fail"), otherwise="unknown")

    steps = F.array(*[step(label, at(i)) for i, (label, _) in enumerate(CHECKLIST)])
    if detail is None:
        return steps
    text = F.coalesce(col(detail), F.lit(""))

    def known(missing: Column) -> Column:
        return F.when(missing, "unknown").otherwise("pass")

    evidence = F.array(
        step("In stock universe", F.lit("pass")),
        step("Composite score", known(col(composite).isNull())),
        step("Dilution evidence", known(F.contains(text, F.lit("dilution_signals")))),
        step("Risk-flag evidence", known(F.contains(text, F.lit("risk_flags")))),
        step("Final eligibility", F.lit("fail")),
    )
    return F.when(reason == "dilution_or_riskflags_unknown", evidence).otherwise(steps)
