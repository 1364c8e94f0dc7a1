"""Risk flags: one row per (security, date, code), unknown is a row of its own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FROZEN, Params
from ..functions import text as T
from ..functions.core import clamp, first_match, money_text
from .bars import split_events

FLAG = "struct<flag_code:string,severity:string,evidence_text:string,source_accession:string,is_unknown:boolean>"

# Thresholds and coefficients.
LOW_COVERAGE = 1.5
RAPID_GROWTH = 0.20
REVERSE_SPLIT_DAYS = 3 * 365
ALTMAN = {"x1": (6.56, -2.0, 2.0), "x2": (3.26, -2.0, 2.0), "x3": (6.72, -2.0, 2.0), "x4": (1.05, 0.0, 10.0)}
DISTRESS, GREY = 1.10, 2.60
SEVERITY_ORDER = ("high", "medium", "low", "context", "unknown")
FILING_GRACE = {"next_period": 91, "deadline": 45, "late": 15}


def flag(code: str, severity, evidence, accession=None) -> Column:
    """A known flag, or an unknown one when its accession may not be absent but is."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    return F.struct(
        F.lit(code).alias("flag_code"), lit(severity).alias("severity"), lit(evidence).alias("evidence_text"),
        lit(accession).alias("source_accession"), F.lit(False).alias("is_unknown"),
    )


def unknown(code: str, why) -> Column:
    why = why if isinstance(why, Column) else F.lit(why)
    return F.struct(
        F.lit(code).alias("flag_code"), F.lit("unknown").alias("severity"),
        F.concat(F.lit("Could not determine: "), why).alias("evidence_text"),
        F.lit(None).cast("string").alias("source_accession"), F.lit(True).alias("is_unknown"),
    )


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def negative_operating_cash_flow(cfo: Column) -> Column:
    code = "negative_operating_cash_flow"
    v, acc = cfo["value"], cfo["accession"]
    said = _say("operating cash flow ", money_text(v))
    return first_match(
        (v.isNull(), unknown(code, "operating cash flow not reported")),
        (v >= 0, flag(code, "none", said, acc)),
        otherwise=flag(code, "high", said, acc),
    )


def negative_free_cash_flow(cfo: Column, capex: Column) -> Column:
    code = "negative_free_cash_flow"
    free = cfo["value"] - F.abs(capex["value"])
    said = _say("free cash flow ", money_text(free))
    return first_match(
        (cfo["value"].isNull(), unknown(code, "operating cash flow not reported")),
        (capex["value"].isNull(), unknown(code, "capital expenditure not reported")),
        (free >= 0, flag(code, "none", said, cfo["accession"])),
        (cfo["value"] >= 0, flag(code, "medium", said, cfo["accession"])),
        otherwise=flag(code, "high", said, cfo["accession"]),
    )


def high_leverage(value: Column, accession: Column, params: Params = FROZEN) -> Column:
    code, limit = "high_leverage", params.high_leverage_debt_ebitda
    said = _say("debt/EBITDA ", F.format_number(value, 2))
    return first_match(
        (value.isNull(), unknown(code, "debt/EBITDA not available")),
        (value <= limit, flag(code, "none", said, accession)),
        (value > limit * 1.5, flag(code, "high", said, accession)),
        otherwise=flag(code, "medium", said, accession),
    )


def low_interest_coverage(value: Column, accession: Column) -> Column:
    code = "low_interest_coverage"
    said = _say("interest coverage ", F.format_number(value, 2))
    return first_match(
        (value.isNull(), unknown(code, "interest coverage not available")),
        (value >= LOW_COVERAGE, flag(code, "none", said, accession)),
        (value < 1.0, flag(code, "high", said, accession)),
        otherwise=flag(code, "medium", said, accession),
    )


def rapid_share_growth(growth: Column, accession: Column, reason: Column) -> Column:
    code = "rapid_share_growth"
    said = _say("split-adjusted share growth ", F.format_number(growth * 100, 1), "%")
    return first_match(
        (growth.isNull(), unknown(code, F.coalesce(reason, F.lit("no comparison")))),
        (accession.isNull(), unknown(code, "growth without a reporting accession")),
        (growth <= RAPID_GROWTH, flag(code, "none", said, accession)),
        (growth > 0.50, flag(code, "high", said, accession)),
        otherwise=flag(code, "medium", said, accession),
    )


def reverse_splits(securities: DataFrame, actions: DataFrame, as_of: Column) -> DataFrame:
    """Newest reverse split of three years per security, as a flag row."""
    code = "recent_reverse_split"
    recent = split_events(actions).where(
        (F.col("ratio") < 1.0) & F.col("ex_date").between(F.date_sub(as_of, REVERSE_SPLIT_DAYS), as_of)
    )
    newest = recent.groupBy("security_id").agg(F.max(F.struct("ex_date", "ratio")).alias("_s"))
    out = securities.select("security_id").join(newest, "security_id", "left")
    key = _say("ledger:corporate_actions:", F.col("security_id").cast("string"), ":")
    seen = F.col("_s").isNotNull()
    made = F.when(
        seen,
        flag(code, "medium", _say("reverse split ", F.col("_s.ratio").cast("string")), F.concat(key, F.col("_s.ex_date").cast("string"))),
    ).otherwise(flag(code, "none", "no ratio below one", F.concat(key, F.lit("none"))))
    return out.select("security_id", made.alias("flag"))


def dilution_flags(securities: DataFrame, evidence: DataFrame) -> DataFrame:
    """Shelf, issuance and structural flags from classified filings, in reading order."""
    e = F.struct(F.col("read_order"), F.col("accession_no"), F.col("form_type"), F.col("filed_date"), F.col("outcome"))
    at = F.col("read_order")
    structural = F.col("outcome").isin("atm_programme", "variable_convertible") & F.col("scores")
    per = evidence.groupBy("cik").agg(
        F.count("*").alias("_n"),
        F.min_by(e, at).alias("_first"),
        F.min_by(e, F.when(F.col("tier") == "D1", at)).alias("_shelf"),
        F.min_by(e, F.when(F.col("tier") == "D2", at)).alias("_take"),
        F.count_if(F.col("tier") == "D2").alias("_takes"),
        F.min_by(e, F.when(structural, at)).alias("_struct"),
        F.max("skipped_by_cap").alias("_skipped"),
    )
    out = securities.select("security_id", "cik").join(per, "cik", "left")
    none = F.col("_n").isNull()

    def pick(code: str, found: str, severity) -> Column:
        f = F.col(found)
        said = _say(f["form_type"], " filed ", f["filed_date"].cast("string"), " classified ", f["outcome"])
        return first_match(
            (none, unknown(code, "no filing was classified")),
            (f.isNotNull(), flag(code, severity, said, f["accession_no"])),
            otherwise=flag(code, "none", _say(F.col("_n").cast("string"), " filings classified"), F.col("_first.accession_no")),
        )

    flags = F.array(
        pick("shelf_capacity", "_shelf", "medium"),
        pick("active_issuance", "_take", F.when(F.col("_takes") >= 3, "high").otherwise("medium")),
        pick("atm_or_convertible", "_struct", F.when(F.col("_struct.outcome") == "variable_convertible", "high").otherwise("medium")),
        F.when(F.coalesce(F.col("_skipped"), F.lit(0)) > 0, unknown("stale_or_incomplete_data", "dilution classification was capped")),
    )
    return out.select("security_id", F.explode(F.filter(flags, lambda f: f.isNotNull())).alias("flag"))


def insider_selling_flags(coverage: DataFrame, sales: DataFrame) -> DataFrame:
    """Selling is context, never a negative; incomplete coverage stays unknown."""
    code = "recent_insider_selling"
    out = coverage.select("security_id", "coverage_complete", "coverage_reason").join(sales, "security_id", "left")
    said = _say(F.col("sales").cast("string"), " sales by ", F.col("sellers").cast("string"), " insiders, ", money_text("value"))
    made = first_match(
        (~F.col("coverage_complete"), unknown(code, F.col("coverage_reason"))),
        (F.col("sales").isNull(), flag(code, "context", "no open-market sales", "none")),
        otherwise=flag(code, "context", said, F.col("newest_accession")),
    )
    return out.select("security_id", made.alias("flag"))


def failing_sources(health: DataFrame, as_of: Column, params: Params = FROZEN) -> DataFrame:
    """One row: the texts of all failing or stale sources, and whether any of them blocks."""
    budget = F.create_map(*[F.lit(x) for k, v in params.freshness_sla.items() for x in (k, float(v))])
    age = F.datediff(as_of, F.col("last_success").cast("date")) * 24.0
    failing = F.col("last_error").isNotNull() & (F.col("consecutive_failures") > 0)
    detail = F.when(failing, _say(F.col("consecutive_failures").cast("string"), " consecutive failures")).when(
        age > F.try_element_at(budget, "source_name"), _say("last success ", F.col("last_success").cast("string"))
    )
    found = health.select(_say(F.coalesce("source_name", F.lit("unnamed source")), ": ", detail).alias("_said"), failing.alias("_failing"))
    return found.agg(F.collect_list("_said").alias("shared"), F.coalesce(F.bool_or("_failing"), F.lit(False)).alias("shared_blocking"))


def data_problems(securities: DataFrame, fundamentals: DataFrame, bars: DataFrame, as_of: Column) -> DataFrame:
    """Problem rows (security_id, source, detail, blocking) of each security's own data."""
    f = securities.select("security_id").join(
        fundamentals.select("security_id", F.map_keys("missing").alias("_m")), "security_id", "left"
    )
    accounts = f.select(
        "security_id", F.lit("sec_companyfacts").alias("source"),
        F.when(F.col("_m").isNull(), "no derived fundamentals").when(
            F.size("_m") > 0, _say(F.size("_m").cast("string"), " fields unresolved: ", F.array_join(F.array_sort("_m"), ", "))
        ).alias("detail"),
        F.col("_m").isNull().alias("blocking"),
    )
    newest = bars.groupBy("security_id").agg(F.max("date").alias("_last"))
    market = bars.where(F.col("date") <= as_of).agg(F.max("date").alias("_market"))
    b = securities.select("security_id").join(newest, "security_id", "left").join(F.broadcast(market))
    prices = b.select(
        "security_id", F.lit("prices").alias("source"),
        F.when(F.col("_last").isNull(), "no bars").when(
            F.col("_last") < F.col("_market"), _say("newest bar ", F.col("_last").cast("string"), ", dataset reaches ", F.col("_market").cast("string"))
        ).alias("detail"),
        F.col("_last").isNull().alias("blocking"),
    )
    return accounts.unionByName(prices).where(F.col("detail").isNotNull())


def completeness_flags(securities: DataFrame, problems: DataFrame, sources: DataFrame | None = None, accession: DataFrame | None = None) -> DataFrame:
    """All problems of a security in one flag; any blocking problem makes it high.

    `sources`, the one row of `failing_sources`, concerns every security: its texts are added
    to each flag and never become a row per (security, source).
    """
    code = "stale_or_incomplete_data"
    per = problems.groupBy("security_id").agg(
        F.collect_list(_say(F.col("source"), ": ", F.col("detail"))).alias("_own"), F.bool_or("blocking").alias("_own_block"),
    )
    out = securities.select("security_id").join(per, "security_id", "left")
    none = F.array().cast("array<string>")
    if sources is not None:
        out = out.join(F.broadcast(sources))  # one row
        texts, block = F.concat(F.coalesce("_own", none), "shared"), F.coalesce("_own_block", F.lit(False)) | F.col("shared_blocking")
    else:
        texts, block = F.coalesce("_own", none), F.coalesce("_own_block", F.lit(False))
    out = out.withColumns({"_text": F.when(F.size(texts) > 0, F.array_join(F.sort_array(texts), "; ")), "_block": block})
    if accession is not None:
        out = out.join(accession.select("security_id", F.col("accession").alias("_acc")), "security_id", "left")
        source = F.coalesce(F.col("_acc"), F.lit("none"))
    else:
        source = F.lit("none")
    made = first_match(
        (F.col("_text").isNull(), flag(code, "none", "no problem found", source)),
        otherwise=flag(code, F.when(F.col("_block"), "high").otherwise("medium"), F.col("_text"), source),
    )
    return out.select("security_id", made.alias("flag"))


def altman(inputs: DataFrame) -> DataFrame:
    """Z'' with clamped ratios; NULL with the missing inputs named.

    Input columns (double): current_assets, current_liabilities, retained_earnings,
    operating_income, pretax_income, interest_expense, equity, assets, liabilities.
    """
    c = F.col
    ebit = F.coalesce(c("operating_income"), c("pretax_income") + c("interest_expense"))
    missing = F.filter(
        F.array(
            F.when(c("assets").isNull() | (c("assets") <= 0), F.lit("total assets")),
            F.when(c("current_assets").isNull(), F.lit("current assets")),
            F.when(c("current_liabilities").isNull(), F.lit("current liabilities")),
            F.when(c("retained_earnings").isNull(), F.lit("retained earnings")),
            F.when(c("equity").isNull(), F.lit("stockholders equity")),
            F.when(c("liabilities").isNull() | (c("liabilities") <= 0), F.lit("total liabilities")),
            F.when(ebit.isNull(), F.lit("EBIT")),
        ),
        lambda m: m.isNotNull(),
    )
    assets = F.nullif(c("assets"), F.lit(0.0))
    raw = {
        "x1": (c("current_assets") - c("current_liabilities")) / assets,
        "x2": c("retained_earnings") / assets,
        "x3": ebit / assets,
        "x4": c("equity") / F.nullif(c("liabilities"), F.lit(0.0)),
    }
    out = inputs.withColumn("altman_missing", missing)
    out = out.withColumns({n: clamp(v, ALTMAN[n][1], ALTMAN[n][2]) for n, v in raw.items()})
    winsorised = F.filter(
        F.array(*[F.when(raw[n] != F.col(n), F.lit(n)) for n in raw]), lambda m: m.isNotNull()
    )
    z = sum((F.col(n) * ALTMAN[n][0] for n in ("x2", "x3", "x4")), F.col("x1") * ALTMAN["x1"][0])
    out = out.withColumns({"z": F.when(F.size("altman_missing") == 0, z), "winsorised": winsorised})
    return out.withColumn(
        "zone", F.when(F.col("z") < DISTRESS, "distress").when(F.col("z") < GREY, "grey").when(F.col("z").isNotNull(), "safe")
    )


def altman_flag(accession: Column) -> Column:
    """Flag over the columns `altman` adds."""
    code = "altman_distress"
    said = _say("Z'' ", F.format_number("z", 2), " ", F.col("zone"))
    return first_match(
        (F.size("altman_missing") > 0, unknown(code, _say("missing ", F.array_join("altman_missing", ", ")))),
        (accession.isNull(), unknown(code, "no reporting accession")),
        (F.col("z") < DISTRESS, flag(code, "high", said, accession)),
        otherwise=flag(code, "none", said, accession),
    )


def going_concern_matches(documents: DataFrame, key: str = "accession_no", text: str = "text") -> DataFrame:
    """Every substantial-doubt anchor with its span, context and why it is refused.

    Whole documents are scanned. Offsets come from the lengths of the pieces
    around the anchors; an anchor needs the going-concern phrase within 240
    characters after it, or before it.
    """
    body = F.col(text)
    hits = documents.where(body.rlike(T.DOUBT))
    pieces = F.split(body, T.DOUBT)
    anchors = F.regexp_extract_all(body, F.lit(T.DOUBT), F.lit(0))
    lengths = F.arrays_zip(F.transform(pieces, lambda p: F.length(p)).alias("before"), F.transform(anchors, lambda a: F.length(a)).alias("len"))
    none = F.array().cast("array<struct<start:int,len:int>>")
    spans = F.aggregate(  # one pass that carries the position
        F.filter(lengths, lambda x: x["len"].isNotNull()),
        F.struct(F.lit(0).alias("at"), none.alias("found")),
        lambda s, x: F.struct(
            (s["at"] + x["before"] + x["len"]).alias("at"),
            F.array_append(s["found"], F.struct((s["at"] + x["before"]).alias("start"), x["len"].alias("len"))).alias("found"),
        ),
        lambda s: s["found"],
    )
    rows = hits.select(key, body.alias("_t"), F.posexplode(spans).alias("anchor_no", "_a"))
    start, stop = F.col("_a.start"), F.col("_a.start") + F.col("_a.len")

    def cut(lo: Column, hi: Column) -> Column:  # [lo, hi) of the text, zero-based
        lo = F.greatest(F.lit(0), lo)
        return F.substring(F.col("_t"), lo + 1, hi - lo)

    after, before = cut(stop, stop + T.ANCHOR_GAP), cut(start - T.ANCHOR_GAP, start)
    forward = after.rlike(T.GOING_CONCERN)
    rows = rows.where(forward | before.rlike(T.GOING_CONCERN))
    tail = F.regexp_extract(after, "(?is)^(.*?)(" + T.GOING_CONCERN.replace("(?i)", "") + ")", 0)
    rows = rows.select(
        key, "_t", "anchor_no",
        F.when(forward, start).otherwise(F.greatest(F.lit(0), start - T.ANCHOR_GAP)).alias("offset"),
        F.when(forward, stop + F.length(tail)).otherwise(stop).alias("_end"),
    )
    context = cut(F.col("offset") - T.CONTEXT_MARGIN, F.col("_end") + T.CONTEXT_MARGIN)
    passage = F.trim(cut(F.col("offset") - T.QUOTE_MARGIN, F.col("_end") + T.QUOTE_MARGIN))
    refused = first_match(
        (context.rlike(T.DENIAL), "denial"),
        (context.rlike(T.DEFINITION), "definition"),
        (~context.rlike(T.SELF_REFERENCE), "third_party"),
    )
    return rows.select(
        key, "anchor_no", "offset", refused.alias("rejected"), context.rlike(T.ALLEVIATED).alias("alleviated"),
        passage.alias("passage"),
    )


def going_concern(documents: DataFrame, key: str = "accession_no", text: str = "text") -> DataFrame:
    """First accepted passage per document, or why every candidate was refused."""
    found = going_concern_matches(documents, key, text)
    accepted = F.col("rejected").isNull()
    per = found.groupBy(key).agg(
        F.min_by(F.struct("offset", "alleviated", "passage"), F.when(accepted, F.col("anchor_no"))).alias("_m"),
        F.array_join(F.array_sort(F.collect_set("rejected")), "; ").alias("_why"),
        F.count("*").alias("candidates"),
    )
    out = documents.select(key).join(per, key, "left")
    hit = F.col("_m").isNotNull()
    return out.select(
        key, hit.alias("detected"), F.coalesce(F.col("_m.alleviated"), F.lit(False)).alias("alleviated"),
        F.col("_m.offset").alias("offset"), F.col("_m.passage").alias("passage"),
        F.when(~hit & (F.col("_why") != ""), F.col("_why")).alias("rejected_reason"),
        F.coalesce(F.col("candidates"), F.lit(0)).alias("candidates"),
    )


def going_concern_flags(securities: DataFrame, filings: DataFrame, scans: DataFrame, as_of: Column) -> DataFrame:
    """Newest 10-K then newest 10-Q of each company; the first detection decides."""
    code = "going_concern"
    forms = F.when(F.col("form_type") == "10-K", 0).when(F.col("form_type") == "10-Q", 1)
    newest = filings.where(
        forms.isNotNull() & (F.col("filed_date") <= as_of) & F.col("primary_doc_url").isNotNull()
    ).groupBy("cik", forms.alias("_order")).agg(F.max_by("accession_no", F.struct("filed_date", "accession_no")).alias("accession_no"))
    read = newest.join(scans, "accession_no", "left")
    hit = F.coalesce(F.col("detected"), F.lit(False))
    per = read.groupBy("cik").agg(
        F.min(F.when(hit, F.struct("_order", "accession_no", "alleviated", "offset"))).alias("_hit"),
        F.min(F.struct("_order", "accession_no")).alias("_first"),
        F.bool_or(F.col("detected").isNull()).alias("_unread"),
    )
    out = securities.select("security_id", "cik").join(per, "cik", "left")
    made = first_match(
        (F.col("_first").isNull(), unknown(code, "no periodic report with a document")),
        (F.col("_hit").isNotNull(), flag(code, F.when(F.col("_hit.alleviated"), "medium").otherwise("high"), _say("offset ", F.col("_hit.offset").cast("string")), F.col("_hit.accession_no"))),
        (F.col("_unread"), unknown(code, "a document could not be read")),
        otherwise=flag(code, "none", "phrase not found", F.col("_first.accession_no")),
    )
    return out.select("security_id", made.alias("flag"))


def overdue_issuer(securities: DataFrame, filings: DataFrame, as_of: Column) -> DataFrame:
    """Newest periodic report's period + 91 + 45 + 15 days lies before the date."""
    code = "overdue_issuer_filing"
    last = filings.where(F.col("form_type").isin("10-K", "10-Q") & (F.col("filed_date") <= as_of)).groupBy("cik").agg(
        F.max_by(F.struct("accession_no", "period_of_report"), F.struct("filed_date", "accession_no")).alias("_f")
    )
    out = securities.select("security_id", "cik").join(last, "cik", "left")
    due = F.date_add("_f.period_of_report", sum(FILING_GRACE.values()))
    made = first_match(
        (F.col("_f").isNull(), unknown(code, "no periodic report on file")),
        (due.isNull(), unknown(code, "no period of report")),
        (as_of > due, flag(code, "medium", _say("due ", due.cast("string")), F.col("_f.accession_no"))),
        otherwise=flag(code, "none", _say("not due until ", due.cast("string")), F.col("_f.accession_no")),
    )
    return out.select("security_id", made.alias("flag"))


def merge_flags(flags: DataFrame, keys: tuple = ("security_id", "as_of_date")) -> DataFrame:
    """One row per code: a known flag beats an unknown one, whose text it keeps.

    `flags` has the keys, a flag struct and optionally `source_order`; the first
    known flag by that order stands.
    """
    order = F.col("source_order") if "source_order" in flags.columns else F.lit(0)
    rows = flags.select(*keys, "flag.*", order.alias("_o"))
    payload = F.struct("severity", "evidence_text", "source_accession")
    known = ~F.col("is_unknown")
    rank = F.struct("_o", "severity", "evidence_text")
    per = rows.groupBy(*keys, "flag_code").agg(
        F.min_by(payload, F.when(known, rank)).alias("_known"),
        F.min_by(payload, F.when(~known, rank)).alias("_unknown"),
        F.min(F.when(known, F.col("_o"))).alias("_ko"),
        # unknown notes that arrived after the known flag are appended to it
        F.sort_array(F.collect_set(F.when(~known, F.struct("_o", "evidence_text")))).alias("_notes"),
    )
    later = F.filter("_notes", lambda n: n["_o"] >= F.col("_ko"))
    text = F.concat_ws(" Also: ", F.col("_known.evidence_text"), F.transform(later, lambda n: n["evidence_text"]))
    hit = F.col("_known").isNotNull()
    return per.select(
        *keys, "flag_code",
        F.when(hit, F.col("_known.severity")).otherwise(F.lit("unknown")).alias("severity"),
        F.when(hit, text).otherwise(F.col("_unknown.evidence_text")).alias("evidence_text"),
        F.when(hit, F.col("_known.source_accession")).alias("source_accession"),
        (~hit).alias("is_unknown"),
    )


def union_flags(as_of: Column, *parts: DataFrame) -> DataFrame:
    """Stack (security_id, flag) frames with their position and the date."""
    tagged = [
        p.select("security_id", as_of.alias("as_of_date"), F.col("flag").cast(FLAG).alias("flag"), F.lit(i).alias("source_order"))
        for i, p in enumerate(parts)
    ]
    return reduce(DataFrame.unionByName, tagged)


def severity_rank(severity) -> Column:
    s = F.col(severity) if isinstance(severity, str) else severity
    return first_match(*[(s == name, i) for i, name in enumerate(SEVERITY_ORDER)], otherwise=len(SEVERITY_ORDER))
