"""Derived fundamentals: what each security's accounts said at each knowledge state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import FROZEN, Params
from ..functions import metrics as M
from ..functions.core import canonical_text
from ..session import cut_lineage
from .asof import asof_join, latest_per_key
from .bars import _ledger, split_events

# Concepts per input in priority order, as the taxonomy names them.
CONCEPTS = {
    "revenue": (
        "us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax", "us-gaap:Revenues",
        "us-gaap:RevenueFromContractWithCustomerIncludingAssessedTax", "us-gaap:SalesRevenueNet",
        "us-gaap:SalesRevenueGoodsNet",
    ),
    "cost_of_revenue": (
        "us-gaap:CostOfRevenue", "us-gaap:CostOfGoodsAndServicesSold", "us-gaap:CostOfGoodsSold",
        "us-gaap:CostOfServices",
    ),
    "gross_profit": ("us-gaap:GrossProfit",),
    "net_income": (
        "us-gaap:NetIncomeLoss", "us-gaap:ProfitLoss",
        "us-gaap:NetIncomeLossAvailableToCommonStockholdersBasic",
    ),
    "pretax_income": (
        "us-gaap:IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
        "us-gaap:IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments",
    ),
    "income_tax": ("us-gaap:IncomeTaxExpenseBenefit",),
    "eps_diluted": ("us-gaap:EarningsPerShareDiluted", "us-gaap:EarningsPerShareBasicAndDiluted"),
    "stockholders_equity": (
        "us-gaap:StockholdersEquity",
        "us-gaap:StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
    ),
    "assets": ("us-gaap:Assets",),
    "liabilities": ("us-gaap:Liabilities",),
    "current_assets": ("us-gaap:AssetsCurrent",),
    "current_liabilities": ("us-gaap:LiabilitiesCurrent",),
    "cash": (
        "us-gaap:CashAndCashEquivalentsAtCarryingValue",
        "us-gaap:CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents",
    ),
    "short_term_debt": ("us-gaap:ShortTermBorrowings", "us-gaap:DebtCurrent", "us-gaap:LongTermDebtCurrent"),
    "long_term_debt": ("us-gaap:LongTermDebtNoncurrent", "us-gaap:LongTermDebt"),
    "operating_income": ("us-gaap:OperatingIncomeLoss",),
    "depreciation_amortization": (
        "us-gaap:DepreciationDepletionAndAmortization", "us-gaap:DepreciationAmortizationAndAccretionNet",
        "us-gaap:DepreciationAndAmortization",
    ),
    "interest_expense": (
        "us-gaap:InterestExpense", "us-gaap:InterestExpenseDebt", "us-gaap:InterestExpenseNonoperating",
    ),
    "cfo": (
        "us-gaap:NetCashProvidedByUsedInOperatingActivities",
        "us-gaap:NetCashProvidedByUsedInOperatingActivitiesContinuingOperations",
    ),
    "capex": ("us-gaap:PaymentsToAcquirePropertyPlantAndEquipment", "us-gaap:PaymentsToAcquireProductiveAssets"),
    "shares_outstanding": (
        "dei:EntityCommonStockSharesOutstanding", "us-gaap:CommonStockSharesOutstanding",
        "us-gaap:WeightedAverageNumberOfDilutedSharesOutstanding",
    ),
}
RETAINED_EARNINGS = (
    "us-gaap:RetainedEarningsAccumulatedDeficit",
    "us-gaap:RetainedEarningsAccumulatedDeficitIncludingPortionAttributableToNoncontrollingInterest",
)
DURATION_INPUTS = (
    "revenue", "cost_of_revenue", "gross_profit", "net_income", "pretax_income", "income_tax", "eps_diluted",
    "operating_income", "depreciation_amortization", "interest_expense", "cfo", "capex",
)
PRIOR_INPUTS = (
    "revenue", "cost_of_revenue", "gross_profit", "net_income", "assets", "current_assets",
    "current_liabilities", "long_term_debt",
)
ANNUAL_DAYS = (330, 400)
PRIOR_YEAR_DAYS = (300, 430)


#: Inputs outside the metrics, for the risk flags.
EXTRA = {"retained_earnings": RETAINED_EARNINGS}
#: A number for each (input, priority), and back.
SLOTS = {(name, rank): i for i, (name, rank) in enumerate((n, r) for n, c in {**CONCEPTS, **EXTRA}.items() for r in range(1, len(c) + 1))}


def concept_mapping(spark: SparkSession, extra: dict | None = None) -> DataFrame:
    """The mapping dimension: some fifty rows, broadcast wherever it is used."""
    rows = [
        (name, *concept.split(":"), rank, name in DURATION_INPUTS, SLOTS[name, rank])
        for name, concepts in {**CONCEPTS, **(extra or {})}.items()
        for rank, concept in enumerate(concepts, 1)
    ]
    return spark.createDataFrame(
        rows, "input string, taxonomy string, concept string, priority int, wants_duration boolean, slot int"
    )


def usable_facts(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("accepted_at").isNotNull())


def mapped_facts(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Numeric usable facts of mapped concepts with their input and fit for it."""
    out = usable_facts(facts).where(F.col("normalized_numeric_value").isNotNull()).join(
        F.broadcast(mapping), ["taxonomy", "concept"]
    )
    span = F.datediff("period_end", "period_start")
    annual = span.between(*ANNUAL_DAYS)
    fits = F.when(F.col("wants_duration"), F.coalesce(annual, F.lit(False))).otherwise(F.col("period_start").isNull())
    return out.withColumns({"annual": F.coalesce(annual, F.lit(False)), "fits": fits})


def stated_values(mapped: DataFrame, key: str = "cik") -> DataFrame:
    """One row per (key, period, acceptance, filing): the fitting value of each (input, priority) as a column `_v{slot}`,
    whether the filing reports a fiscal year's end in an annual form, and whether any input of the metrics is in it.

    A filing states a score of facts at once, so this is far shorter than the facts, and everything below is taken from
    it. It is one hash aggregation of numbers, combined map-side. If a filing states a concept twice, the larger value counts.
    """
    value = F.when(F.col("fits"), F.col("normalized_numeric_value").cast("double"))
    return mapped.groupBy(key, "period_end", "accepted_at", "accession_no").agg(
        F.max(F.col("annual") & F.col("form_type").startswith("10-K")).alias("annual_end"),
        F.max(~F.col("input").isin(*EXTRA)).alias("in_metrics"),
        *[F.max(F.when(F.col("slot") == i, value)).alias(f"_v{i}") for i in SLOTS.values()],
    )


def annual_ends(stated: DataFrame, key: str = "cik") -> DataFrame:
    """Distinct fiscal year ends reported by annual filings."""
    return stated.where("annual_end").select(key, "period_end").distinct()


def latest_periods(ends: DataFrame, since: Column | None = None, n: int | None = None, key: str = "cik") -> DataFrame:
    """Fiscal year ends, all unless a first date or a number of newest ends is given."""
    kept = ends if since is None else ends.where(F.col("period_end") >= since)
    if n is None:
        return kept
    w = Window.partitionBy(key).orderBy(F.desc("period_end"))
    return kept.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def prior_period(periods: DataFrame, ends: DataFrame, key: str = "cik") -> DataFrame:
    """Latest fiscal year end 300 to 430 days before each period; a few ends per company."""
    before = ends.select(F.col(key).alias("_k"), F.col("period_end").alias("_e"))
    gap = F.datediff("period_end", "_e")
    joined = periods.join(before, (F.col(key) == F.col("_k")) & gap.between(*PRIOR_YEAR_DAYS), "left")
    return joined.groupBy(*periods.columns).agg(F.max("_e").alias("prior_end"))


def knowledge_states(stated: DataFrame, n: int | None = None, key: str = "cik") -> DataFrame:
    """Acceptance times per (company, period), all or the newest `n`."""
    stamps = stated.where("in_metrics").select(key, "period_end", F.col("accepted_at").alias("knowledge_date")).distinct()
    if n is None:
        return stamps
    w = Window.partitionBy(key, "period_end").orderBy(F.desc("knowledge_date"))
    return stamps.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def _first_stated(name: str, usable: str = "{0}") -> str:
    """SQL of (rank, at, filing, value) of the first concept of an input that a filing states; NULL if it states none."""
    ranks = [(r, usable.format(f"_v{i}")) for (n, r), i in SLOTS.items() if n == name]
    value = f"coalesce({', '.join(v for _, v in ranks)})"
    rank = "CASE " + " ".join(f"WHEN {v} IS NOT NULL THEN {-r}" for r, v in ranks) + " END"
    return f"CASE WHEN {value} IS NOT NULL THEN named_struct('rank', {rank}, 'at', _at, 'filing', _filing, 'value', {value}) END"


def _input(best: str, name: str, alias: str) -> str:
    """SQL of the struct (value, concept, accession) of a carried best value."""
    concepts = ", ".join(f"'{c}'" for c in {**CONCEPTS, **EXTRA}[name])
    struct = f"named_struct('value', {best}.value, 'concept', element_at(array({concepts}), -{best}.rank), 'accession', {best}.filing)"
    return f"CASE WHEN {best} IS NOT NULL THEN {struct} END AS {alias}"


def resolve_inputs(
    grid: DataFrame, stated: DataFrame, inputs: list[str], prior_inputs: list[str] = (), key: str = "cik"
) -> DataFrame:
    """Input structs as known at each (key, period_end, knowledge_date[, prior_end]).

    First concept by priority with any usable fact wins, then the newest
    acceptance. Filings and the moments asked for are put in one order of time per
    (key, period), and the best value so far of every input is carried forward, so
    each filing is read once whatever the number of states. What is carried is
    (rank, filing, value); concepts are named after the last shuffle, and the rows
    of `grid` travel along with all their columns, so nothing is joined to them.
    """
    names = list(dict.fromkeys(inputs))
    rows = grid
    if "prior_end" in grid.columns and len(prior_inputs) > 0:
        known = F.col(key).isNotNull() & F.col("period_end").isNotNull() & F.col("knowledge_date").isNotNull() & F.col("prior_end").isNotNull()
        before = _carried(grid.where(known), stated, "prior_end", list(dict.fromkeys(prior_inputs)), "_p_", key)
        rows = before.unionByName(grid.where(~known), allowMissingColumns=True)
    carried = _carried(rows, stated, "period_end", names, "_n_", key)
    return carried.selectExpr(
        *[f"`{c}`" for c in grid.columns], *[_input(f"_n_{n}", n, n) for n in inputs],
        *[_input(f"_p_{n}", n, f"prior_{n}") for n in prior_inputs if rows is not grid],
    )


def _carried(grid: DataFrame, stated: DataFrame, target: str, names: list[str], prefix: str, key: str) -> DataFrame:
    """Rows of `grid` with the best (rank, filing, value) of each input for the period `target`, as known at knowledge_date.

    Filings are dealt out and sorted as they are stored, numbers and one accession, and made into structs only then.
    """
    state = F.struct(*[F.col(f"`{c}`") for c in grid.columns])
    wanted = grid.select(F.col(key).alias("_k"), F.col(target).alias("_target"), F.col("knowledge_date").alias("_at"), F.lit(1).alias("_asks"), state.alias("_state"))
    slots = [f"_v{i}" for (n, _), i in SLOTS.items() if n in names]
    filings = stated.select(F.col(key).alias("_k"), F.col("period_end").alias("_target"), F.col("accepted_at").alias("_at"), F.col("accession_no").alias("_filing"), *slots)
    # a fact accepted at the very moment is known then: filings, which have no `_asks`, come before states
    order = [F.col("_at"), F.col("_asks").asc_nulls_first()]
    mixed = filings.unionByName(wanted, allowMissingColumns=True).repartition("_k", "_target").sortWithinPartitions("_k", "_target", *order)
    mixed = mixed.selectExpr("_k", "_target", "_at", "_asks", "_state", *[f"{_first_stated(n)} AS {n}" for n in names])
    so_far = "(PARTITION BY _k, _target ORDER BY _at, _asks NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    filled = mixed.selectExpr("_asks", "_state", *[f"max({n}) OVER {so_far} AS {n}" for n in names]).where("_asks = 1")
    short = lambda n: f"CASE WHEN {n} IS NOT NULL THEN named_struct('rank', {n}.rank, 'filing', {n}.filing, 'value', {n}.value) END AS {prefix}{n}"
    return filled.selectExpr("_state.*", *[short(n) for n in names])


def instant_as_of(grid: DataFrame, stated: DataFrame, name: str, as_of: dict[str, Column], key: str = "cik") -> DataFrame:
    """Latest positive balance dated at or before each as-of column, as known then.

    Both the fact's date and its acceptance are bounded from above. The distinct
    dates of a company's facts are numbered, and the numbers cut into dyadic spans:
    a fact is entered in the span of each length that holds its date, and the dates
    up to a question's are at most one span of each length. In every span facts and
    questions are put in one order of time and the best fact so far is carried
    forward; a question takes the best of its spans. All of it is done where a
    company's facts and questions, which are short rows, were dealt once.
    """
    facts = stated.select(F.col(key).alias("_k"), F.col("period_end").alias("_date"), F.col("accepted_at").alias("_at"), F.col("accession_no").alias("_filing"), *[f"_v{i}" for (n, _), i in SLOTS.items() if n == name])
    facts = facts.where(F.col("_k").isNotNull() & F.col("_date").isNotNull()).withColumn("_one", F.expr(_first_stated(name, "if({0} > 0, {0}, NULL)"))).where(F.col("_one").isNotNull()).select(
        "_k", "_date", "_at", F.struct("_one.rank", F.col("_date").alias("end"), "_one.at", "_one.filing", "_one.value").alias("_fact"),
    )
    asks = F.array(*[F.struct(F.lit(i).alias("out"), at.alias("date")) for i, at in enumerate(as_of.values())])
    asked = grid.select(F.col(key).alias("_k"), F.col("knowledge_date").alias("_at"), "period_end", F.explode(asks).alias("_ask"))
    asked = asked.select("_k", F.col("_ask.date").alias("_date"), "_at", "period_end", F.col("_ask.out").alias("_out"))
    dealt = facts.unionByName(asked, allowMissingColumns=True).repartition("_k")
    own = Window.partitionBy("_k").orderBy("_date", F.col("_out").asc_nulls_first())  # of one date, facts come first
    first = F.when(F.col("_out").isNull() & F.coalesce(F.lag("_date").over(own) != F.col("_date"), F.lit(True)), 1).otherwise(0)
    dealt = dealt.withColumn("_first", first)
    dealt = dealt.withColumn("_no", F.sum("_first").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    dealt = dealt.withColumn("_all", F.sum("_first").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # spans of 2^level dates: of a fact every one that holds its date, of a question one for each bit that is set in the number of dates
    bits = lambda n: F.sequence(F.lit(0), F.length(F.bin(n)) - 1)
    held = F.transform(bits(F.col("_all")), lambda i: F.struct(i.alias("level"), F.call_function("shiftright", F.col("_no") - 1, i).alias("span")))
    upto = F.transform(
        F.filter(bits(F.col("_no")), lambda i: F.call_function("getbit", F.col("_no"), i) == 1),
        lambda i: F.struct(i.alias("level"), (F.call_function("shiftright", F.col("_no"), i) - 1).alias("span")),
    )
    spread = dealt.select("_k", "_at", "_fact", "period_end", "_out", F.explode_outer(F.when(F.col("_out").isNull(), held).otherwise(upto)).alias("_s"))
    spread = spread.select("_k", F.col("_s.level").alias("_level"), F.col("_s.span").alias("_span"), "_at", "_fact", "period_end", "_out")
    so_far = Window.partitionBy("_k", "_level", "_span").orderBy("_at", F.col("_out").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = spread.withColumn("_best", F.when(F.col("_level").isNotNull(), F.max("_fact").over(so_far))).where("_out IS NOT NULL")
    picked = filled.groupBy("_k", "period_end", "_at").agg(*[F.max(F.when(F.col("_out") == i, F.col("_best"))).alias(out) for i, out in enumerate(as_of)])
    return picked.selectExpr(f"_k AS {key}", "period_end", "_at AS knowledge_date", *[_input(c, name, c) for c in as_of])


def derived_fundamentals(
    facts: DataFrame, securities: DataFrame, bars: DataFrame, since: str | None = None,
    params: Params = FROZEN,
) -> DataFrame:
    """One row per (security, fiscal period, knowledge state) with every metric.

    `securities`: security_id, cik, sic_code, class_count. Metric columns are
    structs (value, concept, accession, reason).
    """
    stated = cut_lineage(stated_values(mapped_facts(facts, concept_mapping(facts.sparkSession))))
    ends = annual_ends(stated)
    periods = prior_period(latest_periods(ends, None if since is None else F.lit(since).cast("date")), ends)
    grid = cut_lineage(periods.join(knowledge_states(stated), ["cik", "period_end"]))
    shares = instant_as_of(
        grid, stated, "shares_outstanding",
        {
            "_shares": F.col("knowledge_date").cast("date"),
            "_shares_at_period": F.col("period_end"),
            "_prior_shares": F.col("prior_end"),
        },
    )
    # counts, companies and prices first meet the states, which are short; the inputs, some thirty structs, come last
    rows = grid.join(shares, ["cik", "period_end", "knowledge_date"])
    rows = rows.join(securities.select("security_id", "cik", "sic_code", "class_count"), "cik")
    rows = asof_join(
        rows.withColumn("_known_on", F.col("knowledge_date").cast("date")),
        bars.where(F.col("close").isNotNull()).withColumn("price_date", F.col("date")),
        ["security_id"], "_known_on", "date", ["close", "price_date"],
    ).withColumnRenamed("close", "market_cap_price_used").withColumnRenamed("price_date", "market_cap_price_date")
    rows = resolve_inputs(rows, stated, list(CONCEPTS), list(PRIOR_INPUTS))

    held = F.when(F.col("_shares.value").isNotNull(), F.col("_shares")).otherwise(F.col("shares_outstanding"))
    rows = rows.withColumn("_shares", held)
    any_base = F.coalesce(*[F.col(f"{n}.value") for n in ("revenue", "net_income", "assets", "stockholders_equity")])
    rows = rows.where(any_base.isNotNull())
    rows = M.with_derived_metrics(
        rows, "market_cap_price_used", "_shares", "_shares_at_period", "_prior_shares",
        params.interest_coverage_cap, params.current_ratio_cap,
    )
    applicable = M.model_applicable("sic_code")
    metric = lambda n: F.col("shares_outstanding_metric" if n == "shares_outstanding" else n)
    out = rows.select(
        "security_id", "cik", "period_end", "prior_end", "knowledge_date",
        F.lit(params.mapping_version).alias("mapping_version"),
        F.col("_cap.value").alias("market_cap"),
        M.market_cap_confidence(F.col("_cap"), "class_count").alias("market_cap_confidence"),
        F.col("_shares.value").alias("market_cap_shares_used"),
        "market_cap_price_used", "market_cap_price_date",
        applicable["applicable"].alias("model_applicable"),
        applicable["label"].alias("not_applicable_label"),
        *[metric(n).alias(n) for n in M.ALL_METRICS],
    )
    # (name, value, concept, accession, reason) of every metric, once, as an array
    every = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("m")) for n in sorted(M.ALL_METRICS)])
    out = out.withColumn("_every", every)
    absent = F.filter("_every", lambda e: e["m"]["value"].isNull())
    used = F.transform(
        "_every",
        lambda e: F.array(e["name"], F.coalesce(e["m"]["concept"], F.lit("")), F.coalesce(e["m"]["accession"], F.lit("")), canonical_text(e["m"]["value"], "double")),
    )
    return out.withColumns(
        {
            "missing": F.map_from_entries(F.transform(absent, lambda e: F.struct(e["name"].alias("key"), e["m"]["reason"].alias("value")))),
            "inputs_complete": F.size(absent) == 0,
            "fact_set_hash": F.sha2(F.to_json(used), 256),
        }
    ).drop("_every")


def flat_values(fundamentals: DataFrame) -> DataFrame:
    """Metric structs reduced to their values, for joins and reports."""
    keep = [c for c in fundamentals.columns if c not in M.ALL_METRICS]
    return fundamentals.select(*keep, *[F.col(f"{n}.value").alias(n) for n in M.ALL_METRICS])


def fundamentals_at(fundamentals: DataFrame, cutoff: Column) -> DataFrame:
    """Newest period knowable at the cutoff in its newest state, and the period before it."""
    known = fundamentals.where(F.col("knowledge_date") <= cutoff)
    if "prior_period" in known.columns:
        known = known.drop("prior_period")
    latest = latest_per_key(known, ["security_id"], [F.col("period_end"), F.col("knowledge_date")])
    ends = known.select("security_id", F.col("period_end").alias("_e")).distinct()
    prior = (
        latest.select("security_id", "period_end").join(ends, "security_id").where(F.col("_e") < F.col("period_end"))
        .groupBy("security_id").agg(F.max("_e").alias("prior_period"))
    )
    return latest.join(prior, "security_id", "left")


def market_cap_at(fundamentals: DataFrame, as_of: Column) -> DataFrame:
    """Market cap known by the end of a day; newest knowledge, then newest period."""
    from ..functions.core import end_of_day

    known = fundamentals.where((F.col("knowledge_date") <= end_of_day(as_of)) & F.col("market_cap").isNotNull())
    best = F.max_by(F.struct("market_cap", "market_cap_confidence"), F.struct("knowledge_date", "period_end"))
    return known.groupBy("security_id").agg(best.alias("_m")).select("security_id", "_m.*")


def class_counts(securities: DataFrame) -> DataFrame:
    """Listed classes sharing each company number."""
    n = securities.where(F.col("cik").isNotNull()).groupBy("cik").agg(F.count("*").alias("class_count"))
    return securities.join(n, "cik", "left")


def distinct_companies(securities: DataFrame) -> DataFrame:
    """One row per company with its first security and symbol."""
    return (
        securities.where(F.col("cik").isNotNull())
        .groupBy("cik")
        .agg(F.min("security_id").alias("security_id"), F.min_by("symbol", "security_id").alias("symbol"))
    )


def split_factor_between(spans: DataFrame, actions: DataFrame, start: str, end: str, name: str = "split_factor") -> DataFrame:
    """Product of split ratios with start < ex_date <= end; 1.0 when there is none."""
    out = spans.join(_ledger(split_events(actions), "ratio", "_splits"), "security_id", "left")
    inside = F.filter("_splits", lambda e: (e["ex_date"] > F.col(start)) & (e["ex_date"] <= F.col(end)))
    product = F.aggregate(inside, F.lit(1.0), lambda acc, e: acc * e["amount"])
    return out.withColumn(name, F.coalesce(product, F.lit(1.0))).drop("_splits")


def share_growth(facts: DataFrame, securities: DataFrame, actions: DataFrame, as_of: Column) -> DataFrame:
    """Year-over-year growth of the cover-page share count on one split basis.

    The comparison is the newest count at least 365 days older, else the oldest
    count if it is at least 270 days older.
    """
    counts = facts.where(
        (F.col("concept") == "EntityCommonStockSharesOutstanding")
        & F.col("normalized_numeric_value").isNotNull() & F.col("period_start").isNull()
        & (F.col("period_end") <= as_of) & F.col("accepted_at").isNotNull()
    ).select(
        "cik",
        F.struct(
            "period_end", F.col("normalized_numeric_value").alias("shares"), F.col("accession_no").alias("accession")
        ).alias("_f"),
        F.struct("period_end", "accepted_at", "accession_no").alias("_o"),
    )
    ends = counts.groupBy("cik").agg(F.max_by("_f", "_o").alias("latest"), F.min_by("_f", "_o").alias("oldest"))
    older = counts.join(ends.select("cik", "latest"), "cik").where(
        F.col("_f.period_end") <= F.date_sub(F.col("latest.period_end"), 365)
    )
    prior = older.groupBy("cik").agg(F.max_by("_f", "_o").alias("year_ago"))
    picked = ends.join(prior, "cik", "left")
    fallback = F.when(F.datediff("latest.period_end", "oldest.period_end") >= 270, F.col("oldest"))
    picked = picked.select("cik", "latest", F.coalesce("year_ago", fallback).alias("prior"))
    rows = securities.select("security_id", "cik").join(picked, "cik", "left").select(
        "security_id", "cik",
        F.col("latest.period_end").alias("latest_period"), F.col("latest.shares").alias("latest_shares"),
        F.col("latest.accession").alias("latest_accession"), F.col("prior.period_end").alias("prior_period"),
        F.col("prior.shares").alias("prior_shares_raw"), F.col("prior.accession").alias("prior_accession"),
    )
    rows = split_factor_between(rows, actions, "prior_period", "latest_period")
    adjusted = F.col("prior_shares_raw") * F.col("split_factor")
    reason = (
        F.when(F.col("latest_period").isNull(), "no share counts")
        .when(F.col("prior_period").isNull(), "no share count about a year earlier")
        .when(adjusted <= 0, "prior share count not positive")
    )
    return rows.withColumns(
        {
            "prior_shares_split_adjusted": adjusted,
            "shares_yoy_growth": F.when(adjusted > 0, F.col("latest_shares") / adjusted - 1.0),
            "growth_reason": reason,
        }
    )
