"""Fundamental metrics as struct columns (value, concept, accession, reason).

An input is a struct column (value, concept, accession); a NULL value means not
reported. Zero is a present value. Every metric is NULL with a reason or a
number with its source, never an imputed one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col, first_match

SCALARS = (
    "pe", "pb", "ev_ebitda", "fcf_yield", "roic", "interest_coverage", "debt_ebitda",
    "current_ratio", "gross_margin", "revenue_growth_yoy", "shares_outstanding",
)
PIOTROSKI = (
    "piotroski_roa_positive", "piotroski_cfo_positive", "piotroski_roa_improved",
    "piotroski_accruals", "piotroski_leverage_decreased", "piotroski_current_ratio_improved",
    "piotroski_no_new_shares", "piotroski_gross_margin_improved", "piotroski_asset_turnover_improved",
)
ALL_METRICS = SCALARS + PIOTROSKI
DEFAULT_TAX_RATE = 0.21
MAX_TAX_RATE = 0.60

METRIC_TYPE = "struct<value:double,concept:string,accession:string,reason:string>"


def metric(value=None, source: Column | None = None, reason=None) -> Column:
    none = F.lit(None).cast("string")
    value = F.lit(None) if value is None else value
    return F.struct(
        value.cast("double").alias("value"),
        (none if source is None else source["concept"]).alias("concept"),
        (none if source is None else source["accession"]).alias("accession"),
        (none if reason is None else (reason if isinstance(reason, Column) else F.lit(reason))).alias("reason"),
    )


def missing_names(**inputs: Column) -> Column:
    """'missing:a,b' naming the absent inputs; NULL when all are present."""
    names = F.concat_ws(",", *[F.when(c["value"].isNull(), F.lit(n)) for n, c in inputs.items()])
    return F.when(names != "", F.concat(F.lit("missing:"), names))


def guarded(absent: Column | None, invalid: list[tuple[Column, str]], value: Column, source: Column) -> Column:
    """NULL with the first applicable reason, else the value with its source."""
    rules = [] if absent is None else [(absent.isNotNull(), metric(reason=absent))]
    rules += [(condition, metric(reason=f"invalid:{label}")) for condition, label in invalid]
    return first_match(*rules, otherwise=metric(value, source)) if rules else metric(value, source)


def present_total(*parts: Column) -> Column:
    """Sum of the present parts, sourced from the first of them; NULL if none."""
    any_present = F.coalesce(*[p["value"] for p in parts]).isNotNull()
    total = sum((F.coalesce(p["value"], F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0]["value"], F.lit(0.0)))
    first = F.coalesce(*[F.when(p["value"].isNotNull(), p) for p in parts])
    return F.struct(
        F.when(any_present, total).alias("value"),
        first["concept"].alias("concept"),
        first["accession"].alias("accession"),
    )


def market_cap_input(shares: Column, price) -> Column:
    both = shares["value"].isNotNull() & col(price).isNotNull()
    return F.struct(
        F.when(both, shares["value"] * col(price)).alias("value"),
        F.when(both, shares["concept"]).alias("concept"),
        F.when(both, shares["accession"]).alias("accession"),
    )


def market_cap_confidence(cap: Column, class_count) -> Column:
    """Low for several listed classes, high for a cover-page count, else medium."""
    return F.when(
        cap["value"].isNotNull(),
        first_match((col(class_count) > 1, "low"), (cap["concept"].startswith("dei:"), "high"), otherwise="medium"),
    )


def price_earnings(cap, eps, price, net_income) -> Column:
    from_eps = guarded(None, [(eps["value"] <= 0, "earnings<=0")], price / F.nullif(eps["value"], F.lit(0.0)), eps)
    from_cap = guarded(
        missing_names(market_cap=cap, net_income=net_income),
        [(net_income["value"] <= 0, "earnings<=0")],
        cap["value"] / F.nullif(net_income["value"], F.lit(0.0)),
        net_income,
    )
    return F.when(price.isNotNull() & eps["value"].isNotNull(), from_eps).otherwise(from_cap)


def _over(num: Column, den: Column) -> Column:
    return num / F.nullif(den, F.lit(0.0))


def ebitda(operating_income, depreciation) -> Column:
    return guarded(
        missing_names(operating_income=operating_income, depreciation=depreciation),
        [], operating_income["value"] + depreciation["value"], operating_income,
    )


def enterprise_value(cap, debt, cash) -> Column:
    absent = missing_names(market_cap=cap, total_debt=debt, cash=cash)
    return F.when(absent.isNotNull(), metric(reason=absent)).otherwise(
        metric(cap["value"] + debt["value"] - cash["value"])
    )


def _carry(m: Column, fallback: str) -> Column:
    """Reason of an unavailable upstream metric, NULL when it is available."""
    return F.when(m["value"].isNull(), F.coalesce(m["reason"], F.lit(f"missing:{fallback}")))


def ev_to_ebitda(ev, ebitda_metric) -> Column:
    absent = F.coalesce(_carry(ev, "enterprise_value"), _carry(ebitda_metric, "ebitda"))
    return guarded(
        absent, [(ebitda_metric["value"] <= 0, "ebitda<=0")],
        _over(ev["value"], ebitda_metric["value"]), ebitda_metric,
    )


def roic(operating_income, income_tax, pretax, debt, equity, cash) -> Column:
    derived = F.when(pretax["value"] > 0, _over(income_tax["value"], pretax["value"]))
    rate = F.when(derived.between(0.0, MAX_TAX_RATE), derived).otherwise(F.lit(DEFAULT_TAX_RATE))
    capital = debt["value"] + equity["value"] - cash["value"]
    return guarded(
        missing_names(operating_income=operating_income, total_debt=debt, equity=equity, cash=cash),
        [(capital <= 0, "invested_capital<=0")],
        _over(operating_income["value"] * (1.0 - rate), capital), operating_income,
    )


def interest_coverage(operating_income, interest, debt, cap: float) -> Column:
    return first_match(
        (debt["value"].isNull(), metric(reason="missing:total_debt")),
        (debt["value"] == 0, metric(F.lit(cap), debt)),
        (interest["value"].isNull(), metric(reason="invalid:debt>0_and_interest_missing")),
        (operating_income["value"].isNull(), metric(reason="missing:operating_income")),
        (interest["value"] == 0, metric(F.lit(cap), interest)),
        otherwise=metric(F.least(_over(operating_income["value"], F.abs(interest["value"])), F.lit(cap)), interest),
    )


def debt_to_ebitda(debt, ebitda_metric) -> Column:
    return first_match(
        (debt["value"].isNull(), metric(reason="missing:total_debt")),
        (debt["value"] == 0, metric(F.lit(0.0), debt)),
        (ebitda_metric["value"].isNull(), metric(reason=_carry(ebitda_metric, "ebitda"))),
        (ebitda_metric["value"] <= 0, metric(reason="invalid:ebitda<=0")),
        otherwise=metric(_over(debt["value"], ebitda_metric["value"]), debt),
    )


def current_ratio(assets, liabilities, cap: float) -> Column:
    return guarded(
        missing_names(current_assets=assets, current_liabilities=liabilities),
        [(liabilities["value"] == 0, "current_liabilities=0")],
        F.least(_over(assets["value"], liabilities["value"]), F.lit(cap)), assets,
    )


def gross_margin(gross_profit, revenue, cost) -> Column:
    return first_match(
        (revenue["value"].isNull(), metric(reason="missing:revenue")),
        (revenue["value"] <= 0, metric(reason="invalid:revenue<=0")),
        (gross_profit["value"].isNotNull(), metric(_over(gross_profit["value"], revenue["value"]), gross_profit)),
        (cost["value"].isNotNull(), metric(_over(revenue["value"] - cost["value"], revenue["value"]), cost)),
        otherwise=metric(reason="missing:gross_profit,cost_of_revenue"),
    )


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _compare_ratios(num, den, prior_num, prior_den, names, test: Callable, source) -> Column:
    """Flag comparing num/den with the prior year's, denominators positive."""
    n, d, pn, pd_ = names
    return guarded(
        missing_names(**{n: num, d: den, pn: prior_num, pd_: prior_den}),
        [((den["value"] <= 0) | (prior_den["value"] <= 0), "assets<=0")],
        _flag(test(_over(num["value"], den["value"]), _over(prior_num["value"], prior_den["value"]))),
        source,
    )


def _compare_metrics(current, prior, fallback: str, source) -> Column:
    absent = F.coalesce(
        _carry(current, fallback), F.when(prior["value"].isNull(), F.lit(f"missing:prior_{fallback}"))
    )
    return guarded(absent, [], _flag(current["value"] > prior["value"]), source)


def with_derived_metrics(
    rows, price: str, shares: str, shares_at_period: str, prior_shares: str, interest_cap: float, ratio_cap: float
):
    """Add every metric to rows of input structs (`prior_` ones for the year before).

    Shared terms become columns of their own first, so each is computed once per
    row and the expressions stay small enough to compile.
    """
    now = F.col
    prior = lambda name: F.col(f"prior_{name}")
    rows = rows.withColumns(
        {
            "_cap": market_cap_input(now(shares), price),
            "_debt": present_total(now("short_term_debt"), now("long_term_debt")),
            "_earned": ebitda(now("operating_income"), now("depreciation_amortization")),
            "_margin": gross_margin(now("gross_profit"), now("revenue"), now("cost_of_revenue")),
            "_margin_before": gross_margin(prior("gross_profit"), prior("revenue"), prior("cost_of_revenue")),
            "_liquid": current_ratio(now("current_assets"), now("current_liabilities"), ratio_cap),
            "_liquid_before": current_ratio(prior("current_assets"), prior("current_liabilities"), ratio_cap),
            "_held": F.when(now(shares_at_period)["value"].isNotNull(), now(shares_at_period)).otherwise(now(shares)),
        }
    )
    rows = rows.withColumn("_ev", enterprise_value(now("_cap"), now("_debt"), now("cash")))
    cap, debt, earned, margin, liquid, held = (now(f"_{n}") for n in ("cap", "debt", "earned", "margin", "liquid", "held"))
    revenue, income, assets, cfo = now("revenue"), now("net_income"), now("assets"), now("cfo")
    equity, capex = now("stockholders_equity"), now("capex")
    bad_assets = [(assets["value"] <= 0, "assets<=0")]
    columns = {
        "pe": price_earnings(cap, now("eps_diluted"), now(price), income),
        "pb": guarded(
            missing_names(market_cap=cap, equity=equity), [(equity["value"] <= 0, "book_value<=0")],
            _over(cap["value"], equity["value"]), equity,
        ),
        "ev_ebitda": ev_to_ebitda(now("_ev"), earned),
        "fcf_yield": guarded(
            missing_names(cfo=cfo, capex=capex, market_cap=cap), [(cap["value"] <= 0, "market_cap<=0")],
            _over(cfo["value"] - F.abs(capex["value"]), cap["value"]), cfo,
        ),
        "roic": roic(now("operating_income"), now("income_tax"), now("pretax_income"), debt, equity, now("cash")),
        "interest_coverage": interest_coverage(now("operating_income"), now("interest_expense"), debt, interest_cap),
        "debt_ebitda": debt_to_ebitda(debt, earned),
        "current_ratio": liquid,
        "gross_margin": margin,
        "revenue_growth_yoy": guarded(
            missing_names(revenue=revenue, prior_revenue=prior("revenue")),
            [(prior("revenue")["value"] <= 0, "prior_revenue<=0")],
            _over(revenue["value"], prior("revenue")["value"]) - 1.0, revenue,
        ),
        "shares_outstanding_metric": guarded(missing_names(shares_outstanding=now(shares)), [], now(shares)["value"], now(shares)),
        "piotroski_roa_positive": guarded(
            missing_names(net_income=income, assets=assets), bad_assets,
            _flag(_over(income["value"], assets["value"]) > 0), income,
        ),
        "piotroski_cfo_positive": guarded(missing_names(cfo=cfo), [], _flag(cfo["value"] > 0), cfo),
        "piotroski_roa_improved": _compare_ratios(
            income, assets, prior("net_income"), prior("assets"),
            ("net_income", "assets", "prior_net_income", "prior_assets"), lambda a, b: a > b, income,
        ),
        "piotroski_accruals": guarded(
            missing_names(cfo=cfo, net_income=income, assets=assets), bad_assets,
            _flag(_over(cfo["value"], assets["value"]) > _over(income["value"], assets["value"])), cfo,
        ),
        "piotroski_leverage_decreased": _compare_ratios(
            now("long_term_debt"), assets, prior("long_term_debt"), prior("assets"),
            ("long_term_debt", "assets", "prior_long_term_debt", "prior_assets"), lambda a, b: a < b,
            now("long_term_debt"),
        ),
        "piotroski_current_ratio_improved": _compare_metrics(liquid, now("_liquid_before"), "current_ratio", now("current_assets")),
        "piotroski_no_new_shares": guarded(
            missing_names(shares=held, prior_shares=now(prior_shares)), [],
            _flag(held["value"] <= now(prior_shares)["value"]), held,
        ),
        "piotroski_gross_margin_improved": _compare_metrics(margin, now("_margin_before"), "gross_margin", revenue),
        "piotroski_asset_turnover_improved": _compare_ratios(
            revenue, assets, prior("revenue"), prior("assets"),
            ("revenue", "assets", "prior_revenue", "prior_assets"), lambda a, b: a > b, revenue,
        ),
    }
    return rows.withColumns(columns)


def f_score(value: Callable[[str], Column], has_prior) -> Column:
    """Sum of the nine flags; NULL when one is missing or no prior year exists."""
    flags = F.array(*[value(name).cast("int") for name in PIOTROSKI])
    complete = ~F.exists(flags, lambda f: f.isNull()) & col(has_prior)
    return F.when(complete, F.aggregate(flags, F.lit(0), lambda acc, f: acc + f))


def model_applicable(sic) -> Column:
    """(applicable, label): financial industry codes are outside the model."""
    text = F.trim(col(sic).cast("string"))
    code = F.when(text.rlike(r"^\d+$"), text.try_cast("int"))

    def out(ok: bool, label) -> Column:
        return F.struct(F.lit(ok).alias("applicable"), F.lit(label).cast("string").alias("label"))

    return first_match(
        (code == 6798, out(False, "REIT")),
        (code.between(6300, 6411), out(False, "insurer")),
        (code.between(6000, 6199), out(False, "bank")),
        (code.between(6000, 6799), out(False, "financial")),
        otherwise=out(True, None),
    )
