"""Audits: every check is a frame of violations; none means it passes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import clamp

TOLERANCE = 1e-6
# Metrics that are never zero when known, references allowed to be 'none'.
NEVER_ZERO = ("pe", "pb", "ev_ebitda", "fcf_yield", "roic", "current_ratio")
NONE_ALLOWED = ("recent_insider_selling", "stale_or_incomplete_data")


def reproduce(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], metrics: Sequence[str], tolerance: float = TOLERANCE) -> DataFrame:
    """(keys, metric, stored, recomputed) wherever the two differ; NULL equals NULL."""
    s = stored.unpivot(list(keys), [F.col(m).cast("double").alias(m) for m in metrics], "metric", "stored")
    r = recomputed.unpivot(list(keys), [F.col(m).cast("double").alias(m) for m in metrics], "metric", "recomputed")
    both = s.withColumn("_s", F.lit(True)).join(r.withColumn("_r", F.lit(True)), [*keys, "metric"], "full_outer")
    near = F.when(
        F.col("stored").isNotNull() & F.col("recomputed").isNotNull(), F.abs(F.col("stored") - F.col("recomputed")) <= tolerance
    ).otherwise(F.col("stored").isNull() & F.col("recomputed").isNull())
    absent = F.col("_s").isNull() | F.col("_r").isNull()
    problem = F.when(F.col("_r").isNull(), "not recomputed").when(F.col("_s").isNull(), "not stored").otherwise("differs")
    return both.where(absent | ~near).withColumn("problem", problem).drop("_s", "_r")


def unknown_classifications(securities: DataFrame) -> DataFrame:
    return securities.where(F.col("security_type") == "unknown").select("security_id", "classification_source")


def series_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows on one side only, both ways: a correction must not change an old version."""
    columns = before.columns
    lost = before.exceptAll(after.select(*columns)).withColumn("side", F.lit("before"))
    return lost.unionByName(after.select(*columns).exceptAll(before).withColumn("side", F.lit("after")))


def score_mismatches(scores: DataFrame) -> DataFrame:
    """Ranked scores their stored submetrics, bonus parts and penalty do not reproduce."""

    def mean(name: str, fixed: Column | None, share: float, renormalise: bool) -> Column:
        items = F.filter(F.col(f"{name}_submetrics"), lambda s: s["valid"])
        total = lambda f: F.aggregate(items, F.lit(0.0), lambda acc, s: acc + f(s))
        value = total(lambda s: s["weight"] * s["value_used"])
        if renormalise:
            value = value / F.nullif(total(lambda s: s["weight"]), F.lit(0.0)) * share
        return value if fixed is None else value + fixed

    v = mean("value", None, 1.0, True)
    q = mean("quality", F.col("f_score") / F.lit(9.0) * 100.0 * 0.40, 0.60, True)
    m = mean("momentum", None, 1.0, False)
    b = F.least(F.lit(10.0), F.col("b1_cluster") + F.col("b2_executive") + F.col("b3_size") + F.col("b4_conviction"))
    total = clamp(0.30 * v + 0.30 * q + 0.30 * m + b - F.col("dilution_penalty"), 0.0, 100.0)
    near = lambda a, name: F.coalesce(F.abs(a - F.col(name)) <= TOLERANCE, F.lit(False))
    ok = near(v, "value_score") & near(q, "quality_score") & near(m, "momentum_score") & near(b, "insider_bonus") & near(total, "composite_score")
    return scores.where(F.col("rankable")).where(~ok).select("security_id", F.col("composite_score").alias("stored"), total.alias("recomputed"))


def unresolved_flags(flags: DataFrame, filings: DataFrame, facts: DataFrame, transactions: DataFrame, actions: DataFrame) -> DataFrame:
    """Known flags whose source does not exist: an accession, a ledger row, an allowed none."""
    known = flags.where(~F.col("is_unknown"))
    ref = F.col("source_accession")
    ledger = "ledger:corporate_actions:"
    exempt = (F.coalesce(ref == "none", F.lit(False)) & F.col("flag_code").isin(*NONE_ALLOWED)) | (
        F.coalesce(ref.startswith(ledger) & ref.endswith(":none"), F.lit(False))
    )
    open_refs = known.where(~exempt)
    names = open_refs.where(ref.isNotNull()).select("source_accession").distinct()
    keys = [t.select(F.col("accession_no").alias("source_accession")) for t in (filings, facts, transactions)]
    keys.append(actions.select(F.concat(F.lit(ledger), F.col("security_id").cast("string"), F.lit(":"), F.col("ex_date").cast("string")).alias("source_accession")))
    found = reduce(DataFrame.unionByName, [k.join(names, "source_accession", "left_semi").distinct() for k in keys])
    return open_refs.join(found.distinct(), "source_accession", "left_anti").select("security_id", "flag_code", "source_accession")


def zero_for_absent(fundamentals: DataFrame, scores: DataFrame, flags: DataFrame) -> DataFrame:
    """Zeros where data is absent, and score or flag rows that contradict themselves."""
    zero = F.filter(F.array(*[F.when(F.col(m) == 0.0, F.lit(m)) for m in NEVER_ZERO]), lambda m: m.isNotNull())
    metrics = fundamentals.select("security_id", F.lit("derived_fundamentals").alias("table"), F.explode(zero).alias("problem"))
    parts = ("value_score", "quality_score", "momentum_score", "insider_bonus", "composite_score")
    gap = reduce(lambda a, b: a | b, [F.col(p).isNull() for p in parts])
    bad = F.when(F.col("rankable") & gap, "rankable without a component").when(
        ~F.col("rankable") & (F.col("composite_score").isNotNull() | F.col("withhold_reason").isNull()), "withheld with a score or without a reason"
    )
    s = scores.select("security_id", F.lit("scores").alias("table"), bad.alias("problem"))
    odd = F.when(F.col("is_unknown") != (F.col("severity") == "unknown"), "unknown and severity disagree")
    f = flags.select("security_id", F.lit("risk_flags").alias("table"), odd.alias("problem"))
    return metrics.unionByName(s).unionByName(f).where(F.col("problem").isNotNull())


def pooled_horizons(books: DataFrame, positions: DataFrame, horizons) -> DataFrame:
    """Book horizons differing from the configured ones, and positions on no book."""
    want = books.sparkSession.createDataFrame([(int(h),) for h in horizons], "horizon_days int")
    have = books.select(F.col("horizon_days").cast("int").alias("horizon_days"))
    missing = want.exceptAll(have).withColumn("problem", F.lit("book missing"))
    extra = have.exceptAll(want).withColumn("problem", F.lit("book unexpected or doubled"))
    orphan = positions.select(F.col("horizon_days").cast("int").alias("horizon_days")).distinct().join(F.broadcast(want), "horizon_days", "left_anti")
    return missing.unionByName(extra).unionByName(orphan.withColumn("problem", F.lit("position without a book")))


def double_open(positions: DataFrame, candidates: DataFrame) -> DataFrame:
    """More than one open position for a security at a horizon."""
    opened = positions.where(F.col("status") == "open").join(candidates.select("candidate_id", "security_id"), "candidate_id")
    return opened.groupBy("security_id", "horizon_days").agg(F.count("*").alias("open_count")).where(F.col("open_count") > 1)


def altered_rows(previous: DataFrame, current: DataFrame, keys: Sequence[str], frozen: Column | None = None) -> DataFrame:
    """Append-only audit: rows of the previous snapshot deleted or changed since.

    `frozen` limits the rule to rows that may no longer change, such as closed trades.
    """
    old = previous if frozen is None else previous.where(frozen)
    mark = lambda df, name: df.select(*keys, F.sha2(F.to_json(F.struct(*sorted(previous.columns)), {"ignoreNullFields": "false"}), 256).alias(name))
    both = mark(old, "_old").join(mark(current, "_new"), list(keys), "left")
    kind = F.when(F.col("_new").isNull(), "deleted").when(F.col("_new") != F.col("_old"), "updated")
    return both.withColumn("violation", kind).where(F.col("violation").isNotNull()).select(*keys, "violation")


def failed_rules(df: DataFrame, rules: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """One row per (row, rule) that does not hold; a NULL rule passes, as in SQL CHECK."""
    broken = F.filter(
        F.array(*[F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]), lambda n: n.isNotNull()
    )
    return df.select(*keys, F.explode(broken).alias("rule"))


def score_rules() -> dict[str, Column]:
    c = F.col
    span = lambda n: c(n).isNull() | c(n).between(0, 100)
    return {
        "value_range": span("value_score"), "quality_range": span("quality_score"), "momentum_range": span("momentum_score"),
        "composite_range": span("composite_score"), "bonus_range": c("insider_bonus").isNull() | c("insider_bonus").between(0, 10),
        "penalty_range": c("dilution_penalty").between(0, 30),
        "rankable_complete": ~c("rankable") | c("composite_score").isNotNull(),
        "withheld_has_reason": c("rankable") | (c("withhold_reason").isNotNull() & c("composite_score").isNull()),
    }


def flag_rules() -> dict[str, Column]:
    c = F.col
    return {
        "severity": c("severity").isin("high", "medium", "low", "none", "context", "unknown"),
        "unknown_matches": c("is_unknown") == (c("severity") == "unknown"),
        "known_has_source": c("is_unknown") | c("source_accession").isNotNull(),
        "has_evidence": F.length("evidence_text") > 0,
    }


def position_rules() -> dict[str, Column]:
    c = F.col
    return {
        "status": c("status").isin("open", "closed", "pending_resolution"),
        "positive_slippage": c("slippage_bps") > 0, "positive_shares": c("shares") > 0, "positive_entry": c("entry_price") > 0,
        "closed_complete": (c("status") != "closed") | (c("exit_date").isNotNull() & c("exit_price").isNotNull() & c("exit_reason").isNotNull()),
        "open_has_no_exit": (c("status") == "closed") | c("exit_date").isNull(),
        "exit_after_entry": c("exit_date") > c("entry_date"),
    }


def dilution_rules() -> dict[str, Column]:
    c = F.col
    return {
        "d1": c("d1_capacity").between(0, 4), "d2": c("d2_issuance").between(0, 10), "d3": c("d3_structural").between(0, 8),
        "d4": c("d4_realised").between(0, 12), "total": c("dilution_score").between(0, 30),
        "disqualified_at_limit": c("is_disqualified") == (c("dilution_score") >= 22),
    }


def verdicts(checks: dict[str, DataFrame]) -> DataFrame:
    """One row per check with its number of violations."""
    rows = [df.agg(F.count("*").alias("violations")).select(F.lit(n).alias("check_name"), "violations") for n, df in checks.items()]
    out = reduce(DataFrame.unionByName, rows)
    return out.withColumn("status", F.when(F.col("violations") == 0, "pass").otherwise("fail"))
