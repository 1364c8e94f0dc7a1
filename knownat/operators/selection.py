"""Weekly selection: freshness, eligibility, cooldowns, caps, and every rejection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FROZEN, Params
from ..functions.core import first_match, hours_between, row_hash, session_close_utc, short_id
from .ranking import group_top

# Risk flags that bar a candidate, ledger columns under the hash.
BARRING_FLAGS = ("rapid_share_growth", "active_issuance", "atm_or_convertible")
STAGES = {
    "symbol_master": ("fixture_load",), "prices_daily": ("price_ingest",), "fundamentals": ("fundamentals",),
    "corporate_actions": ("price_ingest",), "filings": ("sec_facts", "insider"),
}
HASHED = (
    ("candidate_id", "string"), ("security_id", "string"), ("data_cutoff_at", "string"), ("snapshot_id", "string"),
    ("strategy_version", "string"), ("config_hash", "string"), ("selection_rule_version", "string"),
    ("composite_at_generation", "double"), ("rank_at_generation", "string"), ("signal_close", "double"),
    ("atr_value", "double"), ("price_data_cutoff", "string"), ("gap_limit_atr", "double"),
)


def pipeline_freshness(
    runs: DataFrame, cutoff: Column, now: Column, sla: dict | None = None, stages: dict | None = None
) -> DataFrame:
    """One row per (source, stage): newest good run against the cutoff and its budget."""
    sla, stages = sla or FROZEN.freshness_sla, stages or STAGES
    spark = runs.sparkSession
    wanted = [(s, st, float(h)) for s, h in sorted(sla.items()) for st in (stages.get(s) or (None,))]
    plan = spark.createDataFrame(wanted, "source string, stage string, sla_hours double")
    good = runs.where(F.col("status").isin("success", "partial") & F.col("finished_at").isNotNull())
    newest = good.groupBy("stage").agg(F.max_by(F.struct("finished_at", "status", "run_id"), F.struct("finished_at", "run_id")).alias("_r"))
    out = plan.join(newest, "stage", "left")
    age = hours_between(F.col("_r.finished_at"), now)
    failure = first_match(
        (F.col("stage").isNull(), "no stage mapped"),
        (F.col("_r").isNull(), "never succeeded"),
        (F.col("_r.finished_at") < cutoff, "finished before the cutoff"),
        (age > F.col("sla_hours"), "older than its budget"),
    )
    return out.select(
        "source", "stage", "sla_hours", F.col("_r.finished_at").alias("last_success"), age.alias("age_hours"),
        F.col("_r.status").alias("run_status"), F.col("_r.run_id").alias("run_id"),
        failure.alias("failure"), failure.isNull().alias("ok"),
    )


def session_present(bars: DataFrame, final_session: Column) -> DataFrame:
    """Whether the week's final session has bars at all."""
    n = bars.where(F.col("date") == final_session).select("security_id").distinct().agg(F.count("*").alias("securities"))
    return n.select(F.lit("prices:latest_session").alias("source"), "securities", (F.col("securities") > 0).alias("ok"))


def form4_coverage(runs: DataFrame, transactions: DataFrame, cutoff: Column, now: Column, sla_hours: float = FROZEN.freshness_sla["filings"]) -> DataFrame:
    """Insider record current up to the cutoff: run fresh, rows accepted, run after the cutoff."""
    run = runs.where(
        (F.col("stage") == "insider") & F.col("status").isin("success", "partial") & F.col("finished_at").isNotNull()
    ).agg(F.max("finished_at").alias("finished_at"))
    newest = transactions.where(F.col("accepted_at") <= cutoff).agg(F.max("accepted_at").alias("covered_to"))
    age = hours_between("finished_at", now)
    failure = first_match(
        (F.col("finished_at").isNull(), "never succeeded"),
        (age > sla_hours, "older than its budget"),
        (F.col("covered_to").isNull(), "no accepted row at the cutoff"),
        (F.col("finished_at") < cutoff, "finished before the cutoff"),
    )
    return run.join(newest).select(
        F.lit("form4:coverage").alias("source"), "finished_at", "covered_to", failure.alias("failure"), failure.isNull().alias("ok")
    )


def failed_symbols(runs: DataFrame, listings: DataFrame, errors: str = "errors_json") -> DataFrame:
    """(run, symbol) for symbols named as whole tokens in a run's error list."""
    words = F.split(F.array_join(F.from_json(errors, "array<string>"), " "), r"[^A-Za-z0-9.$-]+")
    tokens = runs.where(F.col(errors).isNotNull()).select("run_id", F.explode(F.array_distinct(words)).alias("symbol"))
    return tokens.where(F.col("symbol") != "").join(listings.select("symbol").distinct(), "symbol", "left_semi").select("run_id", "symbol")


def position_state(positions: DataFrame, cancelled: DataFrame, candidates: DataFrame, cutoff: Column) -> DataFrame:
    """Last exit, last gap cancel and open horizons per security at a session."""
    who = candidates.select("candidate_id", "security_id")
    p = positions.join(who, "candidate_id").groupBy("security_id").agg(
        F.max(F.when((F.col("status") == "closed") & (F.col("exit_date") <= cutoff), F.col("exit_date"))).alias("last_exit_session"),
        F.array_sort(F.collect_set(F.when(F.col("status") == "open", F.col("horizon_days")))).alias("open_horizons"),
    )
    c = cancelled.join(who, "candidate_id").where(F.col("cancelled_at").cast("date") <= cutoff).groupBy("security_id").agg(
        F.max(F.col("cancelled_at").cast("date")).alias("last_gap_cancel_session")
    )
    return p.join(c, "security_id", "full_outer")


def with_security(df: DataFrame, candidates: DataFrame) -> DataFrame:
    """Positions or cancellations with the security of their candidate."""
    return df.join(candidates.select("candidate_id", "security_id"), "candidate_id")


def screened_rows(
    universe: DataFrame, scores: DataFrame, flags: DataFrame, signals: DataFrame, fundamentals: DataFrame,
    positions: DataFrame, cancelled: DataFrame, session: Column, cutoff: Column,
) -> DataFrame:
    """One row per security of the universe as the selection rule sees it at a session, with what is `missing` of its screening.

    The sources are cut to their columns, tagged by where they stand in one common row, stacked, and folded in a single shuffle by
    security: the score of the session, all its flags, the newest signal on or before it, the newest fundamental period known at
    the cutoff in its newest state, the last exit and gap cancellation up to it, and the open horizons. The fold combines
    map-side, so a security with any number of rows is one row per task. `positions` and `cancelled` carry security_id.

    A security without a signal, or without any flag row at the session, was never screened: `missing` names the sources, and
    `screened` is false; nothing is taken as clean. Source rows without a security_id, or of a security outside the universe,
    are left out. Repeated rows change nothing; of several scores, or signals of one date, the greatest row counts, in the order
    of the columns. Empty sources give unscreened rows, an empty universe none.
    """
    c = F.col
    high = F.when(c("severity") == "high", c("flag_code"))
    gone = F.when((c("status") == "closed") & (c("exit_date") <= session), c("exit_date"))
    paused = c("cancelled_at").cast("date")
    parts = (
        universe.select("security_id", F.struct("symbol").alias("_u")),
        scores.where(c("score_date") == session).select(
            "security_id", F.struct(c("composite_score").alias("composite"), "rank", c("quality_score").alias("quality"), "rankable", c("cohort_id").alias("cohort")).alias("_s")
        ),
        flags.where(c("as_of_date") == session).select("security_id", F.lit(True).alias("_flagged"), high.alias("_high")),
        signals.where(c("as_of_date") <= session).select("security_id", F.struct("as_of_date", "dilution_score", "is_disqualified").alias("_d")),
        fundamentals.where(c("knowledge_date") <= cutoff).select(
            "security_id", F.struct("period_end", "knowledge_date", "model_applicable", "inputs_complete").alias("_a")
        ),
        positions.select("security_id", gone.alias("_exit"), F.when(c("status") == "open", c("horizon_days")).alias("_open")),
        cancelled.where(paused <= session).select("security_id", paused.alias("_pause")),
    )
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [p.where("security_id IS NOT NULL") for p in parts])
    newest = [F.max(n).alias(n) for n in ("_u", "_s", "_flagged", "_d", "_a", "_exit", "_pause")]
    folded = stacked.groupBy("security_id").agg(*newest, F.collect_set("_high").alias("_high"), F.collect_set("_open").alias("_open"))
    no = lambda x: F.coalesce(c(x), F.lit(False))
    missing = F.filter(
        F.array(F.when(c("_d").isNull(), F.lit("dilution_signals")), F.when(c("_flagged").isNull(), F.lit("risk_flags"))),
        lambda m: m.isNotNull(),
    )
    return folded.where(c("_u").isNotNull()).select(
        "security_id", F.coalesce("_u.symbol", c("security_id").cast("string")).alias("symbol"),
        F.coalesce("_s.cohort", F.lit("SIC-UNKNOWN")).alias("cohort_id"), no("_s.rankable").alias("rankable"),
        no("_a.model_applicable").alias("model_applicable"), "_s.composite", "_s.rank", "_s.quality",
        F.coalesce(c("_a.inputs_complete").cast("int"), F.lit(0)).alias("inputs_complete"),
        "_d.dilution_score", no("_d.is_disqualified").alias("dilution_disqualified"),
        F.array_contains("_high", "going_concern").alias("high_going_concern"),
        F.array_sort(F.array_intersect("_high", F.array(*[F.lit(b) for b in BARRING_FLAGS]))).alias("high_dilution_flags"),
        c("_exit").alias("last_exit_session"), c("_pause").alias("last_gap_cancel_session"),
        F.array_sort("_open").cast("array<int>").alias("open_horizons"), missing.alias("missing"), (F.size(missing) == 0).alias("screened"),
    )


def load_rows(screened: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows the rule may judge, rows whose screening is missing) of `screened_rows`."""
    judged = screened.where("screened").drop("missing", "screened")
    return judged, screened.where("NOT screened").select("security_id", "symbol", "composite", "rank", "missing")


def eligibility_failure(threshold: Column | None, params: Params = FROZEN) -> Column:
    """First of seven rules a row fails; NULL when it passes all."""
    c = F.col
    unset = F.lit(threshold is None)
    limit = F.lit(None).cast("double") if threshold is None else threshold
    return first_match(
        (~c("rankable"), "not_rankable"),
        (~c("model_applicable"), "model_not_applicable"),
        (c("dilution_disqualified") | (c("dilution_score") >= params.dilution_disqualify), "dilution_disqualified"),
        (c("high_going_concern"), "risk_flag_going_concern"),
        (F.size("high_dilution_flags") > 0, "risk_flag_dilution_disqualify"),
        (unset, "composite_threshold_unset"),
        (c("composite").isNull() | (c("composite") < limit), "below_composite_threshold"),
    )


def cooldown_failure(exit_cutoff: Column, gap_cutoff: Column) -> Column:
    return first_match(
        (F.col("last_exit_session") > exit_cutoff, "cooldown_recent_exit"),
        (F.col("last_gap_cancel_session") > gap_cutoff, "cooldown_gap_cancelled"),
    )


def order_key() -> Column:
    """Ascending total order: best composite, quality, completeness, lowest id first."""
    return F.struct(
        (-F.coalesce(F.col("composite"), F.lit(-1.0))).alias("k1"), (-F.coalesce(F.col("quality"), F.lit(-1.0))).alias("k2"),
        (-F.col("inputs_complete")).alias("k3"), F.col("security_id").alias("k4"),
    )


_KEY = "struct<k1:double,k2:double,k3:int,k4:bigint>"


def _fold(horizons: list[int], params: Params) -> Column:
    """Greedy pass over the bounded, ordered prefix `_prefix` with `_capacity`."""
    open_to = ", ".join(f"(NOT array_contains(x.open_horizons, {h}) AND s.cap[{i}] > 0)" for i, h in enumerate(horizons))
    step = (
        "(s, x) -> CASE WHEN size(s.sel) < {total} AND exists(array({open}), b -> b) "
        "AND size(filter(s.sel, y -> y.cohort_id = x.cohort_id)) < {per} "
        "THEN named_struct('sel', array_append(s.sel, x), 'cap', transform(s.cap, (c, i) -> "
        "c - CASE WHEN element_at(array({open}), i + 1) THEN 1 ELSE 0 END)) ELSE s END"
    ).format(total=params.max_candidates_per_selection, per=params.max_per_cohort, open=open_to)
    item = f"array<struct<_k:{_KEY},cohort_id:string,open_horizons:array<int>>>"
    return F.expr(
        f"aggregate(_prefix, named_struct('sel', CAST(array() AS {item}), 'cap', _capacity), {step})"
    )


def select(
    rows: DataFrame, capacity: dict[int, int], exit_cutoff: Column, gap_cutoff: Column,
    threshold: Column | None | float = FROZEN.composite_threshold, params: Params = FROZEN, group: tuple = (),
) -> tuple[DataFrame, DataFrame]:
    """(selected rows with position, suppression rows per horizon).

    The greedy scan needs few rows: within one (cohort, open horizons) class the
    rows selected are a prefix of the class, so the first `max_per_cohort` of each
    class are folded in order, and every other row is placed by comparing its key
    with the keys where a cap or a book ran out. `group` columns (for example a
    swept threshold) make independent passes in one job.
    """
    horizons = sorted(capacity)
    limit = threshold if isinstance(threshold, Column) or threshold is None else F.lit(float(threshold))
    fail = F.coalesce(eligibility_failure(limit, params), cooldown_failure(exit_cutoff, gap_cutoff))
    keyed = rows.withColumns(
        {
            "_reason": fail, "_k": order_key().cast(_KEY),
            "open_horizons": F.array_sort(F.array_intersect(F.col("open_horizons").cast("array<int>"), F.array(*[F.lit(h) for h in horizons]))),
        }
    )
    survivors = keyed.where(F.col("_reason").isNull())

    # Bounded by cohorts x open-horizon sets x cap per cohort.
    heads = group_top(survivors, [*group, "cohort_id", "open_horizons"], [F.col("_k")], params.max_per_cohort)
    prefix = heads.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.struct("_k", "cohort_id", "open_horizons"))).alias("_prefix")
    )
    done = prefix.withColumn("_capacity", F.array(*[F.lit(int(capacity[h])) for h in horizons])).withColumn("_s", _fold(horizons, params))
    chosen = F.col("_s.sel")
    limits = {
        "_full": F.when(F.size(chosen) >= params.max_candidates_per_selection, F.element_at(F.transform(chosen, lambda x: x["_k"]), -1)),
    }
    def free_for(h: int):
        """Rows that can still use book h. A bound argument, not a default one: Spark takes a second parameter for the position."""
        return lambda x: ~F.array_contains(x["open_horizons"], F.lit(h))

    for h in horizons:
        used = F.transform(F.filter(chosen, free_for(h)), lambda x: x["_k"])
        # with capacity c the book is gone after the c-th selected row that could use it
        limits[f"_gone_{h}"] = (
            F.when(F.size(used) >= capacity[h], F.get(used, F.lit(int(capacity[h]) - 1))) if capacity[h] > 0 else F.lit(None).cast(_KEY)
        )
    done = done.withColumns(limits)
    picked = F.transform(chosen, lambda x: x["_k"])
    table = done.select(*group, picked.alias("_picked"), *limits)
    # one row per group, holding at most max_candidates keys
    if group:
        placed = survivors.join(F.broadcast(table), list(group), "left")
    else:
        placed = survivors.join(F.broadcast(table), how="left", on=F.lit(True))

    def blocked(h: int) -> Column:
        spent = F.lit(True) if capacity[h] <= 0 else F.coalesce(F.col("_k") > F.col(f"_gone_{h}"), F.lit(False))
        return F.when(F.array_contains("open_horizons", F.lit(h)), "open_position").when(spent, "book_capacity")

    per_horizon = {f"_b{h}": blocked(h) for h in horizons}
    placed = placed.withColumns(per_horizon)
    all_blocked = F.lit(True)
    for h in horizons:
        all_blocked = all_blocked & F.col(f"_b{h}").isNotNull()
    is_picked = F.coalesce(F.array_contains("_picked", F.col("_k")), F.lit(False))
    verdict = first_match(
        (is_picked, "selected"),
        (all_blocked, "blocked"),
        (F.col("_k") > F.col("_full"), "selection_cap"),
        otherwise="cohort_cap",
    )
    placed = placed.withColumn("_verdict", verdict)

    base = [*group, "security_id", "composite", "rank"]
    selected = placed.where(F.col("_verdict") == "selected").select(
        *rows.columns, (F.array_position("_picked", F.col("_k"))).cast("int").alias("position")
    )
    horizon_rows = F.array(*[
        F.struct(F.lit(h).alias("horizon_days"), F.coalesce(F.col(f"_b{h}"), F.when(F.col("_verdict").isin("selection_cap", "cohort_cap"), F.col("_verdict"))).alias("reason"))
        for h in horizons
    ])
    late = placed.select(*base, F.explode(horizon_rows).alias("_h")).select(*base, "_h.*").where(F.col("reason").isNotNull())
    early = keyed.where(F.col("_reason").isNotNull()).select(
        *base, F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_days"), F.col("_reason").alias("reason")
    )
    return selected, early.unionByName(late)


def suppress_all(rows: DataFrame, horizons, reason: str) -> DataFrame:
    """One row per horizon with the same reason: a stale source, missing evidence."""
    return rows.select(
        "security_id", "composite", "rank", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_days"),
        F.lit(reason).alias("reason"),
    )


def evidence_offences(cited: DataFrame, filings: DataFrame, facts: DataFrame, transactions: DataFrame, cutoff: Column) -> DataFrame:
    """Cited accessions whose acceptance is unknown or after the cutoff.

    `cited`: security_id, accession_no. Only cited accessions reach the shuffle.
    """
    keys = cited.select("accession_no").distinct()
    times = None
    for table in (filings, facts, transactions):
        part = table.select("accession_no", "accepted_at").join(keys, "accession_no", "left_semi")
        times = part if times is None else times.unionByName(part)
    newest = times.groupBy("accession_no").agg(F.max("accepted_at").alias("accepted_at"))
    out = cited.join(newest, "accession_no", "left")
    offence = first_match((F.col("accepted_at").isNull(), "unresolvable"), (F.col("accepted_at") > cutoff, "after_cutoff"))
    return out.withColumn("offence", offence).where(F.col("offence").isNotNull())


def candidate_rows(
    selected: DataFrame, signal: DataFrame, session: Column, snapshot: Column, config_hash: str, params: Params = FROZEN
) -> DataFrame:
    """Candidate evidence rows with a deterministic id and a tamper hash.

    `signal`: security_id, signal_close, atr_value, price_data_cutoff at the session.
    """
    cutoff = F.date_format(session_close_utc(session), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    out = selected.join(signal, "security_id").select(
        short_id("cand", "security_id", cutoff, F.lit(params.strategy_version), F.lit(params.selection_rule_version)).alias("candidate_id"),
        "security_id", cutoff.alias("data_cutoff_at"), snapshot.alias("snapshot_id"),
        F.lit(params.strategy_version).alias("strategy_version"), F.lit(config_hash).alias("config_hash"),
        F.lit(params.selection_rule_version).alias("selection_rule_version"),
        F.col("composite").alias("composite_at_generation"), F.col("position").alias("rank_at_generation"),
        "signal_close", "atr_value", "price_data_cutoff", F.lit(params.gap_cancel_atr).alias("gap_limit_atr"), "cohort_id",
    )
    return out.withColumn("row_hash", row_hash(HASHED))


def tampered(candidates: DataFrame) -> DataFrame:
    """Rows whose stored hash no longer matches their content."""
    return candidates.withColumn("recomputed", row_hash(HASHED)).where(F.col("row_hash") != F.col("recomputed"))


def threshold_sweep(rows: DataFrame, capacity: dict[int, int], thresholds=range(50, 91, 5), unknown_count: DataFrame | None = None, params: Params = FROZEN) -> DataFrame:
    """The selection rule at every threshold, each with its own books, in one job."""
    horizons = sorted(capacity)
    swept = rows.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    never = F.lit(None).cast("date")
    picked, dropped = select(swept, capacity, never, never, F.col("threshold").cast("double"), params, ("threshold",))
    by_cohort = picked.groupBy("threshold", "cohort_id").agg(F.count("*").alias("_n"))
    won = by_cohort.groupBy("threshold").agg(
        F.sum("_n").alias("candidates"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("cohort_id", "_n")))).alias("cohort_distribution")
    )
    lost = dropped.groupBy("threshold").agg(F.count("*").alias("suppressed"))
    grid = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    out = grid.join(won, "threshold", "left").join(lost, "threshold", "left").na.fill(0, ["candidates", "suppressed"])
    if unknown_count is not None:
        extra = unknown_count.agg(F.count("*").alias("excluded_unknown"))
        out = out.join(extra).withColumn("suppressed", F.col("suppressed") + F.col("excluded_unknown") * len(horizons))
    for h in horizons:
        out = out.withColumn(f"weeks_to_100_{h}", F.when(F.col("candidates") > 0, F.round(100 / F.col("candidates") + h / 5.0, 1)))
    return out


def permitted_horizons(candidates: DataFrame, suppressions: DataFrame, horizons) -> DataFrame:
    """Horizons of each candidate its own run did not block."""
    every = candidates.select("candidate_id", "run_id", "security_id", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_days"))
    blocked = suppressions.where(F.col("reason").isin("open_position", "book_capacity"))
    return every.join(blocked.select("run_id", "security_id", "horizon_days"), ["run_id", "security_id", "horizon_days"], "left_anti")

