"""Read-side reports over stored tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import first_match
from .asof import latest_per_key, with_current_symbol
from .risk import severity_rank


def facts_summary(facts: DataFrame, keys: Sequence[str] = ("cik",)) -> DataFrame:
    """Totals, usable share, distinct concepts and filings, period range per company.

    Facts are first combined by filing, so a company with very many facts is small
    before it reaches one task; its concepts are those of the taxonomy at most.
    """
    per = facts.groupBy(*keys, "accession_no").agg(
        F.count("*").alias("_n"), F.count("accepted_at").alias("_u"), F.min("period_end").alias("_a"), F.max("period_end").alias("_z"),
        F.collect_set("concept").alias("_c"),
    )
    out = per.groupBy(*keys).agg(
        F.sum("_n").alias("total"), F.sum("_u").alias("usable"), F.size(F.array_distinct(F.flatten(F.collect_set("_c")))).cast("long").alias("concepts"),
        F.count("accession_no").alias("accessions"), F.min("_a").alias("earliest"), F.max("_z").alias("latest"),
    )
    return out.withColumn("unusable", F.col("total") - F.col("usable"))


#: What two facts of the same meaning agree in.
MEANING = ("cik", "taxonomy", "concept", "period_start", "period_end")


def restatements(facts: DataFrame, meaning: Sequence[str] = MEANING) -> DataFrame:
    """Facts of one meaning reported with several values by several filings.

    Meanings are compared by their columns, not by a hash made for each fact. A meaning
    has as many filings as restate one period of one company, so their sets stay small.
    """
    filing = F.xxhash64("accession_no").alias("_filing")
    # dealt as they are, a hash and a number: sets made before would be sorted, spilled and shuffled with a key each
    own = facts.select(*meaning, filing, "normalized_numeric_value").repartition(*meaning)
    per = own.groupBy(*meaning).agg(
        F.count("*").alias("n_rows"), F.size(F.collect_set("_filing")).cast("long").alias("n_accessions"),
        F.size(F.collect_set("normalized_numeric_value")).cast("long").alias("n_values"),
    )
    return per.where((F.col("n_accessions") > 1) & (F.col("n_values") > 1))


def acceptance_rate(facts: DataFrame) -> DataFrame:
    """Share of facts with an acceptance time per company, and overall (cik NULL)."""
    known = F.count("accepted_at")
    per = facts.groupBy("cik").agg(F.count("*").alias("facts"), known.alias("accepted"))
    both = per.unionByName(per.agg(F.sum("facts").alias("facts"), F.sum("accepted").alias("accepted")).withColumn("cik", F.lit(None).cast(dict(per.dtypes)["cik"])))
    return both.withColumn("acceptance_rate", F.col("accepted") / F.col("facts"))


def count_by(df: DataFrame, column: str, order: Sequence[str] | None = None) -> DataFrame:
    """Counts of a category with its place in a custom order."""
    out = df.groupBy(column).agg(F.count("*").alias("count"))
    if order:
        rank = first_match(*[(F.col(column) == v, i) for i, v in enumerate(order)], otherwise=len(order))
        out = out.withColumn("place", rank)
    return out


def payload_summary(payloads: DataFrame) -> DataFrame:
    return payloads.agg(
        F.count("*").alias("payloads"), F.sum("byte_size").alias("bytes"), F.countDistinct("source").alias("sources"),
        F.max("fetched_at").alias("latest"),
    )


def source_health(runs: DataFrame, now: Column | None = None, source: str = "source") -> DataFrame:
    """Last success and the failures since it, per source."""
    ok = runs.groupBy(source).agg(F.max(F.when(F.col("status") == "success", F.col("finished_at"))).alias("last_success"))
    fails = runs.where(F.col("status") == "failed").join(ok, source).where(
        F.col("last_success").isNull() | (F.col("finished_at") > F.col("last_success"))
    ).groupBy(source).agg(F.count("*").alias("consecutive_failures"), F.max("finished_at").alias("last_failure"))
    out = ok.join(fails, source, "left").na.fill(0, ["consecutive_failures"])
    if now is not None:
        from ..functions.core import hours_between

        out = out.withColumn("staleness_hours", hours_between("last_success", now))
    return out


def progress_latest(progress: DataFrame) -> DataFrame:
    """Last attempt per (batch, stage, item)."""
    return latest_per_key(progress, ["batch_id", "stage", "item_key"], [F.col("attempted_at")])


def batch_summary(progress: DataFrame) -> DataFrame:
    last = progress_latest(progress)
    return last.groupBy("batch_id", "stage").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "failed", "skipped")]
    )


def pending_items(items: DataFrame, progress: DataFrame) -> DataFrame:
    """Items of a batch not yet done or skipped; `items` keeps its own order column."""
    done = progress_latest(progress).where(F.col("status").isin("success", "skipped"))
    keys = ["batch_id", "stage", "item_key"]
    return items.join(done.select(*keys), keys, "left_anti")


def stage_progress(progress: DataFrame, members: DataFrame, stage: str) -> DataFrame:
    done = progress.where((F.col("stage") == stage) & (F.col("status") == "success")).groupBy("run_id").agg(F.countDistinct("item_key").alias("completed"))
    return done.join(members.where(F.col("status") == "included").agg(F.count("*").alias("total")))


def suppression_summary(suppressed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Unique securities and rows per reason."""
    per = suppressed.groupBy(*keys, "reason", "security_id").agg(F.count("*").alias("_n"))
    return per.groupBy(*keys, "reason").agg(F.count("*").alias("securities"), F.sum("_n").alias("rows"))


def top_ranked(scores: DataFrame, securities: DataFrame, listings: DataFrame, n: int = 8) -> DataFrame:
    """The n best ranks of the newest score date."""
    newest = scores.agg(F.max("score_date").alias("_d"))
    rows = scores.join(F.broadcast(newest), F.col("score_date") == F.col("_d")).drop("_d")
    rows = rows.where(F.col("rankable") & F.col("composite_score").isNotNull())
    best = rows.orderBy("rank", "security_id").limit(n)
    return with_current_symbol(best.join(securities.select("security_id", "name"), "security_id"), listings).orderBy("rank", "security_id")


def search(securities: DataFrame, listings: DataFrame, scores: DataFrame, query: str, n: int = 20) -> DataFrame:
    """Case-insensitive contains on symbol or name; exact symbol first, then rank."""
    newest = scores.agg(F.max("score_date").alias("_d"))
    latest = scores.join(F.broadcast(newest), F.col("score_date") == F.col("_d")).drop("_d")
    rows = with_current_symbol(securities, listings).join(
        latest.select("security_id", "score_date", "composite_score", "rank", "withhold_reason"), "security_id", "left"
    )
    needle = F.upper(F.lit(query.strip()))
    hit = F.contains(F.upper("symbol"), needle) | F.contains(F.upper("name"), needle)
    exact = F.coalesce(F.upper("symbol") == needle, F.lit(False))
    return rows.where(hit).orderBy(exact.desc(), F.col("rank").asc_nulls_last(), "name", "security_id").limit(n)


def ranked_count(scores: DataFrame) -> DataFrame:
    return scores.where("rankable").groupBy("score_date").agg(F.count("*").alias("ranked"))


def risk_panel(flags: DataFrame, filings: DataFrame) -> DataFrame:
    """Newest flags of each security with their filing; ledger references stay."""
    newest = flags.groupBy("security_id").agg(F.max("as_of_date").alias("_d"))
    rows = flags.join(newest, "security_id").where(F.col("as_of_date") == F.col("_d")).drop("_d")
    f = filings.select(
        F.col("accession_no").alias("source_accession"), F.col("form_type").alias("source_form"), F.col("filed_date").alias("source_filed_date")
    )
    return rows.join(f, "source_accession", "left").withColumn("severity_order", severity_rank("severity"))


def position_details(positions: DataFrame, candidates: DataFrame, listings: DataFrame) -> DataFrame:
    """Positions with candidate attributes, cohort from the stored snapshot and symbol."""
    cohort = F.get_json_object("score_snapshot_json", "$.cohort_id").alias("cohort_id")
    c = candidates.select("candidate_id", "security_id", "composite_at_generation", "rank_at_generation", cohort)
    return with_current_symbol(positions.drop("security_id").join(c, "candidate_id"), listings)


def official(rows: DataFrame, experiments: DataFrame, generated: str = "generated_at") -> DataFrame:
    """Rows of clean code generated since the one active experiment began; none without it."""
    active = experiments.where(F.col("status") == "active").agg(F.max("started_at").alias("_start"))  # one row
    return rows.where(~F.contains("code_version", F.lit("+"))).join(F.broadcast(active)).where(F.col(generated) >= F.col("_start")).drop("_start")


def pre_launch(positions: DataFrame, official_positions: DataFrame) -> DataFrame:
    return positions.join(official_positions.select("position_id"), "position_id", "left_anti")


def published_run(runs: DataFrame, suppressed: DataFrame, stage: str = "selection") -> DataFrame:
    """Newest selection run that no stale source blocked."""
    stale = suppressed.where(F.col("reason") == "stale_source").select("run_id").distinct()
    return runs.where(F.col("stage") == stage).join(stale, "run_id", "left_anti").orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)


def run_activity(progress: DataFrame, runs: DataFrame, n: int = 20) -> DataFrame:
    """Newest progress rows with the state of their run."""
    r = runs.select("run_id", F.col("status").alias("run_status"))
    return progress.join(r, "run_id", "left").orderBy(F.desc("attempted_at"), "item_key").limit(n)


def recent(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Newest n rows of a ledger."""
    return df.orderBy(*order).limit(n)


def security_rows(tables: dict[str, DataFrame], security_id: int, n: int | None = None) -> DataFrame:
    """(table, total, row as JSON) for every table about one security; with n, so many rows of each."""
    parts = []
    for name, df in tables.items():
        mine = df.where(F.col("security_id") == security_id)
        total = mine.agg(F.count("*").alias("total"))
        body = mine.select(F.to_json(F.struct(*df.columns)).alias("row"))
        if n is not None:
            body = body.orderBy("row").limit(n)
        parts.append(total.join(body, how="left", on=F.lit(True)).select(F.lit(name).alias("table"), "total", "row"))
    return reduce(DataFrame.unionByName, parts)


def fundamental_periods(fundamentals: DataFrame) -> DataFrame:
    return fundamentals.groupBy("security_id", "period_end").agg(
        F.max("knowledge_date").alias("knowledge_date"), F.count("*").alias("states")
    )


def coverage_by_source(population: DataFrame, sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Flags per security and source: one left join on distinct keys each."""
    out = population
    for name, (table, key) in sources.items():
        seen = table.where(F.col(key).isNotNull()).select(key).distinct().withColumn(f"has_{name}", F.lit(True))
        out = out.join(seen, key, "left").na.fill(False, [f"has_{name}"])
    return out


def source_coverage(flagged: DataFrame, names: Sequence[str]) -> DataFrame:
    wide = flagged.agg(F.count("*").alias("total"), *[F.count_if(f"has_{n}").alias(n) for n in names])
    out = wide.unpivot(["total"], [F.col(n) for n in names], "source", "covered")
    return out.withColumn("pct", 100.0 * F.col("covered") / F.col("total"))


def worst_coverage(flagged: DataFrame, names: Sequence[str], n: int | None = 20) -> DataFrame:
    """Securities missing most sources, with the missing ones named; all of them without n."""
    have = F.filter(F.array(*[F.when(F.col(f"has_{s}"), F.lit(s)) for s in names]), lambda s: s.isNotNull())
    rows = flagged.select("security_id", F.array_except(F.array(*[F.lit(s) for s in names]), have).alias("missing"))
    rows = rows.where(F.size("missing") > 0).withColumn("sources_present", len(names) - F.size("missing"))
    return rows if n is None else rows.orderBy("sources_present", "security_id").limit(n)


def null_reasons(newest: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Why each metric is NULL in the newest state, counted."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).isNull().alias("absent")) for m in metrics])
    rows = newest.select("missing", F.explode(pairs).alias("_p")).where(F.col("_p.absent"))
    reason = F.coalesce(F.try_element_at("missing", F.col("_p.metric")), F.lit("unknown"))
    return rows.groupBy(F.col("_p.metric").alias("metric"), reason.alias("reason")).agg(F.count("*").alias("count"))


def staleness_buckets(population: DataFrame, bars: DataFrame, today: Column) -> DataFrame:
    last = bars.groupBy("security_id").agg(F.max("date").alias("_last"))
    age = F.datediff(today, "_last")
    label = first_match(
        (age.isNull(), "no data"), (age <= 1, "0-1d"), (age <= 3, "1-3d"), (age <= 7, "3-7d"), otherwise="7d+"
    )
    return population.join(last, "security_id", "left").groupBy(label.alias("bucket")).agg(F.count("*").alias("count"))


def status_rollup(scores: DataFrame, runs: DataFrame, suppressed: DataFrame) -> DataFrame:
    """One row: newest score date, ranked count and the state of the last selection."""
    ranked = scores.groupBy("score_date").agg(F.count_if("rankable").alias("ranked_count")).agg(
        F.max_by(F.struct("score_date", "ranked_count"), "score_date").alias("_s")
    )
    last = runs.where(F.col("stage") == "selection").agg(
        F.max_by(F.struct("run_id", "records_written"), F.struct("started_at", "run_id")).alias("_r")
    )
    stale = suppressed.where(F.col("reason") == "stale_source").groupBy("run_id").agg(F.count("*").alias("_stale"))
    out = ranked.join(last)
    out = out.withColumn("_id", F.col("_r.run_id")).join(stale, F.col("_id") == stale["run_id"], "left")
    n = F.coalesce(F.col("_r.records_written"), F.lit(0))
    state = first_match(
        (F.col("_r").isNull(), "no_run_yet"), ((n == 0) & (F.coalesce(F.col("_stale"), F.lit(0)) > 0), "blocked_stale_source"),
        (n == 0, "zero_candidates"), otherwise="published",
    )
    return out.select(
        F.col("_s.score_date").alias("latest_score_date"), F.col("_s.ranked_count").alias("ranked_count"),
        state.alias("selection_status"), n.alias("selected_count"),
    )


def daily_operations(flags: DataFrame, positions: DataFrame, on: Column) -> DataFrame:
    """New severe flags and positions opened, closed or pending on a date, one report."""
    severe = flags.where((F.col("severity") == "high") & (F.col("as_of_date") == on)).select(
        F.lit("severe_flag").alias("event"), F.col("security_id").cast("string").alias("subject"), F.col("flag_code").alias("detail")
    )
    event = first_match(
        (F.col("entry_date") == on, "opened"), (F.col("exit_date") == on, "closed"), (F.col("status") == "pending_resolution", "pending")
    )
    moves = positions.select(event.alias("event"), F.col("position_id").alias("subject"), F.coalesce("exit_reason", "status").alias("detail"))
    return severe.unionByName(moves.where(F.col("event").isNotNull()))


def pool_in_force(pool: DataFrame) -> DataFrame:
    return pool.agg(F.max_by("pool_version", F.struct("discovered_at", "pool_version")).alias("pool_version"))


def newest_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Newest row for every key at once."""
    return latest_per_key(df, keys, order)


def originating_candidates(positions: DataFrame, cancelled: DataFrame) -> DataFrame:
    both = positions.select("candidate_id").union(cancelled.select("candidate_id")).distinct()
    return both.agg(F.count("*").alias("candidates"))


def verification_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "verified").alias("verified"), F.count_if(F.col("status") == "mismatch").alias("mismatched")
    )


def published_defects(defects: DataFrame) -> DataFrame:
    return defects.where(F.col("published_at").isNotNull()).orderBy(F.desc("published_at"), "defect_id")
