"""Session calendar, trading weeks, gaps and streaks.

Calendars are distinct dates, so they stay within some ten thousand rows however
large the price table is; only these are windowed without a partition key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(bars: DataFrame) -> DataFrame:
    """Every trading date with its 1-based index; holes in one series do not matter."""
    days = bars.select("date").distinct()
    return days.withColumn("session_no", F.row_number().over(Window.orderBy("date")))


def next_sessions(bars: DataFrame) -> DataFrame:
    return sessions(bars).withColumn("next_session", F.lead("date").over(Window.orderBy("date")))


def trading_weeks(bars: DataFrame, as_of: Column) -> DataFrame:
    """ISO weeks with first and final session and whether the week is provably over.

    Over means a later week has a session, or the weekend has come and the last
    session seen was a Friday.
    """
    days = bars.select("date").distinct()
    weeks = days.groupBy(
        F.extract(F.lit("YEAROFWEEK"), F.col("date")).cast("int").alias("iso_year"),
        F.weekofyear("date").alias("iso_week"),
    ).agg(
        F.min("date").alias("first_session"), F.max("date").alias("final_session"), F.count("*").alias("session_count")
    )
    later = F.lead("first_session").over(Window.orderBy("iso_year", "iso_week")).isNotNull()
    saturday = F.date_add(F.trunc("final_session", "week"), 5)
    settled = (as_of >= saturday) & (F.dayofweek("final_session") == 6)
    return weeks.withColumn("complete", later | F.coalesce(settled, F.lit(False)))


def latest_complete_week(bars: DataFrame, as_of: Column) -> DataFrame:
    weeks = trading_weeks(bars, as_of).where(F.col("complete") & (F.col("final_session") <= as_of))
    return weeks.orderBy(F.desc("final_session")).limit(1)


def sessions_upto(cal: DataFrame, dates: DataFrame) -> DataFrame:
    """(_d, _n): number of the last session at or before each date, NULL before the first; one row per distinct date.

    A forward fill over sessions and dates together: at most one row per day of the calendar.
    """
    marks = cal.select(F.col("date").alias("_d"), F.col("session_no").alias("_s"), F.lit(False).alias("_asked")).unionByName(
        dates.where(F.col("_d").isNotNull()).distinct().select("_d", F.lit(None).cast("int").alias("_s"), F.lit(True).alias("_asked"))
    )
    fill = F.max("_s").over(Window.orderBy("_d").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return marks.withColumn("_n", fill).where("_asked").select("_d", "_n")


def sessions_back(bars: DataFrame, ends: DataFrame, count: int, end: str = "end") -> DataFrame:
    """The session `count` sessions before the last one at or before `end`; NULL if too few."""
    cal = sessions(bars)
    edge = sessions_upto(cal, ends.select(F.col(end).alias("_d"))).select(F.col("_d").alias(end), "_n")
    back = cal.select(F.col("session_no").alias("_k"), F.col("date").alias("back_session"))
    return edge.join(back, F.col("_k") == F.col("_n") - count, "left").select(end, "back_session")


def sessions_between(bars: DataFrame, spans: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Sessions after `start` up to and including `end`, per span, by index difference."""
    cal = sessions(bars)
    bounds = spans.select(F.explode(F.array(start, end)).alias("_d")).distinct()
    upto = sessions_upto(cal, bounds).select("_d", F.coalesce("_n", F.lit(0)).alias("_n"))
    a = upto.select(F.col("_d").alias(start), F.col("_n").alias("_a"))
    b = upto.select(F.col("_d").alias(end), F.col("_n").alias("_b"))
    return spans.join(a, start).join(b, end).withColumn(
        "sessions", F.greatest(F.lit(0), F.col("_b") - F.col("_a"))
    ).drop("_a", "_b")


def sessions_missed(bars: DataFrame, securities: DataFrame, as_of: Column, lookback: int = 10) -> DataFrame:
    """Of the last `lookback` sessions, how many come after each security's last bar."""
    recent = bars.where(F.col("date") <= as_of).select("date").distinct().orderBy(F.desc("date")).limit(lookback)
    recent = recent.agg(F.collect_list("date").alias("_recent"))  # at most `lookback` dates
    last = bars.where((F.col("date") <= as_of) & F.col("close").isNotNull()).groupBy("security_id").agg(
        F.max("date").alias("last_bar")
    )
    out = securities.join(last, "security_id", "left").join(F.broadcast(recent))
    missed = F.size(F.filter("_recent", lambda d: d > F.col("last_bar")))
    return out.withColumn("missed", F.when(F.col("last_bar").isNotNull(), missed)).drop("_recent")


def quarter_streak(facts: DataFrame, as_of: Column, key: str = "cik", max_gap_days: int = 100) -> DataFrame:
    """Consecutive quarter ends back from the newest; annual facts stand for Q4."""
    days = F.datediff("period_end", "period_start")
    points = (
        facts.where(F.col("accepted_at").isNotNull() & F.col("period_start").isNotNull() & (F.col("period_end") <= as_of))
        .where(days.between(75, 100) | days.between(350, 380))
        .select(key, "period_end")
        .distinct()
    )
    back = Window.partitionBy(key).orderBy(F.desc("period_end"))  # distinct ends: a few per year
    gap = F.datediff(F.lag("period_end").over(back), F.col("period_end"))
    marked = points.withColumn("_break", F.coalesce((gap > max_gap_days).cast("int"), F.lit(0)))
    marked = marked.withColumn("_breaks", F.sum("_break").over(back.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where(F.col("_breaks") == 0).groupBy(key).agg(F.count("*").alias("streak"))


def missed_runs(runs: DataFrame, today: Column, period_days: int, grace_days: int = 0, key: str = "job") -> DataFrame:
    """Run dates that should have happened between each job's last run and today."""
    last = runs.groupBy(key).agg(F.max("run_date").alias("last_run"))
    late = last.where(F.datediff(today, F.col("last_run")) > period_days + grace_days)
    first = F.date_add("last_run", period_days)
    due = late.where(first < today).select(
        key, "last_run", F.explode(F.sequence(first, F.date_sub(today, 1), F.expr(f"INTERVAL {period_days} DAYS"))).alias("missed_date")
    )
    return due


def abandoned_runs(runs: DataFrame, now: Column, hours: int = 8) -> DataFrame:
    """Runs still marked running after longer than any stage may take, closed as failed."""
    age = F.timestamp_diff("SECOND", F.col("started_at"), now)
    stuck = (F.col("status") == "running") & (age >= hours * 3600)
    return runs.where(stuck).withColumns({"status": F.lit("failed"), "finished_at": now, "age_hours": age / 3600.0})
