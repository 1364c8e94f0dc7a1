"""What a plan must not do however large its tables are."""

from __future__ import annotations

from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_queries_of_nearest_are_not_broadcast(spark):
    """The copies of the queries, one for each group of blocks, look small in a plan and filled the driver."""
    from knownat.llm import ann

    rows = [(i, [float((i * k) % 7 - 3) + 0.1 * k for k in range(8)]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = ann.nearest(table, table.where("vec_id % 10 = 0"), k=3)
    assert "Broadcast" not in plan(found)
    assert found.groupBy("query_id").count().where("count = 3").count() == 6


def test_stored_keys_are_not_broadcast(spark):
    """Keys of exploded rows look small in a plan; all of them went through the driver. NULL keys are still appended."""
    from knownat.sources.sinks import append_new

    def exploded(n):
        return spark.range(n).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("c"))

    rows = append_new(exploded(4), exploded(6).unionByName(exploded(6)), ["k", "c"])
    assert "Broadcast" not in plan(rows)
    assert sorted((r.k or -1, r.c) for r in rows.collect()) == [(-1, "a"), (-1, "b"), (4, "a"), (4, "b"), (5, "a"), (5, "b")]


def shuffle_files(spark) -> int:
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()


def test_stored_tables_leave_no_shuffle_files(spark, tmp_path):
    from knownat.session import cut_lineage
    from knownat.sources import sinks

    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    before = shuffle_files(spark)
    kept = cut_lineage(rows.withColumn("none", F.lit(None)))
    sinks.append_run(kept.select("k", "n").repartition(3), str(tmp_path / "runs"), "one", ["k"])
    assert shuffle_files(spark) <= before
    assert kept.count() == 7 and kept.where("none IS NULL AND n > 140").count() == 7


def test_stored_fundamentals_hold_what_is_read(spark, monkeypatch):
    from types import SimpleNamespace

    from knownat.plans import q_facts

    rows = spark.createDataFrame([(1, "2000-12-31", "2001-02-01", 1.5, "wide")], "security_id bigint, period_end string, knowledge_date string, pb double, hash string")
    monkeypatch.setattr(q_facts, "_derive", lambda t: rows)
    assert q_facts._fund(SimpleNamespace(kept={}), "pb", values=lambda r: r).columns == ["security_id", "period_end", "knowledge_date", "pb"]


def test_inputs_and_share_counts_as_known(spark):
    """Against every (state, filing) pair; dates before 1900 too, and nothing is joined to the rows of inputs."""
    from datetime import date, datetime, timedelta
    from random import Random

    from knownat.operators import fundamentals as FU

    r, shares, cash = Random(5), [i for (n, _), i in FU.SLOTS.items() if n == "shares_outstanding"], FU.SLOTS["cash", 1]
    ends = [date(1890 + 3 * i, 12, 31) for i in range(20)]
    said = lambda p, v: v if r.random() < p else None
    filings = [
        (r.choice("ab"), r.choice(ends), datetime(1990, 1, 1) + timedelta(days=r.randrange(40)), f"A{i:03}", said(0.8, r.random()), *[said(0.3, r.random() - 0.2) for _ in shares])
        for i in range(150)
    ]
    columns = "cik string, period_end date, accepted_at timestamp_ntz, accession_no string, _v%d double" % cash
    stated = spark.createDataFrame(filings, columns + "".join(f", _v{i} double" for i in shares))
    stated = stated.select("*", *[F.lit(None).cast("double").alias(f"_v{i}") for i in FU.SLOTS.values() if i not in (cash, *shares)])
    states = [(k, e, r.choice([*ends, None]), datetime(1990, 1, 1) + timedelta(days=d)) for k in "abc" for e in ends[::3] for d in (0, 9, 25, 60)]
    grid = spark.createDataFrame(states, "cik string, period_end date, prior_end date, knowledge_date timestamp_ntz")

    def as_stated(k, end, at):
        return max(((f[2], f[3], f[4]) for f in filings if f[0] == k and f[1] == end and f[2] <= at and f[4] is not None), default=(None,) * 3)[2]

    def as_of(k, end, at):
        seen = [
            (-rank, f[1], f[2], f[3], f[4 + rank]) for f in filings if end and f[0] == k and f[1] <= end and f[2] <= at
            for rank in [next((j for j in range(1, len(shares) + 1) if (f[4 + j] or 0) > 0), 0)] if rank
        ]
        return max(seen, default=(None,) * 5)[4]

    rows = FU.resolve_inputs(grid, stated, ["cash"], ["cash"])
    assert "Join" not in plan(rows)
    got = {(x.cik, x.period_end, x.prior_end, x.knowledge_date, x.cash and x.cash.value, x.prior_cash and x.prior_cash.value) for x in rows.collect()}
    assert got == {(*s, as_stated(s[0], s[1], s[3]), s[2] and as_stated(s[0], s[2], s[3])) for s in states}
    found = FU.instant_as_of(grid, stated, "shares_outstanding", {"own": F.col("period_end"), "before": F.col("prior_end")}).collect()
    got = {(x.cik, x.period_end, x.knowledge_date): (x.own and x.own.value, x.before and x.before.value) for x in found}
    assert got == {(s[0], s[1], s[3]): (as_of(s[0], s[1], s[3]), as_of(s[0], s[2], s[3])) for s in states}
    assert len(found) == len(states) and any(b for _, b in got.values())


def test_sets_of_restatements_are_not_shuffled(spark):
    from knownat.operators.report import restatements

    rows = [("c", "t", "x", None, "2000", a, v) for a, v in (("A", 1.0), ("B", 2.0), ("B", 2.0))] + [("c", "t", "y", None, "2000", a, 1.0) for a in "AB"]
    facts = spark.createDataFrame(rows, "cik string, taxonomy string, concept string, period_start string, period_end string, accession_no string, normalized_numeric_value double")
    found = restatements(facts)
    steps = plan(found)
    assert steps.count("Exchange") == 1 and steps.rindex("collect_set") < steps.index("Exchange")
    assert [(r.concept, r.n_rows, r.n_accessions, r.n_values) for r in found.collect()] == [("x", 3, 2, 2)]


def test_position_columns_travel_with_events_and_benchmark(spark):
    """Joined back by position, they had every position resolved twice."""
    from knownat.operators import ledger as L

    p = spark.sql("""SELECT 'p' AS position_id, 'c' AS candidate_id, 1L AS security_id, 20 AS horizon_days, DATE '2000-01-03' AS entry_date,
        DATE '2000-02-01' AS exit_date, 10.0D AS shares, 2.0D AS splits_applied, 1000.0D AS notional""")
    a = spark.sql("SELECT 1L AS security_id, DATE '2000-01-10' AS ex_date, 'split' AS action_type, 2.0D AS ratio, CAST(NULL AS DOUBLE) AS cash_amount, false AS requires_manual_review")
    b = spark.sql("SELECT -1L AS security_id, d AS date, 10.0D AS open, 11.0D AS close, 5L AS volume FROM (SELECT explode(sequence(DATE '2000-01-03', DATE '2000-02-01')) AS d)")
    event = L.position_events(p, a, ["security_id", "entry_date", "horizon_days"]).collect()[0]
    assert (event.security_id, str(event.entry_date), event.horizon_days, event.shares_before, event.shares_after) == (1, "2000-01-03", 20, 5.0, 10.0)
    assert [r.security_id for r in L.benchmark_positions(p, b, keep=["security_id"]).collect()] == [1]
