"""Hand-computed cases: ties, NULLs, splits, cooldowns, tight books, delisting."""

import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from knownat.functions import core as C, metrics as M, text as T
from knownat.operators import asof, bars as B, calendar as CAL, ledger as L, ordered as O, ranking as R, selection as SEL
from knownat.sources import sinks


def test_midrank_ties_and_single(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, 2.0, 5.0)] + [("b", 7.0), ("c", None)], "g string, v double")
    got = {(r.g, r.v): r.pct for r in R.midrank(df, "v", ["g"]).collect()}
    assert got[("a", 1.0)] == 0 and got[("a", 2.0)] == 50 and got[("a", 5.0)] == 100
    assert got[("b", 7.0)] is None and got[("c", None)] is None


def test_prefix_sums_match_brute_force(spark):
    rng = random.Random(5)
    data = [(i, rng.choice("xyz") if i % 3 else "x", rng.randint(-50, 50)) for i in range(3000)]
    df = spark.createDataFrame(data, "id bigint, g string, v bigint").repartition(7)
    got = {r.id: (r.running, r.peak) for r in O.running_peak(df, F.col("id"), "v", ["g"]).collect()}
    run, peak = {}, {}
    for i, g, v in data:
        run[g] = run.get(g, 0) + v
        peak[g] = max(peak.get(g, 0), run[g])
        assert got[i] == (run[g], peak[g])
    numbered = {r.id: r.row_no for r in O.numbered(df, F.col("id")).collect()}
    assert numbered == {i: i + 1 for i in range(3000)}


def test_asof_join_matches_brute_force(spark):
    rng = random.Random(9)
    start = date(2020, 1, 1)
    right = [(k, start + timedelta(days=rng.randint(0, 900)), float(i)) for i, k in enumerate(rng.choices("abc", k=120))]
    left = [(i, rng.choice("abcd"), start + timedelta(days=rng.randint(0, 1200))) for i in range(300)]
    ldf = spark.createDataFrame(left, "id bigint, k string, t date")
    rdf = spark.createDataFrame(right, "k string, d date, v double")
    got = {r.id: r.v for r in asof.asof_join(ldf, rdf, ["k"], "t", "d", ["v"], tie_break=[F.col("v")], bucket_days=30).collect()}
    for i, k, t in left:
        known = [(d, v) for kk, d, v in right if kk == k and d <= t]
        assert got[i] == (max(known)[1] if known else None)


def test_split_adjustment_has_no_jump(spark):
    days = ["2024-06-05", "2024-06-06", "2024-06-07", "2024-06-10", "2024-06-11"]
    closes = [1200.0, 1205.0, 1208.0, 121.8, 123.0]
    bars = spark.createDataFrame([(1, d, c, c, c, c, 100) for d, c in zip(days, closes)], "security_id bigint, date string, open double, high double, low double, close double, volume bigint").withColumn("date", F.col("date").cast("date"))
    act = "security_id bigint, ex_date date, action_type string, ratio double, cash_amount double, requires_manual_review boolean"
    actions = spark.createDataFrame([(1, date(2024, 6, 10), "split", 10.0, None, False), (1, date(2024, 6, 11), "other", 3.0, None, True)], act)
    got = {str(r.date): r for r in B.adjusted_bars(bars, actions).collect()}
    assert got["2024-06-07"].close == 120.8 and got["2024-06-07"].factor == 10 and got["2024-06-07"].volume == 1000
    assert got["2024-06-10"].factor == 1


def test_metric_reasons(spark):
    df = spark.range(1).select(
        F.expr("named_struct('value', 0D, 'concept', 'c', 'accession', 'a')").alias("zero"),
        F.expr("named_struct('value', CAST(NULL AS DOUBLE), 'concept', CAST(NULL AS STRING), 'accession', CAST(NULL AS STRING))").alias("none"),
        F.expr("named_struct('value', 10D, 'concept', 'c', 'accession', 'a')").alias("ten"),
    )
    r = df.select(
        M.current_ratio(F.col("ten"), F.col("zero"), 5.0).alias("a"), M.interest_coverage(F.col("ten"), F.col("none"), F.col("zero"), 50.0).alias("b"),
        M.current_ratio(F.col("none"), F.col("ten"), 5.0).alias("c"), M.present_total(F.col("none"), F.col("zero")).alias("d"),
    ).first()
    assert r.a.value is None and r.a.reason == "invalid:current_liabilities=0"
    assert r.b.value == 50.0 and r.c.reason == "missing:current_assets" and r.d.value == 0.0


def greedy(rows, horizons, total, per, capacity):
    chosen, cohorts, cap, log = [], {}, dict(capacity), []
    for r in sorted(rows, key=lambda r: (-r["composite"], -r["quality"], -r["inputs_complete"], r["security_id"])):
        blocked = []
        for h in horizons:
            if h in r["open_horizons"]:
                log.append((r["security_id"], h, "open_position")); blocked.append(h)
            elif cap[h] <= 0:
                log.append((r["security_id"], h, "book_capacity")); blocked.append(h)
        if len(blocked) == len(horizons):
            continue
        why = "selection_cap" if len(chosen) >= total else "cohort_cap" if cohorts.get(r["cohort_id"], 0) >= per else None
        if why:
            log += [(r["security_id"], h, why) for h in horizons if h not in blocked]
            continue
        chosen.append(r["security_id"])
        cohorts[r["cohort_id"]] = cohorts.get(r["cohort_id"], 0) + 1
        for h in horizons:
            if h not in blocked:
                cap[h] -= 1
    return chosen, sorted(log)


@pytest.mark.parametrize("capacity", [{20: 100, 60: 100}, {20: 1, 60: 3}, {20: 0, 60: 2}, {20: 0, 60: 0}])
def test_selection_matches_greedy_scan(spark, capacity):
    rng = random.Random(sum(capacity.values()))
    rows = [
        dict(security_id=i, symbol=str(i), cohort_id=rng.choice("ABCD"), composite=float(rng.randint(56, 70)), quality=float(rng.randint(0, 3)), inputs_complete=rng.randint(0, 1),
             open_horizons=rng.choice([[], [], [20], [60], [20, 60]]))
        for i in range(60)
    ]
    df = spark.createDataFrame(
        [(r["security_id"], r["cohort_id"], r["composite"], r["quality"], r["inputs_complete"], r["open_horizons"]) for r in rows],
        "security_id bigint, cohort_id string, composite double, quality double, inputs_complete int, open_horizons array<int>",
    ).withColumns({
        "rankable": F.lit(True), "model_applicable": F.lit(True), "dilution_score": F.lit(0.0), "dilution_disqualified": F.lit(False), "high_going_concern": F.lit(False),
        "high_dilution_flags": F.array().cast("array<string>"), "last_exit_session": F.lit(None).cast("date"), "last_gap_cancel_session": F.lit(None).cast("date"), "rank": F.lit(None).cast("bigint"),
    })
    none = F.lit(None).cast("date")
    picked, dropped = SEL.select(df, capacity, none, none)
    chosen, log = greedy(rows, sorted(capacity), 5, 2, capacity)
    assert [r.security_id for r in picked.orderBy("position").collect()] == chosen
    assert sorted((r.security_id, r.horizon_days, r.reason) for r in dropped.collect()) == log


@pytest.mark.parametrize("capacity", [{20: 1, 60: 10}, {20: 2, 60: 1}, {20: 3, 60: 3}])
def test_selection_with_tight_books_over_many_seeds(spark, capacity):
    rows = []
    for seed in range(250):
        rng = random.Random(seed)
        rows += [
            dict(seed=seed, security_id=i, symbol=str(i), cohort_id=rng.choice("ABCD"), composite=float(rng.randint(56, 60)), quality=float(rng.randint(0, 2)), inputs_complete=rng.randint(0, 1),
                 open_horizons=rng.choice([[], [20], [60], [20, 60]]))
            for i in range(12)
        ]
    df = spark.createDataFrame(
        [(r["seed"], r["security_id"], r["cohort_id"], r["composite"], r["quality"], r["inputs_complete"], r["open_horizons"]) for r in rows],
        "seed int, security_id bigint, cohort_id string, composite double, quality double, inputs_complete int, open_horizons array<int>",
    ).withColumns({
        "rankable": F.lit(True), "model_applicable": F.lit(True), "dilution_score": F.lit(0.0), "dilution_disqualified": F.lit(False), "high_going_concern": F.lit(False),
        "high_dilution_flags": F.array().cast("array<string>"), "last_exit_session": F.lit(None).cast("date"), "last_gap_cancel_session": F.lit(None).cast("date"), "rank": F.lit(None).cast("bigint"),
    })
    none = F.lit(None).cast("date")
    picked, dropped = SEL.select(df, capacity, none, none, group=("seed",))
    chosen, log = {}, {}
    for r in picked.orderBy("seed", "position").collect():
        chosen.setdefault(r.seed, []).append(r.security_id)
    for r in dropped.collect():
        log.setdefault(r.seed, []).append((r.security_id, r.horizon_days, r.reason))
    for seed in range(250):
        want, reasons = greedy([r for r in rows if r["seed"] == seed], sorted(capacity), 5, 2, capacity)
        assert (chosen.get(seed, []), sorted(log.get(seed, []))) == (want, reasons), seed


def test_submetric_distributions_keep_every_metric(spark):
    from knownat.operators.calibrate import submetric_distributions

    part = "array<struct<metric string, value_used double, valid boolean>>"
    df = spark.createDataFrame(
        [(True, [("pe", 15.0, True), ("pb", None, False)], [], []), (True, [("pe", 95.0, True), ("pb", None, False)], [("roic", 100.0, True)], []), (False, [("pe", 1.0, True)], [], [])],
        f"rankable boolean, value_submetrics {part}, quality_submetrics {part}, momentum_submetrics {part}",
    )
    got = {(r.metric, r.bucket): r for r in submetric_distributions(df).collect()}
    assert {m for m, _ in got} == {"value.pe", "value.pb", "quality.roic"} and len(got) == 30
    assert [got["value.pe", b]["count"] for b in range(10)] == [0, 1, 0, 0, 0, 0, 0, 0, 0, 1]
    assert all(got["value.pb", b]["count"] == 0 for b in range(10)) and (got["value.pb", 0].total, got["value.pb", 0].valid_count) == (2, 0)
    assert got["quality.roic", 9]["count"] == 1 and got["value.pe", 0].bucket_end == 10.0


def test_week_is_complete_only_when_proved(spark):
    bars = spark.createDataFrame([(date(2026, 1, d),) for d in (5, 6, 7, 8, 9, 12, 13, 14)], "date date")
    weeks = {r.iso_week: r.complete for r in CAL.trading_weeks(bars, F.lit("2026-01-20").cast("date")).collect()}
    assert weeks == {2: True, 3: False}


def test_going_concern_passages(spark):
    from knownat.operators.risk import going_concern

    texts = {
        "auditor": "These conditions raise substantial doubt about the Company's ability to continue as a going concern.",
        "denial": "The events did not raise substantial doubt about our ability to continue as a going concern.",
        "policy": "Management evaluates whether there is substantial doubt about our ability to continue as a going concern.",
        "alleviated": "There was substantial doubt about our ability to continue as a going concern, alleviated by financing.",
        "clean": "Our business may fail.",
    }
    df = spark.createDataFrame(list(texts.items()), "accession_no string, text string")
    got = {r.accession_no: r for r in going_concern(df).collect()}
    assert got["auditor"].detected and got["auditor"].offset == 23 and not got["auditor"].alleviated
    assert got["denial"].rejected_reason == "denial" and got["policy"].rejected_reason == "definition"
    assert got["alleviated"].alleviated and not got["clean"].detected


def test_html_text(spark):
    df = spark.createDataFrame([("<p>Profit&nbsp;&amp;<b>loss</b>\n​ &lt;5%</p>",)], "h string")
    assert df.select(T.html_to_text("h")).first()[0] == "Profit & loss <5%"


def _flat(spark, n, price=100.0, volume=2_000_000, special=None):
    start = date(2026, 1, 1)
    rows = []
    for i in range(n):
        o, h, l, c = (special or {}).get(i, (price,) * 4)
        rows.append((1, start + timedelta(days=i), o, h, l, c, volume))
    return spark.createDataFrame(rows, "security_id bigint, date date, open double, high double, low double, close double, volume bigint")


ACT = "security_id bigint, ex_date date, action_type string, ratio double, cash_amount double, requires_manual_review boolean"
SEC = "security_id bigint, is_active boolean, delisted_date date"
POS = "position_id string, candidate_id string, security_id bigint, horizon_days int, entry_date date, entry_price double, slippage_bps double, shares double, notional double, stop_price double, target_price double"


def _position(spark, entry=5, horizon=20, stop=90.0, target=120.0):
    return spark.createDataFrame([("p", "c", 1, horizon, date(2026, 1, 1) + timedelta(days=entry), 100.0, 5.0, 10.0, 1000.0, stop, target)], POS)


def test_split_during_hold_is_no_stop(spark):
    special = {i: (50.0, 50.0, 50.0, 50.0) for i in range(10, 40)}
    actions = spark.createDataFrame([(1, date(2026, 1, 11), "split", 2.0, None, False), (1, date(2026, 1, 8), "dividend", None, 0.5, False), (1, date(2026, 1, 6), "dividend", None, 9.0, False)], ACT)
    sec = spark.createDataFrame([(1, True, None)], SEC)
    r = L.resolve_positions(_position(spark), _flat(spark, 40, special=special), actions, sec, F.lit("2026-03-01").cast("date")).first()
    assert (r.status, r.exit_reason, str(r.exit_date)) == ("closed", "time_exit", "2026-01-26")
    assert r.shares == 20 and r.splits_applied == 2 and r.dividends_received == pytest.approx(5.0)


@pytest.mark.parametrize("as_of, status, reason", [("2026-02-20", "pending_resolution", None), ("2026-09-01", "closed", "delisting_zero_after_180d")])
def test_delisting(spark, as_of, status, reason):
    sec = spark.createDataFrame([(1, False, date(2026, 1, 15))], SEC)
    r = L.resolve_positions(_position(spark, horizon=60), _flat(spark, 40), spark.createDataFrame([], ACT), sec, F.lit(as_of).cast("date")).first()
    assert r.status == status and r.exit_reason == reason
    if reason:
        assert r.net_pnl == -1000.0 and str(r.exit_date) == "2026-07-14"


def test_both_levels_touched_is_a_stop(spark):
    special = {8: (100.0, 130.0, 80.0, 100.0)}
    sec = spark.createDataFrame([(1, True, None)], SEC)
    r = L.resolve_positions(_position(spark), _flat(spark, 20, special=special), spark.createDataFrame([], ACT), sec, F.lit("2026-03-01").cast("date")).first()
    assert r.exit_reason == "stop" and r.exit_price == pytest.approx(90.0 * (1 - 5e-4))


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2")], "id int, v string, row_hash string")
    new = spark.createDataFrame([(2, "c", "hx"), (3, "d", "h3")], "id int, v string, row_hash string")
    fresh, bad = sinks.insert_if_absent(old, new, "id")
    assert [r.id for r in fresh.collect()] == [3] and [r.id for r in bad.collect()] == [2]
    with pytest.raises(ValueError):
        sinks.require_empty(bad, "candidates")
    assert {r.id: r.v for r in sinks.upsert(old, new, ["id"]).collect()} == {1: "a", 2: "c", 3: "d"}


def test_acceptance_time_and_hours(spark):
    df = spark.createDataFrame([("2026-03-02T21:30:05.000Z",), ("2026-03-02",), ("2026-03-02 21:30:05",)], "t string")
    assert [str(r[0]) for r in df.select(F.date_format(C.acceptance_time("t"), "HH:mm:ss")).collect()] == ["21:30:05", "None", "21:30:05"]


def test_blended_percentiles_by_counting(spark):
    """Market and cohort places, ties, a NULL cohort, NULL values and single rows against plain counting."""
    from knownat.operators.ranking import blended_percentiles

    rng = random.Random(5)
    rows = [(i, rng.choice(["pe", "roic"]), rng.choice(["A", "B", None]), rng.choice([None, *map(float, range(40))])) for i in range(600)]
    rows.append((600, "alone", "A", 1.0))
    df = spark.createDataFrame(rows, "id int, metric string, cohort_id string, value double")

    def place(values, v):
        if v is None:
            return None
        n = len(values)
        return None if n < 2 else 100.0 * (sum(x < v for x in values) + (sum(x == v for x in values) - 1) / 2) / (n - 1)

    got = {r.id: r for r in blended_percentiles(df).collect()}
    assert len(got) == len(rows)
    for i, metric, cohort, v in rows:
        market = [x for _, m, _, x in rows if m == metric and x is not None]
        peers = [x for _, m, c, x in rows if m == metric and c == cohort and x is not None]
        for name, values in (("market", market), ("cohort", peers)):
            want = place(values, v)
            if want is not None and metric == "pe":
                want = 100.0 - want
            assert got[i][f"{name}_pct"] == (None if want is None else pytest.approx(want, abs=1e-9))
            assert got[i][f"{name}_n"] == (None if v is None else len(values))


def test_percentiles_read_their_input_twice_and_large_groups_are_spread(spark, tmp_path):
    from knownat.operators.ranking import blended_percentiles

    rows = spark.range(5000).selectExpr("id", "'pe' AS metric", "string(id % 3) AS cohort_id", "double(id * 7919 % 4999) AS value")
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))  # columns that the optimizer can't fold
    plan = blended_percentiles(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1  # counting was the other
    assert O.bucketed(rows, F.col("value"), ["metric"]).select("_bucket").distinct().count() > 200
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = O.running_sum(rows, F.col("value"), "id", ["metric"])
        plan = placed._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(metric#\d+, _bucket#\d+", plan)  # the window sorts a bucket a task, not a metric a task
        assert placed.agg(F.max("running")).first()[0] == 5000 * 4999 // 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_killed_run_done_again_leaves_each_row_once(spark, tmp_path):
    path, schema = str(tmp_path / "facts"), "id int, v string"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    read = lambda: sorted((r.id, r.v, r.run_id) for r in sinks.read_appended(spark, path, make().schema).collect())
    assert read() == []
    sinks.stage_run(make((1, "half")), path, "day/1")  # killed before its marker
    assert read() == []
    assert sinks.append_run(make((1, "a"), (2, "b"), (2, "b"), (None, "n")), path, "day/1", ["id"]) == 3
    done = [(1, "a", "day/1"), (2, "b", "day/1")]
    key = lambda rows: sorted(rows, key=repr)
    sure = lambda: key((r.id, r.v, r.run_id) for r in sinks.read_appended(spark, path, make().schema).collect())
    assert sure() == key([*done, (None, "n", "day/1")])
    assert sinks.append_run(make((7, "late")), path, "day/1", ["id"]) == 0  # committed: nothing is written again
    sinks.stage_run(make((1, "again"), (9, "x")), path, "day/2")
    assert sinks.append_run(make((1, "again"), (3, "c"), (None, "other")), path, "day/2", ["id"]) == 1
    assert sinks.append_run(make(), path, "empty", ["id"]) == 0
    assert sure() == key([*done, (None, "n", "day/1"), (3, "c", "day/2")])
    assert {r.run_id: r.rows_written for r in sinks.read_commits(spark, path).collect()} == {"day/1": 3, "day/2": 1, "empty": 0}
