"""Screened rows against a plain walk over every source, with gaps, ties, repeats and empty sources."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from knownat.operators import selection as SEL

SESSION, CUTOFF = date(2020, 3, 6), datetime(2020, 3, 6, 21)
SCHEMAS = {
    "universe": "security_id bigint, symbol string",
    "scores": "security_id bigint, score_date date, composite_score double, rank bigint, quality_score double, rankable boolean, cohort_id string",
    "flags": "security_id bigint, as_of_date date, flag_code string, severity string",
    "signals": "security_id bigint, as_of_date date, dilution_score double, is_disqualified boolean",
    "fundamentals": "security_id bigint, period_end date, knowledge_date timestamp_ntz, model_applicable boolean, inputs_complete int",
    "positions": "security_id bigint, status string, exit_date date, horizon_days int, symbol string",
    "cancelled": "security_id bigint, cancelled_at timestamp_ntz",
}


def draw(seed):
    """Random sources around the session; some securities are missing from each, and some rows have no security."""
    rng = random.Random(seed)
    who = lambda: rng.choice([None, *range(40)])
    near = lambda: SESSION + timedelta(days=rng.randint(-3, 2))
    out = {"universe": [(i, rng.choice(["S", None]) and f"S{i}") for i in range(30)]}
    out["scores"] = [(i, near(), rng.random(), i, rng.random(), rng.random() < 0.7, rng.choice(["a", None])) for i in rng.sample(range(40), 30)]
    out["flags"] = [(who(), near(), rng.choice(["going_concern", "active_issuance", "atm_or_convertible", "other"]), rng.choice(["high", "low", "unknown", None])) for _ in range(80)]
    out["signals"] = [(i, d, rng.random(), rng.random() < 0.3) for i, d in {(who(), near()) for _ in range(60)}]
    out["fundamentals"] = [(i, p, k, rng.random() < 0.7, rng.randint(0, 1)) for i, p, k in {(who(), near(), datetime(2020, 3, 6, rng.randint(18, 23))) for _ in range(90)}]
    out["positions"] = [(who(), rng.choice(["open", "closed", "pending_resolution"]), rng.choice([None, near()]), rng.choice([20, 60]), "x") for _ in range(80)]
    out["cancelled"] = [(who(), datetime.combine(near(), datetime.min.time()) + timedelta(hours=5)) for _ in range(30)]
    return out


def walk(src):
    """Each security from its own rows, one source after the other."""
    own = lambda name, i: [r for r in src[name] if r[0] == i]
    got = {}
    for i, symbol in src["universe"]:
        score = [r for r in own("scores", i) if r[1] == SESSION]
        score = score[0] if score else (i, None, None, None, None, False, None)
        flags = [r for r in own("flags", i) if r[1] == SESSION]
        high = {r[2] for r in flags if r[3] == "high"}
        signal = max((r for r in own("signals", i) if r[1] <= SESSION), key=lambda r: r[1], default=None)
        state = max((r for r in own("fundamentals", i) if r[2] <= CUTOFF), key=lambda r: r[1:3], default=(i, None, None, False, 0))
        exits = [r[2] for r in own("positions", i) if r[1] == "closed" and r[2] and r[2] <= SESSION]
        pauses = [r[1].date() for r in own("cancelled", i) if r[1].date() <= SESSION]
        got[i] = (
            symbol or str(i), score[6] or "SIC-UNKNOWN", score[5], state[3], score[2], score[3], score[4], state[4], signal[2] if signal else None,
            bool(signal and signal[3]), "going_concern" in high, sorted(high & set(SEL.BARRING_FLAGS)), max(exits, default=None), max(pauses, default=None),
            sorted({r[3] for r in own("positions", i) if r[1] == "open"}), [n for n, there in (("dilution_signals", signal), ("risk_flags", flags)) if not there],
        )
    return got


def screened(spark, src):
    # repeated rows and a foreign column must change nothing
    frames = {n: spark.createDataFrame(src[n] + src[n], s).withColumn("_u", F.lit("z")) for n, s in SCHEMAS.items()}
    return SEL.screened_rows(**frames, session=F.lit(SESSION), cutoff=F.lit(CUTOFF).cast("timestamp_ntz"))


def test_screened_rows_match_a_walk(spark):
    for seed in range(3):
        src = draw(seed)
        rows = screened(spark, src).collect()
        assert len(rows) == len(src["universe"])
        assert {r[0]: tuple(r)[1:-1] for r in rows} == walk(src)
        assert all(r["screened"] == (not r["missing"]) for r in rows)


def test_unscreened_rows_are_never_clean(spark):
    src = draw(7)
    judged, rest = SEL.load_rows(screened(spark, src))
    want = {i for i, row in walk(src).items() if row[-1]}
    assert {r["security_id"] for r in rest.collect()} == want and want
    assert {r["security_id"] for r in judged.collect()} == set(range(30)) - want
    picked, dropped = SEL.select(judged, {20: 5, 60: 5}, F.lit(SESSION), F.lit(SESSION), 0.0)
    assert not want & {r["security_id"] for r in picked.collect()} | want & {r["security_id"] for r in dropped.collect()}


def test_empty_sources(spark):
    none = {n: [] for n in SCHEMAS}
    assert screened(spark, none).collect() == []
    row = screened(spark, none | {"universe": [(1, "S")]}).collect()[0]
    assert row["missing"] == ["dilution_signals", "risk_flags"] and not row["screened"] and not row["rankable"] and row["open_horizons"] == []
