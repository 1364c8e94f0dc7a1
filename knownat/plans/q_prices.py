"""Queries over daily bars, calendars and percentiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import core as C
from ..operators import asof, bars as B, calendar as CAL, momentum as MOM, ranking as R, universe as U
from ..sources import sinks, tables
from . import adapters as A
from .registry import query


@query("bars_daily", "bars", "SELECT security_id, CAST(date AS VARCHAR) AS date, open, high, round(low, 6) AS low, close, volume FROM bars")
def bars_daily(t):
    return A.bars(t)


@query(
    "table_scan", "", """
    SELECT l_orderkey, l_suppkey, l_extendedprice, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'""",
)
def table_scan(t):
    span = (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    df = tables.scan(t.spark, f"{t.folder}/lineitem.parquet", ["l_orderkey", "l_suppkey", "l_extendedprice", "l_shipdate"], span)
    return df.select("l_orderkey", "l_suppkey", "l_extendedprice", F.col("l_shipdate").cast("date").alias("date"))


@query(
    "adv_trailing", "bars", """
    SELECT security_id, CAST(date AS VARCHAR) AS date,
           round(CASE WHEN count(*) OVER w = 20 THEN avg(close * volume) OVER w END, 6) AS adv
    FROM bars WINDOW w AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
def adv_trailing(t):
    return MOM.dollar_adv(A.bars(t), 20).select("security_id", "date", "adv")


@query(
    "atr14", "bars", """
    SELECT security_id, CAST(date AS VARCHAR) AS date, round(CASE WHEN count(tr) OVER w = 14 THEN avg(tr) OVER w END, 6) AS atr
    FROM (SELECT *, CASE WHEN p IS NOT NULL THEN greatest(high - low, abs(high - p), abs(low - p)) END AS tr
          FROM (SELECT *, lag(close) OVER (PARTITION BY security_id ORDER BY date) AS p FROM bars))
    WINDOW w AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""",
)
def atr14(t):
    return MOM.average_true_range(A.bars(t), 14).select("security_id", "date", "atr")


_MOM = """
    w1 AS (SELECT a.*, b.close AS bench, row_number() OVER p AS bar_count,
        lag(a.close, 21) OVER p AS c21, lag(a.close, 63) OVER p AS c63, lag(a.close, 126) OVER p AS c126, lag(a.close, 252) OVER p AS c252,
        lag(b.close, 21) OVER p AS b21, lag(b.close, 63) OVER p AS b63, lag(b.close, 126) OVER p AS b126, lag(b.close, 252) OVER p AS b252,
        CASE WHEN row_number() OVER p >= 252 THEN max(a.close) OVER w252 END AS hi, CASE WHEN row_number() OVER p >= 252 THEN min(a.close) OVER w252 END AS lo,
        CASE WHEN row_number() OVER p >= 50 THEN avg(a.close) OVER w50 END AS sma50, CASE WHEN row_number() OVER p >= 200 THEN avg(a.close) OVER w200 END AS sma200,
        CASE WHEN row_number() OVER p >= 20 THEN avg(a.volume) OVER w20 END AS v20, CASE WHEN row_number() OVER p >= 90 THEN avg(a.volume) OVER w90 END AS v90
      FROM adj a LEFT JOIN bench b ON b.date = a.date
      WINDOW p AS (PARTITION BY a.security_id ORDER BY a.date), w252 AS (PARTITION BY a.security_id ORDER BY a.date ROWS 251 PRECEDING),
        w50 AS (PARTITION BY a.security_id ORDER BY a.date ROWS 49 PRECEDING), w200 AS (PARTITION BY a.security_id ORDER BY a.date ROWS 199 PRECEDING),
        w20 AS (PARTITION BY a.security_id ORDER BY a.date ROWS 19 PRECEDING), w90 AS (PARTITION BY a.security_id ORDER BY a.date ROWS 89 PRECEDING)),
    ind AS (SELECT security_id, date, bar_count, bench, (close / c21) / (bench / b21) - 1 AS rs_21, (close / c63) / (bench / b63) - 1 AS rs_63,
        (close / c126) / (bench / b126) - 1 AS rs_126, (close / c252) / (bench / b252) - 1 AS rs_252,
        CASE WHEN hi <> lo THEN 100.0 * (close - lo) / (hi - lo) END AS range52, sma50, sma200,
        CASE WHEN close > sma50 AND sma50 > sma200 THEN 100.0 WHEN close > sma50 OR sma50 > sma200 THEN 50.0
             WHEN sma50 IS NOT NULL AND sma200 IS NOT NULL THEN 0.0 END AS trend,
        CASE WHEN v20 <> 0 AND v90 <> 0 THEN v20 / v90 END AS volratio FROM w1)"""


def _mom_sql(body: str) -> str:
    from .registry import sql_with

    return sql_with("bars bench actions splits factors adj", "") .rstrip() + ", " + _MOM.strip() + "\n" + body


def _indicators(t):
    b = A.bars(t)
    return MOM.indicators(B.adjusted_bars(b, A.actions(t)), A.benchmark(b))


@query("sma_trend", "", _mom_sql("SELECT security_id, CAST(date AS VARCHAR) AS date, round(sma50, 9) AS sma50, round(sma200, 9) AS sma200, trend FROM ind"), places=9)
def sma_trend(t):
    return _indicators(t).select("security_id", "date", "sma50", "sma200", "trend")


@query("range_position", "", _mom_sql("SELECT security_id, CAST(date AS VARCHAR) AS date, round(range52, 6) AS range52 FROM ind"))
def range_position(t):
    return _indicators(t).select("security_id", "date", "range52")


@query("relative_strength", "", _mom_sql("""
    SELECT security_id, CAST(date AS VARCHAR) AS date, round(rs_21, 6) AS rs_21, round(rs_63, 6) AS rs_63, round(rs_126, 6) AS rs_126,
           round(rs_252, 6) AS rs_252 FROM ind"""))
def relative_strength(t):
    return _indicators(t).select("security_id", "date", "rs_21", "rs_63", "rs_126", "rs_252")


@query("volume_ratio", "", _mom_sql("SELECT security_id, CAST(date AS VARCHAR) AS date, round(volratio, 6) AS volratio FROM ind"))
def volume_ratio(t):
    return _indicators(t).select("security_id", "date", "volratio")


@query("momentum_gate", "", _mom_sql("""
    , lastrow AS (SELECT * FROM ind QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY date DESC) = 1)
    SELECT security_id, CAST(date AS VARCHAR) AS as_of_bar_date, bar_count, round(rs_252, 6) AS rs_252, trend,
           bar_count >= 250 AND bench IS NOT NULL AND rs_21 IS NOT NULL AND rs_63 IS NOT NULL AND rs_126 IS NOT NULL AND rs_252 IS NOT NULL
           AND range52 IS NOT NULL AND trend IS NOT NULL AND volratio IS NOT NULL AS gate_passed FROM lastrow"""))
def momentum_gate(t):
    b = A.bars(t)
    rows = MOM.momentum_inputs(B.adjusted_bars(b, A.actions(t)), A.benchmark(b), A.day("2002-01-01"))
    return rows.select("security_id", "as_of_bar_date", "bar_count", "rs_252", "trend", F.col("gate_reason").isNull().alias("gate_passed"))


@query("split_adjusted", "bars actions splits factors adj", """
    SELECT security_id, CAST(date AS VARCHAR) AS date, open, high, low, close, volume, factor FROM adj""")
def split_adjusted(t):
    return B.adjusted_bars(A.bars(t), A.actions(t)).select("security_id", "date", "open", "high", "low", "close", "volume", "factor")


@query("dividend_adjusted", "bars actions splits factors", """
    SELECT b.security_id, CAST(b.date AS VARCHAR) AS date,
           round(b.close / f.factor * coalesce(product(CASE WHEN a.cash_amount IS NOT NULL THEN greatest(1e-9, 1 - a.cash_amount / b.close) END), 1.0), 4) AS close
    FROM bars b JOIN factors f USING (security_id, date)
    LEFT JOIN actions a ON a.security_id = b.security_id AND a.action_type = 'dividend' AND a.ex_date > b.date
    GROUP BY b.security_id, b.date, b.close, f.factor""", places=4)
def dividend_adjusted(t):
    return B.adjusted_bars(A.bars(t), A.actions(t), include_dividends=True).select("security_id", "date", "close")


@query("vendor_unadjusted", "bars actions splits factors adj", """
    SELECT security_id, CAST(date AS VARCHAR) AS date, round(close * factor, 3) AS close,
           CAST(round_even(volume / factor, 0) AS BIGINT) AS volume FROM adj""", places=3)
def vendor_unadjusted(t):
    a = A.actions(t)
    vendor = B.adjusted_bars(A.bars(t), a).drop("factor")
    return B.unadjusted_bars(vendor, B.split_events(a)).select("security_id", "date", "close", "volume")


_REV = """
    inc AS (SELECT security_id, date, open, high, low, CASE WHEN (security_id + day(date)) % 7 = 0 THEN close * 1.01 WHEN (security_id + day(date)) % 7 = 1 THEN close + 0.001 ELSE close END AS close,
                   CASE WHEN (security_id + day(date)) % 11 = 0 THEN NULL WHEN (security_id + day(date)) % 13 = 0 THEN volume + 1 ELSE volume END AS volume FROM bars),
    sto AS (SELECT * FROM bars WHERE (security_id + month(date)) % 12 <> 0),
    chg AS (SELECT i.security_id, i.date, s.close AS old_close, i.close AS new_close, s.volume AS old_volume, i.volume AS new_volume,
                   CASE WHEN s.security_id IS NULL THEN 'new' WHEN abs(s.close - i.close) > 0.005 OR s.volume IS DISTINCT FROM i.volume THEN 'revised' ELSE 'unchanged' END AS change
            FROM inc i LEFT JOIN sto s USING (security_id, date))"""


def _revisions(t):
    b = A.bars(t)
    k = F.col("security_id") + F.dayofmonth("date")
    inc = b.withColumns(
        {
            "close": F.when(k % 7 == 0, F.col("close") * 1.01).when(k % 7 == 1, F.col("close") + 0.001).otherwise(F.col("close")),
            "volume": F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.col("volume") + 1).otherwise(F.col("volume")),
        }
    )
    stored = b.where((F.col("security_id") + F.month("date")) % 12 != 0).withColumns({"revision": F.lit(0), "price_data_version": F.lit(1)})
    return stored, B.detect_revisions(stored, inc)


@query("revision_detect", "", "WITH bars AS (" + __import__("knownat.plans.tables_sql", fromlist=["CTES"]).CTES["bars"] + "), " + _REV + """
    SELECT security_id, CAST(date AS VARCHAR) AS date, change, round(old_close, 4) AS old_close, round(new_close, 4) AS new_close, old_volume, new_volume FROM chg""", places=4)
def revision_detect(t):
    _, changes = _revisions(t)
    return changes.select("security_id", "date", "change", "old_close", "new_close", "old_volume", "new_volume")


_BARS_CTE = __import__("knownat.plans.tables_sql", fromlist=["CTES"]).CTES["bars"]


@query("series_as_of_version", "", "WITH bars AS (" + _BARS_CTE + "), " + _REV + """
    SELECT security_id, CAST(date AS VARCHAR) AS date, round(close, 4) AS close, volume FROM sto""", places=4)
def series_as_of_version(t):
    stored, changes = _revisions(t)
    after, log = B.apply_revisions(stored, changes, 2)
    return B.bars_at_version(after, log, 1).select("security_id", "date", "close", "volume")


@query("dataset_version", "", "WITH bars AS (" + _BARS_CTE + "), " + _REV + """
    SELECT 2 AS dataset_version, 'vendor' AS provider, count(*) FILTER (change = 'new') || ' new rows; ' || count(*) FILTER (change = 'revised') || ' vendor corrections' AS reason,
           count(*) FILTER (change <> 'unchanged') AS changed_row_count FROM chg""")
def dataset_version(t):
    _, changes = _revisions(t)
    versions = t.region.agg(F.min(F.col("r_regionkey") * 0 + 1).alias("dataset_version"))
    return B.next_dataset_version(versions, changes, "vendor")


@query("bars_after_load", "", "WITH bars AS (" + _BARS_CTE + "), " + _REV + """
    SELECT change AS change, count(*) AS bars, CAST(sum(new_volume) AS BIGINT) AS volume FROM chg GROUP BY change""")
def bars_after_load(t):
    _, changes = _revisions(t)
    return changes.groupBy("change").agg(F.count("*").alias("bars"), F.sum("new_volume").alias("volume"))


@query("daily_return", "bars", """
    SELECT security_id, CAST(date AS VARCHAR) AS date, round(close / lag(close) OVER (PARTITION BY security_id ORDER BY date) - 1, 6) AS daily_return FROM bars""")
def daily_return(t):
    return B.daily_returns(A.bars(t)).select("security_id", "date", "daily_return")


@query("largest_move", "bars", """
    SELECT security_id, round(largest_move, 6) AS largest_move, CAST(move_date AS VARCHAR) AS move_date FROM (
      SELECT security_id, r AS largest_move, date AS move_date, row_number() OVER (PARTITION BY security_id ORDER BY r DESC NULLS LAST, date) AS n
      FROM (SELECT security_id, date, abs(close / lag(close) OVER (PARTITION BY security_id ORDER BY date) - 1) AS r FROM bars)) WHERE n = 1""")
def largest_move(t):
    return B.largest_move(A.bars(t))


@query("chart_timeframe", "bars", """
    SELECT security_id, count(*) AS points, CAST(min(date) AS VARCHAR) AS first_date FROM bars b JOIN (SELECT security_id, max(date) AS m FROM bars GROUP BY 1) USING (security_id)
    WHERE date >= m - 366 GROUP BY security_id""")
def chart_timeframe(t):
    return B.timeframe(A.bars(t), 366).groupBy("security_id").agg(F.count("*").alias("points"), F.min("date").alias("first_date"))


@query("asof_price", "bars", """
    SELECT o_orderkey, o_custkey % 10 AS security_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, close, CAST(b.date AS VARCHAR) AS price_date
    FROM orders o ASOF LEFT JOIN bars b ON b.security_id = o.o_custkey % 10 AND b.date <= CAST(o.o_orderdate AS DATE)""")
def asof_price(t):
    left = t.orders.select("o_orderkey", (F.col("o_custkey") % 10).alias("security_id"), F.col("o_orderdate").cast("date").alias("day"))
    right = A.bars(t).withColumn("price_date", F.col("date"))
    return asof.asof_join(left, right, ["security_id"], "day", "date", ["close", "price_date"])


@query("latest_close", "bars", """
    SELECT security_id, CAST(max(date) AS VARCHAR) AS price_date, arg_max(close, date) AS price FROM bars WHERE date <= DATE '2000-06-30' GROUP BY security_id""")
def latest_close(t):
    return B.latest_close(A.bars(t), A.day("2000-06-30"))


@query("session_calendar", "bars cal", "SELECT CAST(date AS VARCHAR) AS date, session_no FROM cal")
def session_calendar(t):
    return CAL.sessions(A.bars(t)).withColumn("session_no", F.col("session_no").cast("bigint"))


@query("trading_weeks", "bars", """
    SELECT iso_year, iso_week, CAST(first_session AS VARCHAR) AS first_session, CAST(final_session AS VARCHAR) AS final_session, session_count,
           lead(iso_week) OVER (ORDER BY iso_year, iso_week) IS NOT NULL OR (DATE '2001-11-10' >= date_trunc('week', final_session)::DATE + 5 AND isodow(final_session) = 5) AS complete
    FROM (SELECT CAST(isoyear(date) AS INTEGER) AS iso_year, CAST(weekofyear(date) AS INTEGER) AS iso_week, min(date) AS first_session, max(date) AS final_session, count(DISTINCT date) AS session_count
          FROM bars GROUP BY 1, 2)""")
def trading_weeks(t):
    return CAL.trading_weeks(A.bars(t), A.day("2001-11-10"))


@query("latest_week", "bars", """
    WITH w AS (SELECT isoyear(date) AS y, weekofyear(date) AS k, min(date) AS a, max(date) AS z FROM bars WHERE date IS NOT NULL GROUP BY 1, 2)
    SELECT CAST(a AS VARCHAR) AS first_session, CAST(z AS VARCHAR) AS final_session FROM w WHERE z <= DATE '2000-07-05' ORDER BY z DESC LIMIT 1""".replace("WITH w AS", ", w AS", 1))
def latest_week(t):
    return CAL.latest_complete_week(A.bars(t), A.day("2000-07-05")).select("first_session", "final_session")


@query("sessions_back", "bars cal", """
    SELECT CAST(e.day AS VARCHAR) AS end, CAST(b.date AS VARCHAR) AS back_session
    FROM (SELECT x.day, max(c.session_no) AS n FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) x LEFT JOIN cal c ON c.date <= x.day GROUP BY 1) e
    LEFT JOIN cal b ON b.session_no = e.n - 10""".replace("AS end,", 'AS "end",'))
def sessions_back(t):
    ends = t.orders.select(F.col("o_orderdate").cast("date").alias("end"))
    return CAL.sessions_back(A.bars(t), ends, 10)


@query("sessions_between", "bars cal", """
    SELECT o_orderkey, count(c.date) AS sessions FROM orders o LEFT JOIN cal c ON c.date > CAST(o_orderdate AS DATE) AND c.date <= CAST(o_orderdate AS DATE) + CAST(o_custkey % 90 AS INTEGER)
    GROUP BY o_orderkey""")
def sessions_between(t):
    spans = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("start"))
    spans = spans.join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey").select(
        "o_orderkey", "start", F.date_add("start", (F.col("o_custkey") % 90).cast("int")).alias("end")
    )
    return CAL.sessions_between(A.bars(t), spans).select("o_orderkey", F.col("sessions").cast("bigint").alias("sessions"))


@query("sessions_missed", "bars", """
    SELECT s_suppkey AS security_id, CAST(last_bar AS VARCHAR) AS last_bar, (SELECT count(*) FROM (SELECT DISTINCT date FROM bars WHERE date <= DATE '2001-06-30' ORDER BY date DESC LIMIT 10) r WHERE r.date > last_bar) AS missed
    FROM supplier LEFT JOIN (SELECT security_id, max(date) AS last_bar FROM bars WHERE date <= DATE '2001-06-30' GROUP BY 1) ON security_id = s_suppkey""")
def sessions_missed(t):
    s = t.supplier.select(F.col("s_suppkey").alias("security_id"))
    return CAL.sessions_missed(A.bars(t), s, A.day("2001-06-30")).select("security_id", "last_bar", F.col("missed").cast("bigint").alias("missed"))


@query("session_close", "bars cal", """
    SELECT CAST(date AS VARCHAR) AS date, strftime(timezone('UTC', timezone('America/New_York', date::TIMESTAMP + INTERVAL 16 HOURS)), '%Y-%m-%d %H:%M:%S') AS close_utc FROM cal""")
def session_close(t):
    return CAL.sessions(A.bars(t)).select("date", C.session_close_utc("date").alias("close_utc"))


@query("missed_runs", "", """
    WITH last AS (SELECT event_type AS job, max(CAST(ts AS DATE)) AS last_run FROM events GROUP BY 1)
    SELECT job, CAST(last_run AS VARCHAR) AS last_run, CAST(CAST(d AS DATE) AS VARCHAR) AS missed_date
    FROM last, unnest(generate_series(last_run::TIMESTAMP + INTERVAL 7 DAY, TIMESTAMP '2024-03-31', INTERVAL 7 DAY)) AS g(d)
    WHERE date_diff('day', last_run, DATE '2024-04-01') > 7""")
def missed_runs(t):
    runs = t.events.select(F.col("event_type").alias("job"), F.col("ts").cast("date").alias("run_date"))
    return CAL.missed_runs(runs, A.day("2024-04-01"), 7)


@query("abandoned_runs", "runs", """
    SELECT run_id, stage, 'failed' AS status, round(date_sub('second', started_at, TIMESTAMP '2024-01-20 00:00:00') / 3600.0, 3) AS age_hours FROM runs
    WHERE status = 'running' AND epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(started_at) >= 8 * 3600""", places=3)
def abandoned_runs(t):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return CAL.abandoned_runs(A.runs(t), now).select("run_id", "stage", "status", "age_hours")


_MID = "CASE WHEN count(*) OVER ({p}) > 1 THEN 100.0 * ((rank() OVER ({p} ORDER BY {v}) - 1) + (count(*) OVER ({p2}, {v}) - 1) / 2.0) / (count(*) OVER ({p}) - 1) END"


@query("pct_midrank", "", f"""
    SELECT p_partkey, p_type, round({_MID.format(p='PARTITION BY p_type', p2='PARTITION BY p_type', v='p_retailprice')}, 6) AS type_pct,
           round(CASE WHEN count(*) OVER () > 1 THEN 100.0 * ((rank() OVER (ORDER BY p_size) - 1) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0) / (count(*) OVER () - 1) END, 6) AS size_pct FROM part""")
def pct_midrank(t):
    p = t.part.select("p_partkey", "p_type", "p_retailprice", "p_size")
    out = R.midrank(p, "p_retailprice", ["p_type"], "type_")
    return R.midrank(out, "p_size", [], "size_").select("p_partkey", "p_type", "type_pct", "size_pct")


_LONG = """
    m AS (SELECT p_partkey AS security_id, p_brand AS cohort_id, 'pe' AS metric, p_retailprice AS value FROM part
          UNION ALL SELECT p_partkey, p_brand, 'roic', p_size / 10.0 FROM part WHERE p_size > 3
          UNION ALL SELECT p_partkey, p_brand, 'pb', CAST(p_partkey * 31 % 97 AS DOUBLE) FROM part WHERE p_partkey % 9 <> 0
          UNION ALL SELECT p_partkey, p_brand, 'fcf_yield', CAST(p_partkey * 17 % 89 AS DOUBLE) FROM part
          UNION ALL SELECT p_partkey, p_brand, 'ev_ebitda', CAST(p_partkey * 13 % 83 AS DOUBLE) FROM part WHERE p_partkey % 7 <> 0),
    r AS (SELECT *, count(*) OVER (PARTITION BY metric) AS mn, count(*) OVER (PARTITION BY metric, cohort_id) AS cn,
             100.0 * ((rank() OVER (PARTITION BY metric ORDER BY value) - 1) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0) / (count(*) OVER (PARTITION BY metric) - 1) AS mp,
             100.0 * ((rank() OVER (PARTITION BY metric, cohort_id ORDER BY value) - 1) + (count(*) OVER (PARTITION BY metric, cohort_id, value) - 1) / 2.0)
                 / nullif(count(*) OVER (PARTITION BY metric, cohort_id) - 1, 0) AS cp FROM m),
    o AS (SELECT *, CASE WHEN metric IN ('pe', 'pb', 'ev_ebitda') THEN 100 - mp ELSE mp END AS market_pct, CASE WHEN metric IN ('pe', 'pb', 'ev_ebitda') THEN 100 - cp ELSE cp END AS cohort_pct,
             CASE WHEN cn < 10 THEN 0.0 ELSE least(1.0, cn / 50.0) END AS w FROM r),
    b AS (SELECT security_id, cohort_id, metric, market_pct, cohort_pct, w AS blend_w, CASE WHEN w > 0 AND cohort_pct IS NOT NULL THEN w * cohort_pct + (1 - w) * market_pct ELSE market_pct END AS percentile FROM o)"""


def _long_metrics(t):
    p = t.part
    k = F.col("p_partkey")
    pick = lambda cond, name, value: p.where(cond).select(k.alias("security_id"), F.col("p_brand").alias("cohort_id"), F.lit(name).alias("metric"), value.cast("double").alias("value"))
    yes = F.lit(True)
    rows = pick(yes, "pe", F.col("p_retailprice")).unionByName(pick(F.col("p_size") > 3, "roic", F.col("p_size") / 10.0))
    rows = rows.unionByName(pick(k % 9 != 0, "pb", k * 31 % 97)).unionByName(pick(yes, "fcf_yield", k * 17 % 89))
    return rows.unionByName(pick(k % 7 != 0, "ev_ebitda", k * 13 % 83))


@query("pct_blended", "", "WITH " + _LONG.strip() + """
    SELECT security_id, metric, round(market_pct, 6) AS market_pct, round(cohort_pct, 6) AS cohort_pct, round(blend_w, 6) AS blend_w, round(percentile, 6) AS percentile FROM b""")
def pct_blended(t):
    return R.blended_percentiles(_long_metrics(t)).select("security_id", "metric", "market_pct", "cohort_pct", "blend_w", "percentile")


_COMP = "c AS (SELECT security_id, count(percentile) AS value_valid, CASE WHEN count(percentile) >= 3 THEN sum(0.25 * percentile) / sum(0.25) END AS value_score FROM b WHERE metric IN ('pe', 'pb', 'ev_ebitda', 'fcf_yield') GROUP BY 1)"


@query("component_score", "", "WITH " + _LONG.strip() + ", " + _COMP + " SELECT security_id, value_valid, round(value_score, 6) AS value_score FROM c")
def component_score(t):
    ranked = R.blended_percentiles(_long_metrics(t))
    w = {"pe": 0.25, "pb": 0.25, "ev_ebitda": 0.25, "fcf_yield": 0.25}
    return R.weighted_component(ranked, ["security_id"], w, "value", 3).select("security_id", "value_valid", "value_score")


@query("composite_rank", "scores", """
    SELECT security_id, composite, CASE WHEN rankable THEN rank() OVER (PARTITION BY rankable ORDER BY composite DESC) END AS rank FROM scores""")
def composite_rank(t):
    s = A.scores(t).select("security_id", F.col("composite"), F.when(F.col("rankable"), F.col("composite")).alias("_c"))
    return R.competition_rank(s, "_c").select("security_id", "composite", "rank")


@query("positive_percentile", "", f"""
    WITH s AS (SELECT c_custkey, c_acctbal FROM customer), p AS (SELECT c_custkey, {_MID.format(p='PARTITION BY 1', p2='PARTITION BY 1', v='c_acctbal')} AS pct FROM s WHERE c_acctbal > 0)
    SELECT c_custkey, round(coalesce(pct, 0), 6) AS pct FROM s LEFT JOIN p USING (c_custkey)""")
def positive_percentile(t):
    out = R.positive_midrank(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal")
    return out.select("c_custkey", F.coalesce("pct", F.lit(0.0)).alias("pct"))


@query("stride_sample", "", """
    WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS k, count(*) OVER () AS n FROM part),
    i AS (SELECT DISTINCT CAST(floor(i * ((SELECT max(n) FROM n) / 150.0)) AS BIGINT) AS k FROM range(150) r(i))
    SELECT p_partkey FROM n JOIN i USING (k)""")
def stride_sample(t):
    return U.stride_sample(t.part.select("p_partkey", "p_name"), F.struct("p_name", "p_partkey"), 150).select("p_partkey")


@query("top_ranked", "scores", "SELECT security_id, composite FROM scores WHERE rankable ORDER BY composite DESC, security_id LIMIT 50")
def top_ranked(t):
    return R.top_n(A.scores(t).where("rankable").select("security_id", "composite"), [F.desc("composite"), F.col("security_id")], 50)


@query("action_upsert", "actions", """
    SELECT security_id, CAST(ex_date AS VARCHAR) AS ex_date, action_type, CASE WHEN action_type = 'split' AND security_id % 3 = 0 THEN ratio + 1 ELSE ratio END AS ratio FROM actions""")
def action_upsert(t):
    old = A.actions(t)
    new = old.where((F.col("action_type") == "split") & (F.col("security_id") % 3 == 0)).withColumn("ratio", F.col("ratio") + 1)
    return sinks.upsert(old, new, ["security_id", "ex_date", "action_type"]).select("security_id", "ex_date", "action_type", "ratio")


@query("corporate_action_typing", "", """
    WITH v AS (SELECT p_partkey, p_size / CAST(1 + p_partkey % 24 AS DOUBLE) AS x FROM part)
    SELECT p_partkey, round(x, 6) AS ratio, CASE WHEN (list_bool_or([abs(x - round(x * q) / q) <= 1e-6 for q in range(1, 21)]) OR (x < 1 AND list_bool_or([abs(1 / x - round(1 / x * q) / q) <= 1e-6 for q in range(1, 21)])))
        AND x BETWEEN 0.001 AND 1000 THEN 'split' ELSE 'other' END AS action_type FROM v""")
def corporate_action_typing(t):
    v = t.part.select(
        F.col("p_partkey").alias("security_id"), A.day("2024-01-02").alias("date"), (F.col("p_size") / (1 + F.col("p_partkey") % 24)).alias("split_ratio"),
        F.lit(None).cast("double").alias("dividend"),
    )
    return B.typed_actions(v).select(F.col("security_id").alias("p_partkey"), F.round("ratio", 6).alias("ratio"), "action_type")
