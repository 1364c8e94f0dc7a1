"""Trailing-window indicators on daily bars.

Every window is partitioned by security, where a partition holds at most one row
per session. Benchmark values are attached per session before the windows, so
the value at an earlier bar is a lag, not a second join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FROZEN, Params
from ..functions.core import ratio

# Gate, lookbacks and component weights.
MIN_TRADING_DAYS = 250
LOOKBACKS = (21, 63, 126, 252)
RANGE_WINDOW = 252
WEIGHTS = {
    "rs_21": 0.15, "rs_63": 0.25, "rs_126": 0.25, "rs_252": 0.15,
    "range52": 0.10, "trend": 0.05, "volratio": 0.05,
}
RANKED = ("rs_21", "rs_63", "rs_126", "rs_252", "volratio")


def _bars() -> Window:
    return Window.partitionBy("security_id").orderBy("date")


def _last(n: int) -> Window:
    return _bars().rowsBetween(-(n - 1), 0)


def full_window_avg(value: Column, n: int) -> Column:
    """Mean of the last n non-null values; NULL until there are n rows of them."""
    w = _last(n)
    return F.when(F.count(value).over(w) == n, F.avg(value).over(w))


def dollar_adv(bars: DataFrame, window: int = 20) -> DataFrame:
    """Trailing mean of raw close x volume over the last `window` usable sessions."""
    usable = bars.where(F.col("close").isNotNull() & F.col("volume").isNotNull())
    return usable.withColumn("adv", full_window_avg(F.col("close") * F.col("volume"), window))


def average_true_range(bars: DataFrame, window: int = FROZEN.atr_window) -> DataFrame:
    """Mean true range of the last `window` bars; needs one bar more for the first close."""
    usable = bars.where(F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull())
    prev = F.lag("close").over(_bars())
    spread = F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
    )
    out = usable.withColumn("true_range", F.when(prev.isNotNull(), spread))
    return out.withColumn("atr", full_window_avg(F.col("true_range"), window))


def trend_state(close: Column, sma50: Column, sma200: Column) -> Column:
    above, stacked = close > sma50, sma50 > sma200
    return F.when(above & stacked, 100.0).when(above | stacked, 50.0).when(sma50.isNotNull() & sma200.isNotNull(), 0.0)


def benchmark_by_session(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark close in force on every session (newest at or before it)."""
    days = bars.select("date").distinct().join(
        benchmark.where(F.col("close").isNotNull()).select("date", F.col("close").alias("_b")), "date", "full_outer"
    )
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # calendar-sized
    return days.select("date", F.last("_b", ignorenulls=True).over(upto).alias("bench"))


def indicators(bars: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """All momentum inputs at every bar of (adjusted) series; NULL where undefined."""
    out = bars.where(F.col("close").isNotNull())
    if benchmark is not None:
        # one row per session of the calendar
        out = out.join(F.broadcast(benchmark_by_session(bars, benchmark)), "date", "left")
    else:
        out = out.withColumn("bench", F.lit(None).cast("double"))
    w = _bars()
    close, vol = F.col("close"), F.coalesce(F.col("volume"), F.lit(0)).cast("double")
    cols = {"bar_count": F.row_number().over(w).cast("long")}
    for n in LOOKBACKS:
        then, bench_then = F.lag("close", n).over(w), F.lag("bench", n).over(w)
        cols[f"rs_{n}"] = ratio(ratio(close, then), ratio("bench", bench_then)) - 1.0
    high, low = F.max("close").over(_last(RANGE_WINDOW)), F.min("close").over(_last(RANGE_WINDOW))
    enough = F.count("close").over(_last(RANGE_WINDOW)) == RANGE_WINDOW
    cols["range52"] = F.when(enough & (high != low), F.lit(100.0) * (close - low) / (high - low))
    cols["sma50"], cols["sma200"] = full_window_avg(close, 50), full_window_avg(close, 200)
    cols["_v20"], cols["_v90"] = full_window_avg(vol, 20), full_window_avg(vol, 90)
    out = out.withColumns(cols)
    out = out.withColumn("trend", trend_state(close, F.col("sma50"), F.col("sma200")))
    positive = (F.col("_v20") != 0) & (F.col("_v90") != 0)
    return out.withColumn("volratio", F.when(positive, F.col("_v20") / F.col("_v90"))).drop("_v20", "_v90")


def momentum_inputs(bars: DataFrame, benchmark: DataFrame, as_of: Column) -> DataFrame:
    """One row per security: inputs at its last bar up to `as_of`, and the gate."""
    upto = bars.where(F.col("date") <= as_of)
    rows = indicators(upto, benchmark.where(F.col("date") <= as_of))
    names = ["bar_count", *WEIGHTS]
    last = rows.groupBy("security_id").agg(F.max_by(F.struct("date", "bench", *names), "date").alias("_r"))
    out = last.select("security_id", "_r.*")
    missing = F.array_sort(F.filter(
        F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in WEIGHTS]), lambda m: m.isNotNull()
    ))
    gate = (
        F.when(F.col("bar_count") < MIN_TRADING_DAYS, F.concat(F.lit("bars below the gate: "), F.col("bar_count").cast("string")))
        .when(F.col("bench").isNull(), F.lit("no benchmark bars"))
        .when(F.size(missing) > 0, F.concat(F.lit("inputs unavailable: "), F.array_join(missing, ", ")))
    )
    return out.withColumn("gate_reason", gate).withColumnRenamed("date", "as_of_bar_date")


def liquidity_band(adv: Column, params: Params = FROZEN) -> Column:
    """Slippage in basis points by dollar volume; NULL where no band applies."""
    return F.when(adv > params.adv_high_liquidity, params.slippage_bps_high_liquidity).when(
        adv >= params.adv_mid_liquidity, params.slippage_bps_mid_liquidity
    )
