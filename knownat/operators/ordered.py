"""Total orders, prefix sums and ranks over unbounded groups.

A plain window over one group sorts that group in one task. Here a group is cut
into ordered buckets first: bucket bounds are the keys with the smallest hash of
each class of hashes (a sample that is the same on every evaluation), each bucket is windowed on its
own, and per-bucket totals - at most BUCKETS rows per group - carry the prefix.
Input keys and values must be reproducible (stored columns, integers, decimals
or rounded doubles), because the input is read once for totals and once for rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 512
SALTS = 32
_STEPS = [512, 256, 128, 64, 32, 16, 8, 4, 2, 1]


def _class(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _salt(of_class: Column, buckets: int) -> Column:
    return F.floor(of_class * SALTS / buckets).cast("int")


def _bounds(df: DataFrame, group: Sequence[str], key: Column, buckets: int) -> DataFrame:
    """Sorted bucket bounds per group: of each class of key hashes the key with the least hash, combined map-side.

    A group's bounds stand once for each salt that its keys have.
    """
    hashed = F.xxhash64(key)
    names = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    classes = df.groupBy(*names, _class(key, buckets).alias("_class")).agg(F.min_by(key, F.struct(hashed, key)).alias("_key"))
    bounds = F.sort_array(F.collect_set("_key")).alias("_bounds")
    if not group:
        return classes.agg(bounds)
    salts = F.collect_set(_salt(F.col("_class"), buckets)).alias("_salts")
    per = classes.groupBy(*[f"_g{i}" for i in range(len(names))]).agg(bounds, salts)
    return per.withColumn("_gsalt", F.explode("_salts")).drop("_salts")


def bucketed(df: DataFrame, key: Column, group: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """Add `_bucket`, the number of bounds at or below the row's key.

    Rows meet their bounds on (group, salt): a handful of large groups is spread over
    SALTS tasks each, and as the result is not partitioned by the group alone, a window over
    (group, bucket) shuffles by both instead of sorting a whole group in one task.
    """
    bounds = _bounds(df, group, key, buckets)
    keyed = df.withColumn("_key", key)
    if group:
        on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_salt") == F.col("_gsalt")]
        salted = keyed.withColumn("_salt", _salt(_class(F.col("_key"), buckets), buckets))
        joined = salted.join(bounds, on, "left").select(*keyed.columns, "_bounds")
    else:
        joined = keyed.join(F.broadcast(bounds))  # one row of at most `buckets` keys
    steps = F.array(*[F.lit(s) for s in _STEPS])
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: at
        + F.when(F.coalesce(F.get(F.col("_bounds"), at + step - 1) <= F.col("_key"), F.lit(False)), step).otherwise(0),
    )
    return joined.withColumn("_bucket", found).drop("_bounds", "_key")


def _carry_back(rows: DataFrame, carry: DataFrame, group: Sequence[str]) -> DataFrame:
    keys = [*group, "_bucket"]
    extra = [c for c in carry.columns if c not in keys]
    named = carry.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], *extra)
    on = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
    return rows.join(named, on).select(*rows.columns, *extra)


def _windows(group: Sequence[str], order: Sequence[Column]):
    inner = Window.partitionBy(*group, "_bucket").orderBy(*order)
    outer = Window.partitionBy(*group).orderBy("_bucket")
    return inner, outer.rowsBetween(Window.unboundedPreceding, -1)


def numbered(
    df: DataFrame, key: Column, group: Sequence[str] = (), name: str = "row_no", total: str | None = None
) -> DataFrame:
    """1-based position of each row in the order of `key` (must be unique per group)."""
    rows = bucketed(df.withColumn("_order", key), F.col("_order"), group)
    inner, before = _windows(group, [F.col("_order")])
    carry = rows.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    carry = carry.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        carry = carry.withColumn(total, F.sum("_n").over(Window.partitionBy(*group)))
    rows = rows.withColumn("_local", F.row_number().over(inner))
    out = _carry_back(rows, carry.drop("_n"), group)
    return out.withColumn(name, F.col("_before") + F.col("_local")).drop("_before", "_local", "_bucket", "_order")


def running_sum(
    df: DataFrame, key: Column, value: str, group: Sequence[str] = (), name: str = "running",
    total: str | None = None,
) -> DataFrame:
    """Inclusive prefix sum of `value` in the order of `key`."""
    rows = bucketed(df.withColumn("_order", key), F.col("_order"), group)
    inner, before = _windows(group, [F.col("_order")])
    carry = rows.groupBy(*group, "_bucket").agg(F.sum(value).alias("_sum"))
    carry = carry.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    if total:
        carry = carry.withColumn(total, F.sum("_sum").over(Window.partitionBy(*group)))
    rows = rows.withColumn("_local", F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    out = _carry_back(rows, carry.drop("_sum"), group)
    return out.withColumn(name, F.col("_before") + F.col("_local")).drop("_before", "_local", "_bucket", "_order")


def running_peak(
    df: DataFrame, key: Column, value: str, group: Sequence[str] = (), sum_name: str = "running",
    peak_name: str = "peak", start: int = 0,
) -> DataFrame:
    """Prefix sum and the highest prefix sum so far, never below `start`."""
    rows = bucketed(df.withColumn("_order", key), F.col("_order"), group)
    inner, before = _windows(group, [F.col("_order")])
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_local", F.sum(value).over(upto))
    rows = rows.withColumn("_local_peak", F.max("_local").over(upto))
    carry = rows.groupBy(*group, "_bucket").agg(F.sum(value).alias("_sum"), F.max("_local").alias("_high"))
    carry = carry.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    carry = carry.withColumn("_peak_before", F.max(F.col("_before") + F.col("_high")).over(before))
    out = _carry_back(rows, carry.drop("_sum", "_high"), group)
    out = out.withColumn(sum_name, F.col("_before") + F.col("_local"))
    return out.withColumn(
        peak_name, F.greatest(F.lit(start), F.col("_peak_before"), F.col("_before") + F.col("_local_peak"))
    ).drop("_before", "_local", "_local_peak", "_peak_before", "_bucket", "_order")
