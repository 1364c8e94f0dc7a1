"""As-of, interval and latest-state joins, slowly changing dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the greatest by `order`; combined map-side, so hot keys are safe."""
    payload = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*keys).agg(F.max_by(payload, F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def latest_set(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Every row at the key's greatest `order` value."""
    top = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max(order).alias("_top"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col(order) == F.col("_top")]
    return df.join(top, on).select(*df.columns)


def _bucket(time: Column, days: int) -> Column:
    return F.floor(F.unix_date(time.cast("date")) / days).cast("int")


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
    payload: Sequence[str], tie_break: Sequence[Column] = (), bucket_days: int = 64, how: str = "left",
    prefix: str = "",
) -> DataFrame:
    """Newest right row at or before each left row's time, per key.

    The right side becomes validity intervals cut at time-bucket borders, so the
    join is an equi join on (keys, bucket) with a range test: each left row meets
    one bucket of its key, not the key's whole history, and a hot key on the left
    is spread over buckets and split further by adaptive skew handling. The value
    in force is carried only into buckets in which the left side has rows.
    Adds `{prefix}` + payload columns.
    """
    keys = list(keys)
    values = F.struct(*[F.col(c) for c in payload])
    unique = right.where(F.col(right_time).isNotNull()).groupBy(*keys, F.col(right_time).alias("_t")).agg(
        F.max_by(values, F.struct(*tie_break, values) if tie_break else values).alias("_p")
    )
    unique = unique.withColumn("_b", _bucket(F.col("_t"), bucket_days))
    inner = Window.partitionBy(*keys, "_b").orderBy("_t")
    inside = unique.select(*keys, "_b", F.col("_t").alias("_from"), F.lead("_t").over(inner).alias("_to"), "_p")
    ends = unique.groupBy(*keys, "_b").agg(F.min("_t").alias("_first"), F.max_by("_p", "_t").alias("_p"))
    wanted = left.where(F.col(left_time).isNotNull()).select(*keys, _bucket(F.col(left_time), bucket_days).alias("_b")).distinct()
    wanted = wanted.withColumn("_asked", F.lit(1))
    marks = ends.unionByName(wanted, allowMissingColumns=True).groupBy(*keys, "_b").agg(
        F.max("_first").alias("_first"), F.first("_p", ignorenulls=True).alias("_p"), F.max("_asked").alias("_asked")
    )
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket of the calendar
    carried = marks.withColumn("_p", F.last("_p", ignorenulls=True).over(before)).where("_asked = 1 AND _p IS NOT NULL").select(
        *keys, "_b", F.lit(None).cast(dict(unique.dtypes)["_t"]).alias("_from"), F.col("_first").alias("_to"), "_p"
    )
    spans = inside.unionByName(carried)
    spans = spans.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_b"])], "_from", "_to", "_p")
    lt = left.withColumn("_b", _bucket(F.col(left_time), bucket_days))
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate([*keys, "_b"])] + [
        F.col("_from").isNull() | (F.col(left_time) >= F.col("_from")),
        F.col("_to").isNull() | (F.col(left_time) < F.col("_to")),
    ]
    joined = lt.join(spans, on, how)
    return joined.select(*left.columns, *[F.col("_p")[c].alias(f"{prefix}{c}") for c in payload])


def symbol_at(
    queries: DataFrame, listings: DataFrame, symbol: str = "symbol", day: str = "as_of", primary_only: bool = False
) -> DataFrame:
    """Security wearing a symbol on a date: valid_from <= day < valid_to.

    Among overlapping windows the primary one wins, then the newest.
    """
    windows = listings.where(F.col("is_primary")) if primary_only else listings
    windows = windows.select(
        F.upper("symbol").alias("_sym"), "security_id", "valid_from", "valid_to", "is_primary"
    )
    q = queries.select(symbol, day).distinct()
    hit = q.join(
        windows,
        (F.upper(q[symbol]) == windows["_sym"])
        & (windows["valid_from"] <= q[day])
        & (windows["valid_to"].isNull() | (windows["valid_to"] > q[day])),
        "left",
    )
    found = hit.groupBy(symbol, day).agg(
        F.max_by("security_id", F.struct("is_primary", "valid_from", -F.col("security_id"))).alias("security_id")
    )
    return queries.join(found, [symbol, day], "left")


def current_symbol(listings: DataFrame) -> DataFrame:
    """Open listing per security, the primary one first."""
    return (
        listings.where(F.col("valid_to").isNull())
        .groupBy("security_id")
        .agg(F.max_by(F.struct("symbol", "exchange"), F.struct(F.col("is_primary").cast("int"), "symbol")).alias("_l"))
        .select("security_id", "_l.symbol", "_l.exchange")
    )


def with_current_symbol(df: DataFrame, listings: DataFrame, fallback: str | None = None) -> DataFrame:
    """Left join to the current symbol, falling back to the symbol at discovery."""
    cur = current_symbol(listings).select("security_id", F.col("symbol").alias("_cur"))
    out = df.join(cur, "security_id", "left")
    chosen = F.coalesce(F.col("_cur"), F.col(fallback)) if fallback else F.col("_cur")
    return out.withColumn("symbol", chosen).drop("_cur")


def scd2_apply(listings: DataFrame, incoming: DataFrame) -> DataFrame:
    """Apply new open listings: same symbol changes nothing, another closes the open one.

    `incoming` holds one row per security: security_id, symbol, exchange, valid_from.
    """
    new = incoming.select(
        "security_id", F.upper("symbol").alias("_symbol"), F.col("exchange").alias("_exchange"),
        F.col("valid_from").alias("_from"),
    )
    open_now = listings.where(F.col("valid_to").isNull()).select("security_id", F.col("symbol").alias("_open"))
    same = new.join(open_now, "security_id").where(F.col("_open") == F.col("_symbol")).select("security_id").distinct()
    fresh = new.join(same, "security_id", "left_anti")
    closed = listings.join(fresh.select("security_id", "_from"), "security_id", "left").withColumn(
        "valid_to",
        F.when(F.col("valid_to").isNull() & F.col("_from").isNotNull(), F.col("_from")).otherwise(F.col("valid_to")),
    )
    added = fresh.select(
        "security_id", F.col("_symbol").alias("symbol"), F.col("_exchange").alias("exchange"),
        F.col("_from").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_primary"),
    )
    return closed.drop("_from").unionByName(added)


def mark_delisted(securities: DataFrame, listings: DataFrame, delistings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Soft delete: inactive with the date, open listings closed at it."""
    feed = delistings.groupBy("security_id").agg(F.min("delisted_date").alias("_gone"))
    sec = securities.join(feed, "security_id", "left")
    gone = F.col("_gone").isNotNull()
    sec = (
        sec.withColumn("is_active", F.when(gone, F.lit(False)).otherwise(F.col("is_active")))
        .withColumn("delisted_date", F.coalesce(F.col("_gone"), F.col("delisted_date")))
        .drop("_gone")
    )
    lst = listings.join(feed, "security_id", "left")
    lst = lst.withColumn("valid_to", F.coalesce(F.col("valid_to"), F.col("_gone"))).drop("_gone")
    return sec, lst


def match_entities(entries: DataFrame, securities: DataFrame) -> DataFrame:
    """Existing security for an entry: (cik, class, type) null-safe, by name without a CIK."""
    known = securities.select(
        F.col("security_id").alias("_id"), F.col("cik").alias("_cik"), F.col("share_class").alias("_class"),
        F.col("security_type").alias("_type"), F.col("name").alias("_name"),
    )
    by_cik = known.where(F.col("_cik").isNotNull()).groupBy("_cik", "_class", "_type").agg(F.min("_id").alias("_a"))
    by_name = known.where(F.col("_cik").isNull()).groupBy("_name").agg(F.min("_id").alias("_b"))
    out = entries.join(
        by_cik,
        (entries["cik"] == by_cik["_cik"])
        & entries["share_class"].eqNullSafe(by_cik["_class"])
        & entries["security_type"].eqNullSafe(by_cik["_type"]),
        "left",
    ).drop("_cik", "_class", "_type")
    out = out.join(by_name, out["cik"].isNull() & (out["name"] == by_name["_name"]), "left").drop("_name")
    return out.withColumn("security_id", F.coalesce("_a", "_b")).drop("_a", "_b")


def attribute_issuer(filings: DataFrame, listings: DataFrame, securities: DataFrame) -> DataFrame:
    """Security of a filing: current symbol, else lowest common stock of the CIK, else NULL."""
    from ..functions.core import pad_cik

    by_symbol = listings.where(F.col("valid_to").isNull()).groupBy(F.col("symbol").alias("_sym")).agg(
        F.min("security_id").alias("_a")
    )
    by_cik = securities.where(F.col("security_type") == "common_stock").groupBy(F.col("cik").alias("_cik")).agg(
        F.min("security_id").alias("_b")
    )
    out = filings.join(by_symbol, F.upper(F.trim(filings["issuer_symbol"])) == by_symbol["_sym"], "left")
    out = out.join(by_cik, pad_cik("issuer_cik") == by_cik["_cik"], "left")
    return out.withColumn("security_id", F.coalesce("_a", "_b")).drop("_sym", "_cik", "_a", "_b")
