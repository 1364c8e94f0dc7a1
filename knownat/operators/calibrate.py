"""Score distributions and candidate frequency; outcomes are never read here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import latest_set

# Scored columns.
COMPONENT_FIELDS = ("value_score", "quality_score", "momentum_score", "insider_bonus", "dilution_penalty", "composite_score")


def bucket_of(value: Column, size: float, low: float = 0.0, high: float = 100.0) -> Column:
    """Bucket index clamped to the range, truncating like an integer cast."""
    n = int((high - low) / size)
    return F.when(value.isNotNull(), F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((value - low) / size).cast("int"))))


def histogram(df: DataFrame, value: str, size: float, low: float = 0.0, high: float = 100.0, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per fixed-width bucket, empty buckets included (per key seen)."""
    n = int((high - low) / size)
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(*keys, bucket_of(F.col(value), size, low, high).alias("bucket")).agg(F.count("*").alias("_n"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket")
    every = known.select(*keys).distinct().select(*keys, grid) if keys else df.sparkSession.range(1).select(grid)
    out = every.join(counts, [*keys, "bucket"], "left")
    return out.select(
        *keys, "bucket", (F.lit(low) + F.col("bucket") * size).alias("bucket_start"),
        (F.lit(low) + (F.col("bucket") + 1) * size).alias("bucket_end"), F.coalesce("_n", F.lit(0)).alias("count"),
    )


def component_distributions(scores: DataFrame) -> DataFrame:
    """Histogram of every score column of the ranked rows; the bonus runs 0 to 10."""
    long = scores.where("rankable").unpivot(
        ["security_id"], [F.col(c).cast("double").alias(c) for c in COMPONENT_FIELDS], "component", "value"
    )
    narrow = F.col("component") == "insider_bonus"
    wide_scale = long.withColumn("value", F.when(narrow, F.col("value") * 10).otherwise(F.col("value")))
    out = histogram(wide_scale, "value", 10, keys=["component"])
    scale = F.when(narrow, 10.0).otherwise(1.0)
    return out.withColumns({"bucket_start": F.col("bucket_start") / scale, "bucket_end": F.col("bucket_end") / scale})


def submetric_distributions(scores: DataFrame, parts: Sequence[str] = ("value", "quality", "momentum")) -> DataFrame:
    """Valid count, total and percentile histogram per stored submetric; one without a valid row has empty buckets."""

    def named(part: str):
        return lambda s: F.struct(F.concat(F.lit(f"{part}."), s["metric"]).alias("metric"), s["value_used"].alias("percentile"), s["valid"].alias("valid"))

    every = F.concat(*[F.transform(F.col(f"{p}_submetrics"), named(p)) for p in parts])
    rows = scores.where("rankable").select(F.explode(every).alias("_s")).select("_s.*")
    counts = rows.groupBy("metric").agg(F.count("*").alias("total"), F.count_if("valid").alias("valid_count"))
    filled = histogram(rows.where("valid"), "percentile", 10, keys=["metric"])
    empty = counts.where("valid_count = 0").select("metric", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bucket"))
    empty = empty.select("metric", "bucket", (F.col("bucket") * 10.0).alias("bucket_start"), ((F.col("bucket") + 1) * 10.0).alias("bucket_end"), F.lit(0).cast("bigint").alias("count"))
    return filled.unionByName(empty).join(counts, "metric")


def rankable_vs_withheld(scores: DataFrame, top: int | None = None) -> DataFrame:
    """Ranked count and the reasons for withholding; with top, only the most frequent."""
    per = scores.groupBy("rankable", F.when(~F.col("rankable"), F.coalesce("withhold_reason", F.lit("(none recorded)"))).alias("reason")).agg(F.count("*").alias("count"))
    if top is None:
        return per
    withheld = per.where(~F.col("rankable")).orderBy(F.desc("count"), "reason").limit(top)
    return per.where("rankable").unionByName(withheld)


def cohort_sizes(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("cohort_id").isNotNull()).groupBy("cohort_id").agg(F.count("*").alias("count"))


def metric_coverage(scored_ids: DataFrame, fundamentals: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Non-null count of each metric in the newest knowledge state of scored securities."""
    newest = latest_set(fundamentals, ["security_id"], "knowledge_date").join(
        scored_ids.select("security_id").distinct(), "security_id", "left_semi"
    )
    wide = newest.agg(*[F.count(m).alias(m) for m in metrics])
    return wide.unpivot([], [F.col(m) for m in metrics], "metric", "valid_count")
