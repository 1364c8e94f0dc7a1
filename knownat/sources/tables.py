"""Table scans and layout. Bars are partitioned by year and clustered by security."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None, schema: str | None = None) -> DataFrame:
    """Column subset and filter both reach the parquet reader."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def write_bars(bars: DataFrame, path: str, mode: str = "append") -> None:
    """Year partitions prune by date; sorted files let min/max statistics prune by security."""
    (
        bars.withColumn("year", F.year("date"))
        .repartition("year", F.pmod(F.xxhash64("security_id"), F.lit(16)))
        .sortWithinPartitions("security_id", "date")
        .write.mode(mode)
        .partitionBy("year")
        .parquet(path)
    )


def read_bars(spark: SparkSession, path: str, start=None, end=None, columns: list[str] | None = None) -> DataFrame:
    """Bars of a date range; whole years outside it are not listed."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where((F.col("date") >= F.lit(start).cast("date")) & (F.col("year") >= F.year(F.lit(start).cast("date"))))
    if end is not None:
        df = df.where((F.col("date") <= F.lit(end).cast("date")) & (F.col("year") <= F.year(F.lit(end).cast("date"))))
    return df.select(*columns) if columns else df.drop("year")
