"""Write semantics as frames: what to append, what the merged table is.

Merged tables are written to a new location and swapped in by the caller, so a
lost executor or job never leaves a half-overwritten table behind. Appended tables
(`append_run`) are folders of runs, each of which counts from its commit marker on.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import shuffles_dropped


def append_new(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not stored, one per key: append-only and repeatable.

    The stored keys grow with the table, and their size can't be told from a plan (exploded rows count as one), so they
    are never sent to the driver.
    """
    held = existing.select(*keys).hint("merge")
    return incoming.dropDuplicates(list(keys)).join(held, list(keys), "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Last write wins per key; `order` picks among several incoming rows of a key."""
    new = incoming
    if order is not None:
        payload = F.struct(*[F.col(c) for c in incoming.columns])
        new = incoming.groupBy(*keys).agg(F.max_by(payload, order).alias("_r")).select("_r.*")
    columns = existing.columns
    return existing.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*columns))


def coalesce_upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], sticky: Sequence[str]) -> DataFrame:
    """Full merge that never overwrites a known value of the sticky columns."""
    other = [c for c in existing.columns if c not in {*keys, *sticky}]
    e = existing.select(*keys, F.struct(*sticky, *other).alias("_e"))
    n = incoming.select(*keys, F.struct(*sticky, *other).alias("_n"))
    both = e.join(n, list(keys), "full_outer")
    return both.select(
        *keys, *[F.coalesce(F.col(f"_e.{c}"), F.col(f"_n.{c}")).alias(c) for c in sticky],
        *[F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_e.{c}")).alias(c) for c in other],
    ).select(*existing.columns)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str, row_hash: str = "row_hash") -> tuple[DataFrame, DataFrame]:
    """(rows to insert, conflicts): the same id with another hash is a conflict."""
    stored = existing.select(key, F.col(row_hash).alias("_stored"))
    both = incoming.join(stored, key, "left")
    fresh = both.where(F.col("_stored").isNull()).drop("_stored")
    return fresh, both.where(F.col("_stored") != F.col(row_hash))


def require_empty(conflicts: DataFrame, what: str) -> None:
    """Fail a job on the first conflicting row."""
    if conflicts.limit(1).count():
        raise ValueError(f"{what}: stored rows conflict with this run")


def replace_partitions(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Overwrite only the partitions present in `df`."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def _folder(run_id: str) -> str:
    return "run-" + quote(run_id, safe="")


def _present(spark: SparkSession, pattern: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def _clear(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """One row per committed run: run_id and the rows it wrote."""
    if not _present(spark, f"{path}/commits/*"):
        return spark.createDataFrame([], "run_id string, rows_written bigint")
    return spark.read.schema("run_id string, rows_written bigint").parquet(f"{path}/commits/*")


def read_appended(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of committed runs with their run_id; what a killed run left behind is not seen."""
    whole = StructType([*schema.fields, StructField("run_id", StringType())])
    if not _present(spark, f"{path}/rows/*"):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(f"{path}/rows/*").join(read_commits(spark, path).select("run_id"), "run_id", "left_semi")


def stage_run(df: DataFrame, path: str, run_id: str) -> int:
    """Write one run's rows to its own folder, over whatever an earlier try left there; returns the rows."""
    seen = Observation()
    rows = df.withColumn("run_id", F.lit(run_id)).observe(seen, F.count(F.lit(1)).alias("n"))
    with shuffles_dropped(df.sparkSession):
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows/{_folder(run_id)}")
    return seen.get["n"]


def commit_run(spark: SparkSession, path: str, run_id: str, rows: int) -> None:
    marker = spark.createDataFrame([(run_id, rows)], "run_id string, rows_written bigint")
    marker.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{_folder(run_id)}")


def append_run(df: DataFrame, path: str, run_id: str, keys: Sequence[str]) -> int:
    """Append the rows whose key no committed run holds; repeatable at every point.

    A run's rows are staged in a folder of their own and count once its marker is written,
    which is the last step. Killed before that, the run is done again from the start; run again
    after it, nothing is written. Keys may be NULL and are then equal to one another. Runs of
    one table must not overlap in time. The caller's column `run_id`, if any, is not stored.
    Returns the rows written by this call.
    """
    spark = df.sparkSession
    if not read_commits(spark, path).where(F.col("run_id") == run_id).isEmpty():
        return 0
    _clear(spark, f"{path}/rows/{_folder(run_id)}")  # of a killed try: its files must not be listed by the read below
    rows = df.drop("run_id")
    held = read_appended(spark, path, rows.schema).select(*keys, F.lit(True).alias("_held"))
    # rows and held keys are dealt by key once: a group with a held key gives nothing, any other one row
    both = rows.withColumn("_held", F.lit(False)).unionByName(held, allowMissingColumns=True)
    first = Window.partitionBy(*keys).orderBy(F.desc("_held"))
    fresh = both.withColumn("_place", F.row_number().over(first)).where("_place = 1 AND NOT _held").select(*rows.columns)
    written = stage_run(fresh, path, run_id)
    commit_run(spark, path, run_id, written)
    return written
