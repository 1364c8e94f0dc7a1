"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Drops a query's shuffle files when it ends; without it they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(app: str = "knownat", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution and skew handling on, UTC timestamps."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.enabled": "false",
        **{key.replace("__", "."): str(value) for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application, in the shared folder that spark.checkpoint.dir names.

    Only a local master, whose tasks all run on one machine, may go without: it gets
    a temporary folder. On a cluster a missing folder is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="knownat-ckpt-"))
    return context.getCheckpointDir()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files: for writes whose results are read from the files written."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Written to the shared folder once and read from there, as compressed columns of which later steps read what they use.

    A checkpoint holds whole rows uncompressed, and the shuffle files behind it stay beside it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept-{uuid4().hex}"
    typed = df.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind == "void"})
    with shuffles_dropped(spark):
        typed.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(typed.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for short tables such as counts per value."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
