"""Registry of queries with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, TimestampNTZType, TimestampType

from ..session import cut_lineage
from .tables_sql import CTES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.kept: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def stored(t: Tables, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table as later steps of the same query read it: written once, not recomputed inside their plans."""
    if name not in t.kept:
        t.kept[name] = cut_lineage(build())
    return t.kept[name]


def sql_with(names: str, body: str) -> str:
    """WITH clause of the named common tables, in the given order, before `body`."""
    parts = [f"{n} AS ({CTES[n].strip()})" for n in names.split()]
    return (f"WITH {', '.join(parts)}\n" if parts else "") + body


def presentable(df: DataFrame, places: int = 6) -> DataFrame:
    """Dates as ISO text and doubles rounded where summation order may differ."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, DoubleType):
            c = F.round(c, places)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, ctes: str = "", sql: str | None = None, places: int = 6):
    """Register `fn(tables)`; `sql` follows the named common tables."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return presentable(fn(Tables(spark, folder)), places)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql_with(ctes, sql.strip())
        return fn

    return register
