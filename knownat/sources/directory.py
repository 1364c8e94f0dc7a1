"""Symbol directories, manifests and the security dimension load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import first_match, sec_symbol
from ..functions.text import classify_listing, classify_title
from ..operators.asof import match_entities
from ..operators.universe import EXCHANGE_CODES, assign_ids

FOOTER = "File Creation Time"


def _directory_lines(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Lines of all files under `path` as cells, each beside its own file's header; blank lines, headers and footers are left out.

    A file's header is the line that holds all wanted names as cells, wherever a split of the file begins. There is one
    row of headers per file, so the join is a broadcast by size unless there are very many files.
    """
    lines = spark.read.text(path).select("value", F.split("value", r"\|").alias("_v"), F.col("_metadata.file_path").alias("file"))
    lines = lines.where((F.trim("value") != "") & ~F.col("value").startswith(FOOTER))
    names = F.array(*[F.lit(c) for c in columns])
    is_head = F.size(F.array_except(names, F.transform("_v", F.trim))) == 0
    heads = lines.where(is_head).groupBy(F.col("file").alias("_f")).agg(F.min(F.transform("_v", F.trim)).alias("_h"))
    return lines.where(~is_head).join(heads, F.col("file") == F.col("_f"), "left")


def read_directory(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Pipe-delimited files, each by its own header, in whatever order its columns are; `file` tells where a row is from.

    `columns` maps header names to ours. Lines of another width than their header, and all lines of a file without a
    header, are not among the rows but in `directory_rejects`. No file gives no rows.
    """
    rows = _directory_lines(spark, path, columns).where(F.size("_v") == F.size("_h"))
    cell = lambda name: F.trim(F.get("_v", F.array_position("_h", name).cast("int") - 1))
    return rows.select(*[cell(name).alias(ours) for name, ours in columns.items()], "file")


def directory_rejects(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """(file, line, reason) of every line that `read_directory` leaves out."""
    lines = _directory_lines(spark, path, columns)
    reason = first_match((F.col("_h").isNull(), "file without a header"), (F.size("_v") != F.size("_h"), "another width than the header"))
    return lines.withColumn("reason", reason).where("reason IS NOT NULL").select("file", F.col("value").alias("line"), "reason")


def read_nasdaq(spark: SparkSession, path: str) -> DataFrame:
    raw = read_directory(spark, path, {"Symbol": "symbol", "Security Name": "security_name", "Test Issue": "_t", "ETF": "_e"})
    return raw.select("symbol", "security_name", F.lit("Nasdaq").alias("exchange"), (F.col("_e") == "Y").alias("is_etf"), (F.col("_t") == "Y").alias("is_test_issue"))


def read_other(spark: SparkSession, path: str) -> DataFrame:
    raw = read_directory(spark, path, {"ACT Symbol": "symbol", "Security Name": "security_name", "Exchange": "_x", "ETF": "_e", "Test Issue": "_t"})
    return raw.select("symbol", "security_name", exchange_name("_x").alias("exchange"), (F.col("_e") == "Y").alias("is_etf"), (F.col("_t") == "Y").alias("is_test_issue"))


def exchange_name(code) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    return first_match(*[(c == k, v) for k, v in EXCHANGE_CODES.items()], otherwise=c)


def merge_directories(nasdaq: DataFrame, other: DataFrame) -> DataFrame:
    """One row per upper-case symbol; the first directory wins."""
    both = nasdaq.withColumn("_p", F.lit(0)).unionByName(other.withColumn("_p", F.lit(1)))
    rest = F.struct("security_name", "exchange", "is_etf", "is_test_issue")
    return both.groupBy(F.upper("symbol").alias("symbol")).agg(F.min_by(rest, "_p").alias("_r")).select("symbol", "_r.*")


MANIFEST = (
    "manifest_version string, securities array<struct<symbol:string,category:string,inclusion_reason:string,"
    "delisted_date:date,cik:string,name:string,valid_from:date>>, _corrupt_record string"
)


def _manifest_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all manifests with the reason why one can't be used; a manifest that fails as a whole is one row."""
    m = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    m = m.select("*", F.col("_metadata.file_path").alias("file"))
    whole = first_match(
        (F.col("_corrupt_record").isNotNull(), "not a manifest in JSON"),
        (F.col("manifest_version").isNull(), "missing manifest_version"),
        (F.col("securities").isNull(), "missing securities"),
    )
    one = F.when(whole.isNotNull(), F.array(F.lit(None).cast(m.schema["securities"].dataType.elementType))).otherwise(F.col("securities"))
    rows = m.select("file", "manifest_version", whole.alias("_whole"), F.posexplode(one).alias("entry_no", "_s"))
    blank = lambda name: F.coalesce(F.trim(F.col("_s")[name]), F.lit("")) == ""
    lacking = first_match(*[(blank(name), f"missing {name}") for name in ("symbol", "category", "inclusion_reason")])
    return rows.withColumn("reason", F.coalesce("_whole", lacking))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Usable entries of every manifest (JSON, one a file) with its version.

    Files that don't parse, manifests without a version or a list, and entries without a symbol, category or reason are
    in `manifest_rejects`; a job that must not go on with some of them passes those to `sinks.require_empty`.
    """
    return _manifest_entries(spark, path).where("reason IS NULL").select("manifest_version", "_s.*", "file")


def manifest_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(file, entry_no, symbol, reason); entry_no and symbol are NULL where the manifest fails as a whole."""
    rows = _manifest_entries(spark, path).where("reason IS NOT NULL")
    return rows.select("file", F.when(F.col("_whole").isNull(), F.col("entry_no")).alias("entry_no"), F.col("_s.symbol").alias("symbol"), "reason")


def resolve_entries(manifest: DataFrame, directory: DataFrame, tickers: DataFrame, submissions: DataFrame, observed: Column) -> DataFrame:
    """Manifest rows with name, exchange, type and listing window from the best source.

    A symbol absent from the directory is inactive from its delisting or the
    observed date, and is classified by its cover-page title.
    `submissions`: cik, sic, entity_name, entity_exchange, security_title.
    """
    m = manifest.withColumn("symbol", F.upper("symbol")).withColumnRenamed("cik", "_mcik").withColumnRenamed("name", "_mname")
    d = directory.withColumn("_listed", F.lit(True)).withColumnRenamed("exchange", "_dx")
    t = tickers.select(F.col("ticker").alias("_t"), F.col("cik").alias("_c"))
    m = m.join(d, "symbol", "left")
    m = m.join(t.withColumnRenamed("_c", "_c1"), sec_symbol("symbol") == F.col("_t"), "left").drop("_t")
    m = m.join(t.withColumnRenamed("_c", "_c2"), F.col("symbol") == F.col("_t"), "left").drop("_t")
    m = m.withColumn("cik", F.coalesce("_mcik", "_c1", "_c2")).join(submissions, "cik", "left")
    listed = F.coalesce(F.col("_listed"), F.lit(False))
    c = F.when(listed, classify_listing("security_name", "is_test_issue", "is_etf")).otherwise(classify_title("security_title"))
    gone = F.coalesce("delisted_date", observed)
    return m.withColumn("_k", c).select(
        "symbol", "cik", F.when(listed, F.col("security_name")).otherwise(F.coalesce("entity_name", "_mname", "symbol")).alias("name"),
        F.when(listed, F.col("_dx")).otherwise(F.coalesce("entity_exchange", F.lit("NOT LISTED"))).alias("exchange"),
        F.col("_k.security_type").alias("security_type"), F.col("_k.confidence").alias("classification_confidence"),
        F.col("_k.source").alias("classification_source"), F.col("_k.share_class").alias("share_class"),
        F.nullif("sic", F.lit("")).alias("sic_code"), listed.alias("is_active"),
        F.when(~listed, gone).alias("delisted_date"), F.coalesce("valid_from", observed).alias("valid_from"),
        F.when(~listed, gone).alias("valid_to"), "category", "inclusion_reason",
    )


def load_dimension(entries: DataFrame, securities: DataFrame) -> DataFrame:
    """Resolved entries with their security id: an existing one, or a new one never used before."""
    matched = match_entities(entries, securities)
    known = matched.where(F.col("security_id").isNotNull()).withColumn("is_new", F.lit(False))
    fresh = assign_ids(matched.where(F.col("security_id").isNull()).drop("security_id"), securities, F.col("symbol"))
    return known.unionByName(fresh.withColumn("is_new", F.lit(True)))
