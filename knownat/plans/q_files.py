"""Directory and manifest files, written from the given tables with planted faults and read back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import directory as D
from .registry import query

#: Rows of a directory file and of a manifest at most.
LISTED_ROWS, MANIFEST_ROWS = 20, 100
LISTED = {"Symbol": "symbol", "Security Name": "security_name", "Test Issue": "test_issue", "ETF": "etf"}


def _write(files: DataFrame, t, name: str) -> str:
    """One file for each row (file_no, content), under the shared folder."""
    path = f"{shared_folder(t.spark)}/{name}-{uuid4().hex}"
    files.write.partitionBy("file_no").text(path)
    return path


def _directories(t) -> str:
    """Suppliers as directory files: every second file has its columns in another order, every fifth has no header."""
    k = F.col("s_suppkey")
    flag = lambda c: F.when(c, "Y").otherwise("N")
    cells = (F.concat(F.lit("T"), k.cast("string")), F.col("s_name"), flag(k % 6 == 1), flag(k % 4 == 2))
    rows = t.supplier.withColumn("file_no", F.expr(f"CAST(s_suppkey div {LISTED_ROWS} AS INT)"))
    swapped = F.col("file_no") % 2 == 1
    line = F.when(swapped, F.concat_ws("|", cells[3], cells[1], cells[0], cells[2])).otherwise(F.concat_ws("|", *cells))
    line = F.when(k % 10 == 7, F.concat(line, F.lit("|more"))).otherwise(line)
    head = F.when(F.col("file_no") % 5 == 4, "").when(swapped, "ETF|Security Name|Symbol|Test Issue").otherwise("Symbol|Security Name|Test Issue|ETF")
    # at most LISTED_ROWS lines a group
    body = rows.groupBy("file_no").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("_body"))
    return _write(body.select("file_no", F.concat_ws("\n", head, "_body", F.lit(D.FOOTER + ": 0101202500:00")).alias("value")), t, "directories")


_FILE_NO = r"file_no=(\d+)"


@query("directory_files", "", f"""
    WITH r AS (SELECT s_suppkey AS k, s_suppkey // {LISTED_ROWS} AS file_no, 'T' || s_suppkey AS symbol, s_name AS name, CASE WHEN s_suppkey % 6 = 1 THEN 'Y' ELSE 'N' END AS test, CASE WHEN s_suppkey % 4 = 2 THEN 'Y' ELSE 'N' END AS etf FROM supplier),
    l AS (SELECT *, CASE WHEN file_no % 2 = 1 THEN concat_ws('|', etf, name, symbol, test) ELSE concat_ws('|', symbol, name, test, etf) END || CASE WHEN k % 10 = 7 THEN '|more' ELSE '' END AS line,
          CASE WHEN file_no % 5 = 4 THEN 'file without a header' WHEN k % 10 = 7 THEN 'another width than the header' END AS reason FROM r)
    SELECT CAST(file_no AS INTEGER) AS file_no, CASE WHEN reason IS NULL THEN symbol END AS symbol, CASE WHEN reason IS NULL THEN name END AS security_name, CASE WHEN reason IS NULL THEN etf = 'Y' END AS is_etf, CASE WHEN reason IS NULL THEN test = 'Y' END AS is_test_issue, CASE WHEN reason IS NOT NULL THEN line END AS line, reason FROM l""")
def directory_files(t):
    """Rows of all directory files, and the lines that no row could be made of."""
    path = _directories(t)
    number = F.regexp_extract("file", _FILE_NO, 1).cast("int").alias("file_no")
    good = D.read_directory(t.spark, path, LISTED).select(number, "symbol", "security_name", (F.col("etf") == "Y").alias("is_etf"), (F.col("test_issue") == "Y").alias("is_test_issue"))
    return good.unionByName(D.directory_rejects(t.spark, path, LISTED).select(number, "line", "reason"), allowMissingColumns=True)


def _manifests(t) -> str:
    """Customers as manifests: some are cut off, some have no version, and some entries have no category."""
    k = F.col("c_custkey")
    entry = F.struct(
        F.concat(F.lit("C"), k.cast("string")).alias("symbol"), F.when(k % 20 != 4, F.col("c_mktsegment")).alias("category"),
        F.when(k % 30 == 9, " ").otherwise("listed").alias("inclusion_reason"), F.when(k % 9 == 0, F.lit("2001-05-04")).alias("delisted_date"), F.col("c_name").alias("name"),
    )
    # at most MANIFEST_ROWS entries a group
    files = t.customer.groupBy(F.expr(f"CAST(c_custkey div {MANIFEST_ROWS} AS INT)").alias("file_no")).agg(F.array_sort(F.collect_list(entry)).alias("securities"))
    text = F.to_json(F.struct(F.when(F.col("file_no") % 7 != 4, F.lit("3")).alias("manifest_version"), "securities"))
    whole, files = F.col("file_no") % 7 != 1, files.withColumn("_t", text)
    return _write(files.select("file_no", F.when(whole, F.col("_t")).otherwise(F.expr("left(_t, length(_t) div 2)")).alias("value")), t, "manifests")


@query("manifest_files", "", f"""
    WITH r AS (SELECT *, c_custkey // {MANIFEST_ROWS} AS file_no FROM customer),
    e AS (SELECT *, CASE WHEN file_no % 7 = 1 THEN 'not a manifest in JSON' WHEN file_no % 7 = 4 THEN 'missing manifest_version' END AS whole, CASE WHEN c_custkey % 20 = 4 THEN 'missing category' WHEN c_custkey % 30 = 9 THEN 'missing inclusion_reason' END AS lacking FROM r)
    SELECT DISTINCT CAST(file_no AS INTEGER) AS file_no, CAST(NULL AS VARCHAR) AS symbol, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS delisted_date, whole AS reason FROM e WHERE whole IS NOT NULL
    UNION ALL SELECT CAST(file_no AS INTEGER), 'C' || c_custkey, CASE WHEN lacking IS NULL THEN c_mktsegment END, CASE WHEN lacking IS NULL THEN c_name END, CASE WHEN lacking IS NULL AND c_custkey % 9 = 0 THEN '2001-05-04' END, lacking FROM e WHERE whole IS NULL""")
def manifest_files(t):
    """Entries of all manifests, and what could not be used of them."""
    path = _manifests(t)
    number = F.regexp_extract("file", _FILE_NO, 1).cast("int").alias("file_no")
    good = D.read_manifest(t.spark, path).select(number, "symbol", "category", "name", "delisted_date")
    return good.unionByName(D.manifest_rejects(t.spark, path).select(number, "symbol", "reason"), allowMissingColumns=True)


def _cik(k):
    return F.lpad(k.cast("string"), 10, "0")


@query("dimension_load", "", f"""
    WITH e AS (SELECT c_custkey AS k, c_name, 'C' || c_custkey AS symbol FROM customer WHERE c_custkey // {MANIFEST_ROWS} % 7 NOT IN (1, 4) AND c_custkey % 20 <> 4 AND c_custkey % 30 <> 9),
    r AS (SELECT *, k % 3 <> 0 AS listed, CASE WHEN k % 3 <> 0 OR (k % 6 = 0 AND k % 5 <> 0) THEN 'common_stock' ELSE 'unknown' END AS security_type,
          CASE WHEN k % 3 <> 0 THEN c_name || ' Common Stock' WHEN k % 5 <> 0 THEN c_name || ' Inc' ELSE c_name END AS name,
          CASE WHEN k % 3 = 0 THEN CASE WHEN k % 9 = 0 THEN '2001-05-04' ELSE '2001-07-01' END END AS gone,
          CASE WHEN k % 2 = 0 AND (k % 5 <> 0 OR k % 3 <> 0) THEN k END AS known FROM e)
    SELECT symbol, known AS security_id, false AS is_new, name, CASE WHEN listed THEN 'NYSE' ELSE 'NOT LISTED' END AS exchange, security_type, listed AS is_active, gone AS valid_to FROM r WHERE known IS NOT NULL
    UNION ALL SELECT symbol, (SELECT max(c_custkey) FROM customer WHERE c_custkey % 2 = 0) + row_number() OVER (ORDER BY symbol), true, name, CASE WHEN listed THEN 'NYSE' ELSE 'NOT LISTED' END, security_type, listed, gone FROM r WHERE known IS NULL""")
def dimension_load(t):
    """Manifest files resolved against directory, tickers and submissions; known securities keep their id, others get a new one."""
    c, k = t.customer, F.col("c_custkey")
    no = F.lit(False)
    listed = F.concat("c_name", F.lit(" Common Stock"))
    directory = c.where(k % 3 != 0).select(F.concat(F.lit("C"), k.cast("string")).alias("symbol"), listed.alias("security_name"), F.lit("NYSE").alias("exchange"), no.alias("is_etf"), no.alias("is_test_issue"))
    tickers = c.where(k % 5 != 0).select(F.concat(F.lit("C"), k.cast("string")).alias("ticker"), _cik(k).alias("cik"))
    submissions = c.where(k % 3 == 0).select(
        _cik(k).alias("cik"), F.lit("2834").alias("sic"), F.concat("c_name", F.lit(" Inc")).alias("entity_name"), F.lit(None).cast("string").alias("entity_exchange"),
        F.when(k % 6 == 0, "Common Stock").alias("security_title"),
    )
    entries = D.resolve_entries(D.read_manifest(t.spark, _manifests(t)), directory, tickers, submissions, F.lit("2001-07-01").cast("date"))
    known = c.where(k % 2 == 0).select(
        k.alias("security_id"), F.when(k % 10 != 0, _cik(k)).alias("cik"), F.lit(None).cast("string").alias("share_class"), F.lit("common_stock").alias("security_type"), listed.alias("name"),
    )
    return D.load_dimension(entries, known).select("symbol", "security_id", "is_new", "name", "exchange", "security_type", "is_active", "valid_to")
