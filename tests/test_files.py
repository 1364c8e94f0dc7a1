"""Directory and manifest files: headers of their own, faulty lines, faulty files."""

import json

from knownat.sources import directory as D

LISTED = {"Symbol": "symbol", "Security Name": "security_name", "Test Issue": "_t", "ETF": "_e"}


def test_each_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Symbol|Security Name|Test Issue|ETF\nAA| Alpha |N|N\nBB|Beta|N\n\nCC|Gamma|Y|N\nFile Creation Time: 0101|||\n")
    (tmp_path / "b.txt").write_text("ETF|Round Lot|Symbol|Test Issue|Security Name\nY|100|DD|N|Delta\n")
    (tmp_path / "c.txt").write_text("EE|Epsilon|N|N\n")
    got = {tuple(r)[:5] for r in D.read_nasdaq(spark, str(tmp_path)).collect()}
    assert got == {("AA", "Alpha", "Nasdaq", False, False), ("CC", "Gamma", "Nasdaq", False, True), ("DD", "Delta", "Nasdaq", True, False)}
    rejects = {(r["file"].rsplit("/", 1)[1], r["line"], r["reason"]) for r in D.directory_rejects(spark, str(tmp_path), LISTED).collect()}
    assert rejects == {("a.txt", "BB|Beta|N", "another width than the header"), ("c.txt", "EE|Epsilon|N|N", "file without a header")}


def test_lines_of_a_file_in_many_splits_meet_its_header(spark, tmp_path):
    for name, head in (("a", "Symbol|Security Name|Test Issue|ETF"), ("b", "Security Name|Symbol|Test Issue|ETF")):
        (tmp_path / f"{name}.txt").write_text("\n".join([head, *(f"{name}{i}|x{i}|N|N" for i in range(5000))]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8192)
    try:
        rows = D.read_directory(spark, str(tmp_path), LISTED)
        assert rows.rdd.getNumPartitions() > 4
        got = {(r["symbol"], r["security_name"]) for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(f"a{i}", f"x{i}") for i in range(5000)} | {(f"x{i}", f"b{i}") for i in range(5000)}


def test_manifests(spark, tmp_path):
    entry = {"symbol": "AA", "category": "c", "inclusion_reason": "r", "valid_from": "2020-01-02"}
    files = {
        "good": json.dumps({"manifest_version": "1", "securities": [entry, entry | {"symbol": "BB", "category": ""}, {"category": "c"}]}, indent=1),
        "cut": json.dumps({"manifest_version": "1", "securities": [entry]})[:-9],
        "unversioned": json.dumps({"securities": [entry]}),
        "listless": json.dumps({"manifest_version": "1"}),
        "empty": json.dumps({"manifest_version": "1", "securities": []}),
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    (row,) = D.read_manifest(spark, str(tmp_path)).collect()
    assert (row["symbol"], row["manifest_version"], str(row["valid_from"])) == ("AA", "1", "2020-01-02")
    rejects = {(r["file"].rsplit("/", 1)[1][:-5], r["entry_no"], r["symbol"], r["reason"]) for r in D.manifest_rejects(spark, str(tmp_path)).collect()}
    assert rejects == {
        ("good", 1, "BB", "missing category"), ("good", 2, None, "missing symbol"), ("cut", None, None, "not a manifest in JSON"),
        ("unversioned", None, None, "missing manifest_version"), ("listless", None, None, "missing securities"),
    }
