"""Hash trees: order, repeats and NULLs, planted changes, and what is read to find them."""

from pyspark.sql import functions as F

from knownat.operators import hashtree as H

COLUMNS = (("id", "string"), ("v", "double"), ("w", "string"))
SCHEMA = "id bigint, v double, w string"


def root(spark, data):
    rows = H.digests(spark.createDataFrame(data, SCHEMA).withColumn("_leaf", F.lit("z")), ["id"], COLUMNS)
    found = H.tree(rows).where("level = 0").collect()
    return found[0]["digest"] if found else None


def test_root_follows_the_rows_alone(spark):
    data = [(i, i / 4, None if i % 3 else "w") for i in range(200)] + [(None, None, None), (5, 1.25, None)]
    assert root(spark, data) == root(spark, data[::-1])
    assert root(spark, data) != root(spark, data + data[-1:])
    assert root(spark, data) != root(spark, [(0, 0.0, "x"), *data[1:]])
    assert root(spark, []) is None


def test_changes_match_a_comparison_of_all_rows(spark, tmp_path):
    old = [(i, float(i), "w") for i in range(3000)] + [(None, 1.0, "n"), (7, 7.0, "again")]
    new = [(i, float(i) + (i == 1234), "w") for i in range(3000) if i != 2000] + [(None, 2.0, "n"), (7, 7.0, "again"), (7, 7.0, "again"), (9999, 0.0, None)]
    kept = []
    for name, data in (("old", old), ("new", new)):
        H.store(H.digests(spark.createDataFrame(data, SCHEMA), ["id"], COLUMNS), f"{tmp_path}/{name}")
        kept.append(H.read(spark, f"{tmp_path}/{name}", "id bigint"))
    leaves = H.differing_leaves(*map(H.tree, kept))
    got = {r["id"]: r["change"] for r in H.changes(*kept, leaves, ["id"]).collect()}
    assert got == {1234: "changed", 2000: "removed", None: "changed", 7: "changed", 9999: "added"}
    assert leaves.count() <= 5 and leaves.agg(F.sum("rows_old")).first()[0] < 30
    same = H.differing_leaves(H.tree(kept[0]), H.tree(kept[0]))
    assert same.count() == 0 and H.changes(kept[0], kept[0], same, ["id"]).count() == 0
