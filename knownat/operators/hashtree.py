"""Hash trees over keyed populations: one hash for all rows, and changes between two populations from the differing parts only.

A row goes to the leaf that the first hex digits of its key's hash name, so both populations cut their keys alike. A node
holds the number of rows below it and the exact sum of their digests, which needs no order and combines map-side; the leaves
are bounded by 16 ** DEPTH whatever the rows are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import canonical_text, row_hash, sha256

#: Hex digits of a leaf, and those that name a folder of a stored population.
DEPTH, FOLDER = 3, 2
#: Hex digits of a row's hash that are summed: sums of 10**20 rows stay exact in decimal(38).
DIGEST = 15


def digests(df: DataFrame, keys: Sequence[str], columns: Sequence[tuple[str, str]]) -> DataFrame:
    """(keys, _digest, _leaf): a row's digest covers `columns` as (name, kind) pairs, NULLs included; a NULL key is a key."""
    key = F.sha2(F.concat_ws("|", *[canonical_text(k) for k in keys]), 256)
    digest = F.conv(F.substring(row_hash(columns), 1, DIGEST), 16, 10).cast("bigint")
    return df.select(*keys, digest.alias("_digest"), F.substring(key, 1, DEPTH).alias("_leaf"))


def tree(rows: DataFrame) -> DataFrame:
    """(level, node, rows, digest) of `digests`: the root is level 0 with the empty name, leaves are level DEPTH.

    Rows are aggregated once, to leaves; the levels above come from the leaves. No rows give no nodes.
    """
    leaves = rows.groupBy("_leaf").agg(F.count("*").alias("rows"), F.sum(F.col("_digest").cast("decimal(20,0)")).alias("_sum"))
    paths = leaves.select(F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("level"), "_leaf", "rows", "_sum")
    node = F.expr("left(_leaf, level)").alias("node")
    nodes = paths.groupBy("level", node).agg(F.sum("rows").alias("rows"), F.sum("_sum").cast("decimal(38,0)").alias("_sum"))
    return nodes.select("level", "node", "rows", sha256("rows", "_sum").alias("digest"))


def differing_leaves(old: DataFrame, new: DataFrame) -> DataFrame:
    """(_leaf, rows_old, rows_new) where two trees differ, found from the root down: below a node that agrees nothing is compared."""
    side = lambda t, n: t.select("level", "node", F.col("rows").alias(f"rows_{n}"), F.col("digest").alias(f"_{n}"))
    both = side(old, "old").join(side(new, "new"), ["level", "node"], "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    at = both.where("level = 0").select("node")
    for level in range(1, DEPTH + 1):
        here = both.where(F.col("level") == level)
        at = here.join(at.select(F.col("node").alias("_above")), F.substring("node", 1, level - 1) == F.col("_above"), "left_semi")
    return at.select(F.col("node").alias("_leaf"), *[F.coalesce(f"rows_{n}", F.lit(0)).alias(f"rows_{n}") for n in ("old", "new")])


def store(rows: DataFrame, path: str) -> None:
    """Write `digests` in folders by the first digits of the leaf, in leaf order, so that few leaves are few files and row groups.

    Ranges of (leaf, digest) deal the rows, so files follow the data and rows of a frequent key that differ are divided; small
    ranges are put together while the job runs.
    """
    dealt = rows.withColumn("_folder", F.substring("_leaf", 1, FOLDER)).repartitionByRange("_folder", "_leaf", "_digest")
    dealt.sortWithinPartitions("_folder", "_leaf").write.partitionBy("_folder").parquet(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored population; `schema` names the key columns with their types."""
    return spark.read.schema(f"{schema}, _digest bigint, _leaf string, _folder string").parquet(path)


def changes(old: DataFrame, new: DataFrame, leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, change) of keys added, removed or changed between two stored populations, reading the leaves given only.

    The leaves, at most 16 ** DEPTH rows, are broadcast, and prune folders while the job runs. Rows of one key count
    together: their number and digests are compared.
    """
    held = leaves.where(F.col("rows_old") + F.col("rows_new") > 0)  # all of them: pruning asks for a filter on this side
    where = F.broadcast(held.select("_leaf", F.substring("_leaf", 1, FOLDER).alias("_folder")))
    part = lambda df, n: df.join(where, ["_folder", "_leaf"], "left_semi").select(*keys, "_digest", F.lit(n).alias("_side"))
    of = lambda n, value: F.coalesce(F.sum(F.when(F.col("_side") == n, value)), F.lit(0))
    digest = F.col("_digest").cast("decimal(20,0)")
    folded = part(old, 0).unionByName(part(new, 1)).groupBy(*keys).agg(
        *[of(n, F.lit(1)).alias(f"_n{n}") for n in (0, 1)], *[of(n, digest).alias(f"_s{n}") for n in (0, 1)]
    )
    change: Column = F.when(F.col("_n0") == 0, "added").when(F.col("_n1") == 0, "removed").when((F.col("_n0") != F.col("_n1")) | (F.col("_s0") != F.col("_s1")), "changed")
    return folded.withColumn("change", change).where("change IS NOT NULL").select(*keys, "change")
