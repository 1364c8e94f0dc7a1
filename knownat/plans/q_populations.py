"""Hash trees of orders: the hash of all rows, and planted changes found by reading the parts that differ."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..operators import hashtree as H
from ..session import shared_folder
from .registry import query, stored

_COLUMNS = (("o_orderkey", "string"), ("o_custkey", "string"), ("o_orderstatus", "string"), ("o_orderpriority", "string"))


def _orders(t):
    return t.orders.select(*[name for name, _ in _COLUMNS])


def _later(t):
    """The orders with some removed, some of another status, and some added."""
    k, o = F.col("o_orderkey"), _orders(t)
    kept = o.where(k % 1009 != 5).withColumn("o_orderstatus", F.when(k % 997 == 3, "X").otherwise(F.col("o_orderstatus")))
    return kept.unionByName(o.where(k % 1013 == 7).withColumn("o_orderkey", k + 1000000000))


def _row(table: str) -> str:
    """Digest and leaf of a table's rows in SQL."""
    text = ", ".join(f"'{name}=' || coalesce(CAST({name} AS VARCHAR), 'null')" for name, _ in _COLUMNS)
    return f"SELECT o_orderkey, ('0x' || substr(sha256(concat_ws(chr(10), {text})), 1, 15))::BIGINT AS digest, substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 3) AS leaf FROM {table}"


_NODES = "SELECT level, substr(leaf, 1, level) AS node, count(*) AS rows, sha256(count(*) || '|' || CAST(sum(digest::HUGEINT) AS VARCHAR)) AS digest FROM {0}, range(4) v(level) GROUP BY 1, 2"
_LATER = """later AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 997 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 1009 <> 5
      UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 1013 = 7)"""


@query("population_hash", "", f"WITH a AS ({_row('orders')}) SELECT CAST(level AS INTEGER) AS level, node, rows, digest FROM ({_NODES.format('a')})")
def population_hash(t):
    """The hash tree of all orders; its root is the hash of the population."""
    return H.tree(H.digests(_orders(t), ["o_orderkey"], _COLUMNS))


@query("population_changes", "", f"""
    WITH {_LATER}, a AS ({_row('orders')}), b AS ({_row('later')}),
    la AS (SELECT leaf, count(*) AS n, sum(digest::HUGEINT) AS s FROM a GROUP BY 1), lb AS (SELECT leaf, count(*) AS n, sum(digest::HUGEINT) AS s FROM b GROUP BY 1),
    d AS (SELECT sum(coalesce(la.n, 0) + coalesce(lb.n, 0)) AS n FROM la FULL JOIN lb USING (leaf) WHERE la.n IS DISTINCT FROM lb.n OR la.s IS DISTINCT FROM lb.s)
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change, CAST((SELECT n FROM d) AS BIGINT) AS rows_read
    FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.digest IS DISTINCT FROM b.digest""")
def population_changes(t):
    """Orders that differ between two populations, with the rows read to find them."""
    keys, kept = ["o_orderkey"], {}
    for name, rows in (("old", _orders(t)), ("new", _later(t))):
        path = f"{shared_folder(t.spark)}/population-{uuid4().hex}"
        H.store(H.digests(rows, keys, _COLUMNS), path)
        kept[name] = H.read(t.spark, path, "o_orderkey bigint")
    leaves = stored(t, "leaves", lambda: H.differing_leaves(H.tree(kept["old"]), H.tree(kept["new"])))
    read = leaves.agg(F.coalesce(F.sum(F.col("rows_old") + F.col("rows_new")), F.lit(0)).alias("rows_read"))  # one row
    return H.changes(kept["old"], kept["new"], leaves, keys).join(F.broadcast(read))
