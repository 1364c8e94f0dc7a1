"""Near duplicates among vectors of one label: random-hyperplane sign hashing in several tables, exact cosines, components.

Equal vectors of a label are one kind with a number of copies. Each table hashes a kind to the signs of its inner products
with random hyperplanes; two vectors at an angle t agree in one sign with probability 1 - t / pi. The number of signs
follows the rows of the largest label, so that buckets stay of one size, and the number of tables follows from the signs:
a pair at exactly the least cosine shares no bucket with a probability of at most MISS, a closer pair with less.

A bucket of up to BUCKET kinds is one group; a larger one is dealt into blocks, and each pair of blocks is a group, so
no bucket is too large and none is cut. In a group, cosines are matrix products of strips; every pair that reaches the least
cosine counts in the first table in which the two share a bucket and in no other, so no list of pairs is made or made distinct.
A group gives one number of links for each member, and a spanning forest of its links. Components are joined over these.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.llm.components import components
from knownat.llm.store import stored

COSINE = 0.93
#: Chance that a pair at the least cosine meets in no table.
MISS = 1e-4
#: Kinds of a bucket that one task compares, and rows whose cosines are held at once.
BUCKET, STRIP = 8192, 256
#: Signs of a table: so many at least, and at most (a code is one 32-bit number).
SIGNS = (4, 31)
#: Cosines this close to the least one are computed again from the two vectors alone.
CLOSE = 1e-9


def plan(rows: int, least: float = COSINE, miss: float = MISS, bucket: int = BUCKET) -> tuple[int, int]:
    """Signs of a table and number of tables for a label of so many rows."""
    signs = min(max(SIGNS[0], math.ceil(math.log2(max(rows, 1) / bucket)) if rows else 0), SIGNS[1])
    meet = (1 - math.acos(least) / math.pi) ** signs
    return signs, 1 if meet >= 1 else math.ceil(math.log(miss) / math.log(1 - meet))


def codes(vectors: np.ndarray, signs: int, tables: int, seed: int = 29) -> np.ndarray:
    """The code of each vector in each table (vectors x tables)."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * signs))
    side = (vectors @ planes > 0).reshape(len(vectors), tables, signs)
    return (side @ (1 << np.arange(signs))).astype(np.int32)


def cosine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, each from its own two vectors only."""
    return (left * right).sum(1) / (np.sqrt((left * left).sum(1)) * np.sqrt((right * right).sum(1)))


def _matrix(data: list[bytes], size: int) -> np.ndarray:
    kind = np.float32 if len(data[0]) == 4 * size else np.float64
    return np.frombuffer(b"".join(data), kind).reshape(len(data), size).astype(np.float64)


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, with the largest component brought below one by a power of two, and a hash of label and vector."""
    for batch in batches:
        sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            part = batch.filter(pa.array(sizes == size))
            own = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            own = np.ldexp(own, -np.frexp(np.abs(own).max(1))[1][:, None]) + 0.0
            narrow = own.astype(np.float32)
            exact = (narrow == own).all(1)
            data = [(n if e else x).tobytes() for n, x, e in zip(narrow, own, exact)]
            prints = [hashlib.blake2b(b"%d,%d," % (label, size) + x, digest_size=16).digest() for label, x in zip(part.column("label").to_pylist(), data)]
            arrays = [part.column("id"), part.column("label"), pa.array(np.full(part.num_rows, size, np.int32)), pa.array(data, pa.binary()), pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "label", "size", "v", "print"])


def _coded(signs: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.column_stack([batch.column("size").to_numpy(), [len(x) for x in batch.column("v").to_pylist()]])
            for size, length in np.unique(sizes, axis=0):
                part = batch.filter(pa.array((sizes == (size, length)).all(1)))
                made = codes(_matrix(part.column("v").to_pylist(), int(size)), signs, tables)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, tables), pa.int32()), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "codes"])

    return run


def links(vectors: np.ndarray, copies: np.ndarray, made: np.ndarray, table: int, side: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Number of linked rows of each vector, and the least number of a vector that it is joined with, within one group.

    Pairs that share an earlier table's bucket are left to that table. With `side` (flags), only pairs of
    one flagged and one other vector count.
    """
    unit = vectors / np.sqrt((vectors * vectors).sum(1))[:, None]
    count, low = np.zeros(len(vectors), np.int64), np.arange(len(vectors))
    for start in range(0, len(vectors), STRIP):
        close = unit[start : start + STRIP] @ unit[start:].T  # pairs with an earlier strip are done
        i, j = np.nonzero(close >= least - CLOSE)
        unsure = close[i, j] < least + CLOSE
        i, j = i + start, j + start
        fine = i < j if side is None else (i < j) & (side[i] != side[j])
        unsure &= fine
        fine[unsure] = cosine(vectors[i[unsure]], vectors[j[unsure]]) >= least
        i, j = i[fine], j[fine]
        first = ~(made[i, :table] == made[j, :table]).any(1)
        i, j = i[first], j[first]
        count += np.bincount(i, copies[j], len(count)).astype(np.int64) + np.bincount(j, copies[i], len(count)).astype(np.int64)
        while len(i):  # take the lesser root, then shorten, until both ends of every link have one root
            a, b = low[i], low[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
            while (low != low[low]).any():
                low = low[low]
    return count, low


def _linked(least: float):
    """Rows (a, b, links): links of a node where b is null, else an edge of a group's spanning forest."""
    keys = ["label", "size", "table", "code", "cell"]

    def result(rows: pa.Table) -> pa.RecordBatch:
        size, table = rows.column("size")[0].as_py(), rows.column("table")[0].as_py()
        nodes, copies, second = (rows.column(c).to_numpy() for c in ("node", "copies", "second"))
        data = rows.column("v").to_pylist()
        vectors = np.concatenate([_matrix([x], size) for x in data]) if len({len(x) for x in data}) > 1 else _matrix(data, size)
        made = np.array(rows.column("codes").to_pylist(), np.int32)
        whole = rows.column("whole")[0].as_py()
        count, low = links(vectors, copies, made, table, None if whole else second, least)
        some, joined = np.flatnonzero(count), np.flatnonzero(low != np.arange(len(low)))
        a = np.concatenate([nodes[some], nodes[joined]])
        empty = np.concatenate([np.ones(len(some), bool), np.zeros(len(joined), bool)])
        b = pa.array(np.concatenate([np.zeros(len(some), np.int64), nodes[low[joined]]]), mask=empty)
        number = pa.array(np.concatenate([count[some], np.zeros(len(joined), np.int64)]), mask=~empty)
        return pa.RecordBatch.from_arrays([pa.array(a), b, number], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.column_stack([batch.column(c).to_numpy() for c in keys])
            cuts = np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1
            bounds = [0, *cuts.tolist(), batch.num_rows]
            for start, stop in zip(bounds[:-1], bounds[1:]):
                key = tuple(values[start])
                if key != last and held:
                    if sum(x.num_rows for x in held) > 1:
                        yield result(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(start, stop - start))
                last = key
        if held and sum(x.num_rows for x in held) > 1:
            yield result(pa.Table.from_batches(held))

    return run


def near_vectors(vectors: DataFrame, least: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label", bucket: int = BUCKET) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of `vectors`.

    Two rows are linked if their labels are equal and their vectors have a cosine of `least` or more, in double precision.
    n_links is the number of other rows linked directly, component_id the least key reachable by links, and kept tells
    whether that is the row's own. Rows with a null key or label, or a vector that is null, empty or zero or holds a null or
    non-finite component, link with nothing, and are their own component (null if the key is). Vectors of different
    sizes don't link. Every repeated row counts; repeated keys with different vectors are rows of their own. Components of
    any finite size are compared. Keys and labels must be whole numbers; other columns are not read. An empty table gives none.
    """
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: F.when(F.abs(x) < F.lit(float("inf")), x))
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), v.alias("v"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("v", lambda x: x.isNotNull()) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    prepared = rows.where("fine").select("id", "label", "v").mapInArrow(_prepared, "id bigint, label bigint, size int, v binary, print binary")
    prepared = stored(prepared, "vectors")
    largest = prepared.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    signs, tables = plan(largest, least, bucket=bucket)
    kinds = prepared.groupBy("print").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("label", "size", "v")])
    kinds = kinds.withColumn("node", F.monotonically_increasing_id())
    kinds = stored(kinds.mapInArrow(_coded(signs, tables), kinds.drop("codes").schema.simpleString()[7:-1].replace(":", " ") + ", codes array<int>"), "kinds")

    spread = kinds.select("node", "label", "size", "copies", "v", "codes", F.posexplode("codes").alias("table", "code"))
    place = ["label", "size", "table", "code"]
    large = spread.groupBy(*place).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > bucket)
    # two blocks are one group; written, so that its size is known and vectors are not shuffled to join it
    large = stored(large.select(*place, F.ceil(F.col("members") / (bucket // 2)).cast("int").alias("blocks")), "large")
    dealt = spread.join(large, place, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a member of block b is in the cell of every pair (b, other); the cells (b, b) have pairs within a block
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    one, two = F.least("block", "other"), F.greatest("block", "other")
    dealt = dealt.withColumn("cell", (one * F.col("blocks").cast("bigint") + two)).withColumn("second", (F.col("block") == two) & (one != two)).withColumn("whole", one == two)
    groups = dealt.drop("blocks", "block", "other").repartition(*place, "cell").sortWithinPartitions(*place, "cell")
    found = stored(groups.mapInArrow(_linked(least), "a bigint, b bigint, links bigint"), "links")

    joined = components(found.where("b is not null").select("a", "b").distinct())
    count = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    places = kinds.select("print", "node", "low", "copies").join(joined, "node", "left").withColumn("label", F.coalesce("label", "node")).join(count, "node", "left")
    lowest = places.groupBy("label").agg(F.min("low").alias("component_id"))
    places = places.join(lowest, "label").select("print", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = prepared.select("id", "print").join(places, "print").select("id", "n_links", "component_id")
    out = out.unionByName(rows.where("not fine").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
