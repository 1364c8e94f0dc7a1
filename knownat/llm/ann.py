"""Approximate nearest neighbours by cosine from randomly rotated one-bit codes.

Vectors are scaled to length one and turned by one random rotation. A code keeps the sign of each rotated component (one
bit) and the inner product of the vector with its own sign vector. The inner product with a query is then estimated from
the signs alone, and its error is bounded with high probability by the part of the query that the sign vector can't
see. A candidate is ranked again with its original vector if the upper bound of its estimate reaches the k-th best lower
bound of the query; so the bound decides how many are looked at, not a number set beforehand.

Queries are packed into blocks, and every block meets every packed block of codes: the work is queries times vectors,
in bit and matrix operations, without a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.llm.store import stored

#: Vectors of a block of codes, and of a block of queries.
CODES, QUERIES = 4096, 256
#: Blocks of codes meet the queries in so many groups, beyond that in groups of so many blocks: queries are copied for each.
GROUPS, CODES_TOGETHER = 32, 8
#: Blocks of codes whose nearest are put together at once.
FAN = 64
#: Width of the error bound in standard deviations of the estimate; beyond three lie about 3 candidates in 1000.
WIDTH = 3.0


class Codes(NamedTuple):
    """A block of codes."""

    ids: np.ndarray
    bits: np.ndarray  # packed signs
    own: np.ndarray  # inner product of each unit vector with its sign vector


def rotation(size: int, seed: int = 17) -> np.ndarray:
    """A random orthogonal matrix, the same for every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, which all have the same length, as doubles."""
    rows = len(column)
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(rows, -1)


def code(ids: np.ndarray, vectors: np.ndarray) -> Codes:
    turned = unit(vectors) @ rotation(vectors.shape[1])
    return Codes(ids, np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(vectors.shape[1]))


def estimate(codes: Codes, queries: np.ndarray, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products (queries x codes) of rotated unit queries with the coded vectors."""
    size = queries.shape[1]
    signs = np.unpackbits(codes.bits, axis=1, count=size).astype(np.float32) * 2 - 1
    seen = (queries.astype(np.float32) @ signs.T).astype(np.float64) / np.sqrt(size)
    own = np.maximum(codes.own, 1e-6)
    middle = seen / own
    error = width * np.sqrt(np.maximum(1 - own**2, 0)) / own / np.sqrt(max(size - 1, 1))
    return middle - error, middle + error


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (id, v) whose vector has a direction: no null, empty or zero vector, no null or non-finite component."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e150)))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), v.alias("v"))
    return rows.where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: F.abs(x) > 1e-150))


def _packed(rows: DataFrame, block: int) -> DataFrame:
    """Rows packed into blocks of up to `block` vectors of one size, within each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                own = batch.filter(pa.array(sizes == size))
                for at in range(0, own.num_rows, block):
                    part = own.slice(at, block)
                    made = code(part.column("id").to_numpy(), matrix(part.column("v")))
                    row = [[int(size)], [part.column("id").to_pylist()], [made.bits.tobytes()], [made.own.tolist()], [matrix(part.column("v")).tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.binary()))], ["size", "ids", "bits", "own", "vectors"])

    return rows.mapInArrow(run, "size int, ids array<bigint>, bits binary, own array<double>, vectors binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", width: float = WIDTH) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found of each query, nearest first, ties to the smaller id.

    Nearness is the cosine of the original vectors in double precision. Queries meet vectors of their own size, other
    than the row of their own id. Vectors without a direction take no part, nor do null keys; a repeated id with
    a different vector is a candidate of its own, equal rows count once. Other columns are not read.
    """
    candidates = usable(vectors, key, vector).distinct()
    asked = usable(queries, key, vector).distinct()
    blocks = stored(_packed(candidates, CODES).withColumn("code", F.monotonically_increasing_id()), "codes")
    asking = stored(_packed(asked, QUERIES).select("size", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors")), "queries")
    parts = max(blocks.count(), 1)
    groups = max(min(parts, GROUPS), parts // CODES_TOGETHER)
    # every block of queries goes to every group of blocks of codes. A plan takes exploded rows for one, so without a
    # hint all these copies would be sent to the driver to be broadcast
    blocks = blocks.withColumn("group", F.pmod(F.xxhash64("code"), F.lit(groups)).cast("int"))
    spread = asking.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).hint("merge")
    met = blocks.join(spread, ["size", "group"]).select("code", "size", "ids", "bits", "own", "vectors", "query_ids", "query_vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                size = row["size"]
                turned = turn.setdefault(size, rotation(size))
                ids, asked_ids = np.array(row["ids"]), np.array(row["query_ids"])
                codes = Codes(ids, np.frombuffer(row["bits"], np.uint8).reshape(len(ids), -1), np.array(row["own"]))
                own = np.frombuffer(row["vectors"]).reshape(len(ids), size)
                query = np.frombuffer(row["query_vectors"]).reshape(len(asked_ids), size)
                low, high = estimate(codes, unit(query) @ turned, width)
                self_pair = asked_ids[:, None] == ids[None]
                low[self_pair] = high[self_pair] = -np.inf
                least = np.partition(low, -k, 1)[:, -k] if len(ids) > k else np.full(len(asked_ids), -np.inf)
                found = []
                for q in range(len(asked_ids)):
                    near = np.flatnonzero((high[q] >= least[q]) & ~self_pair[q])
                    score = cosine(query[q], own[near])
                    best = np.lexsort((ids[near], -score))[:k]
                    found.append((np.full(len(best), asked_ids[q]), ids[near][best], score[best], np.full(len(best), len(near)), np.full(len(best), row["code"])))
                columns = [np.concatenate(c) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score", "looked_at", "code"])

    near = met.mapInArrow(run, "query_id bigint, vec_id bigint, score double, looked_at bigint, code bigint")
    best = near.select("query_id", F.col("code").alias("part"), F.array(F.struct((-F.col("score")).alias("s"), "vec_id")).alias("best"))
    while True:  # k rows of each query and block of codes become k rows of each query, FAN blocks at a time
        parts = -(-parts // FAN)
        best = best.groupBy("query_id", F.pmod(F.xxhash64("part"), F.lit(parts)).alias("part")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        if parts <= 1:
            break
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def cosine(query: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each from its own two vectors only."""
    if not len(others):
        return np.zeros(0)
    return (others * query).sum(1) / (np.sqrt((query * query).sum()) * np.sqrt((others * others).sum(1)))
