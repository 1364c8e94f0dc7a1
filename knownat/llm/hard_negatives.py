"""Hard negatives by integer inner product, searched with rotated one-bit codes.

A vector is turned by one random rotation. Its first code keeps the signs of the rotated components; the alignment, which
is the inner product of the vector with its unit sign vector, is stored beside it, and what the code leaves over is coded
again, LAYERS times in all. An anchor's rotated vector is rounded to integers of PLANES bits, so that its inner product
with a code is a sum of popcounts of bit planes. The estimate is the sum of these products times the alignments. Its error
is at most the length of the last residual times the part of the anchor that the last code can't see, plus the length of
what rounding took from the anchor times the length of the vector (Cauchy-Schwarz): an interval that holds for certain.
Candidates whose interval can't reach an anchor's k-th best score found so far, or lies outside the window of scores that
is asked for, are ruled out; the others are scored by their integer components. So the result is exact.

Anchors are packed into blocks, and every block of anchors meets every packed block of codes, a few blocks of codes a
task: no row for a pair, and no group by label. A task keeps the best of each anchor over its blocks of codes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knownat.llm.store import stored

#: Vectors of a block of codes, and of a block of anchors.
CODES, ANCHORS = 4096, 64
#: Codes of a vector, and bits of a rounded component of an anchor.
LAYERS, PLANES = 4, 6
#: Blocks of codes that one task takes, and blocks below which each is a task of its own.
CHUNK, SPREAD = 64, 32
#: Partial results of an anchor that are put together at once.
FAN = 64
#: Relative width added to intervals for the rounding of floating-point sums.
SLACK = 1e-9
_LONGEST = 2**63 - 1
_HUGE = np.finfo(np.float64).max
_BLOCK = "size int, rows binary, ids binary, labels binary, ints binary, bits binary, own binary, rest binary, length binary"
_ASKED = "size int, anchor_rows binary, anchor_ids binary, anchor_labels binary, vectors binary, planes binary, steps binary, given array<array<struct<id: bigint, score: bigint>>>"


class Codes(NamedTuple):
    """One-bit codes of a block of vectors."""

    bits: np.ndarray  # (layers, vectors, words): signs, 64 to a word
    own: np.ndarray  # (layers, vectors): alignment of what each code is taken from with its unit sign vector
    rest: np.ndarray  # length of the last residual
    length: np.ndarray  # length of the vector


class Rounded(NamedTuple):
    """Rotated anchors as integers times a step."""

    planes: np.ndarray  # (planes, anchors, words): bits of the integers, which are raised by half their range
    total: np.ndarray  # sum of the integers
    step: np.ndarray
    length: np.ndarray  # of the rounded anchor
    off: np.ndarray  # length of what rounding took away


@lru_cache(4)
def rotation(size: int, seed: int = 23) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _words(signs: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words, filled up with zeros."""
    packed = np.packbits(signs, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def encode(vectors: np.ndarray, layers: int = LAYERS) -> Codes:
    """Codes of the rows of a matrix."""
    size = vectors.shape[1]
    left = vectors @ rotation(size)
    length, bits, own = np.sqrt((vectors * vectors).sum(1)), [], []
    for _ in range(layers):
        signs = left > 0
        bits.append(_words(signs))
        own.append(np.abs(left).sum(1) / np.sqrt(size))
        left = left - np.where(signs, 1.0, -1.0) * (own[-1] / np.sqrt(size))[:, None]
    return Codes(np.array(bits), np.array(own), np.sqrt((left * left).sum(1)), length)


def rounded(anchors: np.ndarray, planes: int = PLANES) -> Rounded:
    """Rotated rows of a matrix as integers of so many bits."""
    turned = anchors @ rotation(anchors.shape[1])
    half = 1 << (planes - 1)
    step = np.abs(turned).max(1) / (half - 1)
    step[~(step > 0)] = 1.0
    whole = np.clip(np.rint(turned / step[:, None]), -half, half - 1)
    raised = (whole + half).astype(np.int64)
    bits = np.array([_words((raised >> j) & 1) for j in range(planes)])
    back = whole * step[:, None]
    off = np.sqrt(((turned - back) ** 2).sum(1))
    return Rounded(bits, whole.sum(1), step, np.sqrt((back * back).sum(1)), off)


def intervals(codes: Codes, asked: Rounded, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products (anchors x codes)."""
    planes = len(asked.planes)
    estimate = np.zeros((asked.planes.shape[1], codes.bits.shape[1]))
    for bits, own in zip(codes.bits, codes.own):
        count = np.zeros(estimate.shape, np.int32)
        ones = np.bitwise_count(bits).sum(1, dtype=np.int32)
        for j in range(planes):
            for w in range(bits.shape[1]):
                count += np.bitwise_count(asked.planes[j][:, None, w] & bits[None, :, w]).astype(np.int32) << j
        # signs are 2 b - 1, and integers are raised by half their range
        seen = (2 * (count - (ones << (planes - 1))[None]) - asked.total[:, None]) * (asked.step / np.sqrt(size))[:, None]
        estimate += seen * own[None]
    unseen = np.sqrt(np.maximum(asked.length[:, None] ** 2 - seen * seen, 0))  # of the last code, to which the last residual is orthogonal
    scale = asked.length + asked.off
    error = codes.rest[None] * unseen + codes.length[None] * (asked.off + SLACK * scale)[:, None]
    return estimate - error, estimate + error


def scores(anchor: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Inner products of whole components, exact. Beyond 64 bits they are held at the ends of the range."""
    if not others.size:
        return np.zeros(len(others), np.int64)
    most = float(np.abs(anchor).max()) * float(np.abs(others).max()) * len(anchor)
    if most < 2**53:
        return (others @ anchor).astype(np.int64)
    own = [int(x) for x in anchor]
    return np.array([max(-_LONGEST, min(_LONGEST, sum(int(x) * y for x, y in zip(row, own)))) for row in others], np.int64)


def window(score: int, least: int, most: int) -> tuple[int, int]:
    """Whole scores s with least * score <= 100 * s <= most * score."""
    return -(-least * score // 100), most * score // 100


def _usable(vectors: DataFrame, key: str, vector: str, label: str, asked: Column) -> DataFrame:
    """Rows that take part; a component that is not finite becomes null and takes its row out."""
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: F.when(F.abs(x) < F.lit(float("inf")), x))
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), v.alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    return rows.where("id is not null and label is not null and v is not null").where(F.forall("v", lambda x: x.isNotNull()))


def _packed(scale: float) -> Callable:
    """Rows packed into blocks of codes, by the size of their vectors. A row is numbered within its task."""

    def block(size: int, parts: list) -> pa.RecordBatch:
        rows, ids, labels, asked, ints = (np.concatenate(x) for x in zip(*parts))
        made = encode(ints)
        kept = ints.astype(np.int16) if np.abs(ints).max(initial=0) < 2**15 else ints
        values = [size, rows, ids, labels, kept, made.bits, made.own, made.rest, made.length, asked]
        arrays = [pa.array([size], pa.int32())] + [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in values[1:]]
        return pa.RecordBatch.from_arrays(arrays, ["size", "rows", "ids", "labels", "ints", "bits", "own", "rest", "length", "asked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seen = TaskContext.get().partitionId() << 32, 0
        waiting: dict[int, list] = {}
        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                ints = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                ints = np.floor(np.clip(ints * scale, -_HUGE, _HUGE))
                if not size:  # an empty vector is a zero of its own size
                    ints = np.zeros((part.num_rows, 1))
                rows = base + seen + np.arange(part.num_rows)
                seen += part.num_rows
                asked = part.column("asked").to_numpy(zero_copy_only=False).astype(bool)
                whole = [rows, part.column("id").to_numpy(), part.column("label").to_numpy(), asked, ints]
                if waiting.get(size):
                    whole = [np.concatenate(x) for x in zip(waiting[size], whole)]
                full = len(whole[0]) // CODES * CODES
                for at in range(0, full, CODES):
                    yield block(int(size), [[x[at : at + CODES] for x in whole]])
                waiting[size] = [x[full:] for x in whole]
        for size, whole in waiting.items():
            if len(whole[0]):
                yield block(int(size), [whole])

    return run


def _ints(size: int, data: bytes, rows: int) -> np.ndarray:
    kind = np.int16 if len(data) == 2 * rows * max(size, 1) else np.float64
    return np.frombuffer(data, kind).reshape(rows, -1).astype(np.float64)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that were asked for, out of the blocks of codes."""
    for batch in batches:
        for row in batch.to_pylist():
            asked = np.frombuffer(row["asked"], bool)
            at = np.flatnonzero(asked)
            rows, ids, labels = (np.frombuffer(row[c], np.int64)[at] for c in ("rows", "ids", "labels"))
            vectors = _ints(row["size"], row["ints"], len(asked))[at]
            arrays = [pa.array(np.full(len(at), row["size"], np.int32)), pa.array(rows), pa.array(ids), pa.array(labels), pa.array([x.tobytes() for x in vectors], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["size", "anchor_row", "anchor_id", "label", "vector"])


def _asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors packed into blocks with their rounded vectors."""
    kind = pa.list_(pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64())])))
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes):
            own = batch.filter(pa.array(sizes == size))
            for at in range(0, own.num_rows, ANCHORS):
                part = own.slice(at, ANCHORS)
                vectors = np.array([np.frombuffer(x) for x in part.column("vector").to_pylist()])
                made = rounded(vectors)
                steps = np.array([made.total, made.step, made.length, made.off])
                data = [*(part.column(c).to_numpy() for c in ("anchor_row", "anchor_id", "label")), vectors, made.planes, steps]
                arrays = [pa.array([size], pa.int32())] + [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in data]
                names = ["size", "anchor_rows", "anchor_ids", "anchor_labels", "vectors", "planes", "steps", "given"]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([part.column("given").to_pylist()], kind)], names)


class Best:
    """The k best (score, id, row) of one window of scores found so far."""

    def __init__(self, k: int, low: int = -_LONGEST, high: int = _LONGEST) -> None:
        self.k, self.low, self.high = k, low, high
        self.found = (np.zeros(0, np.int64),) * 3

    @property
    def least(self) -> int:
        return max(self.low, int(self.found[0][-1])) if len(self.found[0]) == self.k else self.low

    def add(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        inside = (score >= self.least) & (score <= self.high)
        if inside.any():
            score, ids, rows = (np.concatenate([a, b[inside]]) for a, b in zip(self.found, (score, ids, rows)))
            order = np.lexsort((rows, ids, -score))[: self.k]
            self.found = score[order], ids[order], rows[order]


def _search(k: int, windows: Callable[[list], list[Best]], same: bool) -> Callable:
    """Best rows of each anchor and window over the blocks that a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, best = None, []

        def finish() -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], [], []]
            for n, (row, anchor, _) in enumerate(current[1]):
                for which, one in enumerate(best[n]):
                    for values, x in zip(out, (np.full(len(one.found[0]), row), np.full(len(one.found[0]), anchor), np.full(len(one.found[0]), which), *one.found)):
                        values.append(x)
            columns = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out]
            columns[2] = columns[2].astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor_row", "anchor_id", "which", "score", "id", "row"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                size, rows, ids, labels = row["size"], *(np.frombuffer(row[c], np.int64) for c in ("rows", "ids", "labels"))
                if current is None or current[0] != row["asking"]:
                    if current:
                        yield finish()
                    keys = [np.frombuffer(row[c], np.int64).tolist() for c in ("anchor_rows", "anchor_ids", "anchor_labels")]
                    vectors = np.frombuffer(row["vectors"]).reshape(len(keys[0]), -1)
                    total, step, length, off = np.frombuffer(row["steps"]).reshape(4, -1)
                    planes = np.frombuffer(row["planes"], np.uint64).reshape(PLANES, len(keys[0]), -1)
                    asked = Rounded(planes, total.astype(np.int64), step, length, off)
                    current, best = (row["asking"], list(zip(*keys))), [windows(x) for x in row["given"]]
                ints = _ints(size, row["ints"], len(rows))
                bits = np.frombuffer(row["bits"], np.uint64).reshape(LAYERS, len(rows), -1)
                codes = Codes(bits, np.frombuffer(row["own"]).reshape(LAYERS, -1), np.frombuffer(row["rest"]), np.frombuffer(row["length"]))
                low, high = intervals(codes, asked, max(size, 1))
                for n, (own_row, _, label) in enumerate(current[1]):
                    usable = (labels == label) & (rows != own_row) if same else labels != label
                    near = np.flatnonzero(usable)
                    if same and len(near) > k and len(best[n][0].found[0]) < k:  # a first bound from the best estimates
                        first = near[np.argpartition(high[n][near], -k)[-k:]]
                        best[n][0].add(scores(vectors[n], ints[first]), ids[first], rows[first])
                        near = np.setdiff1d(near, first, assume_unique=True)
                    keep = np.zeros(len(near), bool)
                    for one in best[n]:  # a bound that is not a number rules nothing out
                        keep |= ~(high[n][near] < one.least) & ~(low[n][near] > one.high)
                    near = near[keep]
                    if len(near):
                        exact = scores(vectors[n], ints[near])
                        for one in best[n]:
                            one.add(exact, ids[near], rows[near])
        if current:
            yield finish()

    return run


def _met(blocks: DataFrame, asking: DataFrame, parts: int, windows: Callable, k: int, same: bool) -> DataFrame:
    """Rows (anchor_row, anchor_id, which, best): the k best of each anchor and window over all blocks."""
    groups = min(parts, max(SPREAD, -(-parts // CHUNK)))
    codes = blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).drop("asked")
    spread = asking.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = spread.join(codes, ["size", "group"]).drop("group", "block")
    found = met.mapInArrow(_search(k, windows, same), "anchor_row bigint, anchor_id bigint, which int, score bigint, id bigint, row bigint")
    order = F.struct((-F.col("score")).alias("s"), "id", "row")
    best = found.select("anchor_row", "anchor_id", "which", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("part"), F.array(order).alias("best"))
    best = best.groupBy("anchor_row", "anchor_id", "which", "part").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    while groups > 1:
        groups = -(-groups // FAN)
        best = best.groupBy("anchor_row", "anchor_id", "which", F.pmod("part", F.lit(groups)).alias("part")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return best.drop("part")


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100,
    scale: float = 256.0, key: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that `anchors` flags.

    The components of `vector`, times `scale`, are rounded down to whole numbers; scores are their inner products. The positives of an
    anchor are the best other rows of its label; the negatives of each positive are the best rows of other labels with
    least * positive_score <= 100 * score <= most * positive_score (none below a negative score). Best: larger score, then smaller key.
    Rows with a null key, label or vector, or with a null or non-finite component, take no part. Vectors meet those of
    their own size; empty ones score 0. A repeated row is a row of its own, as an anchor, a positive and a negative. Scores
    beyond 64 bits are held at the ends of the range. An anchor without a positive, and a positive without
    a negative, has no row. Keys and labels must be whole numbers; other columns are not read. An empty table gives none.
    """
    rows = _usable(vectors, key, vector, label, anchors)
    tasks = max(1, -(-vectors.count() // CODES))
    packed = rows.coalesce(tasks).mapInArrow(_packed(scale), _BLOCK + ", asked binary")
    blocks = stored(packed.withColumn("block", F.monotonically_increasing_id()), "codes")
    parts = max(blocks.count(), 1)
    asked = stored(blocks.mapInArrow(_anchors, "size int, anchor_row bigint, anchor_id bigint, label bigint, vector binary"), "anchors")

    def asking(given: DataFrame) -> DataFrame:
        return stored(given.coalesce(max(1, parts // 8)).mapInArrow(_asking, _ASKED).withColumn("asking", F.monotonically_increasing_id()), "asking")

    none = F.expr("cast(array() as array<struct<id: bigint, score: bigint>>)").alias("given")
    first = _met(blocks, asking(asked.select("*", none)), parts, lambda given: [Best(positives)], positives, True)
    given = first.select("anchor_row", F.transform("best", lambda b: F.struct(b["id"].alias("id"), (-b["s"]).alias("score"))).alias("given"))
    given = stored(given, "positives")
    second = asking(asked.join(given, "anchor_row").select(*asked.columns, "given"))
    found = _met(blocks, second, parts, lambda given: [Best(negatives, *window(p["score"], least, most)) for p in given], negatives, False)
    out = found.join(given, "anchor_row").withColumn("positive", F.col("given")[F.col("which")])
    out = out.select("anchor_id", "positive", F.posexplode("best").alias("at", "b"))
    return out.select(
        "anchor_id", F.col("positive.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"), (-F.col("b.s")).alias("negative_score"),
    )
