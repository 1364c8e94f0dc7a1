"""Near duplicates by order MinHash, verified by banded alignment.

A text's word shingles are labelled with their occurrence (first, second ...). Each of SKETCHES hash functions picks the
ROWS least labelled shingles and hashes them in the order they have in the text, so a match needs the same shingles in
the same order: texts meet in a bucket with a probability that follows their edit similarity. A text that repeats shingles
is sketched once more by its distinct ones, which are what is verified. Texts of few distinct shingles, whose sketches rarely
agree, also have a bucket for each of their rarest ones, so that any two of them that are alike enough meet. Texts of a bucket are
compared with its most central text (the one that meets most others over all buckets), not with each other. A bucket
whose texts then still lie in several classes gets PIVOTS more central texts. All texts of buckets that are divided even
then are joined by their rarest shingles: with all shingles in one order, rarest first, two texts that are alike enough
share one of the first size - ceil(least * size) + 1 of each (`rare_pairs`). So each pair of a bucket that can be a link is
tested unless its texts are in one class already, however large the bucket is, and a passage that many texts share, which is
never rare, makes no pairs.

Candidates are verified by aligning their distinct shingles in text order within a band: a pair is linked if the
shingles on the best alignment are at least `least` of all shingles of both. For copies whose edits leave the order this is the
Jaccard similarity of the shingles.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knownat.llm import words
from knownat.llm.components import components
from knownat.llm.store import stored

SHINGLE = 5
SIMILARITY = 0.8
#: 20 sketches of 5 shingles: long texts of similarity 0.8 meet in a bucket with 0.9996, of 0.9 with 1 - 1e-8; of 0.3 with 0.05.
SKETCHES, ROWS = 20, 5
#: A text of up to so many distinct shingles meets every text that is alike enough. The least chance beyond is 0.9986.
SHORT = 13
#: Pivots of a bucket in the second round: the most central of as many classes by hash.
PIVOTS = 8
#: Bytes that hashes and numbers of candidates may take as a broadcast table, and bytes of one.
BROADCAST_BYTES, NEEDED_BYTES = 64 << 20, 128
#: Shingles hashed by all functions at once; longer texts take one function after the other.
AT_ONCE = 50_000


def shingles(found: words.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words, in order, and where each text starts. Fewer words make one shingle."""
    hashed = words.hashes(found)
    counts = np.diff(found.word_offsets)
    sizes = np.where(counts == 0, 0, np.maximum(counts - k + 1, 1))
    first = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - found.word_offsets[:-1], sizes)
    end = np.repeat(found.word_offsets[1:], sizes)
    out = np.full(len(at), 0x51ED270B, np.uint64)
    padded = np.append(hashed, np.uint64(0))
    with np.errstate(over="ignore"):
        for step in range(k):
            inside = at + step < end
            value = np.where(inside, padded[np.minimum(at + step, len(hashed))], np.uint64(1))
            out = words.mix(out * np.uint64(0x9E3779B97F4A7C15) + value)
    return out, first


def labelled(values: np.ndarray) -> np.ndarray:
    """Hashes that also tell the first occurrence of a shingle from the second, and so on."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    starts = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    begin = np.maximum.accumulate(np.where(starts, np.arange(len(values)), 0))
    occurrence = np.empty(len(values), np.uint64)
    occurrence[order] = np.arange(len(values)) - begin
    with np.errstate(over="ignore"):
        return words.mix(values + occurrence * np.uint64(0xA0761D6478BD642F))


def sketch(values: np.ndarray, sketches: int = SKETCHES, rows: int = ROWS) -> np.ndarray:
    """The hash of the least labelled shingles in text order, for each function."""
    random = np.random.default_rng(11)
    factors, shifts = random.integers(1, 2**63, sketches, np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 2**63, sketches, np.uint64)
    own, out = labelled(values), np.full(sketches, 0x3C6EF372, np.uint64)
    take = min(rows, len(own))
    with np.errstate(over="ignore"):
        for functions in [np.arange(sketches)] if len(own) <= AT_ONCE else np.arange(sketches)[:, None]:
            ranks = own * factors[functions, None] + shifts[functions, None]
            least = np.argpartition(ranks, take - 1, 1)[:, :take] if take < len(own) else np.broadcast_to(np.arange(len(own)), ranks.shape)
            least = np.sort(least, 1)  # text order
            for column in range(take):
                out[functions] = words.mix(out[functions] * np.uint64(0x9E3779B97F4A7C15) + own[least[:, column]])
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """First occurrences, in text order."""
    _, first = np.unique(values, return_index=True)
    return values[np.sort(first)]


def prefix(size: Column, least: float) -> Column:
    """So many of a text's distinct shingles, in one order of all shingles, hold one of any text that is alike enough."""
    return size - F.ceil(size * least - 1e-6) + 1


def aligned(left: np.ndarray, right: np.ndarray, least: float = SIMILARITY) -> float:
    """Shingles on the best alignment of two sequences of distinct shingles, as a share of all shingles of both.

    At a similarity of `least`, insertions and deletions are at most (1 - least) / (1 + least) of both lengths, so an
    alignment that is good enough stays within a band of that width; matches outside it are not looked at.
    """
    if not len(left) or not len(right):
        return 0.0
    total = len(left) + len(right)
    band = int((1 - least) / (1 + least) * total) + 1
    if abs(len(left) - len(right)) > band:
        return 0.0
    _, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    inside = np.abs(i - j) <= band
    i, j = i[inside], j[inside]
    chain = j[np.argsort(i)]
    length = len(chain)
    if length and (np.diff(chain) < 0).any():  # longest increasing chain of matches
        tails: list[int] = []
        for x in chain.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        length = len(tails)
    return length / (total - length)


def parities(values: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of the distinct values end in i; twice as many bits as values, a power of two."""
    bits = 1 << max(6, (2 * len(values) - 1).bit_length())
    return np.packbits(np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def possible(left: bytes, right: bytes, total: int, least: float = SIMILARITY) -> bool:
    """Whether sets with these parities, of `total` values in all, can be alike enough: each value that only one of
    them holds turns one bit over, so there are at least as many such values as bits that differ."""
    x, y = int.from_bytes(left, "little"), int.from_bytes(right, "little")
    small, large = sorted((8 * len(left), 8 * len(right)))
    x, y = (y, x) if len(left) > len(right) else (x, y)
    while large > small:
        large //= 2
        y = (y >> large) ^ (y & ((1 << large) - 1))
    return (x ^ y).bit_count() <= (1 - least) / (1 + least) * total + 1e-6


def _possible(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bits_a", "bits_b", "size_a", "size_b")]
            good = [possible(x, y, n + m, least) for x, y, n, m in zip(*columns)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch, "text"):
            values, first = shingles(words.split(part.column("text")))
            sets = [np.unique(values[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:])]
            bits = pa.array([parities(x.view(np.uint64)) for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(sets, pa.list_(pa.int64())), bits], ["id", "label", "values", "bits"])


def rare_pairs(texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of texts (id, label, text) with different labels that may share `least` of their distinct shingles.

    Of two such texts the first common shingle, rarest first, has a place in both that leaves enough shingles behind it.
    Pairs that the parities of their shingles rule out (`possible`) are left out before texts are read.
    """
    sets = texts.mapInArrow(_shingled, "id bigint, label bigint, values array<bigint>, bits binary").where("size(values) > 0")
    sets = stored(sets.select("id", "label", F.size("values").alias("size"), "values", "bits"), "shingles")
    every = sets.select("id", F.explode("values").alias("value"))
    # a shingle of one text only takes a place, and needs no number: it is named by that text alone
    spread = every.groupBy("value").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    common = every.join(spread, "value")
    rarest = Window.partitionBy("id").orderBy("texts", "value")  # one text's distinct shingles that others have as well
    of = sets.select("id", "label", "size")
    ranked = common.withColumn("rank", F.row_number().over(rarest)).withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("id")))
    placed = ranked.join(of, "id").withColumn("place", F.col("size") - F.col("shared") + F.col("rank"))
    placed = stored(placed.where(F.col("place") <= prefix(F.col("size"), least)).select("id", "label", "size", "value", "place"), "rarest")
    other = placed.select("value", *[F.col(c).alias(f"{c}_b") for c in ("id", "label", "size", "place")])
    alike = F.least("size", "size_b") >= least * F.greatest("size", "size_b") - 1e-6
    behind = 1 + F.least(F.col("size") - F.col("place"), F.col("size_b") - F.col("place_b"))
    enough = behind >= least / (1 + least) * (F.col("size") + F.col("size_b")) - 1e-6
    pairs = placed.join(other, "value").where((F.col("id") < F.col("id_b")) & (F.col("label") != F.col("label_b")) & alike & enough)
    pairs = pairs.select(F.col("id").alias("a"), F.col("id_b").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("size").alias(f"size_{side}"), F.col("bits").alias(f"bits_{side}")), side)
    return pairs.mapInArrow(_possible(least), "a bigint, b bigint")


def _signed(few: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                values, first = shingles(words.split(part.column("text")))
                size, bands, made, all_of_few = [], [], [], []
                for a, b in zip(first[:-1], first[1:]):
                    own = distinct(values[a:b])
                    size.append(len(own))
                    bands.append(np.arange(SKETCHES if b > a else 0, dtype=np.int32))
                    made.append(sketch(values[a:b]).view(np.int64) if b > a else np.zeros(0, np.int64))
                    if len(own) < b - a:
                        once = sketch(own).view(np.int64)
                        new = np.flatnonzero(once != made[-1])
                        bands[-1], made[-1] = np.append(bands[-1], new.astype(np.int32)), np.append(made[-1], once[new])
                    all_of_few.append(own.view(np.int64) if len(own) <= few else np.zeros(0, np.int64))
                arrays = [pa.array(size, pa.int32()), pa.array(bands, pa.list_(pa.int32())), *[pa.array(x, pa.list_(pa.int64())) for x in (made, all_of_few)]]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("print"), *arrays], ["id", "print", "size", "bands", "sketches", "few"])

    return run


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text_a", 1 << 19):
                sides = []
                for side in ("text_a", "text_b"):
                    values, first = shingles(words.split(part.column(side)))
                    sides.append([values[a:b] for a, b in zip(first[:-1], first[1:])])
                good = [aligned(distinct(x), distinct(y), least) >= least for x, y in zip(*sides)]
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _links(texts: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are alike enough."""
    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    joined = joined.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(_verified(least), "a bigint, b bigint")


def near_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """Rows (doc_id, class_id, copies): the least key of a row's class, and how many rows have the very same text.

    Classes hold equal texts and texts linked through pairs of `least` similarity. Keys must be whole numbers; rows of one
    key and text count once each, and a key with several texts has a row for each, classed by that text alone. A null text is
    alike to nothing and in a class of its own, as is a null key. A text without words is alike only to the very same text.
    Other columns are not read. An empty table gives none.
    """
    keyed = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    usable = keyed.where(F.col("text").isNotNull() & F.col("id").isNotNull())
    printed = usable.withColumn("print", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    prints = printed.select("id", "print")
    # a text is a node of its own, whatever keys it has
    kinds = prints.groupBy("print").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id())
    kinds = stored(kinds, "kinds")
    signed = printed.mapInArrow(_signed(int(SHORT / least + 1e-6)), "id bigint, print binary, size int, bands array<int>, sketches array<bigint>, few array<bigint>").where("size > 0")
    first = signed.join(kinds.select("print", "low", "node"), "print").where("id = low")
    signed = stored(first.select(F.col("node").alias("id"), "size", "bands", "sketches", "few"), "sketches")
    buckets = signed.select("id", "size", F.inline(F.arrays_zip("bands", "sketches")).alias("band", "value"))
    few = signed.select("id", "size", F.explode("few").alias("value"))
    rarest = Window.partitionBy("id").orderBy("texts", "value")  # of at most SHORT / least rows
    few = few.join(few.groupBy("value").agg(F.count(F.lit(1)).alias("texts")), "value").withColumn("place", F.row_number().over(rarest))
    few = few.where(F.col("place") <= prefix(F.col("size"), least)).select("id", "size", F.lit(-1).alias("band"), "value")
    buckets = stored(buckets.unionByName(few), "buckets")
    shared = buckets.groupBy("band", "value").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = buckets.join(shared, ["band", "value"])
    central = members.groupBy("id").agg(F.sum("members").alias("centre"))
    members = stored(members.join(central, "id").withColumn("label", F.col("id")), "members")
    needed = members.select("id").distinct().join(kinds.select(F.col("node").alias("id"), "print", "low"), "id")
    needed = stored(needed.withColumnRenamed("low", "key"), "candidate-texts")
    if needed.count() * NEEDED_BYTES <= BROADCAST_BYTES:  # beyond, texts are dealt out by their hash
        needed = F.broadcast(needed)
    # repeated rows go by the columns of the join, which texts are dealt out by already
    candidates = printed.withColumnRenamed("id", "key").join(needed, ["print", "key"]).dropDuplicates(["print", "key"])
    texts = stored(candidates.select("id", "text"), "candidates")
    edges = None
    for pool in (1, PIVOTS):
        classed = F.pmod(F.xxhash64("id", F.lit(pool)), F.lit(pool)).alias("pick")
        rank = F.struct("centre", F.xxhash64("id").alias("tie"), "id", "size", "label")
        pivots = members.groupBy("band", "value", classed).agg(F.max(rank).alias("p"))
        pivots = pivots.select("band", "value", F.col("p.id").alias("b"), F.col("p.size").alias("size_b"), F.col("p.label").alias("label_b"))
        pairs = members.join(pivots, ["band", "value"]).where(F.col("label") != F.col("label_b"))
        pairs = pairs.where(F.least("size", "size_b") >= least * F.greatest("size", "size_b"))
        found = stored(_links(texts, pairs.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct(), least).distinct(), "links")
        edges = found if edges is None else edges.unionByName(found)
        classes = components(edges)
        # buckets that still lie in several classes go on
        relabelled = members.drop("label").join(classes, members.id == classes.node, "left").withColumn("label", F.coalesce("label", "id")).drop("node")
        divided = relabelled.groupBy("band", "value").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        members = stored(relabelled.join(divided.select("band", "value"), ["band", "value"], "left_semi"), "members")
    left = texts.join(members.select("id", "label").distinct(), "id")
    edges = edges.unionByName(stored(_links(texts, rare_pairs(left, least), least), "links"))
    classes = components(edges)
    joined = kinds.join(classes, kinds.node == classes.node, "left").select("print", "copies", "low", F.coalesce(classes.label, kinds.node).alias("class"))
    grouped = stored(joined, "classes")
    least_key = grouped.groupBy("class").agg(F.min("low").alias("class_id"))
    grouped = grouped.join(least_key, "class").select("print", "class_id", "copies")
    placed = prints.join(grouped, "print").select(F.col("id").alias(key), "class_id", "copies")
    alone = keyed.where(F.col("text").isNull() | F.col("id").isNull()).select(F.col("id").alias(key), F.col("id").alias("class_id"), F.lit(1).cast("bigint").alias("copies"))
    return placed.unionByName(alone)
