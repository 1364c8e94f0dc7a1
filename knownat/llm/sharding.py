"""Jump consistent hashing: stable keys to shards, without a ring table."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the multiplier of the 64-bit linear congruential generator of jump consistent hashing.
MULTIPLIER = Decimal(2862933555777941757)
_TWO_64 = Decimal(2**64)
#: Jumps of one key grow with the logarithm of the shard count (about 22 for 2^31), so this many always suffice.
MOST_JUMPS = 128


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 .. shards-1 of an integer key. With one shard more, a key stays or moves to the new shard.

    The generator works modulo 2^64 in exact decimals, as ANSI longs must not overflow. A null key counts as 0.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    wide = F.coalesce(key.cast("bigint"), F.lit(0)).cast("decimal(20,0)")
    unsigned = F.when(wide < 0, wide + F.lit(_TWO_64)).otherwise(wide).cast("decimal(20,0)")
    start = F.struct(unsigned.alias("k"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def jump(state: Column, _: Column) -> Column:
        k = ((F.lit(MULTIPLIER) * state["k"] + F.lit(1)) % F.lit(_TWO_64)).cast("decimal(20,0)")
        top = F.floor(k / F.lit(2**33)).cast("bigint") + 1
        j = F.floor((state["j"] + 1) * (F.lit(float(2**31)) / top.cast("double"))).cast("bigint")
        moved = F.struct(k.alias("k"), state["j"].alias("b"), j.alias("j"))
        return F.when(state["j"] < shards, moved).otherwise(state)

    steps = F.sequence(F.lit(1), F.lit(min(shards, MOST_JUMPS)))
    return F.aggregate(steps, start, jump, lambda s: s["b"]).cast("int")


def slots(df: DataFrame, shard: str, key: str, ties: list[str], slot: str = "slot", ranges: int = 1024) -> DataFrame:
    """Add a gapless position from 0 inside each shard.

    A shard is cut into `ranges` parts by the hash of the key; each part is numbered alone and starts where the parts
    before it end, so no task holds a whole shard. The table of starts has shards x ranges rows at most and is broadcast.
    Equal keys are ordered by `ties`; rows equal in all of them may swap places.
    """
    if {"_part", "_start", "_shard"} & set(df.columns):
        raise ValueError("columns named _part, _start or _shard are in the way")
    parted = df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(ranges)).cast("int"))
    counts = parted.groupBy(F.col(shard).alias("_shard"), "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_shard", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, "_part").orderBy(key, *ties)
    numbered = parted.withColumn("_row", F.row_number().over(inside) - 1)
    joined = numbered.alias("r").join(F.broadcast(starts.alias("s")), (F.col(f"r.{shard}") == F.col("s._shard")) & (F.col("r._part") == F.col("s._part")))
    return joined.select(*[F.col(f"r.`{c}`") for c in df.columns], (F.col("s._start") + F.col("r._row")).alias(slot))


def shard_documents(docs: DataFrame, shards: int = 8, ranges: int = 1024) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot and grown_shard (with one shard more).

    A null text counts as empty (size 1, crc 0), a null doc_id as key 0. Repeated rows each keep a slot of their own.
    An empty table gives no rows; other columns are not read.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select(
        "doc_id",
        (F.octet_length(data) + 1).cast("bigint").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(F.col("doc_id"), shards).alias("shard"),
        jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    return slots(sized, "shard", "doc_id", ["text_crc32", "size"], ranges=ranges).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
